"""Exact Jaccard links between documents' word n-gram sets, by a blocked sparse product."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import U64, Union, arrow_pass, bit_filter, bounded, components, discard, in_filter, mix, release, staged, word_hashes

#: n-grams (eight bytes each) that a cluster compared whole or one block of a large cluster holds, about.
BLOCK_GRAMS = 1_000_000
#: Sets that such a cluster or block holds, about.
BLOCK_DOCS = 1024
#: Columns of the incidence matrix that are multiplied at once.
BLOCK_COLUMNS = 4096
#: Sets from which on a counted n-gram is looked up last.
MANY = 8


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; of the whole sequence if it has fewer words; empty without words.

    Words are runs of characters other than space and U+0009 to U+000D; A to Z are lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U64)
    h = word_hashes(words)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, U64(k))
    for i in range(k):
        out = mix(out + h[i : len(h) - k + 1 + i])
    return np.unique(out)




def prefix_length(size: int, percent: int) -> int:
    """First n-grams of a set, in any order that all sets share, of which a linked set holds at least one among its own."""
    return size - -(-size * percent // 100) + 1


def sampled(grams: np.ndarray, percent: int) -> np.ndarray:
    """Which n-grams are counted: by hash, about four times as many as a prefix takes, half of them at most."""
    return (grams >> U64(40)) % U64(1000) < U64(min(500, 40 * (100 - percent) + 10))


def prefix(grams: np.ndarray, some: np.ndarray, many: np.ndarray, percent: int) -> np.ndarray:
    """The rarest n-grams of a set: first those that were counted and are in no other set, then in some, those not counted, those in many; each by hash."""
    n = prefix_length(len(grams), percent)
    if n >= len(grams):
        return grams
    level = np.where(sampled(grams, percent), in_filter(some, grams) + 2 * in_filter(many, grams).astype(np.int64), 2).astype(U64)
    return grams[np.argpartition((level << U64(62)) | (grams >> U64(2)), n - 1)[:n]]


def _profiles(n: int, percent: int):
    """A row for each document, and one for each few documents that holds their counted n-grams, those of several sets twice.

    32 bits of an n-gram are enough to count it: chance meetings cost time, not results.
    """

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                rows = batch.slice(part, 2000)
                sizes, firsts, seconds, counted = [], [], [], {}
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    grams = gram_set(text, n)
                    digest = xxhash.xxh128_digest(grams.tobytes())
                    if doc is not None and digest not in counted:
                        counted[digest] = grams[sampled(grams, percent)].astype(np.uint32)
                    sizes.append(len(grams))
                    firsts.append(int.from_bytes(digest[:8], "little", signed=True) if len(grams) else None)
                    seconds.append(int.from_bytes(digest[8:], "little", signed=True) if len(grams) else None)
                codes, times = np.unique(np.concatenate([*counted.values(), np.empty(0, np.uint32)]), return_counts=True)
                doc = pa.concat_arrays([rows.column("doc_id"), pa.nulls(1, pa.int64())])
                blob = np.concatenate([codes, codes[times > 1]]).tobytes()
                yield pa.RecordBatch.from_arrays([doc, pa.array([*sizes, None], pa.int64()), pa.array([*firsts, None], pa.int64()), pa.array([*seconds, None], pa.int64()), pa.array([None] * len(sizes) + [blob], pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "counted"])

    return run


def _counted(batches):
    for batch in batches:
        for raw in batch.column("counted").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int32))], names=["key"])


def _posts(n: int, percent: int, broadcast):
    def run(batches):
        (some, many), seen = broadcast.value, set()
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                sets, keys = [], []
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    grams = gram_set(text, n) if doc is not None else np.empty(0, U64)
                    digest = xxhash.xxh128_digest(grams.tobytes())
                    if len(grams) and digest not in seen:  # of the equal sets of one task, one is enough
                        seen.add(digest)
                        keys.append(prefix(grams, some, many, percent))
                        sets.append(np.full(len(keys[-1]), int.from_bytes(digest[:8], "little", signed=True), np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sets))], names=["key", "set_a"])

    return run


def _gram_bytes(n: int):
    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = batch.slice(part, 1000)
                sets = [gram_set(t, n).tobytes() for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(sets, pa.binary())], names=["node", "grams"])

    return run


def overlap_counts(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Shared elements of each row set with each column set: the product of two incidence matrices, by blocks of columns."""
    flat = [np.concatenate(x) if x else np.empty(0, U64) for x in (rows, cols)]
    universe = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(rows), len(cols)), np.float32)
    if not len(universe):
        return out
    where = []
    for values, sets in zip(flat, (rows, cols), strict=True):
        at = np.searchsorted(universe, values)
        at[at == len(universe)] = 0
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        hit = universe[at] == values
        order = np.argsort(at[hit], kind="stable")
        where.append((at[hit][order], owner[hit][order]))
    for begin in range(0, len(universe), BLOCK_COLUMNS):
        dense = []
        for (at, owner), sets in zip(where, (rows, cols), strict=True):
            lo, hi = np.searchsorted(at, (begin, begin + BLOCK_COLUMNS))
            m = np.zeros((len(sets), min(BLOCK_COLUMNS, len(universe) - begin)), np.float32)
            m[owner[lo:hi], at[lo:hi] - begin] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def linked(rows: list[np.ndarray], cols: list[np.ndarray], percent: int) -> np.ndarray:
    """Which row and column sets link: 100 * intersection >= percent * union. Counts below the sizes' bound are discarded."""
    a, b = np.array([len(x) for x in rows], np.int64)[:, None], np.array([len(x) for x in cols], np.int64)[None, :]
    both = np.rint(overlap_counts(rows, cols)).astype(np.int64)
    return (100 * both >= percent * (a + b - both)) & (both > 0)


def _verify(percent: int):
    """Spanning forests of the links of block pairs: rows of side 0 with each other, or with those of side 1 if there are any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, group in pdf.groupby(["home", "i", "j"], sort=False):
            ids, side = group["node"].tolist(), group["side"].to_numpy()
            sets = [np.frombuffer(x, U64) for x in group["grams"]]
            union, left, right = Union(len(ids)), np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1).tolist()
            right = right or left
            if left and len(ids) > 1:
                for x, y in zip(*np.nonzero(linked([sets[k] for k in left], [sets[k] for k in right], percent)), strict=True):
                    union.join(left[x], right[y])
            for k in range(len(ids)):
                if (root := union.find(k)) != k:
                    out_a.append(ids[k])
                    out_b.append(ids[root])
        release()
        return pd.DataFrame({"a": np.array(out_a, "int64"), "b": np.array(out_b, "int64")})

    return run


def _links(base: DataFrame, tasks: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """Spanning forests (a, b) of the links in tasks (home, i, j, side, node, whole); those of whole homes share bundles."""
    tasks = staged(tasks, f"{name}-tasks")
    nodes = staged(tasks.select("node").distinct(), f"{name}-nodes")
    found = nodes.count()
    if not found:
        return tasks.select(F.col("node").alias("a"), F.col("node").alias("b"))
    sets = arrow_pass(base.join(bounded(nodes, found), F.col("doc_id") == F.col("node")).select("node", "text"), _gram_bytes(n), "node long, grams binary")
    bundle = F.when(F.col("whole"), F.pmod(F.xxhash64("home"), F.lit(max(1, found // 1000)))).otherwise(F.xxhash64("home", "i", "j"))
    rows = sets.join(tasks, "node").select("home", "i", "j", "side", "node", "whole", "grams")
    links = rows.groupBy(bundle.alias("bundle"), "whole").applyInPandas(_verify(percent), "a long, b long")
    return staged(links, f"{name}-links")


def _size_class(percent: int) -> Column:
    """Sets that may link are of one class or of neighbouring ones."""
    return F.floor(F.log(F.col("size") + 0.5) / math.log(100 / percent)).cast("long")


def _within(members: DataFrame, percent: int) -> DataFrame:
    """Tasks that compare the members (node, size, cluster) of each cluster with each other, large clusters in pairs of blocks."""
    per = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("grams")).where("docs > 1")
    whole = (F.col("docs") <= BLOCK_DOCS) & (F.col("grams") <= BLOCK_GRAMS)
    members = members.join(per.select("cluster", whole.alias("whole")), "cluster")
    small = members.where("whole").select(F.col("cluster").alias("home"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "node", "whole")
    large = members.where("not whole").withColumn("class", _size_class(percent))
    parts = large.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("grams"))
    parts = parts.select("cluster", "class", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("grams") / BLOCK_GRAMS)).alias("parts"))
    large = large.join(parts, ["cluster", "class"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")) + F.col("class") * 1_000_000)
    blocks = parts.select("cluster", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p")).select("cluster", "class", (F.col("p") + F.col("class") * 1_000_000).alias("block"))
    a, b = blocks.select("cluster", F.col("class").alias("ca"), F.col("block").alias("i")), blocks.select("cluster", F.col("class").alias("cb"), F.col("block").alias("j"))
    # the sizes bound the pairs: only blocks of one class or of neighbouring ones are multiplied
    pairs = staged(a.join(b, "cluster").where("i <= j and cb - ca <= 1").select(F.col("cluster").alias("home"), "i", "j"), "ngram-blocks")
    at = large.select(F.col("cluster").alias("home"), "block", "node", "whole")
    first = at.join(pairs.withColumn("block", F.col("i")), ["home", "block"]).select("home", "i", "j", F.lit(0).alias("side"), "node", "whole")
    second = at.join(pairs.where("i < j").withColumn("block", F.col("j")), ["home", "block"]).select("home", "i", "j", F.lit(1).alias("side"), "node", "whole")
    return small.unionByName(first).unionByName(second)


def _across(posts: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Tasks that compare sets of different clusters that share an n-gram and are not connected yet.

    posts: key, node, size, cluster; found: node, component. A set goes to the lower clusters of its open keys that hold sets of sizes that may link.
    """
    posts = posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = posts.groupBy("key").agg(F.min("cluster").alias("c0"), F.max("cluster").alias("c1"), F.min("component").alias("k0"), F.max("component").alias("k1"))
    open_ = posts.join(spread.where("c0 < c1 and k0 < k1").select("key"), "key", "left_semi")
    open_ = staged(open_.select("key", "node", "size", "cluster"), "ngram-open")
    homes = open_.groupBy("key", F.col("cluster").alias("home")).agg(F.min("size").alias("least"), F.max("size").alias("most"))
    near = (100 * F.col("size") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("size"))
    guests = staged(open_.join(homes, "key").where("home < cluster").where(near).select("home", "node").distinct(), "ngram-guests")
    own = open_.select(F.col("cluster").alias("home"), "node").distinct().join(guests.select("home").distinct(), "home", "left_semi")
    n_own, n_guest = own.groupBy("home").agg(F.count(F.lit(1)).alias("n_own")), guests.groupBy("home").agg(F.count(F.lit(1)).alias("n_guest"))
    counts = n_own.join(n_guest, "home").select("home", F.ceil(F.col("n_own") / BLOCK_DOCS).alias("rows"), F.ceil(F.col("n_guest") / BLOCK_DOCS).alias("cols"))
    counts = counts.withColumn("whole", F.col("rows") + F.col("cols") == 2)
    own = own.join(counts, "home").withColumns({"i": F.pmod(F.xxhash64("node"), "rows"), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)), "side": F.lit(0)})
    guests = guests.join(counts, "home").withColumns({"j": F.pmod(F.xxhash64("node"), "cols"), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)), "side": F.lit(1)})
    columns = ["home", "i", "j", "side", "node", "whole"]
    return own.select(columns).unionByName(guests.select(columns))


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Documents link when 100 * |A and B| >= percent * |A or B| over their distinct n-word shingles;
    component_id is the smallest doc_id reachable by links. Documents without words have no
    shingles and link with nothing, null text likewise. Rows without doc_id get no component.
    Rows that repeat a doc_id share one component. Extra columns are ignored; empty tables work. A
    very long text is one row of the product: its set (eight bytes an n-gram) has to fit in a task.

    The document by n-gram incidence matrix is multiplied by its transpose block by block, and
    counts below the bound that both sizes give are discarded. Which blocks meet is decided by the
    rare n-grams: in one order of all n-grams, rare ones first, linked sets share one of their first
    few (prefix_length). A fixed share of the n-grams, by hash, is counted over all documents to tell which are rare;
    that decides what is looked up, never whether a pair is found. Each set joins the cluster of the smallest set that it shares such an
    n-gram with, one step, never along chains; clusters are multiplied with themselves. Then a set
    goes to the other clusters of those n-grams whose sets are not connected yet. A block pair
    returns a spanning forest of its links, never its pairs, and equal sets are collapsed first. The
    work is quadratic in the distinct sets of a cluster, cut into block pairs that sizes allow.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    seen = staged(arrow_pass(base, _profiles(n, percent), "doc_id long, n_shingles long, set_a long, set_b long, counted binary"), "ngram-profiles")
    profiles = staged(seen.where("counted is null").drop("counted"), "ngram-sets")
    named = profiles.where("doc_id is not null and set_a is not null")
    reps = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max("n_shingles").alias("size"))
    copies = named.join(reps.where("rep <> last").select("set_a", "set_b", "rep"), ["set_a", "set_b"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    copies = staged(copies, "ngram-copies")

    counted = arrow_pass(seen.where("counted is not null").select("counted"), _counted, "key int")
    common = staged(counted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").cast("long").alias("key"), "n"), "ngram-common")
    discard(seen)
    bits = spark.sparkContext.broadcast((bit_filter(common), bit_filter(common.where(F.col("n") >= MANY))))
    raw = staged(arrow_pass(base, _posts(n, percent, bits), "key long, set_a long"), "ngram-raw")
    shared = raw.groupBy("key").agg(F.min("set_a").alias("first"), F.max("set_a").alias("last")).where("first <> last").select("key")
    shared = staged(shared, "ngram-shared")
    posts = raw.join(bounded(shared), "key", "left_semi").distinct()
    # a key for each n-gram and two neighbouring size classes: only sets whose sizes may link share one
    sized = posts.join(reps.select("set_a", F.col("rep").alias("node"), "size"), "set_a").withColumn("class", _size_class(percent))
    sized = staged(sized.select(F.explode(F.array(F.xxhash64("key", "class"), F.xxhash64("key", F.col("class") + 1))).alias("key"), "node", "size"), "ngram-sized")
    discard(raw)
    met = sized.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("key")
    posts = staged(sized.join(bounded(staged(met, "ngram-met")), "key", "left_semi"), "ngram-posts")
    discard(sized)
    hubs = posts.groupBy("key").agg(F.min("node").alias("hub"))
    members = posts.join(hubs, "key").groupBy("node").agg(F.min("hub").alias("cluster"), F.max("size").alias("size"))
    members = staged(members, "ngram-members")
    near = _links(base, _within(members, percent), n, percent, "ngram-within")
    found = components(near, "ngram-near")
    far = _links(base, _across(posts.join(members.select("node", "cluster"), "node"), found, percent), n, percent, "ngram-across")
    final = components(near.unionByName(far).unionByName(copies), "ngram-links").withColumnRenamed("node", "doc_id")
    out = profiles.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents of a component but its smallest doc_id. Rows without doc_id stay; so do repeated rows of a kept doc_id."""
    gone = ngram_components(docs, n, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(bounded(staged(gone, "ngram-gone")), "doc_id", "left_anti").select(docs.columns)
