"""A stored inverted index: postings in blocks with score bounds, by term bucket; top-k search that leaves blocks out; codes by trigrams."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.retrieval import K1, QUERY_BLOCK, Asked, B, best_by_terms, crossed, id_blocks, top_k
from lectern.session import ship
from lectern.staging import current, new_folder, publish, staged

#: Folders of terms; postings of a block, about; layers of a term's postings by how much they can add to a score.
BUCKETS, BLOCK, LAYERS = 64, 512, 8
#: Queries, or frequent terms, that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Different terms of all queries, up to which a search looks for blocks that it can leave out.
FLOOR_TERMS = 256
#: Scores this close count as equal.
SLACK = 1e-9
#: The weights of a chunk's words, of their further forms, and of its codes.
WEIGHTS = {"words": 1.0, "forms": 0.4, "codes": 2.5}


def search_fields(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, words, forms, codes): a chunk's words, the parts of its compounds, its codes in lower case. Null text has none."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = T.tokens(body)
    parts = lambda w: F.filter(F.split(w, "-"), lambda p: (F.length(p) >= 3) & ~p.rlike(r"^\d+$"))
    forms = F.flatten(F.transform(F.filter(words, lambda w: F.contains(w, F.lit("-"))), lambda w: F.array_distinct(parts(w))))
    return chunks.select("chunk_id", words.alias("words"), forms.alias("forms"), F.transform(T.codes(body), F.lower).alias("codes"))


def query_fields(queries: DataFrame) -> DataFrame:
    """(query_id, terms, codes): what a query asks the index for."""
    body = F.coalesce(F.col("text"), F.lit(""))
    codes = F.transform(T.codes(body), F.lower)
    return queries.select("query_id", F.array_distinct(F.concat(T.with_compound_parts(T.tokens(body)), codes)).alias("terms"), codes.alias("codes"))


def bucket_of(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class InvertedIndex:
    """A published index: its folder, number of chunks, average length in terms."""

    path: str
    chunks: int
    avg_length: float

    def table(self, spark: SparkSession, name: str, schema: str, buckets: list[int]) -> DataFrame:
        """A table of the index, of these buckets: only their folders are read."""
        return spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}").where(F.col("bucket").isin(buckets))


BLOCKS = "term string, bound double, posts array<struct<chunk_id: bigint, part: double>>"
TERMS = "term string, df long, most double"
GRAMS = "gram string, code string"
GRAM_SIZES = "gram string, n long"
CODE_CHUNKS = "code string, chunk_ids array<bigint>"


def _posts(weights: np.ndarray, batches):
    """Batches (chunk_id, length, term, tf) of batches (chunk_id, terms, sizes): a row for each distinct term of a chunk with the sum of its weights, and one without term.

    sizes says how many of a chunk's terms come from each weight's column.
    """
    for batch in batches:
        lengths = np.asarray(batch.column("terms").value_lengths()).astype(np.int64)
        words = batch.column("terms").flatten().dictionary_encode()
        known, codes = max(1, len(words.dictionary)), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        each = np.repeat(np.tile(weights, len(lengths)), sizes)
        row = np.repeat(np.arange(len(lengths)), lengths)
        pairs, at = np.unique(row * known + codes, return_inverse=True)
        tf = np.bincount(at, each, minlength=len(pairs)).astype(float)
        ids, of = batch.column("chunk_id"), pa.array(lengths.astype(np.int32))
        rows = pa.array(pairs // known)
        yield pa.RecordBatch.from_arrays([ids.take(rows), of.take(rows), words.dictionary.take(pa.array(pairs % known)), pa.array(tf)], names=["chunk_id", "length", "term", "tf"])
        yield pa.RecordBatch.from_arrays([ids, of, pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.float64())], names=["chunk_id", "length", "term", "tf"])


def _written(df: DataFrame, path: str, *order: str) -> None:
    df.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)


def build(fields: DataFrame, root: str, weights: dict[str, float] | None = None) -> InvertedIndex:
    """Index term lists in several columns of fields (chunk_id, an array for each weight, codes), and publish the index under root.

    A term's frequency in a chunk is the weighted sum over the columns, a chunk's length the number of terms of all of them. What a posting adds to a
    BM25 score is known here, so it is stored. Postings of a term lie in blocks of about BLOCK, those of like parts together, each with
    its largest part; a term that most chunks hold is as many blocks as it needs, none of which is one task's alone.
    chunk_id is a key; a chunk's terms are counted where it lies. Terms of up to BLOCK chunks are one block. Without weights the index has codes only.
    """
    spark, weights = fields.sparkSession, WEIGHTS if weights is None else weights
    ship(spark)
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in weights]
    rows = fields.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.concat(F.array().cast("array<string>"), *lists).alias("terms"), F.array(*[F.size(c) for c in lists]).cast("array<int>").alias("sizes"))
    values = np.array(list(weights.values()), float)

    def count(batches):
        yield from _posts(values, batches)

    posts = staged(rows.mapInArrow(count, "chunk_id long, length int, term string, tf double"), "index-posts")
    n, total = posts.where("term is null").agg(F.count(F.lit(1)), F.sum("length")).first()
    average = (total or 0) / n if n else 0.0
    posts = posts.where("term is not null")
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average)))
    often = staged(posts.groupBy("term").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > BLOCK), "index-often")
    scored = posts.join(F.broadcast(often) if often.count() <= BROADCAST_ROWS else often, "term", "left").select("term", "chunk_id", "many", share.alias("share"))
    layer = F.when(F.col("many").isNotNull(), F.least(F.lit(LAYERS - 1), F.floor((K1 + 1 - F.col("share")) / (K1 + 1) * LAYERS)))
    salt = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("many") / BLOCK))
    grouped = scored.groupBy("term", "many", layer.alias("layer"), salt.alias("salt"))
    shares = grouped.agg(F.coalesce("many", F.count(F.lit(1))).alias("df"), F.max("share").alias("best"), F.sort_array(F.collect_list(F.struct("chunk_id", "share"))).alias("shares"))  # about BLOCK postings
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    blocks = shares.withColumn("idf", idf).select("term", "df", (F.col("idf") * F.col("best")).alias("bound"), F.transform("shares", lambda p: F.struct(p["chunk_id"].alias("chunk_id"), (F.col("idf") * p["share"]).alias("part"))).alias("posts"))
    build_id = new_folder(spark, "index").rsplit("-", 1)[1]
    path = f"{root}/{build_id}"
    _written(blocks.withColumn("bucket", bucket_of()).select("term", "df", "bound", "posts", "bucket"), f"{path}/blocks", "term", "bound")
    known = spark.read.schema("term string, df long, bound double, bucket int").parquet(f"{path}/blocks")
    _written(known.groupBy("bucket", "term", "df").agg(F.max("bound").alias("most")), f"{path}/terms", "term")

    own = fields.select("chunk_id", F.explode(F.array_distinct("codes")).alias("code"))
    codes = own.groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    grams = codes.select("code", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("code") - 2, F.lit(1))), lambda i: F.substring("code", i, F.lit(3))))).alias("gram"))
    _written(grams.select("gram", "code", bucket_of("gram").alias("bucket")), f"{path}/grams", "gram", "code")
    _written(spark.read.schema(f"{GRAMS}, bucket int").parquet(f"{path}/grams").groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n")), f"{path}/gram_sizes", "gram")
    held = own.join(codes, "code").groupBy("code", F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("df") / BLOCK)).alias("salt")).agg(F.sort_array(F.collect_list(F.col("chunk_id").cast("long"))).alias("chunk_ids"))
    _written(held.select("code", "chunk_ids", bucket_of("code").alias("bucket")), f"{path}/code_chunks", "code")
    spark.createDataFrame([(json.dumps({"chunks": n or 0, "avg_length": average}),)], "about string").coalesce(1).write.parquet(f"{path}/about")
    publish(spark, root, build_id)
    return InvertedIndex(path, n or 0, average)


def opened(spark: SparkSession, root: str) -> InvertedIndex | None:
    """The version that is current under root."""
    path = current(spark, root)
    return path and InvertedIndex(path, *json.loads(spark.read.parquet(f"{path}/about").first()[0]).values())


def _buckets(asked: DataFrame) -> list[int]:
    """The distinct buckets of asked: BUCKETS numbers at most."""
    return sorted(r[0] for r in asked.select("bucket").distinct().collect())


def survey(index: InvertedIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, most, total): a query's known terms, what each can add to a score at most, and all of them."""
    spark = queries.sparkSession
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).where(F.length("term") >= 2).withColumn("bucket", bucket_of())
    terms = index.table(spark, "terms", TERMS, _buckets(wanted)).select("term", "most")
    known = wanted.select("query_id", "term").join(terms, "term")
    return known.withColumn("total", F.sum("most").over(Window.partitionBy("query_id")))


def search(index: InvertedIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query (query_id, terms), as scoring all postings gives them.

    The blocks with the largest parts give each query k partial scores, whose least no result may fall below. A block is read
    if its bound and what all other terms can add reach that for some query: chunks in the others can't be among the k best, so scores stay exact. Queries of
    more than FLOOR_TERMS different terms need nearly all of their blocks, so these are read at once. Postings meet by chunk, once for all queries (QUERY_BLOCK of
    them at a time), and a task keeps its k best of each query. Only folders of the queries' terms are read. `allowed` (chunk_id) restricts the chunks before anything is counted.
    """
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    if parts == 1:
        return _searched(index, queries, k, allowed)
    found = [staged(_searched(index, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b), k, allowed), "search-block") for b in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _searched(index: InvertedIndex, queries: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    spark = queries.sparkSession
    asked = staged(survey(index, queries), "search-terms")
    own = Asked(asked)
    ship(spark)
    sides = spark.sparkContext.broadcast(own)
    blocks = index.table(spark, "blocks", BLOCKS, _buckets(asked.withColumn("bucket", bucket_of()))).select("term", "bound", "posts")
    places = spark.createDataFrame([(t, i) for i, t in enumerate(own.terms)], "term string, place int")

    def score(batches):
        def posts():
            for batch in batches:
                items = batch.column("items")
                flat = items.flatten()
                yield batch.column("chunk_id").to_numpy(), np.asarray(items.value_lengths()).astype(np.int64), flat.field("place").to_numpy(), flat.field("part").to_numpy()

        yield from best_by_terms(sides.value, k, posts())

    def best(chosen: DataFrame) -> DataFrame:
        posts = chosen.join(F.broadcast(places), "term").select("place", F.explode("posts").alias("p")).select("place", "p.*")
        posts = posts if allowed is None else posts.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
        rows = posts.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("items"))
        return top_k(rows.mapInArrow(score, "query_id long, chunk_id long, score double"), k).withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))

    if len(own.terms) > FLOOR_TERMS:
        return best(blocks)
    terms = asked.groupBy("term").agg(F.first("most").alias("most"))
    heads = blocks.join(terms, "term").where(F.col("bound") >= F.col("most") * 0.5).select("term", "posts")
    least = best(heads).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", "least")
    need = F.coalesce(F.col("least") - SLACK, F.lit(-math.inf)) - F.col("total") + F.col("most")
    limits = staged(asked.join(least, "query_id", "left").groupBy("term").agg(F.min(need).alias("need")), "search-limits")
    return best(blocks.join(limits, "term").where(F.col("bound") >= F.col("need")).select("term", "posts"))


def blocks_read(index: InvertedIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, blocks, needed): blocks that a query's terms have, and those that its k best chunks need, with the exact k-th score as limit."""
    spark = queries.sparkSession
    asked = survey(index, queries)
    blocks = index.table(spark, "blocks", BLOCKS, _buckets(asked.withColumn("bucket", bucket_of()))).select("term", "bound")
    last = search(index, queries, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    limits = asked.join(last.select("query_id", "least"), "query_id", "left")
    needed = F.col("bound") + F.col("total") - F.col("most") >= F.coalesce("least", F.lit(-math.inf)) - SLACK
    return blocks.join(limits, "term").groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(needed).alias("needed"))


def code_search(index: InvertedIndex, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, hits): chunks with a code that holds one of the query's codes (query_id, codes) of three or more characters.

    Of a code's trigrams the one that fewest codes have is looked up, and what it finds is compared whole; a trigram that most
    codes have is used only where no rarer one is. hits counts the query's codes that a chunk matches;
    it is counted once for all queries with the same codes and all chunks that match the same of them. Pairs of queries and chunks are made of blocks
    of their ids after the last shuffle, and all of a block come one after the other, so a column repeats itself and takes little disk.
    """
    spark = queries.sparkSession
    each_asked = queries.select("query_id", F.explode(F.array_distinct("codes")).alias("wanted")).where(F.length("wanted") >= 3)
    sets = staged(each_asked.groupBy("query_id").agg(F.sort_array(F.collect_list("wanted")).alias("wants")), "code-queries")
    asked = sets.select("wants").distinct().select("wants", F.explode("wants").alias("wanted"))
    distinct = asked.select("wanted").distinct()
    cut = distinct.select("wanted", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("wanted") - 2), lambda i: F.substring("wanted", i, F.lit(3))))).alias("gram")).withColumn("bucket", bucket_of("gram"))
    cut = staged(cut, "code-grams")
    buckets = _buckets(cut)
    sizes = index.table(spark, "gram_sizes", GRAM_SIZES, buckets).select("gram", "n")
    rarest = cut.join(sizes, "gram", "left").groupBy("wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("wanted", "r.gram")
    met = index.table(spark, "grams", GRAMS, buckets).select("gram", "code").join(rarest, "gram").where(F.contains("code", "wanted")).select("wanted", "code")
    met = staged(met.withColumn("bucket", bucket_of("code")), "code-matches")
    held = index.table(spark, "code_chunks", CODE_CHUNKS, _buckets(met)).select("code", F.explode("chunk_ids").alias("chunk_id"))
    held = held if allowed is None else held.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    each = met.select("wanted", "code").join(held, "code").select("wanted", "chunk_id").distinct()
    pages = id_blocks(each.groupBy("chunk_id").agg(F.sort_array(F.collect_list("wanted")).alias("found")), "found", "chunk_id")
    known = pages.select("found").distinct().select("found", F.explode("found").alias("wanted"))
    hits = asked.join(known, "wanted").groupBy("wants", "found").agg(F.count(F.lit(1)).alias("hits"))
    met = crossed(hits, id_blocks(sets, "wants", "query_id"), pages, "wants", "found")
    return met.select("hits", F.explode("left_ids").alias("query_id"), "right_ids").select("query_id", F.explode("right_ids").alias("chunk_id"), "hits")


def sparse_branch(index: InvertedIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): search() over terms, and matches of codes at their number times the codes' weight; the larger score counts."""
    asked = staged(query_fields(queries), "sparse-queries")
    words = search(index, asked, k, allowed).select("query_id", "chunk_id", "score")
    codes = code_search(index, asked, allowed).select("query_id", "chunk_id", (F.col("hits") * WEIGHTS["codes"]).alias("score"))
    return top_k(words.unionByName(codes).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)
