"""Vectors without a model: signed hashing of words and trigrams; and the checks that a model's vectors have to pass."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.session import dealt, ship
from lectern.staging import staged

#: Dimensions; what a trigram counts beside a word.
DIMS, TRIGRAM = 128, 0.5
#: Words that are counted at a time, and words whose features a worker remembers, about.
SLICE, KNOWN_WORDS = 400_000, 200_000
#: The least cosine of a reference text with its known vector, how far from 1 a norm may be, and tokens of a text at most.
LEAST_COSINE, NORM_SLACK, TOKENS = 0.999, 1e-3, 512


def slot(feature: Column, first: int) -> Column:
    """A number of seven hexadecimal digits of the feature's md5, from this place on."""
    return F.conv(F.substring(F.md5(feature), first, 7), 16, 10).cast("long")


def features(chunks: DataFrame, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """(key, feature, weight): distinct words (w:) and trigrams of words (g:) of a chunk, by 1 + ln of how often it has them."""
    words = chunks.select(key, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("w")).select(key, F.explode("w").alias("word"))
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit("<"), "word", F.lit(">"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), lambda i: F.struct(F.concat(F.lit("g:"), F.substring(padded, i, F.lit(3))).alias("f"), F.lit(TRIGRAM).alias("x")))
    both = F.concat(F.array(F.struct(F.concat(F.lit("w:"), "word").alias("f"), F.lit(1.0).alias("x"))), grams)
    rows = counted.select(key, "n", F.explode(both).alias("p")).groupBy(key, F.col("p.f").alias("feature"), F.col("p.x").alias("x")).agg(F.sum("n").alias("n"))
    return rows.select(key, "feature", (F.col("x") * (1 + F.log("n"))).alias("weight"))


class _Features:
    """Features of words: of each its place in a vector and what it counts, with its sign."""

    def __init__(self, dims: int):
        self.dims, self.words, self.ids, self.places, self.counts = dims, {}, {}, [], []

    def _id(self, feature: str, x: float) -> int:
        known = self.ids.get(feature)
        if known is None:
            h = hashlib.md5(feature.encode()).hexdigest()
            known = self.ids[feature] = len(self.places)
            self.places.append(int(h[:7], 16) % self.dims)
            self.counts.append(x if int(h[8:15], 16) % 2 == 0 else -x)
        return known

    def of(self, word: str) -> list[int]:
        known = self.words.get(word)
        if known is None:
            padded = f"<{word}>"
            known = self.words[word] = [self._id(f"w:{word}", 1.0), *(self._id(f"g:{padded[i : i + 3]}", TRIGRAM) for i in range(len(word)))]
        return known


def _vectors(lists: pa.Array, known: _Features) -> np.ndarray:
    """Unit vectors of lists of words: each list's features are counted by sorting numbers, all lists at once."""
    n, sizes = len(lists), np.asarray(lists.value_lengths())
    coded = lists.flatten().dictionary_encode()
    own = [known.of(w) for w in coded.dictionary.to_pylist()]
    if not own:
        return np.zeros((n, known.dims))
    count, bits = len(own), int(sizes.sum()).bit_length()
    pair, times = np.unique(np.repeat(np.arange(n), sizes) * count + np.asarray(coded.indices), return_counts=True)
    row, word = np.divmod(pair, count)
    width = np.array([len(f) for f in own])
    names, flat = np.unique(np.concatenate([np.asarray(f) for f in own]), return_inverse=True)
    wide = width[word]
    at = np.repeat((np.cumsum(width) - width)[word] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
    packed = np.sort((np.repeat(row, wide) * len(names) + flat[at]) << bits | np.repeat(times, wide))
    key, first = np.unique(packed >> bits, return_index=True)
    total = np.add.reduceat(packed & ((1 << bits) - 1), first)
    row, feature = np.divmod(key, len(names))
    feature = names[feature]
    weight = np.asarray(known.counts)[feature] * (1 + np.log(total))
    out = np.bincount(row * known.dims + np.asarray(known.places)[feature], weight, n * known.dims).reshape(n, known.dims)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _slices(lists: pa.Array) -> list[tuple[int, int]]:
    """(first, rows) of pieces of lists with some SLICE words, one row at least."""
    piece = np.cumsum(np.asarray(lists.value_lengths())) // SLICE
    starts = np.flatnonzero(np.diff(piece, prepend=-1)) if len(piece) else piece
    return [(int(a), int(b - a)) for a, b in zip(starts, [*starts[1:], len(piece)], strict=True)]


def _summed(chunks: DataFrame, dims: int, text: str, key: str) -> DataFrame:
    """hashed_embedding of chunks that may lie in several rows of one key: sparse sums that meet by (key, place)."""
    signed = F.when(slot(F.col("feature"), 9) % 2 == 0, F.col("weight")).otherwise(-F.col("weight"))
    sums = features(chunks, text, key).groupBy(key, (slot(F.col("feature"), 1) % dims).cast("int").alias("place")).agg(F.sum(signed).alias("v"))
    filled = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))  # dims entries at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    vectors = filled.select(key, dense.alias("embedding"))
    return chunks.select(key).join(vectors, key, "left").select(key, T.l2_normalised(F.coalesce("embedding", F.array_repeat(F.lit(0.0), dims))).alias("embedding"))


def hashed_embedding(chunks: DataFrame, dims: int = DIMS, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """(key, embedding): unit vectors of dims numbers; a feature adds its weight to one of them, with a sign, both by its hash.

    A chunk's words are counted where its row lies, nothing but keys is shuffled. Rows that share a key are one chunk, and theirs
    are summed by joins. A chunk without words or key has the zero vector.
    """
    ship(chunks.sparkSession)
    rows = chunks.select(key, text)
    shared = staged(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "shared-keys")
    if several := not shared.isEmpty():
        rows, summed = rows.join(shared, key, "left_anti"), _summed(rows.join(shared, key, "left_semi"), dims, text, key)
    kind = dict(rows.dtypes)[key]

    def run(batches):
        known = _Features(dims)
        for batch in batches:
            for at, n in _slices(batch.column("w")):
                known = known if len(known.words) < KNOWN_WORDS else _Features(dims)
                x = _vectors(batch.column("w").slice(at, n), known)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(at, n), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dims, pa.array(x.ravel()))], names=[key, "embedding"])

    words = T.tokens(F.when(F.col(key).isNotNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(""))
    out = dealt(rows).select(key, words.alias("w")).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")
    return out.unionByName(summed) if several else out


def self_test(vectors: DataFrame, reference: DataFrame, texts: DataFrame, prefix: str, key: str = "chunk_id") -> DataFrame:
    """(check, tested, failed, worst) of a model's vectors (key, embedding): what has to hold before an index is built from them.

    reference: each reference text's cosine with its known vector (key, embedding) is LEAST_COSINE or more. norm: lengths are 1, within NORM_SLACK.
    prefix: texts (key, text) begin with the model's prefix. budget: they take TOKENS tokens at most. A null vector fails the first two.
    """
    cosine = T.cosine(F.col("embedding"), F.col("known"))
    met = reference.select(key, F.col("embedding").alias("known")).join(vectors, key, "left").select(F.coalesce(cosine, F.lit(0.0)).alias("x"))
    length = vectors.select(F.abs(F.coalesce(F.sqrt(T.dot(F.col("embedding"), F.col("embedding"))), F.lit(0.0)) - 1).alias("x"))
    starts = texts.select(F.coalesce(F.startswith("text", F.lit(prefix)), F.lit(False)).cast("double").alias("x"))
    tokens = texts.select(T.token_estimate(F.coalesce("text", F.lit(""))).cast("double").alias("x"))

    def line(name: str, rows: DataFrame, fails: Column, worst: Column) -> DataFrame:
        return rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("tested"), F.count_if(fails).alias("failed"), worst.alias("worst")).select("check", "tested", "failed", "worst")

    out = line("reference", met, F.col("x") < LEAST_COSINE, F.min("x"))
    out = out.unionByName(line("norm", length, F.col("x") > NORM_SLACK, F.max("x")))
    out = out.unionByName(line("prefix", starts, F.col("x") < 1, F.min("x")))
    return out.unionByName(line("budget", tokens, F.col("x") > TOKENS, F.max("x")))
