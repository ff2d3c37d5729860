"""Helpers shared by the corpus operators: staged tables, word hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import ship

#: Right sides of joins are broadcast only when counted and at most this many narrow rows.
BROADCAST_ROWS = 200_000
#: Entries of a worker's word-hash cache before it is emptied.
WORD_CACHE = 400_000
#: Bits of a filter for each key, at most, and in each block of it.
FILTER_BITS, MOST_BITS, FILTER_BLOCK = 16, 1 << 28, 1 << 19
#: Staged tables after which the driver gives free memory back.
SETTLE = 6
#: Spark's setting that removes the shuffle files of a job at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where a local master left it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    root = f"file://{tempfile.gettempdir()}/lectern-stage"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_WRITTEN = itertools.count(1)


def staged(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write df as a table in the shared folder, in folders of these columns if any, and read it back: lineage ends there, and a lost executor loses nothing.

    Once the table is written, nothing needs the shuffle files of the job that wrote it, so they go.
    """
    spark, path = df.sparkSession, f"{shared_root(df.sparkSession)}/lectern/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*folders).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    if next(_WRITTEN) % SETTLE == 0:
        # buffers outside of the driver's heap go only when the heap is collected, which a large one seldom is
        spark._jvm.System.gc()
        release()
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a staged table that only staged tables were made from, so that its disk is free before the job ends."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def release() -> None:
    """Give a Python worker's free memory back: idle workers stay beside the JVM until they are used again."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_pass(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with the package at hand on the executors; a worker gives its free memory back at the end of a task."""
    ship(df.sparkSession)

    def tidy(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its row count, known or counted here, is small enough; otherwise df as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def hashed_sample(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """The n rows of df with the least hash of cols. Only hashes are sorted; the driver gets n of them, not rows."""
    h = F.xxhash64(*cols)
    last = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(last)).limit(n) if last is not None else df.limit(0)


def _bitmap(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of a bit filter, of its keys."""
    flags = np.zeros(FILTER_BLOCK, bool)
    flags[pdf["key"].to_numpy() & (FILTER_BLOCK - 1)] = True
    return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "bits": [np.packbits(flags, bitorder="little").tobytes()]})


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the last places of distinct hashes (key long): FILTER_BITS for each key, at least one block and MOST_BITS at most.

    A full filter answers yes too often, which costs time where it is used, not results.
    """
    rows, bits = keys.count(), FILTER_BLOCK
    while bits < min(MOST_BITS, rows * FILTER_BITS):
        bits *= 2
    placed = keys.select("key", F.shiftrightunsigned(F.col("key").bitwiseAND(F.lit(bits - 1).cast("long")), FILTER_BLOCK.bit_length() - 1).alias("block"))
    whole = np.zeros((bits // FILTER_BLOCK, FILTER_BLOCK // 8), np.uint8)
    for row in placed.groupBy("block").applyInPandas(_bitmap, "block long, bits binary").collect():  # bits / 8 bytes in all
        whole[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return whole.reshape(-1)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes & U64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def crc_mod(col: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % n


class WordHash(dict):
    """64-bit hashes of words, computed once per distinct word and worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on arrays of uint64."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, by doubling: log2(n) array passes instead of n."""
    if len(h) < n:
        return np.empty(0, U64)
    out, done, power, width = None, 0, h, 1
    while True:
        if n & width:
            part = power[done : done + len(h) - n + 1]
            out = mix(part + U64(width)) if out is None else mix(out * MIX_A + part * MIX_B + U64(width))
            done += width
        width *= 2
        if width > n:
            return out
        power = mix(power[: -(width // 2)] * MIX_A + mix(power[width // 2 :]) + U64(width))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b), component = smallest node reachable.

    Alternating large-star and small-star steps: each replaces edges by edges to smaller
    neighbours. Aggregates come before joins, so a hub's edges are only joined with one row, which
    adaptive execution splits. Rounds grow with the logarithm of the longest path.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs = staged(pairs, f"{name}-edges")
    before = None
    while True:
        seen = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if seen == before or not seen[0]:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        before = seen
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(small.select("hi", F.col("m").alias("lo"))).distinct()
        old, pairs = pairs, staged(pairs, f"{name}-round")
        discard(old)


class Union:
    """Union-find over positions of a bounded block; roots are the smallest positions."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
