"""Approximate vector search: cells of a coarse quantiser in folders of their own, residual codes, exact rescoring."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.operators.retrieval import top_k
from lectern.session import ship
from lectern.staging import staged

#: Vectors that the quantisers are fitted on at most (those of the least hash); every vector is indexed.
SAMPLE, ROUNDS, SEED = 20_000, 12, 7
#: Cells at most; dimensions of a subspace, and codes of each.
MOST_CELLS, SUBSPACE, CODES = 4096, 4, 256
#: Sample vectors that serve as queries to choose the number of probes by, and the share of their neighbours to be found.
TRIALS, AIM, AIM_K = 200, 0.97, 10
#: Rows of a cell and queries of a cell that meet in one task at most.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 16_384, 1_024
#: Candidates kept for rescoring, times k.
OVERFETCH = 8


def units(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of x, from distinct rows at random; a centre that loses all rows takes the row farthest from its own."""
    rng = np.random.default_rng(SEED)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the squared distance to it."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x))
    for begin in range(0, len(x), 4096):
        part = x[begin : begin + 4096]
        d = (part**2).sum(1)[:, None] - 2 * part @ centres.T + (centres**2).sum(1)
        at[begin : begin + 4096] = d.argmin(1)
        far[begin : begin + 4096] = d.min(1)
    return at, far


@dataclass
class Quantiser:
    """Centres of the cells, code books of the residuals' subspaces, and how many cells to probe."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def parts(self, residual: np.ndarray) -> list[np.ndarray]:
        return np.array_split(residual, len(self.books), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, _ = nearest(x, self.centres)
        codes = [nearest(p, book)[0] for p, book in zip(self.parts(x - self.centres[cell]), self.books, strict=True)]
        return cell, np.stack(codes, 1).astype(np.uint8)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The probes cells of each query whose centres have the largest dot product with it, the best first."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Dot products of queries with the vectors that codes stand for: by table, a subspace at a time."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), 1)
        for k, (part, book) in enumerate(zip(self.parts(q), self.books, strict=True)):
            out += (part @ book.T)[:, codes[:, k]]
        return out

    def to_json(self) -> str:
        return json.dumps({"centres": self.centres.tolist(), "books": [b.tolist() for b in self.books], "probes": self.probes})

    @classmethod
    def from_json(cls, text: str) -> Quantiser:
        d = json.loads(text)
        return cls(np.array(d["centres"]), [np.array(b) for b in d["books"]], d["probes"])


def fitted(sample: np.ndarray, rows: int) -> Quantiser:
    """A quantiser for `rows` vectors, from unit vectors of a sample of them; probes as few as find AIM of the trials' neighbours in the sample."""
    cells = max(1, min(MOST_CELLS, len(np.unique(sample, axis=0)), round(math.sqrt(rows)), len(sample) // 4 or 1))
    centres = kmeans(sample, cells)
    cell, _ = nearest(sample, centres)
    residual = sample - centres[cell]
    splits = np.array_split(residual, max(1, sample.shape[1] // SUBSPACE), axis=1)
    out = Quantiser(centres, [kmeans(p, min(CODES, len(p))) for p in splits], cells)
    trials = sample[np.random.default_rng(SEED).permutation(len(sample))[:TRIALS]]
    score = trials @ sample.T
    near = np.argpartition(-score, min(AIM_K, len(sample) - 1), axis=1)[:, :AIM_K]
    place = np.argsort(out.probed(trials, cells), axis=1)  # of each cell in each trial's order
    need = np.take_along_axis(place, cell[near], 1) + 1
    out.probes = int(np.quantile(need, AIM, method="higher"))
    return out


@dataclass
class VectorIndex:
    """An index in a folder: cells/cell=N with chunk_id, code, embedding and facets; quantiser/ with the rest."""

    path: str
    rows: int
    quantiser: Quantiser
    sizes: dict[int, int]
    facets: list[str]

    def table(self, spark: SparkSession, *columns: str) -> DataFrame:
        kinds = {"chunk_id": "long", "code": "binary", "embedding": "array<double>"}
        known = spark.read.option("basePath", f"{self.path}/cells").parquet(f"{self.path}/cells") if self.rows else spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", cell int")
        return known.select(*columns, "cell")


def _usable(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """Vectors that hold finite numbers only and are not zero, as doubles."""
    rows = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    fine = F.expr("size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(embedding, c -> c <> 0)")
    return rows.where(fine if dims is None else fine & (F.size("embedding") == dims))


def matrix(batch: pa.RecordBatch, column: str = "embedding") -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def build(vectors: DataFrame, path: str, facets: tuple[str, ...] = ()) -> VectorIndex:
    """Index vectors (chunk_id, embedding, facets) in a new folder. Null, zero and non-finite vectors have no place in it, nor have those of a rarer length.

    Only the sample, SAMPLE rows at most, goes to the driver. A cell of any size is as many files as it needs.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = _usable(vectors.select("chunk_id", "embedding", *facets))
    lengths = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return VectorIndex(path, 0, Quantiser(np.zeros((1, 1)), [np.zeros((1, 1))], 1), {}, list(facets))
    dims, n = lengths
    whole = whole.where(F.size("embedding") == dims)
    drawn = whole.select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(min(n, SAMPLE)).select("embedding").collect()
    quantiser = fitted(units(np.array([r[0] for r in drawn])), n)

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                cell, codes = quantiser.encode(units(matrix(batch)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "cell", "code"])

    kinds = dict(whole.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in whole.columns) + ", cell int, code binary"
    whole.mapInArrow(coded, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
    sizes = {r["cell"]: r["count"] for r in spark.read.parquet(f"{path}/cells").groupBy("cell").count().collect()}  # MOST_CELLS rows at most
    index = VectorIndex(path, n, quantiser, sizes, list(facets))
    spark.createDataFrame([(quantiser.to_json(), json.dumps({"rows": n, "sizes": sizes, "facets": list(facets)}))], "quantiser string, about string").coalesce(1).write.parquet(f"{path}/quantiser")
    return index


def opened(spark: SparkSession, path: str) -> VectorIndex:
    row = spark.read.parquet(f"{path}/quantiser").first()
    about = json.loads(row["about"])
    return VectorIndex(path, about["rows"], Quantiser.from_json(row["quantiser"]), {int(k): v for k, v in about["sizes"].items()}, about["facets"])


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest entries, and of those equal to the k-th."""
    rounded = np.round(score, 9)
    if score.shape[1] > k:
        least = np.partition(rounded, -k, axis=1)[:, -k]
        return np.nonzero(rounded >= least[:, None])
    return np.nonzero(np.ones_like(score, bool))


def _meet(quantiser: Quantiser, keep: int, exact: bool):
    """Queries and vectors of one cell (a part of it): the best of each query, by codes or by the vectors themselves."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names, ids = asked.column("query_id").to_numpy(), rows.column("chunk_id").to_numpy()
        found: list[list[np.ndarray]] = [[], [], []]
        if len(names) and len(ids):
            q = units(np.asarray(asked.column("vector").combine_chunks().flatten()).reshape(len(names), -1))
            if exact:
                score = np.round(q @ units(np.asarray(rows.column("embedding").combine_chunks().flatten()).reshape(len(ids), -1)).T, 12)
            else:
                codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                score = quantiser.approximate(q, asked.column("at")[0].as_py(), codes)
            i, j = _best(score, keep)
            found = [[names[i]], [ids[j]], [score[i, j]]]
        return pa.table({n: np.concatenate(v) if v else np.empty(0, k) for n, v, k in zip(("query_id", "chunk_id", "score"), found, (np.int64, np.int64, float), strict=True)})

    return run


def _probes(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """(query_id, vector, at): a query in each cell that it probes."""
    quantiser = index.quantiser

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                cells = quantiser.probed(units(matrix(batch, "vector")), probes)
                times = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(times), batch.column("vector").take(times), pa.array(cells.ravel(), pa.int32())], names=["query_id", "vector", "at"])

    base = _usable(queries.select("query_id", "embedding"), quantiser.dims).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    return base.mapInArrow(run, "query_id long, vector array<double>, at int")


def _candidates(index: VectorIndex, asked: DataFrame, where: Column | None, keep: int, exact: bool) -> DataFrame:
    """(query_id, chunk_id, score) of queries (query_id, vector, at) with the vectors of their cells.

    Both sides of a cell are cut into parts so that a task meets QUERIES_AT_ONCE queries with about ROWS_AT_ONCE rows: neither a cell that holds
    most vectors nor one that all queries probe is one task's work. Only folders of probed cells are read.
    """
    spark = asked.sparkSession
    counts = {r["at"]: r["count"] for r in asked.groupBy("at").count().collect()}  # MOST_CELLS rows at most
    cells = [c for c in counts if c in index.sizes]
    rows = index.table(spark, "chunk_id", "embedding" if exact else "code", *index.facets).where(F.col("cell").isin(cells))
    if where is not None:
        rows = rows.where(where)
    shape = [(c, -(-index.sizes[c] // ROWS_AT_ONCE), -(-counts[c] // QUERIES_AT_ONCE)) for c in cells]
    cuts = F.broadcast(spark.createDataFrame(shape, "of int, row_parts int, query_parts int"))  # MOST_CELLS rows at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(cuts, F.col("at") == F.col("of")).withColumn("qp", F.pmod(F.xxhash64("query_id"), "query_parts").cast("int")).withColumn("rp", each("row_parts"))
    right = rows.join(cuts, F.col("cell") == F.col("of")).withColumn("rp", F.pmod(F.xxhash64("chunk_id"), "row_parts").cast("int")).withColumn("qp", each("query_parts"))
    left = left.select("query_id", "vector", "at", "rp", "qp")
    right = right.select("chunk_id", "embedding" if exact else "code", F.col("cell").alias("at_"), F.col("rp").alias("rp_"), F.col("qp").alias("qp_"))
    return left.groupBy("at", "rp", "qp").cogroup(right.groupBy("at_", "rp_", "qp_")).applyInArrow(_meet(index.quantiser, keep, exact), "query_id long, chunk_id long, score double")


def exact_search(index: VectorIndex, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The k nearest of each query by cosine among all rows that `where` (over facets) allows: full probing, no codes."""
    return top_k(_candidates(index, _probes(queries, index, len(index.quantiser.centres)), where, k, True), k)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, where: Column | None = None, overfetch: int = 1) -> DataFrame:
    """(query_id, chunk_id, score, rank): about the k nearest of each query by cosine.

    Codes choose OVERFETCH * overfetch * k candidates in the probed cells (all cells: exact search), whose vectors are then read for exact scores.
    Queries with a null, zero or odd vector find nothing. Ties go to the smaller chunk_id.
    """
    probes = index.quantiser.probes if probes is None else probes
    if probes >= len(index.quantiser.centres):
        return exact_search(index, queries, k, where)
    asked = staged(_probes(queries, index, probes), "ann-probes")
    keep = OVERFETCH * overfetch * k
    hits = staged(top_k(_candidates(index, asked, where, keep, False), keep).select("query_id", "chunk_id"), "ann-hits")
    cells = [r["at"] for r in asked.select("at").distinct().collect()]
    vectors = index.table(queries.sparkSession, "chunk_id", "embedding").where(F.col("cell").isin(cells)).select("chunk_id", "embedding")
    mine = asked.select("query_id", "vector").dropDuplicates(["query_id"])
    pairs = hits.join(vectors, "chunk_id").join(mine, "query_id")

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                s = (units(matrix(batch)) * units(matrix(batch, "vector"))).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("chunk_id"), pa.array(np.round(s, 12))], names=["query_id", "chunk_id", "score"])

    scored = pairs.select("query_id", "chunk_id", "embedding", "vector").mapInArrow(score, "query_id long, chunk_id long, score double")
    return top_k(scored, k)


def filtered_search(index: VectorIndex, queries: DataFrame, k: int, where: Column, config: Config | None = None) -> tuple[DataFrame, str]:
    """search() among the rows that `where` (over facets) allows, and the strategy: L2 is exact, for filters that allow few rows.

    L1 fetches more, by the share that the filter allows, and drops the others afterwards; queries that this leaves with fewer than k
    are searched exactly, so no filter empties a result.
    """
    spark, c = queries.sparkSession, config or Config()
    rows = index.table(spark, "chunk_id", *index.facets)
    allowed, total = rows.agg(F.count_if(where), F.count(F.lit(1))).first()
    if not total or allowed / total < c.selectivity_exact or index.quantiser.probes >= len(index.quantiser.centres):
        return exact_search(index, queries, k, where), "L2"
    more = max(1, min(c.max_overfetch, math.ceil(total / allowed)))
    wide = search(index, queries, k * more, overfetch=1)
    mine = staged(top_k(wide.drop("rank").join(rows.where(where).select("chunk_id"), "chunk_id", "left_semi"), k), "ann-filtered")
    enough = mine.groupBy("query_id").count().where(F.col("count") >= min(k, allowed)).select("query_id")
    rest = queries.join(enough, "query_id", "left_anti")
    return mine.join(enough, "query_id", "left_semi").unionByName(exact_search(index, rest, k, where)), "L1"


def about(index: VectorIndex) -> dict:
    """What a report shows of an index."""
    return {"rows": index.rows, "cells": len(index.sizes), "probes": index.quantiser.probes, "subspaces": len(index.quantiser.books), "facets": index.facets, "largest_cell": max(index.sizes.values(), default=0)} | {k: v for k, v in asdict(index).items() if k == "path"}
