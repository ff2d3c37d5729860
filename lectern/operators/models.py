"""Models that are given as Python functions on lists, run on batches of like length."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.session import ship

#: Tokens of a batch, padding counted; texts of a batch at most; rows that a task sorts at once.
TOKENS, TEXTS, SORTED = 8192, 64, 4096


def plan(sizes: Sequence[int], tokens: int = TOKENS, most: int = TEXTS) -> list[np.ndarray]:
    """Places of sizes in batches, the longest first: texts times the longest of them stay within tokens; a longer text is alone."""
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    out, begin = [], 0
    while begin < len(order):
        longest = max(1, int(sizes[order[begin]]))
        n = max(1, min(most, tokens // longest))
        out.append(order[begin : begin + n])
        begin += n
    return out


def padding(sizes: Sequence[int], batches: list[np.ndarray]) -> float:
    """Tokens that a model works through for each one that texts have."""
    padded = sum(len(b) * max(int(sizes[k]) for k in b) for b in batches)
    return padded / max(1, int(np.sum(sizes)))


def _applied(rows: DataFrame, key: str, inputs: list[str], output: str, kind: pa.DataType, schema: str, model: Callable[..., list], tokens: int) -> DataFrame:
    """(keys, output): model(*lists of inputs) for all rows. Rows are dealt out by ranges of length, so a task's texts are alike before it sorts them."""
    ship(rows.sparkSession)
    size = sum((T.token_estimate(F.coalesce(F.col(c), F.lit(""))) for c in inputs[1:]), T.token_estimate(F.coalesce(F.col(inputs[0]), F.lit(""))))
    keys = [c.strip() for c in key.split(",")]
    sized = rows.select(*keys, *[F.coalesce(F.col(c), F.lit("")).alias(f"_i{k}") for k, c in enumerate(inputs)], size.alias("_size"))
    dealt = sized.repartitionByRange(F.col("_size"), F.xxhash64(*keys))  # equal lengths are cut by the hash
    names = [f"_i{k}" for k in range(len(inputs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SORTED):
                part = batch.slice(begin, SORTED)
                sizes = part.column("_size").to_numpy()
                lists = [part.column(n).to_pylist() for n in names]
                made: list = [None] * part.num_rows
                for places in plan(sizes, tokens):
                    answers = model(*[[column[k] for k in places] for column in lists])
                    if len(answers) != len(places):
                        raise ValueError(f"the model gave {len(answers)} answers for {len(places)} texts")
                    for k, answer in zip(places, answers, strict=True):
                        made[k] = answer
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], pa.array(made, kind)], names=[*keys, output])

    kinds = dict(rows.dtypes)
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + f", {schema}")


def embed_with(model: Callable[[list[str]], list[list[float]]], tokens: int = TOKENS) -> Callable[[DataFrame], DataFrame]:
    """An embedder for Engine: (chunk_id, text) to (chunk_id, embedding). Null texts are embedded as empty ones."""
    return lambda rows: _applied(rows, "chunk_id", ["text"], "embedding", pa.list_(pa.float64()), "embedding array<double>", model, tokens)


def rerank_with(model: Callable[[list[str], list[str]], list[float]], tokens: int = TOKENS) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A reranker for retrieve: the model takes questions and texts and gives a score for each pair."""

    def run(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        pairs = candidates.select("query_id", "chunk_id", "text").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
        scores = _applied(pairs, "query_id, chunk_id", ["question", "text"], "rerank_score", pa.float64(), "rerank_score double", model, tokens)
        return candidates.join(scores, ["query_id", "chunk_id"])

    return run


def answer_with(model: Callable[[list[str], list[str]], list[str]], tokens: int = TOKENS) -> Callable[[DataFrame, int], DataFrame]:
    """An answerer for map_reduce_answers: the model takes questions and their sources."""

    def run(rows: DataFrame, _: int) -> DataFrame:
        keyed = rows.withColumn("_key", F.xxhash64("query_id", "place"))
        said = _applied(keyed.select("_key", "question", "text"), "_key", ["question", "text"], "answer", pa.string(), "answer string", model, tokens)
        return keyed.join(said, "_key").drop("_key")

    return run
