"""Models as functions: batches by length, and the hooks that take them."""

import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.operators import generation as G
from lectern.operators import models as M
from lectern.operators import retrieval as R
from lectern.plans import documents as D


def test_batches_keep_to_the_budget_and_pad_little():
    rnd = random.Random(1)
    sizes = [int(rnd.lognormvariate(5, 1)) for _ in range(1000)] + [0, 20_000]
    batches = M.plan(sizes)
    assert sorted(k for b in batches for k in b) == list(range(len(sizes)))
    assert all(len(b) == 1 or len(b) * max(sizes[k] for k in b) <= M.TOKENS for b in batches) and max(map(len, batches)) <= M.TEXTS
    unsorted = [np.arange(b, min(b + 32, len(sizes))) for b in range(0, len(sizes), 32)]
    assert M.padding(sizes, batches) < 1.2 < 2 < M.padding(sizes, unsorted)
    assert M.plan([]) == []


def test_an_embedder_sees_all_texts_once(spark):
    model = lambda texts: [[float(len(t)), float(max(map(len, texts)) * len(texts))] for t in texts]
    rows = [(k, "word " * (k % 40), 0.5) for k in range(500)] + [(900, None, 0.1)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, embedding double")
    got = {r["chunk_id"]: r["embedding"] for r in M.embed_with(model, 512)(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: float(len(t or "")) for k, t, _ in rows}
    assert max(v[1] for v in got.values()) <= 512 * 5
    assert M.embed_with(model)(df.limit(0)).count() == 0


def test_a_model_that_loses_texts_is_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, text string")
    with pytest.raises(PythonException, match="answers"):
        M.embed_with(lambda texts: [])(df).collect()


def test_a_reranker_is_asked_for_each_pair(spark):
    chunks, queries = D.searched(spark, "/root/testdata/sf0.001")
    q = queries.limit(2)
    hits = spark.createDataFrame([(r["query_id"], k, 1.0, k) for r in q.collect() for k in (1, 2, 3)], "query_id long, chunk_id long, score double, rank int")
    model = lambda questions, texts: [len(t) / 1e6 for _, t in zip(questions, texts, strict=True)]
    got = R.retrieve(chunks, q, Config(weight_char_ngram=0.0), dense_hits=hits, sparse_hits=hits, reranker=M.rerank_with(model))
    sizes = dict(chunks.where("chunk_id in (1, 2, 3)").select("chunk_id", F.length(F.coalesce("text", F.lit("")))).collect())
    assert {(r["chunk_id"], round(r["rerank_score"] * 1e6)) for r in got["candidates"].collect()} == set(sizes.items())


def test_a_model_answers_and_reduces(spark):
    model = lambda questions, texts: [f"{q}:{t.count('[')}" for q, t in zip(questions, texts, strict=True)]
    evidence = spark.createDataFrame([(1, 1, "a", "One. Two."), (1, 2, "b", "Three.")], "query_id long, ordinal int, document_id string, text string")
    out = G.map_reduce_answers(evidence, spark.createDataFrame([(1, "why")], "query_id long, text string"), answerer=M.answer_with(model)).first()
    assert (out["answer"], out["documents"], out["levels"]) == ("why:0", 2, 2)
