"""Hashed vectors against a plain version, and the checks of a model's vectors."""

import hashlib
import math
from collections import Counter

import regex

from lectern.operators import embedding as B
from lectern.plans import search as Q

WORD = regex.compile(r"[\p{L}\p{N}]+(?:['\-][\p{L}\p{N}]+)*")


def plain(text, dims=B.DIMS):
    counts = Counter()
    for w in WORD.findall((text or "").lower()):
        counts["w:" + w] += 1
        counts.update("g:" + f"<{w}>"[i : i + 3] for i in range(len(w)))
    v = [0.0] * dims
    for f, n in counts.items():
        h = hashlib.md5(f.encode()).hexdigest()
        v[int(h[:7], 16) % dims] += (1 if int(h[8:15], 16) % 2 == 0 else -1) * (1 if f[0] == "w" else B.TRIGRAM) * (1 + math.log(n))
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def test_vectors_equal_a_plain_version(spark):
    texts = ["one two two", None, "", "Ünï-code a", "!!!", "x " * 500]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "chunk_id long, text string, place int")
    got = {r["chunk_id"]: r["embedding"] for r in B.hashed_embedding(df).collect()}
    for k, t in enumerate(texts):
        assert max(abs(a - b) for a, b in zip(got[k], plain(t), strict=True)) < 1e-12
    assert B.hashed_embedding(df.limit(0)).count() == 0


def test_like_texts_have_like_vectors(spark):
    texts = ["the red fox jumps over the lazy dog", "the red fox jumped over a lazy dog", "quarterly revenue grew by nine percent"]
    a, b, c = (plain(t) for t in texts)
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert dot(a, b) > 0.6 > 0.4 > abs(dot(a, c))


def test_the_self_test_tells_what_fails(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, None)], "chunk_id long, embedding array<double>")
    known = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (9, [1.0, 0.0])], "chunk_id long, embedding array<double>")
    texts = spark.createDataFrame([(1, "q: short"), (2, "no prefix"), (3, "q: " + "long word " * 600), (4, None)], "chunk_id long, text string")
    got = {r["check"]: (r["tested"], r["failed"]) for r in B.self_test(v, known, texts, "q: ").collect()}
    assert got == {"reference": (3, 2), "norm": (3, 2), "prefix": (4, 2), "budget": (4, 1)}


def test_the_self_test_of_documents_passes(spark):
    rows = {r["check"]: r["failed"] for r in Q.embedding_self_test(spark, "/root/testdata/sf0.001").collect()}
    assert rows == {"reference": 0, "norm": 0, "prefix": 0, "budget": 0}


def test_the_self_test_reads_whole_documents(spark, tmp_path):
    """What stands behind a document's beginning is tested too: its tail has more words, so more tokens, than any other piece."""
    texts = ["x" * 300 + "\n" + "b " * 149 + "c", "y" * 901, "short", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["check"]: (r["tested"], r["failed"], r["worst"]) for r in Q.embedding_self_test(spark, str(tmp_path)).collect()}
    assert rows["prefix"] == (7, 0, 1.0) and rows["budget"] == (7, 0, float(int(151 * 2.35) + 1))
    pieces = Q.passages(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "chunk_id long, text string"), "").orderBy("chunk_id").collect()
    assert all("".join(p["text"] for p in pieces if p["chunk_id"] == k) == (t or "") for k, t in enumerate(texts))


def test_rows_of_one_key_are_one_chunk(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "two"), (2, "aaaa aaa"), (None, "lost"), (3, None)], "chunk_id long, text string")
    got = [(r["chunk_id"], r["embedding"]) for r in B.hashed_embedding(df, 16).collect()]
    assert sorted(str(k) for k, _ in got) == ["1", "1", "2", "3", "None"]
    want = {1: plain("one two two", 16), 2: plain("aaaa aaa", 16)}
    assert all(max(abs(a - b) for a, b in zip(v, want.get(k, [0.0] * 16), strict=True)) < 1e-12 for k, v in got)


def test_features_are_not_shuffled(spark, monkeypatch):
    """Words are counted where a row lies, also if a row has more than a slice of them: only keys meet in an exchange."""
    monkeypatch.setattr(B, "SLICE", 3)
    texts = ["a b c d e", "", "one two", "x", "b b b b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    out = B.hashed_embedding(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["chunk_id"]: r["embedding"] for r in out.collect()}
    assert all(max(abs(a - b) for a, b in zip(got[k], plain(t), strict=True)) < 1e-12 for k, t in enumerate(texts))
