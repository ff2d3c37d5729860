"""Comparisons of runs, arms, chapters, citations, lexicons, deletes and rates, on small frames."""

import itertools
import math
import random

import pytest

from lectern.config import Config
from lectern.functions import normalize
from lectern.operators import evaluation as E
from lectern.operators import generation as G
from lectern.operators import ingest as I
from lectern.operators import operations as O
from lectern.operators import retrieval as R
from lectern.plans import documents as D

VALUES = "query_id long, metric string, value double"


def runs(spark, differences, metric="m"):
    base = spark.createDataFrame([(k, metric, 0.5) for k in range(len(differences))], VALUES)
    return base, spark.createDataFrame([(k, metric, 0.5 + d) for k, d in enumerate(differences)], VALUES)


def exact_p(d):
    signs = list(itertools.product((-1, 1), repeat=len(d)))
    return sum(abs(sum(s * x for s, x in zip(c, d, strict=True))) >= abs(sum(d)) - 1e-9 for c in signs) / len(signs)


def test_the_randomisation_test_is_near_the_exact_one(spark):
    rnd = random.Random(1)
    d = [rnd.choice([0.1, 0.2, -0.1, 0.3]) for _ in range(10)]
    got = E.compare_runs(*runs(spark, d)).first()
    assert abs(got["p_random"] - exact_p(d)) < 0.02
    again = E.compare_runs(*[x.repartition(5) for x in runs(spark, d)]).first()
    assert again["p_random"] == got["p_random"]
    mean = sum(d) / 10
    t = mean / (math.sqrt(sum((x - mean) ** 2 for x in d) / 9) / math.sqrt(10))
    assert abs(got["t"] - t) < 1e-9 and abs(got["p_t"] - E.student_p(t, 9)) < 1e-12
    assert got["n"] == 10 and abs(got["gain"] - mean / 0.5 * 100) < 1e-9


@pytest.mark.parametrize(("d", "t", "p"), [([0.0, 0.0], 0.0, 1.0), ([0.1], None, None), ([0.25, 0.25, 0.25], math.inf, 0.0)])
def test_runs_that_hardly_differ(spark, d, t, p):
    got = E.compare_runs(*runs(spark, d), rounds=200).first()
    assert (got["t"], got["p_t"]) == (t, p) and 0 < got["p_random"] <= 1


def test_only_common_queries_count(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 1.0), (1, "b", 0.0)], VALUES)
    other = spark.createDataFrame([(1, "a", 0.0), (2, "a", 1.0), (4, "a", 1.0), (1, "b", 1.0)], VALUES)
    got = {r["metric"]: r for r in E.compare_runs(base, other, rounds=50).collect()}
    assert got["a"]["n"] == 1 and got["a"]["gain"] == -100 and got["b"]["gain"] == math.inf


def test_arms_are_told_apart_by_their_settings(spark):
    chunks, queries = D.searched(spark, "/root/testdata/sf0.001")
    gold = D.gold(spark, "/root/testdata/sf0.001")
    some = queries.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    rows = E.run_arms(chunks, some, gold, [E.arms()[0], E.arms()[3]]).collect()
    value = {(r["arm"], r["query_id"], r["metric"]): r["value"] for r in rows}
    assert {a for a, _, _ in value} == {"bm25", "hybrid+rerank"} and len(value) == 2 * 29 * some.count()
    assert all(value["bm25", q, "recall@10"] == 1 for _, q, _ in value)
    assert [a[0] for a in E.weight_arms()][:2] == ["w_sparse=0/w_ngram=0", "w_sparse=0/w_ngram=0.4"] and [c.final_top_k for _, c, _ in E.top_k_arms(Config())] == [2, 3, 5, 8, 12]


def test_chapters_by_the_last_title(spark):
    chunks = spark.createDataFrame([(1, "//A//B//"), (1, "//"), (1, "//C∕D//"), (2, "//B//")], "document_id long, header_path string")
    chapters = spark.createDataFrame([(1, 10, " B ", 1), (1, 11, "B", 5), (1, 12, "C/D", 3)], "document_id long, chapter_id long, title string, lft long")
    got = {(r["document_id"], r["header_path"]): r["chapter_id"] for r in I.chapter_of(chunks, chapters).collect()}
    assert got == {(1, "//A//B//"): 11, (1, "//"): None, (1, "//C∕D//"): 12, (2, "//B//"): None}


def test_citations_of_touching_pages_become_one(spark):
    rows = [(1, 1, 3, 10, 12), (1, 1, 1, 13, 13), (1, 1, 2, 20, None), (1, 2, 4, 11, 11), (2, 1, 5, 12, 12)]
    got = {tuple(r) for r in G.merge_citations(spark.createDataFrame(rows, "message_id long, document_id long, ordinal int, page_from int, page_to int")).select("message_id", "document_id", "ordinal", "page_from", "page_to").collect()}
    assert got == {(1, 1, 1, 10, 13), (1, 1, 2, 20, 20), (1, 2, 4, 11, 11), (2, 1, 5, 12, 12)}


def test_the_share_of_known_words(spark):
    lexicon = spark.createDataFrame([("кіт", "word"), ("стріл", "stem"), ("a", "stem")], "word string, kind string")
    pages = spark.createDataFrame([(1, "кіт стріляти стрілець дім " * 3), (2, "кіт дім"), (3, None)], "page long, text string")
    got = {r["page"]: r["hit_rate"] for r in normalize.lexicon_hit_rate(pages, lexicon, "page").collect()}
    assert abs(got[1] - 0.75) < 1e-9 and got.get(2) is None and got.get(3) is None


def test_deletes_reach_all_levels(spark):
    docs = spark.createDataFrame([(1,), (2,)], "document_id long")
    chunks = spark.createDataFrame([(10, 1), (20, 2)], "chunk_id long, document_id long")
    notes = spark.createDataFrame([(100, 10), (200, 20)], "note_id long, chunk_id long")
    other = spark.createDataFrame([(5,)], "other_id long")
    tables = {"document": (docs, "document_id", None), "chunk": (chunks, "chunk_id", "document"), "note": (notes, "note_id", "chunk"), "other": (other, "other_id", None)}
    left = O.cascade(tables, spark.createDataFrame([(1,), (1,)], "document_id long"), "document")
    assert {n: [r[0] for r in left[n].collect()] for n in tables} == {"document": [2], "chunk": [20], "note": [200], "other": [5]}


def test_the_rate_is_smoothed(spark):
    samples = spark.createDataFrame([(1, 0.0, 0.0, 100.0), (1, 10.0, 10.0, 100.0), (1, 20.0, 40.0, 100.0), (2, 0.0, 5.0, 9.0)], "job long, at double, done double, total double")
    got = {r["job"]: (r["rate"], r["eta"]) for r in O.smoothed_eta(samples, "job").collect()}
    rate = 0.3 * 3 + 0.7 * 1
    assert abs(got[1][0] - rate) < 1e-9 and abs(got[1][1] - 60 / rate) < 1e-9 and got[2] == (None, None)


def test_near_hashes_and_pairs_equal_all_comparisons(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(30)]
    rows = [(k, (h ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))))) for k, h in enumerate(rnd.choice(base) for _ in range(150))]
    signed = [(k, h - (1 << 64) if h >> 63 else h) for k, h in rows] + [(999, None)]
    df = spark.createDataFrame(signed, "chunk_id long, simhash long")
    apart = lambda x, y: bin((x ^ y) & ((1 << 64) - 1)).count("1")
    want = {(a, b, apart(x, y)) for (a, x), (b, y) in itertools.combinations(signed[:-1], 2) if apart(x, y) <= 3}
    assert {tuple(r) for r in R.near_pairs(df).collect()} == want
    hashes = {h for _, h in signed[:-1]}
    assert R.near_hashes(df).where("x = y").count() == len(hashes)


def test_near_pairs_are_made_of_blocks(spark, monkeypatch):
    """Hashes that many chunks share: after the last shuffle come blocks of ids, and every pair is told once, however blocks interleave."""
    monkeypatch.setattr(R, "ID_BLOCK", 8)
    monkeypatch.setattr(R, "TASK_PAIRS", 100)
    hashes, moved = [0, 1, 3, 7, -1, 1 << 40], []
    rows = [(k, hashes[k * k % 6]) for k in range(180)] + [(500 + k, 7) for k in range(40)]
    monkeypatch.setattr(R, "crossed", lambda *a, known=R.crossed: moved.append(known(*a)) or moved[-1])
    got = [tuple(r) for r in R.near_pairs(spark.createDataFrame(rows, "chunk_id long, simhash long")).collect()]
    apart = lambda x, y: bin((x ^ y) & ((1 << 64) - 1)).count("1")
    assert sorted(got) == sorted((a, b, apart(x, y)) for (a, x), (b, y) in itertools.combinations(rows, 2) if apart(x, y) <= 3)
    assert moved[0].count() < len(got) / 10


def test_the_best_threshold_does_not_depend_on_ranges(spark):
    rnd = random.Random(3)
    rows = [(float(rnd.randint(0, 40)), rnd.choice([0, 1, 1, None])) for _ in range(500)]
    samples = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, x in rows if x == 1], [s for s, x in rows if x == 0]
    j = {t: round(sum(s >= t for s in pos) / len(pos) - sum(s >= t for s in neg) / len(neg), 9) for t in {s for s, _ in rows}}
    best = min(j, key=lambda t: (-j[t], t))
    assert tuple(E.youden(samples, "score", "label").first()) == (best, j[best])
    assert E.youden(samples.where("label = 1"), "score", "label").count() == 0 and E.youden(samples.limit(0), "score", "label").count() == 0
