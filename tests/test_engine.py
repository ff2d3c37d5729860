"""From Markdown to answers: what ingest makes, retrieve takes."""

import pytest
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.engine import Engine
from lectern.operators import ingest as I

FOX = "The red fox lives in the northern forest and hunts at night. " * 12
OWL = "The barn owl nests in old towers and eats small mice every evening. " * 12
DOCS = [
    (1, f"# Animals\n\n## Fox\n\n{FOX}\n\n| kind | weight |\n|---|---|\n| fox | 6 kg |\n\n## Owl\n\n{OWL}\n\n```\ncode stays whole\n```\n", "Field guide"),
    (2, "# Engines\n\nA diesel engine compresses air until fuel burns by itself; it needs no spark. " + "Compression is high. " * 40, "Motors"),
    (3, None, "Empty"),
    (4, "# Animals\n\nshort", "Note"),
]
ASKED = [(1, "Where does the barn owl nest?"), (2, "Which engine needs no spark?"), (3, "zzz qqq")]


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    documents = docs.select(F.col("doc_id").alias("document_id"), "title", F.lit(1).alias("created_at"))
    empty = Engine({"documents": documents})
    chunks = empty.ingest(docs, title="title").cache()
    return Engine({"documents": documents, "chunks": chunks}, Config(confidence_required="low"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(ASKED, "query_id long, text string")


def test_the_tree_holds_together(spark, engine):
    rows = engine.tables["chunks"].collect()
    by_id = {r["chunk_id"]: r for r in rows}
    assert len(by_id) == len(rows) and {r["document_id"] for r in rows} == {1, 2, 4}
    for r in rows:
        up = by_id.get(r["parent_id"])
        assert (r["level"], up and up["level"]) in (("L0", None), ("L1", "L0"), ("L2", "L1"))
        assert (r["simhash"] is not None) == (r["embedding"] is not None) == (r["level"] == "L2")
        if r["level"] == "L2":
            assert r["text"].strip() and len(r["text"]) <= I.HARD and r["header_path"] == up["header_path"] and r["document_id"] == up["document_id"]
    paths = {r["header_path"] for r in rows if r["document_id"] == 1 and r["level"] == "L1"}
    assert paths == {"//Animals//Fox//", "//Animals//Owl//"}
    for parent in {r["parent_id"] for r in rows if r["level"] == "L2"}:
        own = sorted((r["sibling"], r["siblings"]) for r in rows if r["parent_id"] == parent)
        assert own == [(i, len(own)) for i in range(len(own))]


def test_leaves_cover_their_sections(engine):
    rows = engine.tables["chunks"].collect()
    for section in (r for r in rows if r["level"] == "L1"):
        leaves = " ".join(r["text"] for r in rows if r["parent_id"] == section["chunk_id"])
        assert set(section["text"].split()) == set(leaves.split())
    assert any("code stays whole" in r["text"] and r["text"].count("```") % 2 == 0 for r in rows if r["level"] == "L2")


def test_ids_do_not_depend_on_the_run(spark, engine):
    docs = spark.createDataFrame(DOCS[::-1], "doc_id long, text string, title string").repartition(3)
    again = {(r["chunk_id"], r["chunk_uid"]) for r in engine.ingest(docs, title="title").collect()}
    assert again == {(r["chunk_id"], r["chunk_uid"]) for r in engine.tables["chunks"].collect()}


def test_a_document_that_repeats_another_is_not_ingested(spark, engine):
    docs = spark.createDataFrame([*DOCS, (9, DOCS[1][1], "Copy")], "doc_id long, text string, title string")
    assert {r["document_id"] for r in engine.ingest(docs, title="title").select("document_id").distinct().collect()} == {1, 2, 4}


def test_questions_find_their_sections(engine, queries):
    got = engine.retrieve(queries)
    first = {r["query_id"]: r for r in got["selected"].where("ordinal = 1").collect()}
    assert "owl" in first[1]["text"] and first[2]["document_id"] == 2
    decisions = {r["query_id"]: r["abstain"] for r in got["decisions"].collect()}
    assert not decisions[1] and not decisions[2] and decisions[3]


def test_answers_cite_and_refusals_say_so(engine, queries):
    got = {r["query_id"]: r for r in engine.answer(queries).collect()}
    assert "barn owl nests" in got[1]["answer"] and "[1]" in got[1]["answer"]
    assert got[3]["abstain"] and "[1]" not in got[3]["answer"]


def test_prompts_and_the_playground(engine, queries):
    prompt = engine.prompt_preview(queries.where("query_id = 1")).first()
    assert ASKED[0][1] in prompt["prompt"] and "barn owl" in prompt["prompt"] and prompt["citations"]["1"]
    both = engine.playground(queries.where("query_id = 2")).collect()
    assert min(r["before"] for r in both) == 1 and min(r["after"] for r in both if r["after"]) == 1


def test_models_are_given_as_functions(spark, engine, queries):
    fixed = lambda rows: rows.select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    last = lambda rows, _: rows.withColumn("rerank_score", F.when(F.col("document_id") == 4, 0.9).otherwise(0.1))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    mine = Engine(engine.tables, Config(), embedder=fixed, reranker=last)
    chunks = mine.ingest(docs, title="title")
    assert {tuple(r["embedding"]) for r in chunks.where("level = 'L2'").collect()} == {(1.0, 0.0)}
    mine.tables = {**engine.tables, "chunks": chunks}
    got = mine.retrieve(queries.where("query_id = 1"))["selected"].where("ordinal = 1").first()
    assert got["document_id"] == 4
