"""Answers by document, reduced level by level, and what is published whole."""

import pytest
import regex
from pyspark.sql import functions as F

from lectern import sinks
from lectern.operators import generation as G
from lectern.plans import documents as D
from lectern.staging import new_folder, versions

EVIDENCE = "query_id long, ordinal int, document_id string, text string"


def test_best_lines_keep_their_order_and_size(spark):
    rows = spark.createDataFrame([(1, "red foxes hunt", "Dogs sleep [1]\nThe red fox hunts [2]\nFoxes hunt red mice [3]"), (2, "nothing here", "Dogs sleep [1]"), (3, "red", "")], "query_id long, question string, text string")
    got = {r["query_id"]: r["answer"] for r in G.best_lines(rows, 1000).collect()}
    assert got == {1: "The red fox hunts [2]\nFoxes hunt red mice [3]", 2: "", 3: ""}
    assert G.best_lines(rows, 1).where("query_id = 1").first()["answer"] == "Foxes hunt red mice [3]"


def test_answers_are_reduced_until_one_is_left(spark):
    seen = []

    def answerer(rows, tokens):
        done = rows.withColumn("answer", F.when(F.contains("text", F.lit("NOTHING")), "").otherwise(F.concat(F.lit("("), F.replace("text", F.lit("\n"), F.lit(",")), F.lit(")"))))
        seen.append(sorted((r["query_id"], r["text"]) for r in done.collect()))
        return done

    evidence = [(1, k, f"d{k}", f"S{k}.") for k in range(1, 6)] + [(1, 6, "d1", "More."), (1, 7, "d9", "NOTHING."), (2, 1, "d1", "Only."), (3, 1, "d1", "NOTHING."), (4, 1, "d1", None)]
    queries = spark.createDataFrame([(k, "q") for k in range(1, 6)], "query_id long, text string")
    got = {r["query_id"]: (r["answer"], r["documents"], r["levels"]) for r in G.map_reduce_answers(spark.createDataFrame(evidence, EVIDENCE), queries, 1, 10, answerer).collect()}
    assert got[2] == ("(Only. [1])", 1, 1) and 3 not in got and 5 not in got
    answer, documents, levels = got[1]
    assert documents == 5 and levels == 4 and answer == "((((S1. [1]),(S2. [2])),((S3. [3]),(S4. [4]))),(S5. [5]))"
    assert all(text.count("\n") <= 1 for level in seen[1:] for _, text in level)


def test_a_group_keeps_to_the_budget(spark):
    sizes = []

    def answerer(rows, tokens):
        sizes.extend(r["n"] for r in rows.select(G.T.token_estimate(F.col("text")).alias("n")).collect())
        return G.best_lines(rows, tokens)

    evidence = D.found(spark, "/root/testdata/sf0.001", 20).join(D.chunks(spark, "/root/testdata/sf0.001"), "chunk_id").select("query_id", F.col("rank").alias("ordinal"), "document_id", F.substring("text", 1, 2000).alias("text"))
    out = G.map_reduce_answers(evidence, D.asked(spark, "/root/testdata/sf0.001"), 900, 120, answerer).collect()
    assert len(out) == 40 and max(r["levels"] for r in out) > 1
    assert max(sizes) <= 2 * 900


def test_answers_of_documents_cite_their_sources(spark):
    d = "/root/testdata/sf0.001"
    out = D.map_reduce_answers(spark, d).collect()
    assert len(out) == 40
    for r in out:
        cited = {int(n) for n in regex.findall(r"\[(\d+)\]", r["answer"])}
        assert cited and cited <= set(range(1, 21))


def test_leaves_below_sections(spark):
    chunks = spark.createDataFrame([(1, "L1", None), (2, "L2", 1), (3, "L2", 1), (4, "L2", None)], "chunk_id long, level string, parent_id long")
    selected = spark.createDataFrame([(9, 1), (9, 4), (8, 3)], "query_id long, chunk_id long")
    assert {tuple(r) for r in G.leaves_of(selected, chunks).collect()} == {(9, 1, 2), (9, 1, 3), (9, 4, 4), (8, 3, 3)}


def test_changed_vectors_are_another_version(spark):
    root = new_folder(spark, "vectors")
    frame = lambda x: spark.createDataFrame([(1, [3.0, 4.0]), (2, [x, 0.0])], "chunk_id long, embedding array<double>")
    a, again, b = (sinks.publish_vectors(frame(x), root, "m") for x in (1.0, 1.0, -1.0))
    assert a == again != b and [v for _, v in versions(spark, root)] == [a, b]
    assert {r["chunk_id"]: r["embedding"] for r in sinks.read_vectors(spark, root).collect()} == {1: [0.6, 0.8], 2: [-1.0, 0.0]}
    sinks.publish_vectors(frame(1.0), root, "m")
    assert {r["chunk_id"]: r["embedding"] for r in sinks.read_vectors(spark, root).collect()}[2] == [1.0, 0.0]


@pytest.mark.parametrize("models", [[{"w": [1.0]}], [{"w": [1.0]}, {"w": [2.0], "b": "ї"}]])
def test_the_newest_calibration_is_read(spark, models):
    root = new_folder(spark, "calibration")
    for m in models:
        sinks.save_calibration(spark, m, root)
    assert sinks.load_calibration(spark, root) == models[-1]
