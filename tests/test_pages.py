"""Pages that were probed and read, their boxes and references, drafts, and what the sinks write, against plain versions."""

import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lectern import sinks as S
from lectern.functions import text as T
from lectern.operators import drafts as D
from lectern.operators import evaluation as E
from lectern.operators import ingest as I
from lectern.operators import pages as P
from lectern.plans import pages as Q
from lectern.sources import readers as X

DATA = "/root/testdata/sf0.001"


def plain_boxes(text, columns=80):
    """Boxes of long words, character by character."""
    out = []
    for m in re.finditer(r"[^\W\d_]{9,}", text):
        for line in range(m.start() // columns, (m.end() - 1) // columns + 1):
            a, b = max(m.start(), line * columns), min(m.end(), (line + 1) * columns)
            out.append((line * 14.0, (a - line * columns) * 6.0, (b - line * columns) * 6.0, line * 14.0 + 12))
    return out


def plain_blocks(boxes):
    """The fold over sorted boxes (top, left, right, bottom)."""
    out = []
    for t, x, r, b in sorted(set(boxes)):
        if out:
            o = out[-1]
            if x < o[2] and o[1] < r and t - o[3] <= 0.5 * max(o[3] - o[0], b - t):
                out[-1] = [min(o[0], t), min(o[1], x), max(o[2], r), max(o[3], b), o[4] + 1]
                continue
        out.append([t, x, r, b, 1])
    return out


def test_merged_boxes_of_all_documents(spark):
    got = {(r["document_id"], r["page"], r["block"]): [r[c] for c in ("top", "left", "right", "bottom", "n")] for r in Q.merged_boxes(spark, DATA).collect()}
    want = {}
    for row in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        text = row["text"] or ""
        for page in range(max(1, -(-len(text) // 1800))):
            for k, block in enumerate(plain_blocks(plain_boxes(text[page * 1800 : page * 1800 + 1800]))):
                want[row["doc_id"], page + 1, k] = block
    assert len(want) > 1000 and got == want


def test_merged_boxes_at_the_edges(spark):
    rows = [
        (1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 15.0, 10.0, 25.0), (1, 1, 0.0, 15.0, 10.0, 25.0),  # a gap of half the height joins, a repeated box counts once
        (1, 2, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 15.1, 10.0, 25.1),  # a wider gap doesn't
        (1, 3, 0.0, 0.0, 10.0, 10.0), (1, 3, 10.0, 0.0, 20.0, 10.0),  # boxes that only touch don't
        (1, 4, 5.0, 0.0, 5.0, 10.0), (1, 4, None, 0.0, 5.0, 10.0),  # boxes without a side are none
    ]
    boxes = spark.createDataFrame(rows, "document_id int, page int, left double, top double, right double, bottom double")
    got = sorted((r["page"], r["block"], r["bottom"], r["n"]) for r in P.merged_boxes(boxes).collect())
    assert got == [(1, 0, 25.0, 2), (2, 0, 10.0, 1), (2, 1, 25.1, 1), (3, 0, 10.0, 1), (3, 1, 10.0, 1)]
    assert P.merged_boxes(boxes.where("false")).collect() == []


def test_limited_boxes_keep_the_first_and_are_stored(spark):
    rows = [(c, k, k // 2, 0.0, float(k // 2), 5.0, float(k // 2 + 1)) for c in (1, 2) for k in range(50 if c == 1 else 6)]
    boxes = spark.createDataFrame(rows, "chunk_id int, place int, page int, left double, top double, right double, bottom double")
    got = P.limited_boxes(boxes, most=20).collect()
    assert sorted((r["chunk_id"], r["place"]) for r in got) == [(1, 2 * k) for k in range(20)] + [(2, 0), (2, 2), (2, 4)]
    sides = [F.col(c) for c in ("page", "left", "top", "right", "bottom")]
    back = boxes.select("page", "top", P.box_json(*sides).alias("j")).select("page", "top", "j", P.from_box_json(F.col("j")).alias("b")).first()
    assert (back["b"]["page"], back["b"]["t"]) == (back["page"], back["top"]) and '"l":0.0' in back["j"]


def test_merged_pages_take_the_newest_measure(spark):
    probed = spark.createDataFrame(
        [("a", 1, 0.1, 5.0, 700, "X", "extra"), ("a", 2, 0.2, 5.0, 0, "X", "extra"), ("b", 1, 0.3, 6.0, 9, "X", "extra"), (None, 1, 0.0, 0.0, 0, "X", "extra")],
        "document_id string, page int, cyrillic_ratio double, cost_weight double, char_to int, page_class string, version string",
    )
    read = spark.createDataFrame(
        [("a", 1, 1, 0.5, 0.9, 0, "Y"), ("a", 1, 2, None, 0.8, 800, None), ("a", 1, 3, 0.7, None, 900, "Z"), ("a", 3, 1, None, 0.6, 0, "Y"), ("a", 3, 1, None, 0.7, 0, "Y"), ("a", None, 1, 1.0, 1.0, 1, "Y")],
        "document_id string, page int, version int, cyrillic_ratio double, parse_score double, char_to int, page_class string",
    )
    look = ("document_id", "page", "readings", "cyrillic_ratio", "parse_score", "char_to", "cost_weight", "page_class")
    all_ = [tuple(r) for r in P.merged_pages(probed, read).select(*look).orderBy("document_id", "page").collect()]
    assert all_ == [("a", 1, 3, 0.7, 0.8, 900, 5.0, "Z"), ("a", 3, 2, None, 0.7, None, None, "Y"), ("b", 1, 0, 0.3, None, 9, 6.0, "X")]
    as_of = spark.createDataFrame([("a", 2), ("b", 0)], "document_id string, as_of int")
    early = [tuple(r) for r in P.merged_pages(probed, read, as_of=as_of).select(*look).where("page = 1").orderBy("document_id").collect()]
    assert early == [("a", 1, 2, 0.5, 0.8, 800, 5.0, None), ("b", 1, 0, 0.3, None, 9, 6.0, "X")]
    none = P.merged_pages(probed, read.where("false")).select("document_id", "page", "readings").orderBy("document_id", "page").collect()
    assert [tuple(r) for r in none] == [("a", 1, 0), ("a", 2, 0), ("b", 1, 0)]


def test_quantiles_and_rollups(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in rng.integers(0, 40, 500 if k == "a" else 7)] + [("a", None), ("b", float("nan")), ("c", None)]
    got = {r["k"]: [r["q0"], r["q1"], r["q2"]] for r in P.quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", (0.5, 0.95, 1.0)).collect()}
    want = {k: list(np.percentile([v for j, v in rows if j == k and v is not None and v == v], (50, 95, 100))) for k in ("a", "b", None)}
    assert {k: [round(x, 9) for x in v] for k, v in got.items()} == {k: [round(float(x), 9) for x in v] for k, v in want.items()}
    read = spark.createDataFrame([("d", "fast", 2, 4.0, 7.0, None), ("e", "fast", 4, 4.0, 9.0, None), ("f", "fast", 0, 4.0, 99.0, None), ("g", "fast", 1, 1.0, 99.0, "lost"), ("h", "none", 1, 1.0, 1.0, "lost")], "document_id string, mode string, pages int, seconds double, peak_mb double, error string")
    fast, none = P.mode_rollup(read).orderBy("mode").collect()
    assert (fast["documents"], fast["pages"], fast["mean"], fast["median"], fast["minutes_1000"], fast["peak_mb"], fast["failures"]) == (4, 6, 1.5, 1.5, 25.0, 9.0, 1)
    assert (none["documents"], none["pages"], none["mean"], none["p95"], none["failures"]) == (1, 0, None, None, 1)


MARKDOWN = "# A\n\ntext ![one](p.png) and ![two](q.png \"t\") again ![three](p.png)\n\n| x | y |\n|---|:-:|\n| 1 | 2 |\n| 3 | 4 |\n\n# B\n\n$$ a + b $$ then $$c$$\n\n| k |\n"


def test_references_of_a_tree(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "plain")], "doc_id int, text string")
    refs = {(r["document_id"], r["header_path"]): r["refs"] for r in I.chunk_tree(docs).where("level = 'L2'").collect()}
    a, b, plain = refs[1, "//A//"], refs[1, "//B//"], refs[3, "//"]
    assert a["pictures"] == {"p.png": "three", "q.png": "two"} and [tuple(x) for x in a["tables"]] == [(1, 3)] and a["formulas"] == []
    assert b["pictures"] == {} and [tuple(x) for x in b["tables"]] == [(1, 1)] and [tuple(x) for x in b["formulas"]] == [(1, "a + b"), (2, "c")]
    assert (plain["pictures"], plain["tables"], plain["formulas"]) == ({}, [], [])
    long = spark.createDataFrame([("|a|\n" * 30_000,)], "text string").select(P.references(F.col("text")).alias("r")).first()["r"]
    assert [tuple(x) for x in long["tables"]] == [(1, 30_000)]


def test_drafts_become_gold(spark):
    chunks = spark.createDataFrame(
        [("u1", "d1", "//A//Основи//", "Перше речення має  рівно\nодин два три чотири п'ять шість сім, вісім. Друге.", "с. 12–13"), ("u2", "d1", "//", "", None), ("u3", "d2", "//B∕C//", "One. Two.", "iv"), ("u4", "d9", None, None, "с. 7")],
        "chunk_uid string, document_id string, header_path string, text string, page_label string",
    )
    titles = spark.createDataFrame([("d1", "T1"), ("d2", None)], "document_id string, title string")
    said = {"One. Two.": "\n  Що таке один?  \nзайве", "": "Недостатньо інформації?"}
    drafts = D.draft_questions(chunks, D.draft_with(lambda texts: [said.get(t, "no question") for t in texts]), titles)
    got = {r["chunk_uid"]: r for r in drafts.collect()}
    assert got["u1"]["question"] == "Що навчальні матеріали зазначають про «Перше речення має рівно один два три чотири п'ять» (розділ «Основи»)?"
    assert (got["u2"]["question"], got["u2"]["source"]) == ("Що навчальні матеріали зазначають про «»?", "шаблон")
    assert (got["u3"]["question"], got["u3"]["source"], got["u3"]["document_title"]) == ("Що таке один?", "llm", "")
    assert got["u4"]["needs_review"] and got["u4"]["excerpt"] == ""
    gold = D.approve_drafts(drafts, "c", spark.createDataFrame([("u1",), ("u3",), ("zz",)], "chunk_uid string"))
    rows = {r["gold_chunk_uids"][0]: r for r in gold.collect()}
    assert rows.keys() == {"u1", "u3"} and rows["u1"]["gold_pages"] == ["d1:12"] and rows["u3"]["gold_pages"] == []
    assert rows["u1"]["note"] == "чернетка: шаблон; джерело: T1" and D.approve_drafts(drafts, "c").count() == 4
    known = chunks.select("chunk_uid", F.lit("c").alias("collection_id"), F.lit("L2").alias("level"))
    assert [r["issue"] for r in E.gold_issues(gold.withColumnRenamed("gold_chunk_uids", "gold_uids"), known).collect()] == ["too_few"]


def test_heading_only_keeps_digits_at_line_ends(spark):
    lines = spark.createDataFrame([("Розділ 1\n1",), ("Розділ.0\n2.1",), ("a sentence.",)], "text string")
    assert [r[0] for r in lines.select(T.heading_only(F.col("text"))).collect()] == [True, True, False]


def test_sinks_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    chunks = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "chunk_id int, collection_id string, text string")
    S.write_chunks(chunks.where("chunk_id = 1"), f"{root}/chunks")
    S.write_chunks(chunks.where("chunk_id = 2"), f"{root}/chunks")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/chunks").select("chunk_id", "collection_id", "text").collect()) == [(1, "a", "x"), (2, "b", "y")]
    assert {p.name for p in Path(tmp_path, "chunks").iterdir() if p.is_dir()} == {"collection_id=a", "collection_id=b"}
    values = spark.createDataFrame([(1, "mrr@3", 0.5)], "query_id int, metric string, value double")
    for run in ("r1", "r2"):
        S.save_run(values, f"{root}/runs", run, {"k": 3, "mode": "так"})
    runs = spark.read.parquet(f"{root}/runs").orderBy("run_id").collect()
    assert [(r["run_id"], r["value"], r["settings"]) for r in runs] == [(n, 0.5, '{"k": 3, "mode": "так"}') for n in ("r1", "r2")]
    gold = spark.createDataFrame([("q1", "c", 'a "quoted", question', ["00a", "1b1", "u2"], ["d:1"], ""), ("q2", "c", "none", [], [], "n")], "id string, collection_id string, question string, gold_chunk_uids array<string>, gold_pages array<string>, note string")
    S.write_gold_csv(gold, f"{root}/gold-csv")
    S.write_gold_json(gold, f"{root}/gold-json")
    for back in (X.read_gold_csv(spark, f"{root}/gold-csv"), X.read_gold_json(spark, f"{root}/gold-json")):
        assert [(r["id"], r["question"], r["gold_chunk_uids"]) for r in back.orderBy("id").collect()] == [("q1", 'a "quoted", question', ["00a", "1b1", "u2"]), ("q2", "none", [])]
    Path(tmp_path, "array.json").write_text('[\n {"id": "q1",\n  "question": "x"},\n {"id": "q2", "question": "y"}\n]\n')
    assert X.read_gold_json(spark, f"{root}/array.json").count() == 2
    S.write_report(values, f"{root}/report")
    S.write_report(values, f"{root}/report")
    assert spark.read.option("header", True).csv(f"{root}/report/csv").first()["metric"] == "mrr@3" and spark.read.json(f"{root}/report/json").count() == 1
