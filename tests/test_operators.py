from pyspark.sql import functions as F

from lectern.operators import evaluation, ingest, retrieval
from lectern.sources.readers import html_grid, markdown_grid


def test_elements_and_chunks():
    text = "# A\n\npara one\npara two\n\n### B/b\n- x\n- y\n\n|a|b|\n|-|-|\n|1|2|\n\n```\n# not a heading\n```\n"
    assert [(k, n) for k, n, _ in ingest.elements(text)] == [("heading", 1), ("paragraph", 0), ("heading", 3), ("list", 0), ("table", 0), ("code", 0)]
    rows = ingest.chunk_rows(1, text)
    assert [r["ordinal"] for r in rows] == list(range(len(rows)))
    assert [r["level"] for r in rows] == ["L0", "L1", "L1", "L2", "L2"] and {r["header_path"] for r in rows} == {"//", "//A//", "//A//B∕b//"}
    assert [(r["parent"], r["sibling"], r["siblings"]) for r in rows[3:]] == [(1, 0, 1), (2, 0, 1)]
    assert ingest.chunk_rows(1, None) == []
    long = ingest.chunk_rows(1, ("word " * 3000).strip())
    assert max(len(r["text"]) for r in long if r["level"] == "L2") <= ingest.HARD


def test_fusion_order_and_empty_branch(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id long, chunk_id long, rank int")
    got = retrieval.fuse({"a": (a, 1.0), "b": (b, 0.6), "c": (b, 0.0)}).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [11, 10] and abs(got[0]["rrf"] - (1 / 62 + 0.6 / 61)) < 1e-12


def test_abstains_without_candidates(spark):
    scored = spark.createDataFrame([(1, 5, 0.9)], "query_id long, chunk_id long, score double")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r["query_id"]: r["abstain"] for r in retrieval.abstention(scored, asked, 0.5).collect()}
    assert got == {1: False, 2: True}


def test_student_p():
    assert abs(evaluation.student_p(2.228, 10) - 0.05) < 1e-3
    assert evaluation.student_p(0.0, 5) == 1.0


def test_grids():
    assert html_grid("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [["a", "b"], ["a", "c"]]
    assert markdown_grid("|a|b|\n|--|:-|\n|1| 2 |") == [["a", "b"], ["1", "2"]]


def test_error_rate_of_every_item(spark, tmp_path):
    from lectern.plans import registry

    texts = {i: "e" * (i % 7) + "abc" for i in range(490, 520)} | {600: None, 601: ""}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["query_id"]: r["cer"] for r in registry.queries()["cer"](spark, str(tmp_path)).collect()}
    assert set(got) == set(texts) and all(got[i] == round(t.count("e") / len(t), 6) for i, t in texts.items() if t)


def test_long_and_atomic_texts_are_cut_where_allowed():
    assert all(len(p) <= ingest.SOFT for p in ingest.split_text("x" * 300_000))
    table = "\n".join(f"|{i}|{'v' * 90}|" for i in range(100))
    parts = [r["text"] for r in ingest.chunk_rows(1, table) if r["level"] == "L2"]
    assert len(parts) > 1 and "\n".join(parts) == table
    code = "```\n" + "line of code\n" * 500 + "```"
    assert [r["text"] for r in ingest.chunk_rows(1, code) if r["level"] == "L2"] == [code]


def test_normalisation():
    from lectern.functions.normalize import normalize_text

    assert normalize_text("гар-\nмата") == "гармата" and normalize_text("п\u2019ять") == "п'ять" and normalize_text(None) == ""
    assert normalize_text("Straße") == "strasse" and normalize_text("Д\u201130") == "д-30"
    assert normalize_text("гaубиця") == "гаубиця" and normalize_text("PDF-файл") == "pdf-файл" and normalize_text("PDFфайл") == "pdfфайл"
    once = normalize_text("Об\u02bcєкт \u2014 Iнша")
    assert normalize_text(once) == once


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from lectern.functions import text as T

    def one(*columns):
        return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())

    assert one(*[T.lexical_anchor(F.lit(x)) for x in ("за ДСТУ", "слово", "„так“", "mil-std", "TUN", "п'ять")]) == (True, False, True, True, False, False)
    assert one(T.mojibake_ratio(F.lit("ab\x0c\n")), T.mojibake_ratio(F.lit("/g12ab")), T.mojibake_ratio(F.lit("\U000f0001x"))) == (0.0, 4 / 6, 0.5)
    page = lambda *x: T.page_class(*[F.lit(v) for v in x])
    assert one(page(10, 0.3, 0.9, 0.0, 0.0), page(10, 0.2, 0.9, 0.0, 0.0), page(50, 0.0, 0.03, 0.0, 1.0), page(50, 0.9, 0.0, 0.4, 0.4), page(50, 0.3, 0.0, 0.0, 0.0), page(50, 0.0, 0.0, 0.4, None)) == ("SCANNED", "DIGITAL_CLEAN", "DIGITAL_BROKEN", "DIGITAL_BROKEN", "MIXED", "DIGITAL_CLEAN")
    assert one(*[T.roman(F.lit(n)) for n in (0, 4, 9, 14, 1990)]) == ("", "iv", "ix", "xiv", "mcmxc")
    assert one(*[T.from_roman(F.lit(x)) for x in ("xiv", "MCMXC", "iix", "", "5")]) == (14, 1990, None, None, None)
    assert one(*[T.alpha_label(F.lit(n)) for n in (1, 26, 27, 53)]) == ("a", "z", "aa", "aaa")
    label = lambda *x: T.citation_label(*[F.lit(v) for v in x])
    assert one(label("xii", "xiv", 1, 2), label(None, None, 3, 3), label(None, None, None, None)) == ("с. xii–xiv", "с. 3", "")
    assert one(T.quote(F.lit("A  b. " + "w" * 5)), T.quote(F.lit("word " * 20), 20)) == ("A b. wwwww", "word word word word…")
    assert one(T.quote(F.lit("one two three. four five six seven"), 20))[0] == "one two three."
    assert one(T.sanitize_display(F.lit(" <header>x</header>a  \n\n\n\nb<page_separator/>")))[0] == "a\n\nb"
    assert one(T.simhash(F.split(F.lit("a b c d e"), " ")) == T.simhash(F.split(F.lit("a b c d e"), " ")), T.simhash(F.array().cast("array<string>"))) == (True, 0)
    assert one(T.embed_text(F.lit("note"), F.lit("//A//B//"), F.lit("t")), T.rerank_text(F.lit("//A//B//"), F.lit("t"))) == ("note\nA › B\nt", "B\nt")


def test_fusion_counts_a_repeated_chunk_once(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 3)], "query_id long, chunk_id long, rank int")
    got = {r["chunk_id"]: r["rrf"] for r in retrieval.fuse({"a": (a, 1.0)}).collect()}
    assert abs(got[10] - 1 / 61) < 1e-12 and abs(got[11] - 1 / 62) < 1e-12


def test_deduplication_packing_and_diversity(spark):
    rows = [(1, 1, 1, 7, [1.0, 0.0]), (1, 2, 2, 7, [1.0, 0.0]), (1, 3, 3, 7, [0.0, 1.0]), (1, 4, 4, None, [1.0, 0.0]), (1, 5, 5, 7 ^ 15, None), (1, 6, 6, 6, None)]
    ranked = spark.createDataFrame([r[:4] for r in rows], "query_id long, chunk_id long, rank int, simhash long")
    vectors = spark.createDataFrame([(r[1], r[4]) for r in rows if r[4]], "chunk_id long, embedding array<double>")
    got = {r["chunk_id"]: r["duplicate_of"] for r in retrieval.deduplicate(ranked, vectors).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: 1}
    sized = spark.createDataFrame([(1, 1, 1, 90), (1, 2, 2, 20), (1, 3, 3, 10), (2, 4, 1, 500)], "query_id long, chunk_id long, rank int, size int")
    assert {r["chunk_id"] for r in retrieval.pack(sized, 100).collect()} == {1, 3, 4}
    one = spark.createDataFrame([(1, c, d, s, k) for k, (c, d, s) in enumerate([(1, "a", 1.0), (2, "a", 0.9), (3, "a", 0.8), (4, "b", 0.7), (5, "c", 0.3)], 1)], "query_id long, chunk_id long, document_id string, score double, rank int")
    pick = lambda k, per: [r["chunk_id"] for r in retrieval.diversify(one, k, per, 0.6).orderBy("position").collect()]
    assert pick(5, 2) == [1, 2, 3, 4] and pick(2, 2) == [1, 4] and pick(3, 1) == [1, 2, 4]


def test_citations_and_claims(spark):
    from lectern.operators import generation as G

    answers = spark.createDataFrame([("m", "Так [1, 7] . Ні [2][9]."), ("n", "Без цитат")], "message_id string, content string")
    evidence = spark.createDataFrame([("m", 1, "u1"), ("m", 2, "u2")], "message_id string, ordinal int, chunk_uid string")
    texts, citations, unresolved = G.resolve_citations(answers, evidence)
    assert {r["message_id"]: r["content"] for r in texts.collect()} == {"m": "Так [1]. Ні [2].", "n": "Без цитат"}
    assert [(r["ordinal"], r["chunk_uid"]) for r in citations.orderBy("place").collect()] == [(1, "u1"), (2, "u2")]
    assert sorted(r["marker"] for r in unresolved.collect()) == ["[7]", "[9]"]
    said = spark.createDataFrame([(1, "Див. рис. 3. Дальність 15300 м. Це друге твердження [1]. Коротко."), (2, None), (3, ""), (4, "Перше речення тут?  «Друге речення тут!» і далі. (Третє речення) кінець")], "message_id long, content string")
    got = {(r["message_id"], r["claim_no"]): r["claim"] for r in G.claims(said).collect()}
    assert got == {(1, 0): "Див. рис. 3. Дальність 15300 м.", (1, 1): "Це друге твердження [1].", (4, 0): "Перше речення тут?", (4, 1): "«Друге речення тут!» і далі.", (4, 2): "(Третє речення) кінець"}
    claimed = spark.createDataFrame([("m", "Дальність гармати 15300 метрів [1]"), ("m", "Дальність гармати 99 метрів"), ("m", "Зовсім інше речення")], "message_id string, claim string")
    said = spark.createDataFrame([("m", "Дальність стрільби гармати 15300 метрів")], "message_id string, text string")
    assert [r["verdict"] for r in G.lexical_verdicts(claimed, said).collect()] == ["YES", "PARTLY", "NO"]


def test_fit_evidence_drops_the_worst_first(spark):
    from lectern.config import Config
    from lectern.operators import generation as G

    rows = spark.createDataFrame([(1, k, "word " * 400) for k in range(1, 6)], "query_id long, rank int, text string")
    assert [r["rank"] for r in G.fit_evidence(rows, Config(), 2200 + 430 + 2000).orderBy("rank").collect()] == [1, 2]
    cut = G.fit_evidence(rows, Config(), 2200 + 430 + 1200).collect()
    assert {r["rank"] for r in cut} == {1, 2} and {r["cap"] for r in cut} == {1000}


def test_ridge_and_decision(spark):
    import numpy as np

    from lectern.config import Config

    rng = np.random.default_rng(1)
    data = [(i, rng.random(rng.integers(1, 14)).tolist()) for i in range(60)]
    samples = [(i, s, float(min(1.0, max(s)))) for i, s in data]
    model = evaluation.fit_u_lin(spark.createDataFrame(samples, "query_id long, scores array<double>, ndcg double"), Config())
    x = np.array([([min(s)] * 10 + sorted(s))[-10:] if len(s) < 10 else sorted(s)[-10:] for _, s, _ in samples])
    y = np.array([v for *_, v in samples])
    w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 0.1 * np.eye(10), (x - x.mean(0)).T @ (y - y.mean()))
    assert np.allclose(w, model["weights"], atol=1e-6) and model["ready"]
    scored = spark.createDataFrame([(i, v) for i, s, _ in samples[:3] for v in s], "query_id long, score double")
    got = {r["query_id"]: r for r in evaluation.decide(scored, spark.range(4).withColumnRenamed("id", "query_id"), Config(), model).collect()}
    assert got[3]["abstain"] and got[3]["mode"] == "empty" and abs(got[0]["confidence"] - min(1, max(0, x[0] @ w + y.mean() - x.mean(0) @ w))) < 1e-6


def test_ocr_scores_and_report(spark):
    pairs = spark.createDataFrame([("e", "1", "п'ять слів тут", "пять слів там", 1.0, None), ("e", "2", "abc", "abc", 2.0, None), ("e", "3", "", "x", 0.5, "boom")], "engine string, page string, reference string, hypothesis string, seconds double, error string")
    got = {r["page"]: r for r in evaluation.ocr_scores(pairs).collect()}
    assert abs(got["1"]["cer"] - 3 / 14) < 1e-9 and abs(got["1"]["wer"] - 2 / 3) < 1e-9 and abs(got["1"]["cer_soft"] - 2 / 13) < 1e-9 and got["3"]["cer"] is None
    report = evaluation.ocr_report(evaluation.ocr_scores(pairs)).first()
    assert (report["pages"], report["failures"], report["seconds"]) == (2, 1, 3.5) and len(report["top"]) == 3


def test_labels_windows_and_jobs(spark):
    from pyspark.sql import functions as F

    from lectern.operators import operations as O

    heads = spark.createDataFrame([(1, p, f"Розділ 3 с. {p + 12}" if p % 6 else "—") for p in range(1, 12)], "document_id long, page long, header string")
    assert [tuple(r) for r in ingest.header_offset(heads).collect()] == [(1, 12, 1.0)]
    pages = spark.range(1, 6).select(F.lit(1).cast("long").alias("document_id"), F.col("id").alias("page"))
    ranges = spark.createDataFrame([(1, 0, "r", "", 1), (1, 3, "D", "A-", 7)], "document_id long, start long, style string, prefix string, first long")
    assert [r["label"] for r in ingest.range_labels(pages, ranges).orderBy("page").collect()] == ["i", "ii", "iii", "A-7", "A-8"]
    tables = spark.createDataFrame([(1, p, p in (5, 6)) for p in range(1, 13)], "document_id long, page int, has_table boolean")
    assert [(r["first"], r["last"]) for r in ingest.page_windows(tables, 5).orderBy("first").collect()] == [(1, 4), (5, 9), (10, 12)]
    steps = spark.createDataFrame([(1, 1, "LEASED"), (1, 2, "RUNNING"), (1, 3, "DONE"), (1, 4, "RUNNING"), (2, 1, "DONE")], "job_id long, event_id long, state string")
    assert {r["job_id"]: (r["state"], r["refused"]) for r in O.final_states(steps).collect()} == {1: ("DONE", 1), 2: ("QUEUED", 1)}


def test_nested_sets_of_long_documents(spark, monkeypatch):
    """Runs of a few headings, cut anywhere, give what a plain walk gives; the memory of a row doesn't grow with its document."""
    import random

    monkeypatch.setattr(ingest, "RUN", 7)
    draw = random.Random(3)
    rows = [(d, p, draw.choice([1, 2, 2, 3, 3, 3, 4, 6, None]), f"t{p}") for d, n in (("a", 90), ("b", 1), ("c", 23), (None, 12)) for p in range(n)]
    want = set()
    for d in ("a", "b", "c", None):
        own = [r for r in rows if r[0] == d]
        for i, (_, place, level, title) in enumerate(own):
            end = next((j for j in range(i + 1, len(own)) if None not in (level, own[j][2]) and own[j][2] <= level), len(own))
            above, least = [], level
            for _, p, x, _ in reversed(own[:i]):
                if None not in (x, least) and x < least:
                    least, above = x, [*above, p]
            lft = 2 * (i + 1) - 1 - len(above)
            want.add((d, place, level, title, above[0] if above else None, lft, lft + 2 * (end - i - 1) + 1))
    df = spark.createDataFrame(rows, "document_id string, place long, level int, title string")
    got = [tuple(r) for r in ingest.nested_sets(df).collect()]
    assert len(got) == len(want) and set(got) == want
    assert ingest.nested_sets(df.limit(0)).count() == 0
    monkeypatch.setattr(ingest, "RUN", 8_000)
    flat = ingest.nested_sets(spark.range(30_000).select(F.lit("x").alias("document_id"), F.col("id").alias("place"), F.lit(1).alias("level"), F.lit("t").alias("title")))
    assert flat.where("rgt = lft + 1 and parent_place is null").count() == 30_000
