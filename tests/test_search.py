"""Stored indexes and the whole retrieval, against plain versions of them."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions.normalize import normalize_text
from lectern.operators import inverted_index as N
from lectern.operators import retrieval as R
from lectern.operators import vector_index as V
from lectern.plans import documents as D
from lectern.plans import search as Q
from lectern.staging import current, new_folder, publish, versions

SMALL = "/root/testdata/sf0.001"
WORD = regex.compile(r"[\p{L}\p{N}]+(?:['\-][\p{L}\p{N}]+)*")


def pairs(rows):
    return {(r["query_id"], r["chunk_id"]) for r in rows}


def partitions(df, column):
    """The folders that a scan of df's plan is restricted to."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(regex.search(rf"PartitionFilters: \[{column}#\d+ (?:IN|INSET) \(?([\d,\s]+)\)?|PartitionFilters: \[isnotnull\({column}#\d+\), \({column}#\d+ = (\d+)\)", plan).expand(r"\1\2").replace(" ", "").strip(",").split(","))


# ---- vectors ----


@pytest.fixture(scope="module")
def index(spark):
    return Q.vector_index(spark, "/root/testdata/sf0.1")


def test_recall_of_probing_and_exactness_of_full_probing(spark, index):
    d = "/root/testdata/sf0.1"
    exact = D.dense_top(spark, d).collect()
    assert pairs(V.exact_search(index, D.vector_queries(spark, d), 10).collect()) == pairs(exact)
    assert index.quantiser.probes < len(index.quantiser.centres)
    found = pairs(V.search(index, D.vector_queries(spark, d), 10).collect())
    assert len(found & pairs(exact)) / len(exact) >= 0.9


def test_few_probes_read_few_cells(spark, index):
    q = D.vector_queries(spark, "/root/testdata/sf0.1").limit(1)
    df = V.search(index, q, 5, probes=2)
    assert df.count() == 5 and len(partitions(df, "cell")) <= 2


def test_scores_of_probing_are_exact(spark, index):
    d = "/root/testdata/sf0.1"
    exact = {(r["query_id"], r["chunk_id"]): r["score"] for r in V.exact_search(index, D.vector_queries(spark, d), 50).collect()}
    for r in V.search(index, D.vector_queries(spark, d), 5).collect():
        assert abs(exact[r["query_id"], r["chunk_id"]] - r["score"]) < 1e-9


def test_filters_choose_their_strategy_and_empty_no_result(spark, index):
    d = "/root/testdata/sf0.1"
    q = D.vector_queries(spark, d)
    for labels, strategy in (([1], "L2"), (list(range(6)), "L1")):
        found, how = V.filtered_search(index, q, 10, F.col("label").isin(labels))
        rows = found.collect()
        exact = D.dense_top(spark, d, where=F.col("label").isin(labels)).collect()
        assert how == strategy and len(rows) == len(exact)
        assert len(pairs(rows) & pairs(exact)) / len(exact) >= (1 if how == "L2" else 0.9)


def test_a_cell_that_holds_most_vectors_is_cut(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(V, "QUERIES_AT_ONCE", 5)
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 0.0, 0.0, 0.001 * k] if k < 200 else [float(x) for x in rng.standard_normal(4)], "a") for k in range(300)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, kind string")
    index = V.build(v, new_folder(spark, "hot"), ("kind",))
    q = v.where("chunk_id < 40").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert pairs(V.exact_search(index, q, 7).collect()) == pairs(R.dense_top_k(v, q, 7).collect())
    again = V.opened(spark, index.path)
    assert again.sizes == index.sizes and again.facets == ["kind"] and V.about(again)["rows"] == 300


def test_odd_vectors_have_no_place(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [1.0]), (7, []), (8, [0.5, 0.5])]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    index = V.build(v, new_folder(spark, "odd"))
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding")
    assert pairs(V.search(index, q, 3).collect()) == {(a, b) for a in (1, 8) for b in (1, 8)}
    empty = V.build(v.limit(0), new_folder(spark, "empty"))
    assert V.search(empty, q, 3).count() == 0


def test_blocks_of_queries_find_the_same(spark, monkeypatch):
    v, q = D.vectors(spark, SMALL), D.vector_queries(spark, SMALL)
    want = pairs(R.dense_top_k(v, q, 4).collect())
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    assert pairs(R.dense_top_k(v, q, 4).collect()) == want


# ---- words ----

TEXTS = ["the red-brown fox AB-12", "the the the dog", None, "", "fox fox dog ab-123", "a lone xy99z here", "the end"]


@pytest.fixture(scope="module")
def words(spark):
    chunks = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "chunk_id long, text string, term string")
    root = new_folder(spark, "words")
    return N.build(N.search_fields(chunks), root), root


def plain_terms(text):
    own = WORD.findall((text or "").lower())
    parts = [p for w in own if "-" in w for p in dict.fromkeys(w.split("-")) if len(p) >= 3 and not p.isdigit()]
    codes = [c.lower() for c in regex.findall(r"[\p{L}\p{N}_-]+", text or "") if len(c) >= 2 and regex.search(r"\p{L}", c) and regex.search(r"\p{N}", c)]
    return [(w, 1.0) for w in own] + [(p, 0.4) for p in parts] + [(c, 2.5) for c in codes]


def plain_bm25(texts, terms):
    lists = [plain_terms(t) for t in texts]
    n, average = len(texts), sum(map(len, lists)) / len(texts)
    out = {}
    for k, own in enumerate(lists):
        for term in set(terms):
            tf = sum(w for t, w in own if t == term)
            df = sum(any(t == term for t, _ in o) for o in lists)
            if tf and len(term) >= 2:
                idf = math.log((n - df + 0.5) / (df + 0.5))
                out[k] = out.get(k, 0) + max(idf, 1e-6 if idf <= 0 else idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / average))
    return out


def test_search_equals_plain_scores(spark, words):
    index, root = words
    asked = ["fox", "the red dog", "ab-12", "nothing", "the"]
    queries = spark.createDataFrame([(k, [w for w, _ in plain_terms(t)], t) for k, t in enumerate(asked)], "query_id long, terms array<string>, text string")
    got = {}
    for r in N.search(index, queries, 10).collect():
        got.setdefault(r["query_id"], {})[r["chunk_id"]] = r["score"]
    for k, t in enumerate(asked):
        want = plain_bm25(TEXTS, [w for w, _ in plain_terms(t)])
        assert got.get(k, {}).keys() == want.keys() and all(abs(got[k][c] - s) < 1e-9 for c, s in want.items())
    allowed = spark.createDataFrame([(1,), (4,)], "chunk_id long")
    assert {r["chunk_id"] for r in N.search(index, queries, 10, allowed).collect()} <= {1, 4}
    assert N.opened(spark, root) == index


def test_blocks_are_left_out_and_results_stay(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    index = N.build(N.search_fields(D.chunks(spark, SMALL)), new_folder(spark, "blocks"))
    texts = dict(D.chunks(spark, SMALL).select("chunk_id", "text").collect())
    ids = sorted(texts)
    often = [w for w, _ in Counter(w for t in texts.values() for w in set(WORD.findall((t or "").lower())) if len(w) > 1).most_common(12)]
    asked = spark.createDataFrame([(k, often[k : k + 2]) for k in range(0, 12, 2)] + [(99, often[:1])], "query_id long, terms array<string>")
    rows = N.blocks_read(index, asked, 3).collect()
    assert sum(r["needed"] for r in rows) < 0.7 * sum(r["blocks"] for r in rows)
    got = N.search(index, asked, 3).collect()
    for q in asked.collect():
        want = plain_bm25([texts[i] for i in ids], q["terms"])
        best = sorted(want, key=lambda k: (-round(want[k], 9), ids[k]))[:3]
        assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q["query_id"]] == [ids[k] for k in best]


def test_only_folders_of_the_terms_are_read(spark, words):
    index, _ = words
    one = spark.createDataFrame([(1, ["fox"])], "query_id long, terms array<string>")
    asked = N.survey(index, one)
    assert len(partitions(asked, "bucket")) == 1


def test_codes_are_found_inside_of_codes(spark, words):
    index, _ = words
    queries = spark.createDataFrame([(1, ["ab-12"]), (2, ["99z", "xy9"]), (3, ["qq-77"]), (4, ["b1"]), (5, [])], "query_id long, codes array<string>")
    assert {(r["query_id"], r["chunk_id"]): r["hits"] for r in N.code_search(index, queries).collect()} == {(1, 0): 1, (1, 4): 1, (2, 5): 2}
    assert pairs(N.sparse_branch(index, spark.createDataFrame([(1, "AB-12")], "query_id long, text string"), 5).collect()) == {(1, 0), (1, 4)}


def test_an_empty_index_finds_nothing(spark):
    none = N.build(N.search_fields(D.chunks(spark, SMALL).limit(0)), new_folder(spark, "none"))
    assert N.search(none, N.query_fields(D.asked(spark, SMALL)), 5).count() == 0


def test_a_version_is_seen_whole_or_not_at_all(spark):
    root = new_folder(spark, "published")
    assert current(spark, root) is None
    assert [publish(spark, root, b) for b in ("a", "a", "b", "a")] == [1, 1, 2, 3]
    assert versions(spark, root) == [(1, "a"), (2, "b"), (3, "a")] and current(spark, root) == f"{root}/a"


# ---- the whole retrieval ----


def grams(text, least=3, most=5):
    t = f" {text} "
    return [t[i : i + n] for n in range(least, most + 1) for i in range(len(t) - n + 1)]


def simhash(text):
    w = WORD.findall((text or "").lower())
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if w else 0


def plain_retrieve(leaves, query, c):
    """candidates and decision of one query over all leaves {id: (text, vector)}."""
    anchored = regex.search(r"\d|[\"«»„“”]", query["text"] or "") is not None or R.T.STANDARDS and regex.search(rf"(^|[^\p{{L}}\p{{N}}_])({R.T.STANDARDS})($|[^\p{{L}}\p{{N}}_])", (query["text"] or "").upper()) is not None
    norm = {k: normalize_text(t) for k, (t, _) in leaves.items()}
    asked = normalize_text(query["text"])
    best = lambda s, k: sorted(s, key=lambda i: (-round(s[i], 9), i))[:k]
    unit = lambda v: np.array(v, float) / (np.linalg.norm(np.array(v, float)) or 1)
    dense = {k: float(unit(query["embedding"]) @ unit(v)) for k, (_, v) in leaves.items() if v is not None} if query["embedding"] is not None else {}
    words = {k: WORD.findall(t.lower()) for k, t in norm.items()}
    average = sum(map(len, words.values())) / len(words)
    terms = {w for w in WORD.findall(asked.lower()) if len(w) >= 2}
    counts = {k: Counter(w) for k, w in words.items()}
    sparse = {}
    for t in terms:
        df = sum(t in n for n in counts.values())
        idf = math.log((len(words) - df + 0.5) / (df + 0.5))
        for k, n in counts.items():
            if n[t]:
                sparse[k] = sparse.get(k, 0) + (1e-6 if idf <= 0 else idf) * n[t] * 2.2 / (n[t] + 1.2 * (0.25 + 0.75 * len(words[k]) / average))
    d, s = best(dense, c.dense_top_k), best(sparse, c.sparse_top_k)
    pool = (d + [k for k in s if k not in d])[: c.ngram_pool]
    low = {k: norm[k].lower()[: c.ngram_text_chars] for k in pool}
    mine = set(grams(asked.lower()[: c.ngram_query_chars]))
    tf = {k: {g: n for g in mine if (n := low[k].count(g))} for k in pool}
    mean = sum(map(len, low.values())) / len(low)
    ng = {k: sum((math.log((len(pool) + 1) / (sum(g in x for x in tf.values()) + 1)) + 1) * (1 + math.log(n)) / (0.25 + 0.75 * len(low[k]) / mean) for g, n in own.items()) for k, own in tf.items() if own}
    g = best(ng, c.dense_top_k // 2)
    rrf, at = {}, {}
    for name, hits, w in (("dense", d, c.weight_dense), ("sparse", s, max(c.weight_sparse, c.anchored_sparse_weight) if anchored else c.weight_sparse), ("ngram", g, c.weight_char_ngram)):
        for r, k in enumerate(hits, 1):
            rrf[k] = rrf.get(k, 0) + w / (c.rrf_k + r)
            at.setdefault(k, {})[name] = r
    order = sorted(rrf, key=lambda k: (-round(rrf[k], 12), -len(at[k]), min(at[k].values()), k))[: max(c.rerank_top_k, c.final_top_k)]
    kept, same = [], {}
    hashes = {k: simhash(leaves[k][0]) for k in order}
    for k in order:
        twins = [o for o in kept if bin(hashes[o] ^ hashes[k]).count("1") <= c.max_hamming and (leaves[o][1] is None or leaves[k][1] is None or unit(leaves[o][1]) @ unit(leaves[k][1]) >= c.min_cosine)]
        same[k] = twins[0] if twins else None
        kept += [] if twins else [k]
    cover = lambda q, own: len(q & own) / len(q) if q else 0.0
    own_words = lambda t: list(dict.fromkeys(WORD.findall((t or "").lower())))
    qw = own_words(query["text"])
    score = {k: 0.6 * cover(set(qw), set(w := own_words(leaves[k][0]))) + 0.4 * cover(set(grams(" ".join(qw), 3, 3)), set(grams(" ".join(w), 3, 3))) for k in order}
    rows = {k: (r, round(rrf[k], 9), at[k].get("dense"), at[k].get("sparse"), at[k].get("ngram"), same[k], round(score[k], 9)) for r, k in enumerate(order, 1)}
    support = [score[k] for k in kept]
    return rows, (round(max(support, default=0.0), 9), sum(x >= c.threshold for x in support))


@pytest.fixture(scope="module")
def retrieved(spark):
    chunks, queries = D.searched(spark, SMALL)
    return chunks, queries, R.retrieve(chunks, queries)


def test_candidates_and_decisions_equal_a_plain_version(spark, retrieved):
    chunks, queries, got = retrieved
    leaves = {r["chunk_id"]: (r["text"], r["embedding"]) for r in chunks.where("level = 'L2'").collect()}
    found: dict = {}
    for r in got["candidates"].collect():
        found.setdefault(r["query_id"], {})[r["chunk_id"]] = (r["rank"], round(r["rrf"], 9), r["dense_rank"], r["sparse_rank"], r["ngram_rank"], r["duplicate_of"], round(r["rerank_score"], 9))
    decided = {r["query_id"]: (round(r["confidence"], 9), r["supporting"]) for r in got["decisions"].collect()}
    for q in queries.collect():
        rows, decision = plain_retrieve(leaves, q, Config())
        assert found[q["query_id"]] == rows
        assert decided[q["query_id"]] == decision


def test_selected_chunks_keep_the_rules(spark, retrieved):
    c, (chunks, queries, got) = Config(), retrieved
    rows = got["selected"].collect()
    by_query: dict = {}
    for r in rows:
        by_query.setdefault(r["query_id"], []).append(r)
    assert all(len(x) <= c.final_top_k and sorted(r["ordinal"] for r in x) == list(range(1, len(x) + 1)) for x in by_query.values())
    chosen = {(r["query_id"], r["chunk_id"]) for r in got["candidates"].where("selected and merged_into is null").collect()}
    assert chosen == {(r["query_id"], r["chunk_id"]) for r in rows if not r["merged"]}
    assert {r["merged_into"] for r in got["candidates"].where("merged_into is not null").collect()} == {r["chunk_id"] for r in rows if r["merged"]}
    assert by_query.keys() == {r["query_id"] for r in queries.collect()}


def test_given_branches_and_reranker_take_the_place_of_the_own(spark, retrieved):
    chunks, queries, _ = retrieved
    q = queries.limit(2)
    hits = spark.createDataFrame([(r["query_id"], k, 1.0 - k / 10, k) for r in q.collect() for k in (1, 2, 3)], "query_id long, chunk_id long, score double, rank int")
    got = R.retrieve(chunks, q, Config(weight_char_ngram=0.0), dense_hits=hits, sparse_hits=hits, reranker=lambda rows, _: rows.withColumn("rerank_score", F.col("chunk_id") / 10))
    assert {r["chunk_id"] for r in got["candidates"].collect()} == {1, 2, 3}
    assert {r["confidence"] for r in got["decisions"].collect()} == {0.3}


def test_a_candidate_is_spelled_and_hashed_once_for_all_queries(spark, retrieved, monkeypatch):
    chunks, queries, _ = retrieved
    spelled, hashed, plain = [], spark.sparkContext.accumulator(0), R.normalized
    monkeypatch.setattr(R, "normalized", lambda df: spelled.append(df.count()) or plain(df))
    monkeypatch.setattr(R, "text_simhash", lambda text: F.udf(lambda t: hashed.add(1) or len(t), "long")(text))
    q = queries.limit(2)
    hits = spark.createDataFrame([(r["query_id"], k, 1.0 - k / 10, k) for r in q.collect() for k in (1, 2, 3)], "query_id long, chunk_id long, score double, rank int")
    assert R.retrieve(chunks, q, dense_hits=hits, sparse_hits=hits)["candidates"].count() == 6
    assert (spelled, hashed.value) == ([2, 3], 3)


def test_a_filter_that_allows_nothing_abstains(spark, retrieved):
    chunks, queries, _ = retrieved
    got = R.retrieve(chunks, queries.limit(3), predicate=F.col("document_id") == "no such")
    assert [(r["confidence"], r["abstain"]) for r in got["decisions"].collect()] == [(0.0, True)] * 3 and got["selected"].count() == 0


def test_a_small_allowed_set_is_the_pool_of_ngrams(spark, retrieved):
    chunks, queries, _ = retrieved
    got = R.retrieve(chunks, queries.limit(1), Config(dense_top_k=1, sparse_top_k=1, ngram_pool=50), predicate=F.col("chunk_id") < 30)
    assert got["candidates"].where("chunk_id >= 30").count() == 0


def test_queries_of_the_same_codes_are_counted_once(spark):
    """Pairs of like queries and chunks are made after the last exchange; a query that comes in several rows keeps all its codes."""
    chunks = spark.createDataFrame([(k, f"utf-8 x{k % 3}") for k in range(90)], "chunk_id long, text string")
    index = N.build(N.search_fields(chunks), new_folder(spark, "same"), {})
    assert index.chunks == 90
    queries = spark.createDataFrame([(q, ["utf-8"]) for q in range(40)] + [(0, ["tf-8", "x1"]), (77, ["none-1"])], "query_id long, codes array<string>")
    out = N.code_search(index, queries)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan.split("Aggregate")[0] and not any("Aggregate [query_id" in line for line in plan.split("\n"))
    got = {(r["query_id"], r["chunk_id"]): r["hits"] for r in out.collect()}
    assert got == {(q, c): 2 if q == 0 else 1 for q in range(40) for c in range(90)}


def test_pairs_of_codes_are_made_of_blocks(spark, monkeypatch):
    """What meets are classes of queries and of chunks that match the same codes: far fewer rows than queries' classes times chunks."""
    monkeypatch.setattr(R, "ID_BLOCK", 8)
    monkeypatch.setattr(R, "TASK_PAIRS", 50)
    chunks = spark.createDataFrame([(k, f"utf-8 x{k % 30}-1") for k in range(300)], "chunk_id long, text string")
    queries = spark.createDataFrame([(q, ["utf-8", f"x{q % 20}-1"]) for q in range(60)] + [(99, ["none-1"])], "query_id long, codes array<string>")
    met = []
    monkeypatch.setattr(N, "crossed", lambda links, *rest: met.append(links) or R.crossed(links, *rest))
    out = N.code_search(N.build(N.search_fields(chunks), new_folder(spark, "blocks"), {}), queries)
    got = [tuple(r) for r in out.select("query_id", "chunk_id", "hits").collect()]
    assert sorted(got) == [(q, c, 1 + (q % 20 == c % 30)) for q in range(60) for c in range(300)]
    assert met[0].count() == 20 * 21


def test_scores_are_held_tile_by_tile(spark):
    """A task's memory does not grow with its vectors times the queries; ties are broken by ids over all tiles and batches."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (9_000, 4)).astype(float)  # many equal scores
    x[3] = 0
    names, q = np.arange(3_000), R._units(x[:3_000])
    ids = rng.permutation(9_000)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(list(x[a:b]))], names=["chunk_id", "embedding"])
    batches = [batch(0, 7_000), batch(7_000, 9_000)]
    tracemalloc.start()
    got = [r for b in R._nearest({4: (names, q)}, 5, batches) for r in zip(*(b.column(c).to_pylist() for c in ("query_id", "chunk_id", "score")), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 7_000 * 3_000 * 8  # one matrix of all scores of a batch
    assert len(got) == 3_000 * 5
    found = {}
    for query, chunk, _ in got:
        found.setdefault(query, set()).add(chunk)
    for query in (0, 3, 1_023, 1_024, 2_999):
        near = np.round(np.round(R._units(x) @ q[query], 12), 9)
        assert found[query] == set(ids[np.lexsort((ids, -near))[:5]].tolist())


def plain_top(texts, queries, k):
    """The k best (chunk, score) of each query by words alone."""
    lists = {c: WORD.findall((t or "").lower()) for c, t in texts.items()}
    n, average = len(texts), sum(map(len, lists.values())) / len(texts)
    held = Counter(w for own in lists.values() for w in set(own))
    out = {}
    for q, text in queries.items():
        score = {}
        for term in {w for w in WORD.findall((text or "").lower()) if len(w) >= 2}:
            idf = math.log((n - held[term] + 0.5) / (held[term] + 0.5))
            for c, own in lists.items():
                if tf := own.count(term):
                    score[c] = score.get(c, 0) + (1e-6 if idf <= 0 else idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / average))
        out |= {(q, c): score[c] for c in sorted(score, key=lambda c: (-round(score[c], 9), c))[:k]}
    return out


@pytest.mark.parametrize("tile, block", [((2_048, 1_024), 10_000), ((2, 3), 10_000), ((2_048, 1_024), 3)])
def test_words_are_scored_where_chunks_lie(spark, monkeypatch, tile, block):
    """No pair of a query and a chunk is joined or shuffled before a task has kept its k best; results are those of plain scores, ties by ids."""
    monkeypatch.setattr(R, "TILE", tile)
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    texts = {c: t for c, t in enumerate(TEXTS * 3)}
    asked = {0: "fox", 1: "the red-brown dog", 5: None, 6: "", 7: "a", 8: "nothing here", 9: "the", 11: "ab-12 the fox dog end"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    out = R.bm25_top_k(chunks, queries, 4)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in out.collect()}
    want = plain_top(texts, asked, 4)
    assert out.schema["query_id"].dataType.simpleString() == "int"
    assert got.keys() == want.keys() and all(abs(got[x] - s) < 1e-9 for x, s in want.items())
    assert R.bm25_top_k(chunks.limit(0), queries, 4).count() == 0 == R.bm25_top_k(chunks, queries.limit(0), 4).count()


def test_words_of_all_queries_need_no_join(spark):
    plan = D.found(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "MapInArrow" in plan


def test_passages_are_looked_for_by_a_word(spark):
    """Texts meet passages by an equality join; one without a word between spaces, odd spaces and repeated words lose no holder."""
    texts = ["one two  three two one", "xone two  threey", "two", "", None, "ab", "zabz q", "one two three", "a b c a b c", " \u00e9 \u00e9\u00e9 "]
    items = ["one two  three", "two", "ab", " ", "b c a", "", None, "  ", "\u00e9 \u00e9\u00e9 ", "two two"]
    held = D.holders(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), spark.createDataFrame(list(enumerate(items)), "query_id long, text string"))
    want = Counter((q, c) for q, i in enumerate(items) for c, t in enumerate(texts) if i and t and i in t)
    assert Counter(map(tuple, held.select("query_id", "chunk_id").collect())) == want
    assert "anchor" in held._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("floor, block", [(0, 10_000), (256, 10_000), (0, 2)])
def test_postings_meet_by_chunk_once_for_all_queries(spark, words, monkeypatch, floor, block):
    """Pairs of queries and chunks are not joined or shuffled; many terms, floors and blocks of queries give the scores of all postings."""
    monkeypatch.setattr(N, "FLOOR_TERMS", floor)
    monkeypatch.setattr(N, "QUERY_BLOCK", block)
    index, _ = words
    asked = {0: "fox", 3: "the red-brown dog", 4: "ab-12 xy99z", 6: "", 7: "the end"}
    queries = spark.createDataFrame([(q, [w for w, _ in plain_terms(t)]) for q, t in asked.items()], "query_id int, terms array<string>")
    out = N.search(index, queries, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in out.collect()}
    want = {}
    for q, t in asked.items():
        scores = plain_bm25(TEXTS, [w for w, _ in plain_terms(t)])
        want |= {(q, c): scores[c] for c in sorted(scores, key=lambda c: (-round(scores[c], 9), c))[:3]}
    assert got.keys() == want.keys() and all(abs(got[x] - s) < 1e-9 for x, s in want.items())


def test_terms_are_counted_where_a_chunk_lies(spark):
    """A chunk's postings are rows of its own batch; weights add up, a chunk without terms is one row without term."""
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5, 6]), pa.array([["b", "a", "b", "a"], [], ["c"]]), pa.array([[2, 1, 1], [0, 0, 0], [0, 0, 1]], pa.list_(pa.int32()))], names=["chunk_id", "terms", "sizes"])
    rows = [tuple(r.values()) for b in N._posts(np.array([1.0, 0.4, 2.5]), [batch, batch.slice(1)]) for r in b.to_pylist()]
    first = {(4, 4, "a", 3.5), (4, 4, "b", 1.4), (6, 1, "c", 2.5), (4, 4, None, None), (5, 0, None, None), (6, 1, None, None)}
    assert set(rows) == first and len(rows) == len(first) + 3
