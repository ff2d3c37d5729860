"""Attribution against SQL and a batch-by-batch version, the language model against its definition, whitening against a dense solver."""

import math
import random
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import attribution, lm, queries, whitening

DATA = Path("/root/testdata/sf0.001")
DAY0 = datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, ref long"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, at long, batch int"


# ---- attribution ----


def plain_attribution(clicks, sales):
    """The contract, batch by batch, with lists."""
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    hour = lambda key, t: us(t) // 3_600_000_000 + 240 * (key is not None and zlib.crc32(str(key).encode()) % 4 == 0)
    clean = {}
    for c in clicks:
        if None not in c[:2] and c[3] is not None:
            clean[c[0]] = min(clean.get(c[0], c), c, key=lambda x: (hour(x[0], x[2]), x[1], x[3]))
    sold = [s for s in sales if s[1] is not None and s[2] is not None]
    hours = [hour(c[0], c[2]) for c in clean.values()]
    lo, hi = (min(hours), max(hours)) if hours else (0, 0)
    batch = lambda key, t: max(0, min(9, 10 * (hour(key, t) - lo) // (hi - lo + 1)))
    last, out, kept, waiting = [None, None], [], [], []
    for b in range(11):
        mark = math.inf if b == 10 else min(last) - 48 * 3_600_000_000 if None not in last else -math.inf
        new = [c for c in clean.values() if batch(c[0], c[2]) == b] if b < 10 else []
        asks = [s for s in sold if batch(s[0], s[3]) == b] if b < 10 else []
        kept += [c for c in new if us(c[1]) >= mark]
        out += [(s[0], b, True, None, 0) for s in asks if us(s[2]) < mark]
        waiting += [s for s in asks if us(s[2]) >= mark]
        for s in [s for s in waiting if us(s[2]) < mark or b == 10]:
            hits = [c for c in kept if c[3] == s[1] and timedelta(0) <= s[2] - c[1] <= timedelta(days=7)]
            out.append((s[0], b, False, max(hits, key=lambda c: (c[1], c[0]))[0] if hits else None, len(hits)))
        waiting = [s for s in waiting if us(s[2]) >= mark and b < 10]
        kept = [c for c in kept if us(c[1]) >= mark - 168 * 3_600_000_000]
        for k, times in enumerate(([c[1] for c in new], [s[2] for s in asks])):
            last[k] = max([us(t) for t in times] + ([last[k]] if last[k] is not None else []), default=None)
    return out


def key(row):
    return tuple(-1 if x is None else int(x) for x in row)


def test_attribution_equals_sql(spark):
    c = duckdb.connect()
    for n in ("clicks", "sales"):
        c.execute(f"create view {n} as select * from '{DATA}/{n}.parquet'")
    df = queries.queries()["op11_click_attribution"](spark, str(DATA))
    assert df.columns == attribution.RESULT
    assert sorted(map(key, df.collect())) == sorted(map(key, c.execute(queries.OP11_SQL).fetchall()))


def test_attribution_equals_batch_by_batch(spark):
    rnd = random.Random(5)
    at = lambda: DAY0 + timedelta(hours=rnd.randint(0, 1400), microseconds=rnd.choice([0, 0, 1, 999_999]))
    late = lambda t: t + timedelta(hours=rnd.choice([0, 0, 1, 60, 300]))
    who = lambda: rnd.choice([1, 1, 1, 1, 2, 3, None])
    clicks = [(k, t, late(t), who(), "x", 1) for k, t in enumerate(at() for _ in range(400))]
    clicks += clicks[:20] + [(1000, DAY0, DAY0, 1, None, None), (1001, DAY0, DAY0, 1, None, None), (1002, None, DAY0, 1, None, None), (None, DAY0, DAY0, 1, None, None)]
    clicks += [(5, DAY0, clicks[5][2] + timedelta(hours=2), 9, "again", 0)]
    sales = [(k, who(), t, late(t), 7, 7) for k, t in enumerate(at() for _ in range(200))]
    sales += sales[:3] + [(None, 1, DAY0, DAY0, 0, 0), (500, 1, DAY0, DAY0, 0, 0), (501, 1, None, DAY0, 0, 0), (502, 1, DAY0 + timedelta(days=7), DAY0, 0, 0)]
    got = attribution.attribute(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES)).collect()
    assert sorted(map(key, got)) == sorted(map(key, plain_attribution(clicks, sales)))


@pytest.mark.parametrize("with_sales", [False, True])
def test_attribution_without_clicks(spark, with_sales):
    sales = [(1, 1, DAY0, DAY0, 0, 0), (2, None, DAY0, DAY0, 0, 0)] * with_sales
    got = attribution.attribute(spark.createDataFrame([], CLICKS), spark.createDataFrame(sales, SALES)).collect()
    assert [tuple(r) for r in got] == [(1, 10, False, None, 0)] * with_sales


def test_bucket_closes_several_clients_at_once():
    width, hour = attribution.SLICE_MOST, attribution.HOUR
    t = lambda h: 1000 * width + h * hour
    column = lambda *v: np.array(v, np.int64)
    clicks = {"client": column(1, 1, 2, 1), "slice": column(1000, 1000, 1000, 1001), "ts": column(t(0), t(1), t(1), t(3)), "click": column(7, 8, 9, 10)}
    sales = {"kind": column(attribution.UPPER, attribution.LOWER), "client": column(1, 1), "slice": column(1000, 1000), "sold": column(t(1), t(1) + attribution.WINDOW), "ref": column(0, 1), "sale": column(5, 6)}
    out = attribution.close(clicks, sales, width, attribution.NEVER, t(2), 3)
    asked = out[out.kind != attribution.SLICE]
    assert asked[["n", "click"]].to_numpy().tolist() == [[2, 8], [1, 0]]
    ended = out[out.kind == attribution.SLICE]
    assert ended[["client", "slice", "n", "click"]].to_numpy().tolist() == [[1, 1000, 2, 8], [2, 1000, 1, 9]]


def test_watermarks_wait_for_both_tables():
    h = attribution.HOUR
    assert attribution.watermarks([100 * h, None, 90 * h], [None, 80 * h, 200 * h]) == [attribution.NEVER, attribution.NEVER, 32 * h, attribution.ENDED]


# ---- language model ----


TEXTS = ["the cat sat", "The cat\tran  home\n", None, "", "Ärger the the dog", "x" * 5000, "the " * 3000, "cat the unknown-word", "the cat sat"] * 6


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", 3, 0.5) for k, t in enumerate(TEXTS)] + [(None, "no number", "en", 1, 0.5), (3, "again three", "fr", 1, 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block long, score double")


def plain_base(rows):
    words = [(r[0], (r[1] or "").encode().lower().split() + [b""]) for r in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in words]
    counts: dict[bytes, int] = {}
    for (_, ws), out in zip(words, held, strict=True):
        for w in ws if not out else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return [(d, h, len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), 6)) for (d, ws), h in zip(words, held, strict=True)]


def test_base_scores_equal_their_definition(docs):
    got = lm.score(docs).collect()
    strip = lambda rows: sorted([tuple(-1 if x is None else x for x in r) for r in rows])
    assert strip([(*r[:5], round(r["base_score"], 6)) for r in got]) == strip(plain_base(docs.collect()))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    same = [r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] % 9 == 0]
    assert max(same) - min(same) < 1e-9


def test_an_empty_table_has_no_scores(docs):
    assert lm.score(docs.limit(0)).columns == [c.split()[0] for c in lm.RESULT.split(", ")]
    assert lm.score(docs.limit(0)).count() == 0


def random_model(classes, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return lm.Model(norm(rng.random(lm.STATES), 0), norm(rng.random((lm.STATES, lm.STATES)), 1), norm(rng.random((classes, lm.STATES)), 0))


def plain_forward(model, seq):
    alpha = model.start * model.emissions[seq[0]]
    logs = 0.0
    for c in seq[1:]:
        total = alpha.sum()
        logs, alpha = logs + math.log(total), (alpha / total @ model.moves) * model.emissions[c]
    return logs + math.log(alpha.sum())


def test_likelihoods_equal_a_plain_forward_pass():
    model, rng = random_model(30), np.random.default_rng(2)
    texts = [rng.integers(0, 30, n).astype(np.int32) for n in (1, 2, 50, lm.LONG, lm.LONG + 1, 3 * lm.PIECE + 5, 5000)]
    assert np.allclose(lm.likelihoods(model, texts), [plain_forward(model, t) for t in texts], rtol=1e-10)


def test_the_model_is_a_distribution():
    model = random_model(3)
    texts = [np.array([a, b, c], np.int32) for a in range(3) for b in range(3) for c in range(3)]
    assert np.isclose(np.exp(lm.likelihoods(model, texts)).sum(), 1)


def test_expected_counts_equal_enumeration():
    model, seq = random_model(4), np.array([2, 0, 3, 3], np.int32)
    sums, log = lm.expected(model, [seq, seq[:2]], np.array([True, True]))
    want = np.zeros_like(sums)
    for s in (seq, seq[:2]):
        paths = np.stack(np.meshgrid(*[range(lm.STATES)] * len(s), indexing="ij"), -1).reshape(-1, len(s))
        p = model.start[paths[:, 0]] * model.emissions[s[0], paths[:, 0]]
        for t in range(1, len(s)):
            p = p * model.moves[paths[:, t - 1], paths[:, t]] * model.emissions[s[t], paths[:, t]]
        p = p / p.sum()
        np.add.at(want, (4 + lm.STATES, paths[:, 0]), p)
        for t in range(len(s)):
            np.add.at(want, (s[t], paths[:, t]), p)
            if t:
                np.add.at(want, (4 + paths[:, t - 1], paths[:, t]), p)
    assert np.allclose(sums, want)
    assert np.isclose(log, plain_forward(model, seq) + plain_forward(model, seq[:2]))


def test_each_round_of_training_fits_better():
    rng = np.random.default_rng(4)
    seqs = [np.concatenate([rng.integers(0, 5, 40), rng.integers(5, 10, 40)]).astype(np.int32) for _ in range(60)]
    overall = np.bincount(np.concatenate(seqs), minlength=10) + 1.0
    model, logs = lm.Model.first(overall), []
    for _ in range(12):
        sums, log = lm.expected(model, seqs, np.ones(60, bool))
        model = lm.Model.fitted(sums, overall)
        logs.append(log)
    assert all(b > a - 1e-6 * abs(a) for a, b in zip(logs, logs[1:], strict=False)) and logs[-1] > logs[0]


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    p = queries.queries()["op12_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert (p.score.sum() - p.base_score.sum()) / p.n_tokens.sum() > 0.3


# ---- whitening ----


def plain_whitening(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - u.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:16], v[:, ::-1][:, :16]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening_equals_a_dense_solver(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    fine = [r for r in table.collect() if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    n, deviation, want, explained = plain_whitening([r["embedding"] for r in fine])
    p = queries.queries()["op13_embedding_whitening"](spark, str(DATA)).toPandas().set_index(["vec_id", "component"])
    assert len(p) == 16 * len(fine) and set(p.n) == {n} and p.identity_error.max() < 1e-9
    got = p.whitened.unstack().loc[[r["vec_id"] for r in fine]].to_numpy()
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-8
    assert p.deviation.unstack()[1].loc[[r["vec_id"] for r in fine]].tolist() == deviation.tolist()
    assert np.allclose(p.explained.unstack().iloc[0], explained)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in rng.standard_normal(3)], 1, 0.5) for k in range(20)]
    rows += [rows[0], (None, rows[1][1], 1, 0.5), (30, None, 1, 0.5), (31, [], 1, 0.5), (32, [1.0, None, 2.0], 1, 0.5), (33, [1.0, math.nan, 2.0], 1, 0.5), (34, [1.0, math.inf, 2.0], 1, 0.5), (35, [1.0, 2.0], 1, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component double")
    p = whitening.whiten(df).toPandas()
    assert sorted(p.vec_id.fillna(-1).astype(int)) == sorted([*range(20), 0, -1] * 3)
    assert set(p.n) == {20} and set(p.component) == {1, 2, 3}
    assert p.identity_error.max() < 1e-9 and np.isclose(p.groupby("component").explained.first().sum(), 1)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]])
def test_whitening_without_variance_has_no_rows(spark, rows):
    df = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert df.columns == [c.split()[0] for c in whitening.RESULT.split(", ")] and df.count() == 0


def test_whitening_leaves_out_flat_directions(spark):
    rows = [(k, [float(k), float(2 * k), 1e300]) for k in range(5)]
    p = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(p.component) == {1} and np.isclose(p.explained.iloc[0], 1)


def test_squares_beyond_long_are_null():
    far = np.array([[3_000_000_000, 0], [1, 1]])
    assert whitening._squares(far, 2, np.array([0, 0])) == [None, 8]


def test_lobpcg_finds_close_eigenvalues():
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.standard_normal((120, 120)))
    e = np.concatenate([1 + np.arange(20)[::-1] * 1e-3, np.linspace(0.9, 0.1, 100)])
    a = q * e @ q.T
    values, vectors, residual = whitening.lobpcg(lambda b: a @ b, 120, 16)
    assert residual < whitening.ACCEPT and np.allclose(values, e[:16], rtol=1e-10)
    assert np.abs(np.abs((vectors * q[:, :16]).sum(0)) - 1).max() < 1e-10


def test_micros_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 31, 2, 30, 0, 5),)], "t timestamp_ntz")
    assert df.select(attribution.micros(df, "t").alias("m"), F.lit(1)).first()["m"] == 1711852200000005
