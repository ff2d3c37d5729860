"""Ranking metrics, significance and error rates as DataFrame plans."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import text as T
from lectern.functions.alignment import APOSTROPHES, confusion_class, differences
from lectern.operators import retrieval as R
from lectern.session import ship
from lectern.staging import staged


def ranking_metrics(run: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """recall, precision, mrr, ndcg, map and hit at k of each query of gold (query_id, chunk_id); a query that run lacks scores 0."""
    size = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = run.where(F.col("rank") <= k).join(gold, ["query_id", "chunk_id"], "left_semi").select("query_id", "rank")
    seen = hits.withColumn("so_far", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    got = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("so_far") / F.col("rank")).alias("ap"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    both, zero = size.join(got, "query_id", "left"), F.lit(0.0)
    return both.select(
        "query_id",
        F.coalesce(F.col("hits") / F.col("relevant"), zero).alias("recall"),
        F.coalesce(F.col("hits") / k, zero).alias("precision"),
        F.coalesce(1 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"),
        F.coalesce(F.col("ap") / F.least("relevant", F.lit(k)), zero).alias("map"),
        F.coalesce((F.col("hits") > 0).cast("double"), zero).alias("hit"),
    )


def latency_summary(events: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and the 50th, 95th and 99th percentile (linear interpolation) of value by key."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return events.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), q.alias("q")).select(key, "n", "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def relative_gain(ours: str, base: str):
    """Gain in percent; over a base of 0 it is infinite, or 0 if ours is 0 too."""
    a, b = F.col(ours), F.col(base)
    return F.when(b != 0, (a - b) / b * 100).when(a == 0, 0.0).otherwise(float("inf"))


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean difference and t statistic of paired values; t is null without spread."""
    d = F.col(a) - F.col(b)
    out = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    return out.select("n", "mean_diff", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the incomplete beta function's series of central terms (Simpson's rule on its density)."""
    if math.isinf(t):
        return 0.0
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    n, t = 2000, abs(t)
    step = t / n
    inner = sum((1 if i in (0, n) else 4 if i % 2 else 2) * norm * (1 + (i * step) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)) * step / 3
    return max(0.0, 1 - 2 * inner)


def youden(samples: DataFrame, score: str, label: str) -> DataFrame:
    """The score that, as a threshold, has the largest sensitivity plus specificity minus 1; the smaller of equals. No row without both labels.

    Counts per distinct score are dealt out by ranges of scores and written; the ranges' own sums, a row for each, say what lies above a range, so running
    sums are taken in each range alone.
    """
    spark = samples.sparkSession
    per = samples.groupBy(F.col(score).alias("tau")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    dealt = per.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.desc("tau"))
    ranged = staged(dealt.withColumn("part", F.spark_partition_id()), "youden")
    sums = {r["part"]: (r["pos"], r["neg"]) for r in ranged.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}  # a row for each partition
    above, offsets = [0, 0], []
    for part in sorted(sums):
        offsets.append((part, *above))
        above = [x + y for x, y in zip(above, sums[part], strict=True)]
    if not all(above):
        return ranged.select("tau", F.lit(None).cast("double").alias("j")).limit(0)
    known = spark.createDataFrame(offsets, "part int, pos_above long, neg_above long")
    own = Window.partitionBy("part").orderBy(F.desc("tau")).rowsBetween(Window.unboundedPreceding, 0)
    pos, neg = (F.sum(c).over(own) + F.col(f"{c}_above") for c in ("pos", "neg"))
    j = ranged.join(F.broadcast(known), "part").withColumn("j", F.round(pos / above[0] - neg / above[1], 9))  # a row for each partition is broadcast
    return j.orderBy(F.desc("j"), "tau").limit(1).select("tau", "j")


def char_error_rate(pairs: DataFrame, reference: str, hypothesis: str):
    """Edit distance by characters over the reference's length; an empty reference gives 0 or 1."""
    r, h = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(hypothesis), F.lit(""))
    return pairs.withColumn("cer", F.when(F.length(r) > 0, F.levenshtein(r, h) / F.length(r)).otherwise((F.length(h) > 0).cast("double")))


def cell_f1(cells: DataFrame, predicted: DataFrame) -> DataFrame:
    """F1 of cells (table_id, value) as bags: the intersection counts each value as often as both have it."""
    a = cells.groupBy("table_id", "value").agg(F.count(F.lit(1)).alias("c"))
    b = predicted.groupBy("table_id", "value").agg(F.count(F.lit(1)).alias("p"))
    both = a.join(b, ["table_id", "value"], "full").groupBy("table_id").agg(F.sum(F.least(F.coalesce("c", F.lit(0)), F.coalesce("p", F.lit(0)))).alias("shared"), F.sum(F.coalesce("c", F.lit(0))).alias("gold"), F.sum(F.coalesce("p", F.lit(0))).alias("found"))
    return both.withColumn("f1", F.when(F.col("gold") + F.col("found") > 0, 2 * F.col("shared") / (F.col("gold") + F.col("found"))))  # nothing on both sides: undefined


def randomisation_p(pairs: DataFrame, rounds: int = 10_000, seed: int = 20260101) -> DataFrame:
    """(metric, p_random) of pairs (metric, query_id, difference): Fisher's randomisation test, how often random signs give as large a sum.

    A pair's signs in all rounds are bits of a generator that its metric and query_id key, so they don't depend on partitions; tasks sum `rounds`
    numbers for each metric, and Spark adds these up. Without any difference p is 1.
    """
    ship(pairs.sparkSession)
    width = -(-rounds // 8)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for metric, key, d in zip(*(batch.column(n).to_pylist() for n in ("metric", "key", "difference")), strict=True):
                bits = np.random.Generator(np.random.Philox(key=key & ((1 << 64) - 1))).bytes(width)
                signs = np.unpackbits(np.frombuffer(bits, np.uint8))[:rounds].astype(np.float64) * 2 - 1
                own = sums.setdefault(metric, np.zeros(rounds))
                own += signs * d
        for metric, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([metric] * rounds, pa.string()), pa.array(np.arange(rounds), pa.int32()), pa.array(own)], names=["metric", "round", "total"])

    rows = pairs.select("metric", F.xxhash64(F.lit(seed), "metric", "query_id").alias("key"), F.col("difference").cast("double").alias("difference"))
    totals = rows.mapInArrow(run, "metric string, round int, total double").groupBy("metric", "round").agg(F.sum("total").alias("total"))
    seen = pairs.groupBy("metric").agg(F.abs(F.sum("difference")).alias("seen"), F.max(F.abs("difference")).alias("largest"))
    met = totals.join(seen, "metric").groupBy("metric").agg(F.count_if(F.abs("total") >= F.col("seen") - 1e-9).alias("as_large"), F.max("largest").alias("largest"))
    return met.select("metric", F.when(F.col("largest") > 0, (F.col("as_large") + 1) / (rounds + 1)).otherwise(1.0).alias("p_random"))


def metrics_at(run: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query_id, metric, value) for each query of gold: recall, precision, mrr, ndcg, hit_rate, hits and map at each k, and first_hit_rank.

    A chunk that run repeats takes up a position but counts once; a query that run lacks found nothing.
    """
    want = gold.select("query_id", "chunk_id").distinct()
    size = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    order = Window.partitionBy("query_id").orderBy("first")
    seen = run.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("first")).withColumn("place", F.row_number().over(order))
    hits = seen.join(want, ["query_id", "chunk_id"], "left_semi").withColumn("so_far", F.row_number().over(order))
    sums, values = [F.min("first").alias("first")], []
    for k in ks:
        inside = F.col("first") <= k
        sums += [F.count_if(inside).alias(f"hits{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("place") + 1))).alias(f"dcg{k}"), F.sum(F.when(inside, F.col("so_far") / F.col("place"))).alias(f"ap{k}")]
    got = size.join(hits.groupBy("query_id").agg(*sums), "query_id", "left")
    for k in ks:
        found, most = F.coalesce(f"hits{k}", F.lit(0)), F.least(F.col("relevant"), F.lit(k))
        ideal = F.aggregate(F.sequence(F.lit(1), most.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
        one = {"recall": found / F.col("relevant"), "precision": found / k, "mrr": F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0), "ndcg": F.coalesce(F.col(f"dcg{k}") / ideal, F.lit(0.0)), "hit_rate": (found > 0).cast("double"), "hits": found.cast("double"), "map": F.coalesce(F.col(f"ap{k}") / most, F.lit(0.0))}
        values += [F.struct(F.lit(f"{name}@{k}").alias("metric"), v.cast("double").alias("value")) for name, v in one.items()]
    values.append(F.struct(F.lit("first_hit_rank").alias("metric"), F.col("first").cast("double").alias("value")))
    return got.select("query_id", F.explode(F.array(*values)).alias("m")).select("query_id", "m.*")


def metric_means(values: DataFrame) -> DataFrame:
    """(metric, mean, n) over queries; undefined values are left out."""
    return values.groupBy("metric").agg(F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("mean"), F.count(F.lit(1)).alias("n"))


def compare_runs(base: DataFrame, candidate: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(metric, n, base, candidate, gain, t, p_t, p_random) over the queries that both (query_id, metric, value) have.

    Means and deviations are aggregates; t is null below two queries, infinite where all differences are equal and not 0.
    """
    pairs = base.select("query_id", "metric", F.col("value").alias("base")).join(candidate.select("query_id", "metric", F.col("value").alias("candidate")), ["query_id", "metric"])
    pairs = pairs.where("base is not null and candidate is not null").withColumn("difference", F.col("candidate") - F.col("base"))
    sums = pairs.groupBy("metric").agg(F.count(F.lit(1)).cast("int").alias("n"), F.avg("base").alias("base"), F.avg("candidate").alias("candidate"), F.avg("difference").alias("mean"), F.stddev_samp("difference").alias("spread"))
    t = F.when(F.col("spread") > 0, F.col("mean") / (F.col("spread") / F.sqrt("n"))).when(F.col("n") < 2, F.lit(None)).when(F.col("mean") == 0, 0.0).otherwise(F.signum("mean") * F.lit(math.inf))
    gain = F.when(F.col("base") != 0, (F.col("candidate") - F.col("base")) / F.col("base") * 100).when(F.col("candidate") > 0, F.lit(math.inf)).otherwise(0.0)
    ship(base.sparkSession)

    def tails(values: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([math.nan if math.isnan(x) else 0.0 if math.isinf(x) else student_p(x, k - 1) for x, k in zip(values.astype(float), n, strict=True)])

    p_t = F.pandas_udf(tails, "double")  # a row for each metric
    rows = sums.withColumns({"t": t, "gain": gain}).withColumn("p_t", F.when(F.col("t").isNotNull(), p_t("t", "n")))
    return rows.join(randomisation_p(pairs, rounds), "metric").select("metric", "n", "base", "candidate", "gain", "t", "p_t", "p_random")


def significant(p: str = "p_t", alpha: float = 0.05):
    return F.col(p) < alpha


def arms(base: Config | None = None) -> list[tuple[str, Config, bool]]:
    """(name, settings, reranked) of the standard comparison: words alone, vectors alone, both, both with the reranker."""
    c = base or Config()
    deep = replace(c, dense_top_k=max(c.dense_top_k, c.eval_depth), sparse_top_k=max(c.sparse_top_k, c.eval_depth), rerank_top_k=max(c.rerank_top_k, c.eval_depth))
    mixed = replace(deep, weight_dense=1.0, weight_sparse=0.6, weight_char_ngram=0.4)
    alone = replace(deep, weight_dense=1.0, weight_sparse=0.0, weight_char_ngram=0.0, anchored_sparse_weight=0.0)
    return [("bm25", replace(deep, weight_dense=0.0, weight_sparse=1.0, weight_char_ngram=0.0), False), ("dense", alone, False), ("hybrid", mixed, False), ("hybrid+rerank", mixed, True)]


def weight_arms(base: Config | None = None, sparse: tuple = (0.0, 0.4, 0.6, 0.8, 1.0), ngram: tuple = (0.0, 0.4)) -> list[tuple[str, Config, bool]]:
    """The weights of the word and the n-gram branch, each with each, without the raise for anchors."""
    deep = arms(base)[2][1]
    return [(f"w_sparse={s:g}/w_ngram={n:g}", replace(deep, weight_sparse=s, weight_char_ngram=n, anchored_sparse_weight=0.0), False) for s in sparse for n in ngram]


def top_k_arms(base: Config | None = None, values: tuple = (2, 3, 5, 8, 12)) -> list[tuple[str, Config, bool]]:
    deep = arms(base)[2][1]
    return [(f"final_top_k={k}", replace(deep, final_top_k=k), True) for k in values]


def run_arms(chunks: DataFrame, queries: DataFrame, gold: DataFrame, chosen: list[tuple[str, Config, bool]] | None = None) -> DataFrame:
    """(arm, query_id, metric, value) of each arm, one plan for all its queries."""
    out = None
    for name, config, reranked in chosen or arms():
        got = R.retrieve(chunks, queries, config, reranked=reranked)
        values = metrics_at(R.ranked_list(got["candidates"].where("duplicate_of is null"), config.eval_depth), gold).withColumn("arm", F.lit(name))
        out = values if out is None else out.unionByName(values)
    return out


def stratified_sample(chunks: DataFrame, count: int = 50, per_document: int = 8, min_chars: int = 250, seed: str = "20260101") -> DataFrame:
    """`count` leaves (chunk_id, document_id, level, text) in turn over documents, each document's in the order of a seeded hash."""
    fit = chunks.where((F.col("level") == "L2") & (F.length("text") >= min_chars))
    own = Window.partitionBy("document_id").orderBy(F.md5(F.concat(F.lit(seed + "/"), F.col("chunk_id").cast("string"))))
    turn = fit.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= per_document)
    return turn.orderBy("turn", "document_id").limit(count)


def gold_issues(questions: DataFrame, chunks: DataFrame, least: int = 38) -> DataFrame:
    """(question_id, issue, uid): what is wrong with gold questions (question_id, question, collection_id, gold_uids).

    empty_question, duplicate (of an earlier one, spaces and case aside), no_gold, and for uids: stale_uid, foreign_uid, not_leaf;
    too_few if fewer than `least` questions have gold chunks.
    """
    none = F.lit(None).cast("string")
    text = T.squeezed(F.lower(F.coalesce("question", F.lit(""))))
    q = questions.withColumns({"_text": text, "_n": F.row_number().over(Window.partitionBy(text).orderBy("question_id")), "_gold": F.coalesce("gold_uids", F.array().cast("array<string>"))})
    plain = F.array(F.when(F.col("_text") == "", "empty_question").when(F.col("_n") > 1, "duplicate"), F.when(F.size("_gold") == 0, "no_gold"))
    own = q.select("question_id", F.explode(plain).alias("issue"), none.alias("uid")).where("issue is not null")
    known = chunks.select(F.col("chunk_uid").alias("uid"), F.col("collection_id").alias("_c"), F.col("level").alias("_l"))
    met = q.select("question_id", "collection_id", F.explode("_gold").alias("uid")).join(known, "uid", "left")
    of = F.when(F.col("_l").isNull(), F.array(F.lit("stale_uid"))).otherwise(F.array(F.when(F.col("collection_id") != F.col("_c"), "foreign_uid"), F.when(F.col("_l") != "L2", "not_leaf")))
    uids = met.select("question_id", F.explode(of).alias("issue"), "uid").where("issue is not null")
    few = q.agg(F.count_if(F.size("_gold") > 0).alias("n")).where(F.col("n") < least).select(F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"), F.lit("too_few").alias("issue"), none.alias("uid"))
    return own.unionByName(uids).unionByName(few)


def abstention_rates(questions: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: how often unanswerable questions (question_id, answerable) were refused, answerable ones too, and the balanced accuracy."""
    rows = questions.join(decided.select("question_id", "abstained"), "question_id", "left").withColumn("no", F.coalesce("abstained", F.lit(False)))
    out = rows.agg(F.count_if(~F.col("answerable")).alias("unanswerable"), F.count_if(~F.col("answerable") & F.col("no")).alias("unanswerable_refused"), F.count_if("answerable").alias("answerable"), F.count_if(F.col("answerable") & F.col("no")).alias("answerable_refused"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = out.withColumns({"correct_refusals": share("unanswerable_refused", "unanswerable"), "false_refusals": share("answerable_refused", "answerable")})
    return out.withColumn("balanced_accuracy", (F.col("correct_refusals") + 1 - F.col("false_refusals")) / 2)


def graded_ndcg(judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) with gains of 2 to the relevance less 1, over judged (query_id, rank, relevance)."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank"))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    rows = judged.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).withColumn("ideal", ideal)
    sums = rows.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1))).alias("dcg"), F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1))).alias("idcg"))
    return sums.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def score_features(scores, n: int = 10):
    """The n best of an array of scores, ascending, filled up in front with the least; zeros without scores."""
    rising = F.slice(F.sort_array(scores), F.greatest(F.size(scores) - n + 1, F.lit(1)), F.lit(n))
    return F.when(F.size(scores) > 0, F.concat(F.array_repeat(F.array_min(scores), F.greatest(n - F.size(scores), F.lit(0))), rising)).otherwise(F.array_repeat(F.lit(0.0), n))


def fit_u_lin(samples: DataFrame, config: Config | None = None) -> dict:
    """A ridge regression of ndcg on the score features of samples (query_id, scores, ndcg), and the threshold that parts useful queries.

    The driver gets sums of products, n + 2 squared numbers at most, and counts per predicted value. `ready` once there are enough queries.
    """
    c = config or Config()
    n = c.calibration_features
    x = [F.element_at("x", i + 1) for i in range(n)]
    rows = samples.select(score_features(F.col("scores"), n).alias("x"), F.col("ndcg").alias("y"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.sum(v * F.col("y")).alias(f"xy{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"xx{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    if not sums["n"]:
        raise ValueError("no labelled query")
    mean = np.array([sums[f"m{i}"] for i in range(n)])
    xx = np.array([[sums[f"xx{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) - sums["n"] * np.outer(mean, mean)
    xy = np.array([sums[f"xy{i}"] for i in range(n)]) - sums["n"] * mean * sums["y"]
    w = np.linalg.solve(xx + c.ridge_lambda * np.eye(n), xy)
    model = {"weights": w.tolist(), "intercept": float(sums["y"] - mean @ w), "n": sums["n"], "ready": sums["n"] >= c.min_calibration_queries}
    predicted = rows.select(predict_u_lin(F.col("x"), model).alias("p"), (F.col("y") >= c.min_useful_ndcg).cast("int").alias("useful"))
    # the threshold of a query's worth is itself a candidate
    at = predicted.unionByName(predicted.limit(1).select(F.lit(c.min_useful_ndcg).alias("p"), F.lit(None).cast("int").alias("useful")))
    kinds = predicted.agg(F.count_distinct("useful").alias("k")).first()["k"]
    best = youden(at, "p", "useful").first() if kinds == 2 else None
    return model | {"tau": best["tau"] if best else c.min_useful_ndcg}


def predict_u_lin(features, model: dict):
    """The predicted ndcg of a feature array, from 0 to 1."""
    raw = sum((F.element_at(features, i + 1) * w for i, w in enumerate(model["weights"])), F.lit(model["intercept"]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def decide(scored: DataFrame, queries: DataFrame, config: Config | None = None, model: dict | None = None) -> DataFrame:
    """(query_id, abstain, confidence, mode, threshold, supporting): by the fitted model once it is ready, else by supporting scores; empty without scores."""
    c = config or Config()
    rows = queries.select("query_id").join(scored.groupBy("query_id").agg(F.collect_list("score").alias("scores")), "query_id", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<double>")))
    rows = rows.withColumn("supporting", F.size(F.filter("scores", lambda x: x >= c.threshold)))
    empty = F.size("scores") == 0
    if model and model["ready"]:
        value = predict_u_lin(score_features(F.col("scores"), c.calibration_features), model)
        mode, limit, abstain = "u_lin", model["tau"], value < model["tau"]
    else:
        value, mode, limit, abstain = F.array_max("scores"), "threshold", c.threshold, F.col("supporting") < c.supporting
    return rows.select("query_id", (empty | abstain).alias("abstain"), F.when(empty, 0.0).otherwise(value).alias("confidence"), F.when(empty, "empty").otherwise(mode).alias("mode"), F.lit(limit).alias("threshold"), "supporting")


def word_distance(a: list[str], b: list[str]) -> int:
    """Edit distance by words, a row of the table at a time."""
    row = np.arange(len(b) + 1)
    for i, word in enumerate(a, 1):
        swap = row[:-1] + np.array([word != x for x in b], int) if b else row[:0]
        step = np.concatenate([[i], np.minimum(row[1:] + 1, swap)])
        row = np.minimum.accumulate(step - np.arange(len(step))) + np.arange(len(step))
    return int(row[-1])


def ocr_text(text: str | None, without_apostrophes: bool = False) -> str:
    """What is compared: composed letters, no soft hyphens, single spaces, and no apostrophes if they are not to count."""
    plain = unicodedata.normalize("NFC", text or "").replace("\u00ad", "")
    return " ".join((plain.translate({ord(c): None for c in APOSTROPHES}) if without_apostrophes else plain).split())


def confusions(pairs: DataFrame, by: str, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """(by, class, expected, found, n): how often each character stands for another, was added or lost, in the alignments of pairs, and its class.

    Texts are compared as ocr_text spells them; null is empty. A batch of pairs is aligned together, and counted before it is shuffled.
    """
    ship(pairs.sparkSession)

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            texts = [(ocr_text(x), ocr_text(y)) for x, y in zip(batch.column("r").to_pylist(), batch.column("h").to_pylist(), strict=True)]
            for key, found in zip(batch.column("k").to_pylist(), differences(texts), strict=True):
                counts.update((key, *pair) for pair in found)
            rows = [(k, confusion_class(x, y), x, y, n) for (k, x, y), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.string()] * 4 + [pa.int64()], strict=True)], names=["k", "class", "expected", "found", "n"])

    rows = pairs.select(F.col(by).cast("string").alias("k"), F.col(reference).alias("r"), F.col(hypothesis).alias("h"))
    return rows.mapInArrow(run, "k string, class string, expected string, found string, n long").groupBy(F.col("k").alias(by), "class", "expected", "found").agg(F.sum("n").alias("n"))


def confusion_classes(counts: DataFrame, by: str) -> DataFrame:
    """(by, class, n) of confusions()."""
    return counts.groupBy(by, "class").agg(F.sum("n").alias("n"))


def ocr_scores(pairs: DataFrame) -> DataFrame:
    """pairs (engine, page, reference, hypothesis, seconds, error) with cer, wer, cer_soft (apostrophes aside) and swaps; null rates without reference."""
    ship(pairs.sparkSession)

    def rate(distance: int, size: int) -> float | None:
        return distance / size if size else None

    def run(frames):
        for pdf in frames:
            rows = []
            swaps = differences([(ocr_text(r), ocr_text(h)) for r, h in zip(pdf["reference"], pdf["hypothesis"], strict=True)])
            for r, h, swapped in zip(pdf["reference"], pdf["hypothesis"], swaps, strict=True):
                a, b, sa, sb = ocr_text(r), ocr_text(h), ocr_text(r, True), ocr_text(h, True)
                rows.append((rate(word_distance(list(a), list(b)), len(a)), rate(word_distance(a.split(), b.split()), len(a.split())), rate(word_distance(list(sa), list(sb)), len(sa)), [f"{x}>{y}" for x, y in swapped]))
            yield pd.concat([pdf[["engine", "page", "seconds", "error"]].reset_index(drop=True), pd.DataFrame(rows, columns=["cer", "wer", "cer_soft", "swaps"])], axis=1)

    return pairs.select("engine", "page", "reference", "hypothesis", F.col("seconds").cast("double").alias("seconds"), F.col("error").cast("string").alias("error")).mapInPandas(run, "engine string, page string, seconds double, error string, cer double, wer double, cer_soft double, swaps array<string>")


def ocr_report(scores: DataFrame) -> DataFrame:
    """(engine, pages, mean and median rates, seconds, failures, top) over pages without error; top: the 15 most frequent substitutions."""
    good = (F.coalesce("error", F.lit("")) == "") & F.col("cer").isNotNull()
    own = lambda c: F.when(good, F.col(c))
    out = scores.groupBy("engine").agg(F.count_if(good).alias("pages"), F.avg(own("cer")).alias("mean_cer"), F.median(own("cer")).alias("median_cer"), F.avg(own("wer")).alias("mean_wer"), F.median(own("wer")).alias("median_wer"), F.sum("seconds").alias("seconds"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failures"))
    counts = scores.where(good).select("engine", F.explode("swaps").alias("swap")).groupBy("engine", "swap").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("n"), "swap"))).where("k <= 15")
    return out.join(best.groupBy("engine").agg(F.sort_array(F.collect_list(F.struct("k", "swap", "n"))).alias("top")), "engine", "left")


def positional_f1(cells: DataFrame, predicted: DataFrame) -> DataFrame:
    """(table_id, f1) of cells (table_id, row, col, value) that stand at the same place with the same value; null where neither side has any."""
    key = ["table_id", "row", "col", "value"]
    same = cells.select(key).join(predicted.select(key), key, "left_semi").groupBy("table_id").agg(F.count(F.lit(1)).alias("same"))
    sizes = cells.groupBy("table_id").agg(F.count(F.lit(1)).alias("gold")).join(predicted.groupBy("table_id").agg(F.count(F.lit(1)).alias("found")), "table_id", "full").join(same, "table_id", "left")
    both = F.coalesce("gold", F.lit(0)) + F.coalesce("found", F.lit(0))
    return sizes.select("table_id", F.when(both > 0, 2 * F.coalesce("same", F.lit(0)) / both).alias("f1"))


def markdown_report(rows: list[dict], columns: list[str] | None = None) -> str:
    """A Markdown table of a report's few rows."""
    names = columns or (list(rows[0]) if rows else [])
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(names), "|" + "---|" * len(names), *[line([_shown(r.get(c, "")) for c in names]) for r in rows]]) if rows else ""


def latex_report(rows: list[dict], caption: str, label: str) -> str:
    """The same as a LaTeX table with booktabs rules."""
    names = list(rows[0]) if rows else []
    line = lambda cells: " & ".join(str(c).replace("_", r"\_") for c in cells) + r" \\"
    body = [line(names), r"\midrule", *[line([_shown(r.get(c, "")) for c in names]) for r in rows]]
    head = [r"\begin{table}[htbp]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{l{'r' * (len(names) - 1)}}}", r"\toprule"]
    return "\n".join([*head, *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"]) if rows else ""


def _shown(value) -> str:
    if isinstance(value, float):
        return "—" if math.isnan(value) else "∞" if math.isinf(value) else f"{value:.4f}"
    return str(value)
