"""Quality scores from a weak-label model: labellers' accuracies by EM, posteriors train a hashed linear scorer."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_pass, hashed_sample, release

#: Documents that the linear scorer is fitted on at most (those with the least hash), and its hashed features.
SAMPLE_DOCS, FEATURES = 4000, 1 << 12
REJECT_BELOW = 0.5


def measures() -> dict[str, Column]:
    """What the labellers look at; all from `text` and its `words`, JVM side."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / n
    words = F.col("words")
    count = F.greatest(F.size(words), F.lit(1))
    return {
        "n_words": F.size(words),
        "letters": share(r"\p{L}+"),
        "capitals": share(r"\p{Lu}+"),
        "marks": share(r"[^\p{L}\p{N}\s.,;:'\"()\-]+"),
        "digits": share(r"\p{N}+"),
        "distinct": F.size(F.array_distinct(words)) / count,
        "runs": F.size(F.filter(words, lambda w, i: w == F.get(words, i + 1))) / count,
        "longest": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)),
    }


def voted(docs: DataFrame) -> DataFrame:
    """docs with the measures and votes of each text; its words are split once."""
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), lambda w: w != "")
    return docs.withColumn("words", words).withColumns(measures()).drop("words").withColumns(votes())


def votes() -> dict[str, Column]:
    """Each labeller: 1 for good, 0 for bad, null where it has no opinion. They overlap on purpose."""
    c, when = F.col, F.when
    return {
        "v_letters": when(c("letters") < 0.6, 0),
        "v_capitals": when(c("capitals") > 0.3, 0),
        "v_marks": when(c("marks") > 0.03, 0),
        "v_digits": when(c("digits") > 0.25, 0),
        "v_repeats": when((c("distinct") < 0.35) & c("n_words").between(30, 1500), 0).when((c("distinct") >= 0.5) | (c("n_words") < 30), 1),
        "v_runs": when(c("runs") > 0.25, 0).when(c("runs") < 0.05, 1),
        "v_longest": when(c("longest") > 60, 0),
        "v_words": when(c("n_words") < 2, 0),
        "v_prose": when((c("letters") >= 0.7) & (c("capitals") < 0.15) & (c("marks") < 0.02) & (c("digits") < 0.1) & (c("n_words") >= 2), 1),
    }


class LabelModel:
    """How labellers answer (bad, good, no opinion) given the true label, by EM over counts of vote patterns."""

    def __init__(self, patterns: list[tuple], counts: list[int], rounds: int = 100) -> None:
        v = self.coded(patterns)
        n, k = np.array(counts, float), v.shape[1]
        # the start says which label is which: labellers are right more often than not
        self.answers = np.stack([np.tile([0.4, 0.1, 0.5], (k, 1)), np.tile([0.05, 0.55, 0.4], (k, 1))])
        self.prior = 0.8
        for _ in range(rounds if len(patterns) else 0):
            p = self.posterior(v)
            self.prior = float(np.clip((n @ p + 8) / (n.sum() + 10), 0.01, 0.99))
            for label, weight in ((0, n * (1 - p)), (1, n * p)):
                said = np.stack([(weight[:, None] * (v == a)).sum(0) for a in range(3)], 1) + 0.5
                self.answers[label] = said / said.sum(1, keepdims=True)

    @staticmethod
    def coded(patterns: list[tuple]) -> np.ndarray:
        return np.array([[2 if x is None else int(x) for x in p] for p in patterns], int).reshape(len(patterns), len(patterns[0]) if patterns else len(votes()))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for k in range(v.shape[1]):
            odds += np.log(self.answers[1, k, v[:, k]]) - np.log(self.answers[0, k, v[:, k]])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right when it has an opinion."""
        good, bad = self.answers[1] * self.prior, self.answers[0] * (1 - self.prior)
        return (good[:, 1] + bad[:, 0]) / (good[:, :2].sum(1) + bad[:, :2].sum(1))


def features(text: str | None) -> np.ndarray:
    """Hashed features of a whole text: square roots of the frequencies of byte-class 4-grams, and buckets of how words repeat.

    Letters of one case are one class, so that the features tell form, not topic.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    b, words = np.frombuffer(raw, np.uint8), raw.split()
    out = np.zeros(FEATURES)
    if len(b) >= 4:
        code = _SHAPES[b].astype(np.uint32)
        code = code[:-3] | (code[1:-2] << np.uint32(8)) | (code[2:-1] << np.uint32(16)) | (code[3:] << np.uint32(24))
        slot = (code * np.uint32(2654435761)) >> np.uint32(20)
        out = 3 * np.sqrt(np.bincount(slot, minlength=FEATURES) / len(code))
    n = max(1, len(words))
    buckets = (len(set(words)) * 20 // n, sum(map(eq, words, words[1:])) * 20 // n, min(len(words), 4000).bit_length())
    for kind, bucket in enumerate((*buckets, buckets[0] * 100 + buckets[2])):
        out[(kind * 977 + bucket * 131 + 7) * 2654435761 % FEATURES] += 0.5
    out[0] += 1
    return out


def _shapes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[0x80:] = ord("a")  # bytes of letters beyond ASCII, mostly
    return out


_SHAPES = _shapes()


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, full-batch gradient steps with momentum: the same result each time."""
    w, speed, y = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype), y.astype(x.dtype)
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - rate * (x.T @ (p - y) / len(x) + penalty * w)
        w += speed
    return w


def _score(broadcast):
    def run(batches):
        w = broadcast.value
        for batch in batches:
            scores = [float(1 / (1 + np.exp(-np.clip(features(t) @ w, -30, 30)))) for t in batch.column("text").to_pylist()]
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return run


def _features_of(batches):
    """The features that are not zero: their slots and values."""
    for batch in batches:
        slots, values = [], []
        for text in batch.column("text").to_pylist():
            x = features(text).astype("<f4")
            at = np.flatnonzero(x)
            slots.append(at.astype("<u2").tobytes())
            values.append(x[at].tobytes())
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(slots, pa.binary()), pa.array(values, pa.binary())], names=[*keep, "slots", "x"])


def fit_quality(docs: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """The label model, from the vote patterns of all documents, and the scorer, from a bounded sample of them.

    There are at most 3 to the number of labellers patterns; their counts and the sample's features are all that the driver gets.
    """
    named = list(votes())
    rows = voted(docs.select(F.col("text").cast("string").alias("text"))).groupBy(*named).agg(F.count(F.lit(1)).alias("n")).orderBy(*named).collect()
    model = LabelModel([tuple(r[v] for v in named) for r in rows], [r["n"] for r in rows])
    sample = hashed_sample(docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id")), SAMPLE_DOCS, "doc_id", "text").select("text")
    sample = voted(sample).select("text", *named)
    x, patterns = np.zeros((SAMPLE_DOCS, FEATURES), np.float32), []
    for row in arrow_pass(sample, _features_of, ", ".join(f"{v} int" for v in named) + ", slots binary, x binary").toLocalIterator():
        x[len(patterns), np.frombuffer(row["slots"], "<u2")] = np.frombuffer(row["x"], "<f4")
        patterns.append(tuple(row[k] for k in named))
    w = fit_linear(x[: len(patterns)], model.posterior(LabelModel.coded(patterns)))
    del x
    release()
    return model, w


def quality_scores(docs: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1), keep (score at least 0.5) of every row of docs (doc_id, text), from whole texts.

    Null text counts as empty. Repeated rows are scored each, null doc_ids stay, extra columns are
    ignored; an empty table gives an empty result. Labels are not used: heuristics vote, EM over the
    counts of their vote patterns finds how far each can be trusted, and the posteriors train the scorer.
    """
    _, w = fit_quality(docs)
    shared = docs.sparkSession.sparkContext.broadcast(w)
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return arrow_pass(base, _score(shared), "doc_id long, score double").withColumn("keep", F.col("score") >= REJECT_BELOW)


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that score at least 0.5; each row is judged by its own text, so none needs an id."""
    _, w = fit_quality(docs)
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for batch in batches:
            keep = [float(features(t) @ shared.value) >= 0 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return arrow_pass(docs, run, docs.schema)
