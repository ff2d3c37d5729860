"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_pass, bounded, crc_mod, hashed_sample, release

#: Labelled examples at most (those with the least hash of doc_id), neighbours that vote, examples of an index block,
#: examples that calibration scores at most, and the folds that they are held out in.
EXAMPLES, NEIGHBOURS, BLOCK, CALIBRATION, FOLDS = 3000, 15, 128, 2000, 3
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")

#: An example: its doc_id, its words with their counts, its label.
Example = tuple[int, dict[str, int], int]


def word_counts(text: str | None) -> Counter:
    """How often each lower-cased word of letters occurs in the whole text."""
    return Counter(_WORD.findall((text or "").lower()))


def term_weights(examples: list[Example]) -> tuple[dict[str, int], np.ndarray]:
    """Every word of the examples, numbered, and its weight: the inverse document frequency, times more the surer it marks toxic ones.

    The surplus is the log-likelihood (examples with the word times the divergence of their toxic rate from the
    base rate) beyond 3, which chance seldom gives. All words keep at least their inverse document frequency.
    """
    n, seen, toxic = len(examples), Counter(), Counter()
    for _, words, label in examples:
        seen.update(words.keys())
        if label:
            toxic.update(words.keys())
    names = {t: k for k, t in enumerate(sorted(seen))}
    base = sum(y for _, _, y in examples) / n if n else 0
    df, dp = np.array([seen[t] for t in names], float), np.array([toxic[t] for t in names], float)
    weights = np.log((1 + n) / (1 + df)) + 1
    if 0 < base < 1:
        rate = (dp + base) / (df + 1)
        gain = df * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
        weights *= 1 + np.where(rate > 2 * base, np.maximum(0, gain - 3), 0)
    return names, weights


class Index:
    """Inverted lists of unit vectors in blocks of examples, with the largest weight of each list in each block.

    Examples are placed in blocks by label and by their heaviest word, so that like ones share blocks and
    bounds are tight; ties between neighbours go by position, so by that order.
    """

    def __init__(self, examples: list[Example]) -> None:
        self.names, self.idf = term_weights(examples)
        vectors = [self.vector(words) for _, words, _ in examples]
        order = sorted(range(len(examples)), key=lambda k: (-examples[k][2], int(vectors[k][0][np.argmax(vectors[k][1])]) if len(vectors[k][0]) else -1, examples[k][0]))
        self.ids = [examples[k][0] for k in order]
        self.labels = np.array([examples[k][2] for k in order], float)
        self.base = float(self.labels.mean()) if len(order) else 0.5
        size = [len(vectors[k][0]) for k in order]
        term = np.concatenate([vectors[k][0] for k in order] or [np.empty(0, np.int64)])
        self.weight = np.concatenate([vectors[k][1] for k in order] or [np.empty(0)])
        self.doc = np.repeat(np.arange(len(order)), size)
        by_term = np.argsort(term, kind="stable")
        term, self.weight, self.doc = term[by_term], self.weight[by_term], self.doc[by_term]
        # one entry for each word and block: where its list begins there, and its largest weight
        self.blocks = -(-len(order) // BLOCK)
        cell = term * max(1, self.blocks) + self.doc // BLOCK
        self.begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
        self.length = np.diff(self.begin, append=len(cell))
        self.block = self.doc[self.begin] // BLOCK
        self.most = np.maximum.reduceat(self.weight, self.begin) if len(cell) else np.empty(0)
        self.entries = np.searchsorted(term[self.begin], np.arange(len(self.names) + 1))

    def vector(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector over the known words, (1 + ln count) * weight: their numbers and values."""
        at = np.fromiter((self.names.get(t, -1) for t in words), np.int64, len(words))
        times = np.fromiter(words.values(), np.float64, len(words))[at >= 0]
        at = at[at >= 0]
        value = (1 + np.log(times)) * self.idf[at]
        return at, value / np.sqrt(value @ value) if len(at) else value

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of largest cosine, smaller positions first among equals; exact: a block is left out only if its bound can't reach the k-th."""
        at, value = vector
        if not len(at):
            return []
        entry, own = _ranges(self.entries[at], self.entries[at + 1])
        weight, block = value[own], self.block[entry]
        bound = np.bincount(block, weight * self.most[entry], self.blocks) + 1e-9
        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bound, kind="stable")[: max(2, self.blocks // 8)]] = True
        score = self._scores(entry, weight, first[block])
        least = np.partition(score, -k)[-k] - 1e-9 if len(score) > k else 0
        rest = ~first & (bound >= max(least, 1e-9))
        if rest.any():
            score += self._scores(entry, weight, rest[block])
        score = np.round(score, 12)
        some = np.flatnonzero(score >= max(np.partition(score, -k)[-k] if len(score) > k else 0, 1e-12))
        return [(float(score[d]), int(d)) for d in some[np.lexsort((some, -score[some]))][:k]]

    def _scores(self, entry: np.ndarray, weight: np.ndarray, keep: np.ndarray) -> np.ndarray:
        entry, weight = entry[keep], weight[keep]
        post, own = _ranges(self.begin[entry], self.begin[entry] + self.length[entry])
        return np.bincount(self.doc[post], weight[own] * self.weight[post], len(self.labels))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic neighbours, weighted by squared cosine, with the base rate as a weak neighbour."""
        if not near:
            return self.base
        w = np.array([s * s for s, _ in near])
        return float((w @ self.labels[[d for _, d in near]] + 0.05 * self.base) / (w.sum() + 0.05))


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after the other, and the range that each is of."""
    n = end - begin
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) + np.repeat(begin - (np.cumsum(n) - n), n), own


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and non-decreasing rates."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for value, label in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([label, 1.0, value])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], top[2]]
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.5 * (b[0] / b[1])) / (b[1] + 0.5) for b in blocks])


class Model:
    """The index over all examples, and a calibration from votes on examples that were held out of the index."""

    def __init__(self, examples: list[Example]) -> None:
        self.index = Index(examples)
        self.knots = self.rates = np.empty(0)
        votes, labels = [], []
        for fold in range(FOLDS if 0 < self.index.base < 1 else 0):
            part = Index([e for k, e in enumerate(examples) if k % FOLDS != fold])
            for e in examples[fold::FOLDS][: -(-CALIBRATION // FOLDS)]:
                votes.append(part.vote(part.nearest(part.vector(e[1]))))
                labels.append(e[2])
            del part
        if votes:
            self.knots, self.rates = isotonic(np.array(votes), np.array(labels, float))
        self.cache: dict = {}

    def score(self, text: str | None) -> tuple[float, list[int]]:
        if text not in self.cache:  # repeated texts are scored once
            if len(self.cache) > 2000:
                self.cache.clear()
            near = self.index.nearest(self.index.vector(word_counts(text)))
            vote = calibrated = self.index.vote(near)
            if near and len(self.knots):
                calibrated = float(self.rates[min(np.searchsorted(self.knots, vote), len(self.rates) - 1)])
            # the calibrated rate, with a share of the vote itself to order equal rates
            self.cache[text] = float(np.clip(0.95 * calibrated + 0.05 * vote, 0, 1)), [self.index.ids[d] for _, d in near[:3]]
        return self.cache[text]


def _vectors(batches):
    for batch in batches:
        counts = [word_counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
            names=["doc_id", "toxic", "words", "times"],
        )


def learn(labelled: DataFrame) -> Model:
    """From (doc_id, text, toxic), a row for each doc_id; tasks count the words, so the driver gets counts, not texts."""
    rows = arrow_pass(labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), _vectors, "doc_id long, toxic int, words array<string>, times array<int>").toLocalIterator()
    shared: dict[str, str] = {}  # one string for each word
    examples = [(r["doc_id"], {shared.setdefault(w, w): n for w, n in zip(r["words"], r["times"], strict=True)}, r["toxic"]) for r in rows]
    model = Model(sorted(examples, key=lambda e: e[0]))
    del examples, shared
    release()
    return model


def _scores(broadcast):
    def run(batches):
        model = broadcast.value
        for batch in batches:
            got = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_ids of the three nearest examples) of every row of docs.

    Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1; those are held_out
    false. Labels other than 0 and 1 are not used, nor are doc_ids that labels contradict; of rows that repeat a
    labelled doc_id the least text is learned from. Null or empty text, and text without a word of any example, has no neighbour and gets
    the rate of toxic examples. Very long texts are one vector. Equally near examples are taken in the index's order. Repeated
    rows are scored each; extra columns are ignored; without labels every score is 0.5.

    The index holds the whole TF-IDF vectors of at most EXAMPLES examples, so it is broadcast at a bounded size.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long"), "toxic").where(crc_mod("doc_id", 3) != 1)
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    # doc_ids without a document are no examples, so they don't take places of the sample
    known = known.join(base.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = hashed_sample(known, EXAMPLES, "doc_id")
    model = learn(base.join(bounded(sample, EXAMPLES), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return arrow_pass(base, _scores(shared), "doc_id long, score double, evidence array<long>").withColumns({"held_out": held, "predicted": (F.col("score") >= THRESHOLD).cast("int")})
