"""Finding benchmark passages in documents by spaced seeds, tolerant of substituted words."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import U64, arrow_pass, bounded, mix, staged, word_hashes

#: Words of a compared window, and how many of them may differ.
WINDOW, SUBSTITUTIONS = 13, 2
#: Shorter items down to so many words may differ in one word; those below are matched exactly.
LEAST_WORDS = 8
#: Windows of the benchmark that are joined in one pass over the documents; a larger benchmark takes more passes.
BLOCK_WINDOWS = 2_000_000
#: Pairs of equal seeds that are verified at once.
PAIRS = 100_000


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words, cut at white space and stripped of punctuation at both ends; what is left empty goes."""
    words = [w.strip(".,;:!?\"'()[]{}*#&%$|") for w in (text or "").lower().split()]
    return word_hashes([w.encode("utf-8", "surrogatepass") for w in words if w])


def masks(width: int, wrong: int) -> list[np.ndarray]:
    """Spaced seeds over width positions: any `wrong` positions are ignored together by at least one of them."""
    parts = np.array_split(np.arange(width), wrong + 2)
    return [np.concatenate([p for k, p in enumerate(parts) if k not in skip]) for skip in combinations(range(len(parts)), wrong)] if wrong else [np.arange(width)]


def allowed(width: int) -> int:
    return SUBSTITUTIONS if width >= WINDOW else int(width >= LEAST_WORDS)


def place_factors(width: int) -> np.ndarray:
    """An odd factor for each place of a window."""
    return mix(np.arange(1, width + 1, dtype=U64)) | U64(1)


def scaled(h: np.ndarray, width: int) -> list[np.ndarray]:
    """For each place of a window, the words at it times its factor: seeds and windows are sums of some of these."""
    n = max(0, len(h) - width + 1)
    return [h[k : n + k] * f for k, f in enumerate(place_factors(width))]


def seed_hashes(parts: list[np.ndarray], mask: np.ndarray, name: int) -> np.ndarray:
    return mix(sum((parts[k] for k in mask[1:]), parts[mask[0]] + U64(name)))


class Index:
    """Seeds of a block of benchmark items: sorted hashes, with item and position of each.

    Equal windows of an item stand for themselves once, at their first place.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        lengths = np.array([len(h) for _, h in items])
        self.words = np.concatenate([h for _, h in items])
        self.first = np.cumsum(lengths) - lengths
        self.width = np.minimum(WINDOW, lengths)
        owner = np.repeat(np.arange(len(items)), lengths)
        self.seeds: dict[int, list[tuple]] = {}
        for width in sorted(set(self.width.tolist())):
            parts, own = scaled(self.words, width), owner[: max(0, len(self.words) - width + 1)]
            at = np.flatnonzero((self.width[own] == width) & (np.arange(len(own)) + width <= (self.first + lengths)[own]))
            at = at[_firsts(seed_hashes(parts, np.arange(width), 99)[at], own[at])]
            self.seeds[width] = []
            for m, mask in enumerate(masks(width, allowed(width))):
                keys = seed_hashes(parts, mask, m)[at]
                order, sieve = np.argsort(keys, kind="stable"), np.zeros(1 << 20, bool)
                sieve[(keys & U64((1 << 20) - 1)).astype(np.int64)] = True
                self.seeds[width].append((mask, keys[order], at[order], own[at[order]], sieve))

    def matches(self, docs: list[np.ndarray]) -> np.ndarray:
        """Rows (number of the document, number of the item, document position, item position, words that match in the best window)."""
        lengths = np.array([len(h) for h in docs])
        h, first = np.concatenate([*docs, np.empty(0, U64)]), np.cumsum(lengths) - lengths
        owner, found = np.repeat(np.arange(len(docs)), lengths), [np.empty((0, 5), np.int64)]
        for width, seeds in self.seeds.items():
            if len(h) < width:
                continue
            parts, own = scaled(h, width), owner[: len(h) - width + 1]
            whole = np.arange(len(own)) + width <= (first + lengths)[own]
            inside = np.arange(width)
            for m, (mask, keys, places, items, sieve) in enumerate(seeds):
                s = seed_hashes(parts, mask, m)
                at = np.flatnonzero(sieve[(s & U64((1 << 20) - 1)).astype(np.int64)] & whole)
                lo, hi = np.searchsorted(keys, s[at], "left"), np.searchsorted(keys, s[at], "right")
                at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
                if not len(at):
                    continue
                full = mix(sum((parts[k][at] for k in range(1, width)), parts[0][at]))
                once = _firsts(full, own[at])
                at, lo, hi = at[once], lo[once], hi[once]
                ends = np.cumsum(hi - lo)
                for begin in range(0, int(ends[-1]), PAIRS):  # pairs of equal seeds, so many at a time
                    pair = np.arange(begin, min(begin + PAIRS, int(ends[-1])))
                    k = np.searchsorted(ends, pair, "right")
                    post = lo[k] + pair - (ends[k] - (hi - lo)[k])
                    p, q = at[k], places[post]
                    same = (h[p[:, None] + inside] == self.words[q[:, None] + inside]).sum(1)
                    good = np.flatnonzero(same >= width - allowed(width))
                    d, n = own[p[good]], items[post[good]]
                    found.append(np.stack([d, n, p[good] - first[d], q[good] - self.first[n], same[good]], 1))
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 4], rows[:, 1], rows[:, 0]))]
        return rows[np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(1)]))] if len(rows) else rows


def _firsts(windows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Ascending positions of the first of equal windows of each owner."""
    return np.sort(np.unique(mix(windows + owner.astype(U64)), return_index=True)[1])


def _matches(broadcast):
    def run(batches):
        index = Index([(i, np.frombuffer(b, U64)) for i, b in broadcast.value])
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                rows = index.matches([tokens(t) for t in part.column("text").to_pylist()])
                item = rows[:, 1]
                cols = [index.ids[item], rows[:, 2], rows[:, 3], rows[:, 4], index.width[item]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows[:, 0])), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "item_id", "doc_word", "item_word", "matched", "width"])

    return run


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that share a window: doc_id, item_id, doc_word, item_word, matched, width.

    A window is 13 words, or a shorter item's whole length; in 13, up to two words may be
    substituted, in 8 to 12 one, in fewer none. The columns tell the best window: its first word in either, how many words
    match, its width; of equally good ones the first in the document, then in the item. Null texts, null ids of items, and items without words match nothing; repeated
    rows of documents are told each, of items that repeat an id each text; extra columns are ignored; empty tables give an empty
    result. Equal windows of a text are looked up once, so that long repetitive texts cost no more than others.

    Six fixed masks leave out two of four parts of the 13 places, so every pair of substitutions is
    ignored by one of them: seeds under the masks are joined, hits are verified word by word. The benchmark is
    the stated query set: it is joined in blocks of a fixed number of windows, each broadcast,
    with one pass over the documents per block.
    """
    schema = "doc_id long, item_id long, doc_word long, item_word long, matched long, width long"
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    spark, out, block, size = docs.sparkSession, None, [], 0

    def joined(block):
        return arrow_pass(base, _matches(spark.sparkContext.broadcast(block)), schema)

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    for row in items.orderBy("item_id", "text").toLocalIterator():
        h = tokens(row["text"])
        if len(h):
            block.append((row["item_id"], h.tobytes()))
            size += len(h)
            if size >= BLOCK_WINDOWS:
                out, block, size = joined(block) if out is None else out.unionByName(joined(block)), [], 0
    if block:
        out = joined(block) if out is None else out.unionByName(joined(block))
    if out is None:
        return spark.createDataFrame([], schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that share a window with a benchmark item; rows without doc_id are judged by nothing and stay."""
    hit = staged(benchmark_overlaps(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(bounded(hit), "doc_id", "left_anti").select(docs.columns)
