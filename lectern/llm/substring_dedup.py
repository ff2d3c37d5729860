"""Removal of words in long passages that an earlier document has, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import MIX_A, U64, arrow_pass, bit_filter, discard, in_filter, mix, staged, window_hashes, word_hashes

#: A difference cover. Any two places have a common shift below the period that brings both, modulo it, into the cover.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Windows of a chunk at most (they are the bits of a long), one window in so many that starts a chunk, and parts that the rows of a chunk are dealt to.
CHUNK, CUT_ONE_IN, SALTS = 64, 16, 8
#: Words of texts that are hashed at a time.
BLOCK_WORDS = 200_000
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Block:
    """The texts of some rows end to end as word hashes, so that array passes run over many short texts at once."""

    def __init__(self, texts: list[list[bytes]], ids: list[tuple[int, int]]) -> None:
        self.h = word_hashes(list(chain.from_iterable(texts)))
        self.length = np.array([len(t) for t in texts])
        self.begin = np.cumsum(self.length) - self.length
        self.doc, self.ta = np.array(ids, np.int64).T
        self.text = np.repeat(np.arange(len(texts)), self.length)
        self.place = np.arange(len(self.h)) - self.begin[self.text]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at places in the cover, and the hash of the window - PERIOD + 1 words of the text from there on."""
        width = window - PERIOD + 1
        hashes = window_hashes(self.h, width)
        place = self.place[: len(hashes)]
        at = np.flatnonzero(_IN_COVER[place % PERIOD] & (place + width <= self.length[self.text[: len(hashes)]]))
        return at, hashes[at]

    def candidates(self, at: np.ndarray, window: int) -> np.ndarray:
        """Positions of the windows that hold an anchor of `at` at one of their first PERIOD words."""
        begin, size = self.begin[self.text[at]], len(self.h) + 1
        on = np.bincount(np.maximum(at - PERIOD + 1, begin), minlength=size)
        off = np.bincount(np.minimum(at, begin + self.length[self.text[at]] - window) + 1, minlength=size)
        return np.flatnonzero(np.cumsum(on - off) > 0)


def blocks(batches, window: int):
    """Blocks of the texts of at least `window` words, of BLOCK_WORDS words or one text more."""
    for batch in batches:
        texts, ids, held = [], [], 0
        for part in range(0, batch.num_rows, 1000):
            for text, own in _least_ids(batch.slice(part, 1000)).items():
                words = words_of(text)
                if len(words) < window:
                    continue
                texts.append(words)
                ids.append(own)
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield Block(texts, ids)
                    texts, ids, held = [], [], 0
        if texts:
            yield Block(texts, ids)


def _least_ids(batch) -> dict[str, tuple[int, int]]:
    """Each distinct text of a batch with its smallest doc_id and its hash: equal texts of a batch speak once."""
    least: dict[str, tuple[int, int]] = {}
    for doc, ta, text in zip(batch.column("doc_id").to_pylist(), batch.column("ta").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if doc is not None and text and (text not in least or doc < least[text][0]):
            least[text] = doc, ta
    return least


def _anchor_rows(window: int):
    def run(batches):
        for block in blocks(batches, window):
            at, key = block.anchors(window)
            doc = block.doc[block.text[at]]
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(np.minimum.reduceat(doc, first)), pa.array(np.maximum.reduceat(doc, first))], names=["key", "least", "most"])

    return run


def chunked(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, length and hash of each chunk of the windows at `starts` with hashes `keys`.

    Chunks begin where windows are not consecutive and at windows whose hash says so, so equal
    stretches of different documents have equal chunks but for those at their ends; none is longer than CHUNK.
    """
    at = np.arange(len(starts))
    cut = np.concatenate([[True], (np.diff(starts) != 1) | (keys[1:] & U64(CUT_ONE_IN - 1) == 0)])
    first = np.flatnonzero(cut)
    cut |= (at - np.repeat(first, np.diff(first, append=len(at)))) % CHUNK == 0
    first = np.flatnonzero(cut)
    n = np.diff(first, append=len(at))
    inside = (at - np.repeat(first, n)).astype(U64)
    return first, n, mix(np.add.reduceat(mix(keys + inside * MIX_A), first) + n.astype(U64))


def _chunk_rows(window: int, broadcast):
    def run(batches):
        shared = np.frombuffer(broadcast.value, np.uint8)
        for block in blocks(batches, window):
            at, key = block.anchors(window)
            at = at[in_filter(shared, key)]
            if not len(at):
                continue
            starts = block.candidates(at, window)
            keys = window_hashes(block.h, window)[starts]
            first, n, hashes = chunked(starts, keys)
            text = block.text[starts[first]]
            packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n) * 8])), pa.py_buffer(keys)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(block.doc[text]), pa.array(block.ta[text]), pa.array(block.place[starts[first]].astype(np.int32)), pa.array(n.astype(np.int32)), packed],
                names=["chunk", "doc_id", "ta", "place", "n", "keys"],
            )

    return run


def _window_rows(batches):
    """The windows of distinct chunks, with the smallest document of the chunk."""
    for batch in batches:
        for part in range(0, batch.num_rows, 5000):
            few = batch.slice(part, 5000)
            packed = few.column("keys").to_pylist()
            n = np.array([len(k) // 8 for k in packed])
            ends = np.cumsum(n)
            inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(np.repeat(few.column("least").to_numpy(), n)), pa.array(np.repeat(few.column("chunk").to_numpy(), n)), pa.array(inside.astype(np.int32))],
                names=["key", "doc_id", "chunk", "inside"],
            )


def _kept(window: int):
    def run(batches):
        for batch in batches:
            n, removed, shas, texts = [], [], [], []
            marks = batch.column("marks")
            ends, fields = marks.offsets.to_numpy(), marks.values
            place, size, mask = (fields.field(f).to_numpy(zero_copy_only=False) for f in ("place", "n", "mask"))
            for row, (text, copy) in enumerate(zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), strict=True)):
                words = words_of(text)
                gone = np.zeros(len(words) + 1, np.int64)
                lo, hi = ends[row], ends[row + 1]
                if copy and len(words) >= window:
                    gone[0] = 1
                elif hi > lo:
                    bits = np.unpackbits(np.ascontiguousarray(mask[lo:hi], "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
                    which, inside = np.nonzero(bits & (np.arange(CHUNK) < size[lo:hi, None]))
                    at = place[lo:hi][which].astype(np.int64) + inside
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                keep = np.cumsum(gone[:-1]) <= 0
                left = b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k])
                n.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row of docs (doc_id, text).

    Each word goes that a window of `window` words covers whose word sequence also starts in a
    document with a smaller doc_id, judged on the input. Null text has no words. Rows without
    doc_id are returned whole and are no source for others; rows that repeat a doc_id count as one
    document with several texts and lose what a smaller doc_id has. Extra columns are ignored.

    Two equal windows hold, at one shift below the period, a common anchor: the words from a cover
    place on. Anchors that several documents have fill a bit filter of bounded size; only windows
    with such an anchor are hashed whole. Runs of them are cut into chunks where their hashes say so:
    a chunk that a smaller document also has is a hit from end to end, and only the windows of
    distinct chunks, in their smallest document, are compared one by one. A text equal to that of a
    smaller doc_id is a hit as a whole.
    """
    if window < PERIOD:
        raise ValueError(f"window is at least {PERIOD}")
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).select("doc_id", "text", F.xxhash64("text").alias("ta"))
    texts = staged(base.where("text is not null and doc_id is not null").select("doc_id", "ta", F.xxhash64(F.lit(5), "text").alias("tb")), "texts")
    first = texts.groupBy("ta", "tb").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
    copies = texts.join(first, ["ta", "tb"]).where("doc_id > least").select("doc_id", "ta")

    keys = arrow_pass(base, _anchor_rows(window), "key long, least long, most long").groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("key")
    keys = staged(keys, "shared-anchors")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(keys).tobytes())

    chunks = staged(arrow_pass(base, _chunk_rows(window, shared), "chunk long, doc_id long, ta long, place int, n int, keys binary"), "chunks")
    places = staged(chunks.drop("keys"), "chunk-places")
    distinct = chunks.groupBy("chunk").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"))
    windows = staged(arrow_pass(distinct, _window_rows, "key long, doc_id long, chunk long, inside int"), "windows")
    discard(chunks)
    source = windows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").select("key", "least")
    source = staged(source, "window-sources")
    own = windows.join(source, "key").where("doc_id > least").groupBy("chunk").agg(F.expr("bit_or(shiftleft(1L, inside))").alias("own"))
    own = staged(own, "own-windows")
    discard(windows)
    known = places.groupBy("chunk").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).join(own, "chunk", "left").where("least <> most or own is not null")
    known = staged(known, "known-chunks").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a document that is not the smallest of a chunk loses all of it, the smallest one what a smaller one has in other chunks
    hits = places.select("chunk", "doc_id", "ta", "place", "n", F.expr(f"int(pmod(hash(doc_id), {SALTS}))").alias("salt")).join(known, ["chunk", "salt"])
    hits = hits.withColumn("mask", F.when(F.col("doc_id") > F.col("least"), F.lit(-1).cast("long")).otherwise(F.col("own"))).where("mask is not null")
    said = hits.select("doc_id", "ta", F.struct("place", "n", "mask").alias("mark"), F.lit(False).alias("copy")).unionByName(copies.select("doc_id", "ta", F.lit(None).cast("struct<place: int, n: int, mask: bigint>").alias("mark"), F.lit(True).alias("copy")))
    said = staged(said.groupBy("doc_id", "ta").agg(F.max("copy").alias("copy"), F.collect_list("mark").alias("marks")), "window-hits")
    whole = base.join(said, ["doc_id", "ta"], "left").select("doc_id", "text", "copy", "marks")
    return arrow_pass(whole, _kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
