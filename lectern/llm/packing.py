"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import arrow_pass, staged

#: Texts of these characters only are tokenised chunk by chunk through a cache: there the tokenizer's
#: normaliser is lower-casing alone and no pre-token spans white space.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
CHUNK_CACHE = 200_000
#: Pieces per rank bucket.
BUCKET_ROWS = 50_000

_TOKENIZERS: dict = {}


#: The pre-tokens of PLAIN text, as the vocabulary file's own pattern splits them.
PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿªµº]+|[0-9]|[^a-zß-öø-ÿªµº0-9\\s]+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Generations(dict):
    """A bounded cache: full, it becomes the older generation, from which what is used again moves up."""

    def __init__(self, make, size: int) -> None:
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def chunk_cache(tokenizer) -> Generations:
    """Little-endian uint32 ids of chunks of PLAIN text without white space, by way of a cache of their pre-tokens."""
    symbols = byte_symbols()

    def word(piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join([symbols[b] for b in piece.encode()])
        return np.array([token.id for token in tokenizer.model.tokenize(spelled)], "<u4").tobytes()

    words = Generations(word, CHUNK_CACHE)
    return Generations(lambda chunk: b"".join([words[p] for p in PRE_TOKENS.findall(chunk)]), CHUNK_CACHE)


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _TOKENIZERS[path] = tokenizer, chunk_cache(tokenizer)
    return _TOKENIZERS[path]


def document_ids(text: str | None, path: str, end_id: int) -> bytes:
    """The document's ids as little-endian uint32, then end_id. Null text counts as empty."""
    tokenizer, chunks = _tokenizer(path)
    text = text or ""
    if PLAIN.fullmatch(text) and "<|" not in text:
        ids = b"".join(map(chunks.__getitem__, text.lower().split()))
    else:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return ids + end_id.to_bytes(4, "little")


def _pieces(path: str, length: int, end_id: int, keep_ids: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = document_ids(text, path, end_id)
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if keep_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    return run


class OpenBins:
    """Segment tree over remaining capacities: how many open bins have each, tightest fit in logarithmic time."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = self.size + capacity
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least need that an open bin has."""
        at = self.size + need
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths, equal items placed together.

    Items of one length are told apart by rank 0, 1, 2...  Returns runs (item length, first rank,
    items, first bin, offset): rank first+i goes to bin first_bin+i at that offset. An item always
    goes to the tightest open bin that holds it, so equal items fill a chosen bin before the next
    one; a run therefore covers a whole stack of equal bins. Work and result depend on the number
    of distinct lengths (at most `length`), not on the number of documents.
    """
    tree, stacks, plan, bins = OpenBins(length), defaultdict(list), [], 0

    def fill(item: int, rank: int, left: int, first: int, n: int, capacity: int) -> int:
        """Puts up to left items into n bins of one capacity, several deep; returns how many."""
        deep = capacity // item
        whole = min(n, left // deep)
        rest = left - whole * deep if whole < n else 0
        at = length - capacity
        for bins_used, begin, layers in ((whole, first, deep), (1 if rest else 0, first + whole, rest)):
            if bins_used:
                for k in range(layers):
                    plan.append((item, rank, bins_used, begin, at + k * item))
                    rank += bins_used
                if left_over := capacity - layers * item:
                    stacks[left_over].append((begin, bins_used))
                    tree.add(left_over, bins_used)
        unused = n - whole - bool(rest)
        if unused:
            stacks[capacity].append((first + whole + bool(rest), unused))
            tree.add(capacity, unused)
        return whole * deep + rest

    for item in sorted(counts, reverse=True):
        rank, left = 0, counts[item]
        while left:
            capacity = tree.tightest(item)
            if capacity is None:
                n = -(-left // (length // item))
                done = fill(item, rank, left, bins, n, length)
                bins += n
            else:
                first, n = stacks[capacity].pop()
                tree.add(capacity, -n)
                done = fill(item, rank, left, first, n, capacity)
            rank, left = rank + done, left - done
    return plan


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pack all documents (doc_id, text) into as few sequences of at most `length` tokens as best fit finds.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, (ids: uint32 little-endian,
    if keep_ids), sequence_id, offset. Only documents longer than `length` are cut. Null or empty
    text is the end token alone; a null doc_id is kept; repeated rows are packed each; extra
    columns are ignored; an empty table gives an empty result.

    The pieces are staged once; only their length histogram (at most `length` rows) reaches the
    driver, where best fit runs on it. Ranks among equal lengths come from counts per bucket, so
    a length that a third of the rows share is spread over many tasks.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    pieces = arrow_pass(base, _pieces(tokenizer_path, length, end_id, keep_ids), schema)
    pieces = staged(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts, length)
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = keyed.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    runs = docs.sparkSession.createDataFrame(plan, "plan_length long, first_rank long, items long, first_bin long, offset long")
    fits = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("items"))
    placed = ranked.join(F.broadcast(runs), fits)  # at most some length * ln(length) runs
    return placed.select(*[c.split()[0] for c in schema.split(", ")], (F.col("first_bin") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
