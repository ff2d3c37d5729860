"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import U64, arrow_pass, crc_mod, mix

#: Documents per language that filters are learned from at most, those with the least hash.
SAMPLE_DOCS = 1500
#: Slots of the bit-sliced filter (a 64-bit mask for each 64 languages), hashes per n-gram, n-grams of a language at most.
SLOTS, HASHES, NGRAMS = 1 << 19, 3, 20_000
#: Byte lengths of the n-grams.
WIDTHS = (3, 4, 5)


def gram_codes(text: str, width: int) -> np.ndarray:
    """Hash-like codes of all n-grams of width bytes of the lower-cased text between spaces."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(U64)
    if len(b) < width:
        return np.empty(0, U64)
    code = np.full(len(b) - width + 1, U64(width))
    for k in range(width):
        code = (code << U64(8)) | b[k : len(b) - width + 1 + k]
    return code


def slots(codes: np.ndarray) -> list[np.ndarray]:
    h = mix(codes)
    return [((h >> U64(20 * k)) & U64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Filters:
    """One slice of bits per slot: looking a slot up answers for 64 languages at once."""

    def __init__(self, profiles: dict[str, np.ndarray]) -> None:
        self.languages = sorted(profiles)
        self.masks = np.zeros((-(-len(self.languages) // 64), SLOTS), U64)
        for k, language in enumerate(self.languages):
            for s in slots(profiles[language]):
                np.bitwise_or.at(self.masks[k // 64], s, U64(1 << k % 64))
        fill = np.array([np.count_nonzero(self.masks[k // 64] & U64(1 << k % 64)) / SLOTS for k in range(len(self.languages))])
        self.false = fill**HASHES

    def shares(self, text: str) -> np.ndarray:
        """Per language the share of the text's n-grams that its filter holds, less the expected false positives."""
        count, total = np.zeros(len(self.languages)), 0
        for width in WIDTHS:
            codes = gram_codes(text, width)
            total += len(codes)
            a, b, c = slots(codes)
            for word, masks in enumerate(self.masks):
                hit = masks[a] & masks[b] & masks[c]
                hit, first = hit[hit != 0], 64 * word
                count[first : first + 64] += [np.count_nonzero(hit & U64(1 << k)) for k in range(min(64, len(self.languages) - first))]
        return np.clip((count / max(1, total) - self.false) / (1 - self.false), 0, 1)


def _counted(batches):
    """Codes of each language's texts with their counts, a few texts at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            rows = batch.slice(begin, 500)
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).extend(gram_codes(text, width) for width in WIDTHS)
            for lang, codes in texts.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "code", "n"])


def learn(docs: DataFrame) -> Filters:
    """Filters from the text and lang of docs: at most SAMPLE_DOCS documents a language, those of the least hash, whole.

    A filter holds the n-grams that mark a language: frequent in it, and at least a third as frequent as anywhere in another,
    each language with equal weight; the most frequent NGRAMS of them, smaller codes first among equals. Samples of all languages are drawn
    and counted together; the driver gets the chosen n-grams.
    """
    labelled = docs.where("lang is not null and text is not null and text <> ''").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    groups = labelled.select("lang", "h").distinct()
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row for each language
    # hashes are spread evenly, so twice the wanted number lies below this; only these are ranked
    below = F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_DOCS) / F.col("n")) * 2.0**64
    near = groups.join(F.broadcast(sizes), "lang").where((F.col("n") <= 2 * SAMPLE_DOCS) | (F.col("h").cast("double") <= below))
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= SAMPLE_DOCS)
    last = ranked.groupBy("lang").agg(F.max("h").alias("last"))  # a row for each language
    few = labelled.join(F.broadcast(last), "lang").where("h <= last").groupBy("lang", "h").agg(F.min("text").alias("text"))
    counts = arrow_pass(few.select("lang", "text"), _counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rates = counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    marking = rates.withColumn("top", F.max("rate").over(Window.partitionBy("code"))).where("rate * 3 >= top")
    chosen = marking.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "code"))).where(F.col("k") <= NGRAMS)
    codes = chosen.groupBy("lang").agg(F.collect_list("code").alias("codes")).collect()
    return Filters({r["lang"]: np.array(r["codes"], np.int64).view(U64) for r in codes})


def _predict(broadcast):
    def run(batches):
        filters = broadcast.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                shares = filters.shares(text) if has_letter(text) else np.empty(0)
                if not len(shares):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(shares))
                langs.append(filters.languages[best])
                scores.append(float(shares[best] / shares.sum()) if shares.sum() else 0.0)
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs, from its whole text alone.

    `und` and score 0 where the text is null or has no letter; the first language in order wins a
    tie. Repeated rows, null doc_ids and extra columns are no matter; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS masks of 8 bytes for each 64 languages
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return arrow_pass(base, _predict(shared), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """identify(), learned from the rows whose crc32(doc_id as text) mod 4 is not 2; held_out tells the others."""
    return identify(docs, learn(docs.where(crc_mod("doc_id", 4) != 2))).withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)))
