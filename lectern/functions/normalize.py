"""One spelling for text and queries: composed letters, one apostrophe and hyphen, joined line breaks, no look-alike letters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import text as T
from lectern.session import ship

#: Apostrophes, hyphens and dashes that become one; what goes or becomes a space.
APOSTROPHES, HYPHENS, GONE, SPACE = "\u2019\u02bc\u0060\u00b4\u2032", "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "\u00ad\u200b", "\u00a0"
#: Latin letters and the Cyrillic letters that look like them, in the same order.
LATIN, LOOKALIKE = "iIeEoOaAcCpPxXyYBHKMT", "іІеЕоОаАсСрРхХуУВНКМТ"

_TABLE = str.maketrans(APOSTROPHES + HYPHENS + SPACE, "'" * len(APOSTROPHES) + "-" * len(HYPHENS) + " ", GONE)
_TO_CYRILLIC = str.maketrans(LATIN, LOOKALIKE)
_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_MARKS = re.compile(f"[{APOSTROPHES}{HYPHENS}{GONE}{SPACE}]")
_SURE = f"(?![{LOOKALIKE}])[\u0400-\u052f\u2de0-\u2dff\ua640-\ua69f]"
_SURELY_CYRILLIC = re.compile(_SURE)
#: Words that may hold letters of both kinds; each is looked through from its beginning only.
_MIXED = re.compile(rf"(?<![^\W_])(?=[^\W_]*?[{LATIN}])(?=[^\W_]*?{_SURE})[^\W_]+")
_OTHER_LATIN = re.compile(f"(?![{LATIN}])[A-Za-z]")


def repair_lookalikes(text: str) -> str:
    """Latin letters become Cyrillic in words that hold a letter which only Cyrillic has and no Latin letter without a twin."""
    def fixed(word: re.Match) -> str:
        w = word[0]
        return w.translate(_TO_CYRILLIC) if _SURELY_CYRILLIC.search(w) and not _OTHER_LATIN.search(w) else w

    return text if text.isascii() else _MIXED.sub(fixed, text)


def normalize_text(text: str | None) -> str:
    """The canonical spelling of a text; doing it twice changes nothing. Null is empty."""
    joined = unicodedata.normalize("NFC", text or "")
    if _MARKS.search(joined):
        joined = joined.translate(_TABLE)
    if "-" in joined and "\n" in joined:
        joined = _BREAK.sub("", joined)
    return repair_lookalikes(joined).casefold()


def normalized(df: DataFrame, source: str = "text", target: str = "normalized") -> DataFrame:
    """df with the canonical spelling of a column; Spark has neither composition nor case folding of its own."""
    ship(df.sparkSession)

    def spelled(text: pd.Series) -> pd.Series:
        return text.map(normalize_text)

    return df.withColumn(target, F.pandas_udf(spelled, StringType())(F.col(source)))


def search_terms(normal: Column) -> Column:
    """Words of a normalised text, compounds followed by their parts."""
    return T.with_compound_parts(T.tokens(normal))


def lemmas(terms: DataFrame, dictionary: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, lemmas): of each term (key, place, term), in order, its lemmas in dictionary (surface, lemma), two at most, else itself.

    Each distinct surface is looked up once; a stop list is the dictionary's matter (a null lemma drops the term).
    """
    known = dictionary.groupBy("surface").agg(F.slice(F.sort_array(F.collect_set("lemma")), 1, 2).alias("found"), F.max(F.col("lemma").isNull()).alias("stop"))
    found = terms.join(known, terms["term"] == known["surface"], "left")
    each = F.when(F.col("surface").isNull(), F.array("term")).when(F.col("stop"), F.array().cast("array<string>")).otherwise(F.col("found"))
    return found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", each.alias("l")))).alias("all")).select(key, F.flatten(F.col("all.l")).alias("lemmas"))


def lexicon_hit_rate(pages: DataFrame, lexicon: DataFrame, key: str, least: int = 12) -> DataFrame:
    """(key, hit_rate): share of the words of pages (key, text) that the lexicon (word, kind: word or stem) knows; null below `least` words.

    A stem of 4 to 12 letters knows the words that begin with it.
    """
    words = pages.select(key, F.explode_outer(T.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    tries = words.select(key, "w", F.monotonically_increasing_id().alias("n")).where(F.length("w") >= 2)
    whole = lexicon.where("kind = 'word'").select(F.col("word").alias("w")).distinct().withColumn("whole", F.lit(True))
    stems = lexicon.where("kind = 'stem' and length(word) between 4 and 12").select(F.col("word").alias("stem")).distinct()
    starts = tries.select(F.col("w").alias("of"), F.explode(F.transform(F.sequence(F.lit(4), F.lit(12)), lambda k: F.substring("w", F.lit(1), k))).alias("stem")).distinct()
    stemmed = starts.where(F.length("stem") >= 4).join(stems, "stem", "left_semi").select(F.col("of").alias("w")).distinct().withColumn("stemmed", F.lit(True))
    judged = tries.join(whole, "w", "left").join(stemmed, "w", "left")
    return judged.groupBy(key).agg(F.when(F.count(F.lit(1)) >= least, F.avg((F.coalesce("whole", F.lit(False)) | F.coalesce("stemmed", F.lit(False))).cast("double"))).alias("hit_rate"))
