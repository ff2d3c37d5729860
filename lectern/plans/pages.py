"""Queries over documents as pages that were probed and read, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import MATHS
from lectern.operators import drafts as D
from lectern.operators import ingest as I
from lectern.operators import pages as P
from lectern.plans.documents import read, short

#: Words of nine letters or more, on pages of 80 columns.
LONG_WORD = r"\p{L}{9,}"


def probed_pages(spark: SparkSession, d: str) -> DataFrame:
    return I.probe(I.text_pages(read(spark, d, "documents")))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of labelled documents, their white space closed up: the first measures letters where there are characters, the second digits where there are some."""
    labelled = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    pages = I.text_pages(labelled.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " ")))
    size, letters, digits = F.length("text"), F.length(F.regexp_replace("text", r"[^\p{L}]", "")), F.length(F.regexp_replace("text", "[^0-9]", ""))
    kept = ("document_id", "page", "char_from", "char_to")
    first = pages.select(*kept, F.lit(1).alias("version"), F.when(size > 0, letters / size).alias("parse_score"), F.lit("first").alias("ocr_mode"))
    second = pages.where(digits > 0).select(*kept, F.lit(2).alias("version"), F.when(digits >= 3, 1 - digits / size).alias("parse_score"), F.when(digits >= 3, "second").alias("ocr_mode"))
    return first.unionByName(second)


def page_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the newest measured values, the probe's where there are none; toxic documents as of their first reading."""
    as_of = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("as_of"))
    pages = P.merged_pages(probed_pages(spark, d).withColumnRenamed("cost", "cost_weight").drop("mojibake"), readings(spark, d), as_of=as_of)
    return short(pages.select("document_id", "page", "readings", "parse_score", "cost_weight", "char_from", "char_to", "ocr_mode"), "parse_score")


PAGES = r"""p as (select doc_id as document_id, i + 1 as page, substr(t, i * 1800 + 1, 1800) as text, i * 1800 as char_from
  from (select doc_id, t, unnest(range(0, greatest(ceil(length(t) / 1800), 1)::bigint)) as i from {rows}))"""
PROBED = rf"""raw as (select doc_id, coalesce(text, '') as t from documents), {PAGES.format(rows="raw")},
lines as (select *, string_split(text, chr(10)) as l, length(text) as size, length(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) as chars from p),
k as (select document_id, page, char_from, size, chars,
  regexp_matches(lower(text), 'таблиц|табл\.') or len(list_filter(l, lambda x: len(regexp_extract_all(x, '[^\s] {{2,}}')) - len(regexp_extract_all(x, '[^\s] {{2,}}(?:[\t\r\f\x0B]|$)')) >= 2)) >= 3
    or len(list_filter(l, lambda x: length(x) - length(replace(x, chr(9), '')) >= 2 or length(x) - length(replace(x, '|', '')) >= 2)) >= 3 as tab,
  regexp_matches(lower(text), 'формул|рівнянн') or regexp_matches(text, '[{MATHS}]') as form,
  size > 0 and (2 * size - length(regexp_replace(text, '/glyph<[^>]{{0,16}}>|/g\d+', '', 'g')) - length(regexp_replace(text, '[\x{{FFFD}}\x{{E000}}-\x{{F8FF}}\x{{F0000}}-\x{{FFFFD}}\x{{100000}}-\x{{10FFFD}}\x00-\x08\x0B\x0E-\x1F]', '', 'g'))) / size > 0.02 as broken from lines)"""


def mode_speed(spark: SparkSession, d: str) -> DataFrame:
    """Events as readings: a mode by type, the value as seconds, pages from the properties, errors of their own."""
    e = read(spark, d, "events")
    pages = F.get_json_object("props", "$.k").cast("long") % 10
    rows = e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("mode"), pages.alias("pages"), F.col("value").alias("seconds"), F.col("value").alias("peak_mb"), F.when((F.col("event_type") == "error") & (F.col("value") > 50), "slow").alias("error"))
    return short(P.mode_rollup(rows), "mean", "minutes_1000", "median", "p95", "peak_mb")


MODE_SQL = """with r as (select event_type as mode, (props->>'$.k')::bigint % 10 as pages, value as seconds, event_type = 'error' and coalesce(value > 50, false) as failed from events),
e as (select *, not failed and pages > 0 as good, case when not failed and pages > 0 then seconds / pages end as x from r)
select mode, count(*) as documents, coalesce(sum(pages) filter (good), 0)::bigint as pages, round(avg(x), 6) as mean, round(avg(x) * 1000 / 60, 6) as minutes_1000,
  round(max(seconds) filter (good), 6) as peak_mb, count(*) filter (failed) as failures, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.95), 6) as p95 from e group by 1"""


def page_grades(spark: SparkSession, d: str) -> DataFrame:
    """Grades of read pages by the mode that read them last."""
    nothing = {n: F.lit(None).cast("double") for n in ("layout_score", "table_score", "ocr_score", "lexicon_hit_rate")}
    pages = probed_pages(spark, d).withColumnRenamed("cyrillic", "cyrillic_ratio").select("document_id", "page", "cyrillic_ratio", "char_from", "char_to", F.lit("none").alias("ocr_mode"))
    return P.grade_rollup(P.merged_pages(pages, readings(spark, d)).withColumns(nothing))


def _read_sql(late: str) -> str:
    """v: what the newest readings say; `late` tells where the second doesn't count."""
    return rf"""red as (select doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g') as t from documents semi join labels using (doc_id)),
{PAGES.format(rows="red").replace("p as (", "q as (", 1)},
n as (select document_id, page, char_from, char_from + length(text) as char_to, length(text) as size, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) as letters, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits from q),
m as (select *, digits > 0 and not {late} as two, digits >= 3 and not {late} as three from n left join (select doc_id as document_id, bool_or(toxic = 1) as toxic from labels group by 1) using (document_id)),
v as (select document_id, page, 1 + two::int as readings, case when three then 1 - digits / size when size > 0 then letters / size end as score, char_from, char_to,
  case when three then 'second' when not two then 'first' end as mode from m)"""


SCORES_SQL = f"""with {PROBED}, {_read_sql("coalesce(toxic, false)")},
pr as (select document_id, page, 1.0::double + 3 * (broken and chars >= 40)::int + 2 * tab::int + form::int as cost, char_from, char_from + size as char_to, case when chars < 40 then 'NONE' when broken then 'FULL_PAGE' else 'DEFAULT' end as mode from k)
select document_id, page, readings, round(score, 6) as parse_score, cost as cost_weight, coalesce(nullif(v.char_from, 0), pr.char_from) as char_from,
  coalesce(nullif(v.char_to, 0), pr.char_to) as char_to, v.mode as ocr_mode from v left join pr using (document_id, page)
union all select document_id, page, 0, null, cost, char_from, char_to, mode from pr where document_id not in (select document_id from v)"""
GRADES_SQL = f"""with {PROBED}, {_read_sql("false")},
a as (select mode, score from v union all select 'none', null from p where document_id not in (select document_id from v))
select mode, case when score is null then 'UNKNOWN' when score >= 0.9 then 'EXCELLENT' when score >= 0.8 then 'GOOD' when score >= 0.5 then 'FAIR' else 'POOR' end as grade,
  count(*) as pages, count(*) filter (score < 0.5) as repairs from a group by 1, 2"""


def merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of neighbouring lines that hold long words, on all pages of all documents."""
    return P.merged_boxes(P.matched_boxes(I.text_pages(read(spark, d, "documents")), LONG_WORD))


def gold_from_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Questions drafted from all documents by the template, and the gold set of those of good quality."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_uid"), F.col("source").alias("document_id"), F.concat(F.lit("//"), "source", F.lit("//"), "lang", F.lit("//")).alias("header_path"), F.concat(F.lit("с. "), F.col("doc_id").cast("string")).alias("page_label"), "text")
    drafts = D.draft_questions(docs)
    approved = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_uid"))
    gold = D.approve_drafts(drafts, "c0", approved)
    return gold.select("question", F.get("gold_chunk_uids", F.lit(0)).alias("uid"), F.get("gold_pages", F.lit(0)).alias("page"), "note")


DRAFTS_SQL = r"""with s as (select doc_id, source, lang, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as sq from documents where doc_id in (select doc_id from labels where quality = 1)),
f as (select *, regexp_extract(sq || ' ', '^(.*?[.!?…]) ', 1) as cut from s),
t as (select *, regexp_replace(array_to_string(string_split(case when cut = '' then sq else cut end, ' ')[1:9], ' '), '[,.;:]+$', '') as topic, trim(lang) as title from f)
select case when coalesce(title, '') <> '' and source is not null then 'Що навчальні матеріали зазначають про «' || topic || '» (розділ «' || title || '»)?' else 'Що навчальні матеріали зазначають про «' || topic || '»?' end as question,
  doc_id::varchar as uid, concat_ws(':', source, doc_id::varchar) as page, 'чернетка: шаблон; джерело: ' as note from t"""

QUERIES = {
    "page_scores": (page_scores, SCORES_SQL),
    "page_grades": (page_grades, GRADES_SQL),
    "mode_rollup": (mode_speed, MODE_SQL),
    "merged_boxes": (merged_boxes, None),
    "gold_from_drafts": (gold_from_drafts, DRAFTS_SQL),
}
