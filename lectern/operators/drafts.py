"""Questions drafted from chunks, and gold sets of those that a person approved."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.models import TOKENS, _applied

#: Characters of a chunk that a model is shown, and that a draft keeps.
SHOWN, KEPT = 1200, 300
#: The question of a chunk without a model's, with and without a section; words of its topic; what drafts and gold sets call the two kinds.
PLAIN, IN_SECTION, TOPIC = "Що навчальні матеріали зазначають про «%s»?", "Що навчальні матеріали зазначають про «%s» (розділ «%s»)?", 9
MODEL, TEMPLATE, NOTE = "llm", "шаблон", "чернетка: %s; джерело: %s"


def template_question(path: Column, text: Column) -> Column:
    """A question about the first words of a text's first sentence, and the last title of its path."""
    sentence = F.get(F.split(T.squeezed(F.coalesce(text, F.lit(""))), r"(?<=[.!?…]) ", 2), F.lit(0))
    topic = F.regexp_replace(F.array_join(F.slice(F.split(sentence, " "), 1, TOPIC), " "), r"[,.;:]+$", "")
    titles = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), "//"), lambda x: F.trim(x)), lambda t: t != "")
    return F.when(F.size(titles) > 0, F.format_string(IN_SECTION, topic, F.element_at(titles, -1))).otherwise(F.format_string(PLAIN, topic))


def draft_with(model: Callable[[list[str]], list[str]], tokens: int = TOKENS) -> Callable[[DataFrame], DataFrame]:
    """A drafter for draft_questions: the model takes excerpts and gives what it wrote for each."""
    return lambda rows: _applied(rows, "chunk_uid", ["excerpt"], "draft", pa.string(), "draft string", model, tokens)


def draft_questions(chunks: DataFrame, drafter: Callable[[DataFrame], DataFrame] | None = None, titles: DataFrame | None = None) -> DataFrame:
    """One draft of each chunk (chunk_uid, document_id, header_path, text, page_label): what the drafter wrote if its first line is a question, else the template.

    Returns (chunk_uid, question, document_id, document_title, page_label, excerpt, source, needs_review); every draft needs a review. titles
    (document_id, title) are joined by document. Null or blank texts give a template about nothing.
    """
    rows = chunks.select("chunk_uid", "document_id", F.coalesce("page_label", F.lit("")).alias("page_label"), "header_path", F.coalesce("text", F.lit("")).alias("text"))
    said = F.lit(None).cast("string").alias("said")
    if drafter is not None:
        drafts = drafter(rows.select("chunk_uid", F.substring("text", 1, SHOWN).alias("excerpt"))).select("chunk_uid", "draft")
        rows = rows.join(drafts, "chunk_uid", "left")
        lines = F.filter(F.transform(F.split("draft", r"\R"), lambda x: F.trim(x)), lambda x: x != "")
        rows = rows.withColumn("line", F.get(lines, F.lit(0)))
        said = F.when(T.looks_like_question(F.col("line")), F.col("line")).alias("said")
    rows = rows.select("chunk_uid", "document_id", "page_label", "header_path", "text", said)
    named = rows.withColumn("document_title", F.lit("")) if titles is None else rows.join(titles.select("document_id", F.coalesce("title", F.lit("")).alias("document_title")), "document_id", "left").fillna("", ["document_title"])
    question = F.coalesce("said", template_question(F.col("header_path"), F.col("text")))
    return named.select("chunk_uid", question.alias("question"), "document_id", "document_title", "page_label", F.substring("text", 1, KEPT).alias("excerpt"), F.when(F.col("said").isNotNull(), MODEL).otherwise(TEMPLATE).alias("source"), F.lit(True).alias("needs_review"))


def approve_drafts(drafts: DataFrame, collection_id: str, approved: DataFrame | None = None) -> DataFrame:
    """Gold questions (question_id, collection_id, question, gold_chunk_uids, gold_pages, note) of drafts; approved (chunk_uid) names those that are taken, null all.

    A blank question is left out. gold_pages has document:page for the first number of a draft's page label.
    """
    taken = drafts if approved is None else drafts.join(approved.select("chunk_uid"), "chunk_uid", "left_semi")
    number = F.regexp_extract("page_label", r"\d+", 0)
    pages = F.when(number != "", F.array(F.concat_ws(":", F.col("document_id").cast("string"), number.cast("long").cast("string")))).otherwise(F.array().cast("array<string>"))
    uid = F.col("chunk_uid").cast("string")
    rows = taken.where(F.trim("question") != "")
    return rows.select(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(collection_id), uid), 256), 1, 32).alias("question_id"), F.lit(collection_id).alias("collection_id"), F.trim("question").alias("question"), F.array(uid).alias("gold_chunk_uids"), pages.alias("gold_pages"), F.format_string(NOTE, F.col("source"), F.coalesce("document_title", F.lit(""))).alias("note"))
