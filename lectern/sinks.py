"""Writing chunks, postings, vectors, runs and gold sets as tables and files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.staging import current, publish, versions


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by collection, so that a search of one collection reads its folder only."""
    chunks.write.mode("append").partitionBy("collection_id").parquet(path)


def posting_rows(fields: DataFrame) -> DataFrame:
    """(collection_id, chunk_id, field, term, tf) of the lists lemmas, forms and codes; empty ones give none."""
    out = None
    for name in ("lemmas", "forms", "codes"):
        part = fields.select("collection_id", "chunk_id", F.lit(name).alias("field"), F.explode(F.col(name)).alias("term"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("collection_id", "chunk_id", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def write_postings(fields: DataFrame, path: str) -> None:
    posting_rows(fields).write.mode("overwrite").partitionBy("collection_id").parquet(path)


def publish_vectors(vectors: DataFrame, root: str, model_key: str) -> str:
    """Write vectors (chunk_id, embedding) below root and publish them as the current version; returns its build id.

    The id is one of the model and of all vectors, so changed vectors get another, and publishing the same again writes nothing.
    """
    spark = vectors.sparkSession
    rows = vectors.select("chunk_id", T.l2_normalised(F.col("embedding")).alias("embedding"))
    seen = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("chunk_id", "embedding")), F.sum(F.xxhash64("embedding", "chunk_id").bitwiseAND(F.lit((1 << 31) - 1).cast("long")))).first()
    build = f"{uuid.uuid5(uuid.NAMESPACE_URL, repr((model_key, *seen)))}"
    if not any(b == build for _, b in versions(spark, root)):
        rows.write.mode("overwrite").parquet(f"{root}/{build}")
    publish(spark, root, build)
    return build


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(current(spark, root))


def save_run(values: DataFrame, path: str, run_id: str, settings: dict) -> None:
    """A run's (query_id, metric, value) rows and its settings, beside other runs."""
    values.withColumns({"run_id": F.lit(run_id), "settings": F.lit(json.dumps(settings, ensure_ascii=False, sort_keys=True))}).write.mode("append").partitionBy("run_id").parquet(path)


def write_gold_json(questions: DataFrame, path: str) -> None:
    questions.coalesce(1).write.mode("overwrite").json(path)


def write_gold_csv(questions: DataFrame, path: str) -> None:
    """Gold questions with their lists joined by semicolons; quotes in them are doubled, as read_gold_csv takes them."""
    lists = {c: F.array_join(c, ";") for c in ("gold_chunk_uids", "gold_pages") if c in questions.columns}
    questions.withColumns(lists).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report's rows as CSV and JSON."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/json")


def save_calibration(spark: SparkSession, model: dict, root: str) -> None:
    """A new version of the model below root; the old one is there until the new one is published."""
    build = uuid.uuid4().hex
    spark.createDataFrame([(json.dumps(model),)], "model string").coalesce(1).write.json(f"{root}/{build}")
    publish(spark, root, build)


def load_calibration(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.json(current(spark, root)).first()["model"])
