"""Event-time windows over telemetry streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum of value by window and event_type; batch or streaming. ts may be without zone: it is taken as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """One event per key within the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])
