"""Queries that run streams, batch after batch on one checkpoint, each with the SQL of its end state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.documents import read
from lectern.staging import new_folder
from lectern.streaming import jobs as J
from lectern.streaming import windows as S
from lectern.streaming.sink import UpsertTable, run

#: Batches that the events are cut into by time, the lease of a job, and attempts at most.
PARTS, LEASE, ATTEMPTS = 3, 21_600, 3
TARGETS = {"click": "LEASED", "view": "RUNNING", "purchase": "DONE", "signup": "QUEUED", "error": "FAILED"}


def parts(events: DataFrame) -> list[DataFrame]:
    """events (ts) in PARTS pieces of equal time."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(ms), F.max(ms)).first()
    if lo is None:
        return [events]
    place = F.floor(PARTS * (ms - lo) / F.lit(hi - lo + 1))
    return [events.where(place == k) for k in range(PARTS)]


def streamed(events: DataFrame, changed: Callable[[DataFrame], DataFrame], keys: tuple[str, ...], schema: str) -> DataFrame:
    """What the table holds once all parts of events have come, the query started anew for each."""
    spark, root = events.sparkSession, new_folder(events.sparkSession, "stream")
    table = UpsertTable(f"{root}/table", keys, schema)
    for part in parts(events):
        part.write.mode("append").parquet(f"{root}/fed")
        run(changed(spark.readStream.schema(events.schema).parquet(f"{root}/fed")), table, f"{root}/progress")
    return table.read(spark)


def moves(events: DataFrame) -> DataFrame:
    """Events as moves of one job for each user."""
    target = F.element_at(F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv]), F.col("event_type"))
    return events.select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), target.alias("state"))


def stream_jobs(spark: SparkSession, d: str) -> DataFrame:
    """States of jobs after all events, with leases ended by event-time timers."""
    return streamed(read(spark, d, "events"), lambda e: J.job_stream(moves(e), LEASE, ATTEMPTS), ("job_id",), J.RESULT)


def batch_jobs(spark: SparkSession, d: str) -> DataFrame:
    e = moves(read(spark, d, "events"))
    now = e.agg(F.max(F.unix_millis("at"))).first()[0]
    return J.job_states(e, now or 0, LEASE, ATTEMPTS)


def last_of_user(events: DataFrame) -> DataFrame:
    """The latest event of each user, as a running aggregate."""
    newest = F.max(F.struct("ts", "event_id", "event_type", "value"))
    return events.where("user_id is not null").groupBy("user_id").agg(newest.alias("e"), F.count(F.lit(1)).alias("n")).select("user_id", "n", "e.event_id", "e.event_type", "e.value")


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    return streamed(read(spark, d, "events"), last_of_user, ("user_id",), "user_id long, n long, event_id long, event_type string, value double")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return streamed(read(spark, d, "events"), lambda e: S.windowed_counts(e, late="365 days"), ("window_start", "event_type"), "window_start string, event_type string, n long, total double")


JOBS_SQL = f"""with m as (
  select user_id as job_id, event_id, epoch_us(ts) // 1000 as ms, map {{'click': 'LEASED', 'view': 'RUNNING', 'purchase': 'DONE', 'signup': 'QUEUED', 'error': 'FAILED'}}[event_type] as target from events where user_id is not null),
moves as (select map {{'QUEUED': ['LEASED', 'CANCELLED'], 'LEASED': ['RUNNING', 'QUEUED', 'DONE', 'FAILED', 'CANCELLED'], 'RUNNING': ['QUEUED', 'DONE', 'FAILED', 'CANCELLED'], 'DONE': [], 'FAILED': ['QUEUED'], 'CANCELLED': ['QUEUED']}} as allowed),
l as (select job_id, list({{'ms': ms, 'state': target, 'refused': 0::bigint, 'attempts': 0, 'lease': 0::bigint}} order by ms, event_id) as e from m group by 1),
s as (
  select job_id, list_reduce(list_append(list_prepend({{'ms': 0::bigint, 'state': 'QUEUED', 'refused': 0::bigint, 'attempts': 0, 'lease': 0::bigint}}, e), {{'ms': (select max(ms) from m), 'state': 'END', 'refused': 0::bigint, 'attempts': 0, 'lease': 0::bigint}}), lambda a, x:
    list_transform([case when a.lease > 0 and a.lease < x.ms and a.attempts + 1 <= {ATTEMPTS} then {{'ms': x.ms, 'state': 'QUEUED', 'refused': a.refused, 'attempts': a.attempts + 1, 'lease': 0::bigint}}
                         when a.lease > 0 and a.lease < x.ms then {{'ms': x.ms, 'state': 'FAILED', 'refused': a.refused, 'attempts': a.attempts, 'lease': 0::bigint}} else a end],
      lambda b: case when x.state = 'END' then b
                     when list_contains(allowed[b.state], x.state) or (b.state = 'RUNNING' and x.state = 'RUNNING')
                     then {{'ms': x.ms, 'state': x.state, 'refused': b.refused, 'attempts': b.attempts, 'lease': case when x.state in ('LEASED', 'RUNNING') then x.ms + {1000 * LEASE} else 0::bigint end}}
                     else {{'ms': x.ms, 'state': b.state, 'refused': b.refused + 1, 'attempts': b.attempts, 'lease': b.lease}} end)[1]) as r
  from l, moves)
select job_id, r.state as state, r.refused as refused, r.attempts as attempts, r.lease as lease_until from s"""
UPSERT_SQL = "select user_id, count(*) as n, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value from events where user_id is not null group by 1"
WINDOWS_SQL = "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"

QUERIES = {
    "stream_jobs": (stream_jobs, JOBS_SQL),
    "job_states": (batch_jobs, JOBS_SQL),
    "stream_upsert": (stream_upsert, UPSERT_SQL),
    "stream_windows": (stream_windows, WINDOWS_SQL),
}
