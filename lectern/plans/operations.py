"""Queries over events, orders and conversations as telemetry, jobs and chats, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import evaluation as E
from lectern.operators import operations as O
from lectern.plans.documents import read
from lectern.streaming import windows as S


def jobs(s, d):
    """Events as jobs: state and priority by type, a lease one hour after the event."""
    e = read(s, d, "events")
    state = F.element_at(F.array(*map(F.lit, ("QUEUED", "LEASED", "RUNNING", "DONE"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("job_id"), "user_id", "event_type", state.alias("state"), (F.col("event_id") % 3).alias("priority"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 1 hour")).alias("lease_until"), (F.col("event_id") % 5).cast("int").alias("attempts"))


def triples(s, d):
    return jobs(s, d).withColumn("triple", F.floor(F.col("job_id") / 3))


JOBS = "j as (select event_id as job_id, user_id, event_type, ['QUEUED', 'LEASED', 'RUNNING', 'DONE'][event_id % 4 + 1] as state, event_id % 3 as priority, ts as created_at, ts + interval 1 hour as lease_until, (event_id % 5)::int as attempts from events)"
NOON = "timestamp_ntz '2024-01-15 12:00:00'"


def pairs(s, d):
    e = read(s, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    return e.where("a is not null and b is not null")


WINDOWS = "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"

QUERIES = {
    "telemetry_summary": (lambda s, d: O.telemetry(read(s, d, "events"), "event_type", "value", F.col("event_type") == "error").withColumn("avg_duration", F.round("avg_duration", 6)), "select event_type, count(*) as n, round(avg(value), 6) as avg_duration, sum((event_type = 'error')::int)::bigint as failures from events group by 1 order by n desc, 1 limit 50"),
    "latency_summary": (lambda s, d: E.latency_summary(read(s, d, "events"), "event_type", "value").select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")]), "select event_type, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events where value is not null group by 1"),
    "session_counts": (lambda s, d: read(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"), F.sum(T.token_estimate(F.coalesce("text", F.lit("")))).alias("tokens")), r"select conv_id, count(*) as messages, max(turn) as last_turn, sum(case when coalesce(text, '') = '' then 0 else greatest(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 2.35), floor(length(text) / 3.2)) + 1 end)::bigint as tokens from conversations group by 1"),
    "feedback_counts": (lambda s, d: read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")), "select event_type, count(*) as n, count(distinct user_id) as users from events group by 1"),
    "job_claim": (lambda s, d: O.claim(jobs(s, d), "event_type"), f"with {JOBS} select event_type, job_id from (select *, row_number() over (partition by event_type order by priority, created_at, job_id) as n from j where state = 'QUEUED') where n = 1"),
    "lease_reclaim": (lambda s, d: O.reclaim(jobs(s, d), F.expr(NOON), 3).groupBy("state", "attempts", "error_code").agg(F.count(F.lit(1)).alias("n"), F.count("lease_until").alias("leases")), f"with {JOBS}, l as (select *, state in ('LEASED', 'RUNNING') and lease_until < timestamp '2024-01-15 12:00:00' as lost from j) select case when lost and attempts + 1 <= 3 then 'QUEUED' when lost then 'FAILED' else state end as state, attempts + (lost and attempts + 1 <= 3)::int as attempts, case when lost and attempts + 1 > 3 then 'LEASE_EXPIRED' end as error_code, count(*) as n, count(*) filter (not lost) as leases from l group by 1, 2, 3"),
    "enqueue_once": (lambda s, d: O.enqueue_once(triples(s, d).where("priority = 0"), triples(s, d).where("priority = 1"), "triple"), "select distinct event_id // 3 as triple from events where event_id % 3 = 1 and event_id // 3 not in (select event_id // 3 from events where event_id % 3 = 0 and event_id % 4 <> 3)"),
    "upsert_pages": (lambda s, d: O.upsert(read(s, d, "pages").select("page_id", F.length("html").cast("long").alias("size")), read(s, d, "pages").where("page_id % 3 = 0").select((F.col("page_id") + 1).alias("page_id"), F.lit(-1).cast("long").alias("size")), "page_id"), "select page_id, length(html) as size from pages where page_id not in (select page_id + 1 from pages where page_id % 3 = 0) union all select page_id + 1, -1 from pages where page_id % 3 = 0"),
    "cascade_delete": (lambda s, d: O.cascade_delete(read(s, d, "lineitem"), read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), "select l_returnflag, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by 1"),
    "event_replay": (lambda s, d: O.replay(read(s, d, "events"), 500, 512).select("event_id", "event_type"), "select event_id, event_type from events where event_id > 500 and event_id > (select max(event_id) from events) - 512"),
    "poll_diff": (lambda s, d: O.changes(read(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"), "select user_id, event_id, event_type, before from (select user_id, event_id, event_type, lag(event_type) over w as before, row_number() over w as n from events window w as (partition by user_id order by event_id)) where n > 1 and before is distinct from event_type"),
    "eta_median": (lambda s, d: O.rolling_median(read(s, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("event_id", F.round("median", 6).alias("median")), "select event_id, round(quantile_cont(value, 0.5) over (partition by user_id order by event_id rows between 23 preceding and current row), 6) as median from events"),
    "cumulative_map": (lambda s, d: O.cumulative_map(read(s, d, "events"), "user_id", "event_id", "event_type", "value"), "select user_id, event_type, arg_max(value, event_id) as value from events group by 1, 2"),
    "paired_t": (lambda s, d: E.paired_t(pairs(s, d), "a", "b").select("n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 6).alias("t")), "with p as (select user_id, avg(value) filter (event_type = 'click') as a, avg(value) filter (event_type = 'view') as b from events group by 1), d as (select a - b as d from p where a is not null and b is not null) select count(*) as n, round(avg(d), 6) as mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as t from d"),
    "relative_gain": (lambda s, d: pairs(s, d).select("user_id", F.round(E.relative_gain("a", "b"), 6).alias("gain")), "with p as (select user_id, avg(value) filter (event_type = 'click') as a, avg(value) filter (event_type = 'view') as b from events group by 1) select user_id, round((a - b) / b * 100, 6) as gain from p where a is not null and b is not null"),
    "event_windows": (lambda s, d: S.windowed_counts(read(s, d, "events")), WINDOWS),
}
