"""Job states as a stateful stream: moves, leases that heartbeats extend, and leases that run out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.operations import MOVES
from lectern.session import ship

#: Columns of a job's state; lease_until in milliseconds, 0 without a lease.
STATE = "state string, refused long, attempts int, lease_until long"
RESULT = f"job_id long, {STATE}"
HELD = ("LEASED", "RUNNING")
#: Jobs are held by the hash of their ids, in so many buckets: a call of Python for each job takes longer than its events do.
BUCKETS = 1024


def reclaimed(job: tuple, now: int, most: int) -> tuple:
    """job once its lease, if it ran out before now, has ended: queued with one more attempt, or failed after `most` of them."""
    state, refused, attempts, lease = job
    if not lease or lease >= now:
        return job
    return ("QUEUED", refused, attempts + 1, 0) if attempts + 1 <= most else ("FAILED", refused, attempts, 0)


def moved(job: tuple, at: int, target: str, seconds: int, most: int) -> tuple:
    """job after an event: an allowed move, a heartbeat (RUNNING again), or a refused one."""
    state, refused, attempts, lease = reclaimed(job, at, most)
    if target in MOVES[state] or state == target == "RUNNING":
        return (target, refused, attempts, at + 1000 * seconds if target in HELD else 0)
    return (state, refused + 1, attempts, lease)


def job_stream(events: DataFrame, seconds: int, most: int, late: str = "0 seconds") -> DataFrame:
    """Changes of jobs (RESULT) from a stream of events (job_id, event_id, at timestamp, state), in update mode.

    A job's events of a batch are taken in the order of at and event_id. Event-time timers end leases: once the watermark (the latest event less
    `late`) has passed a lease, the job goes back to the queue or fails, whether or not it has another event. Events behind the watermark are dropped.
    A bucket of jobs is one state with one timer, that of its earliest lease; only jobs that an event or a timer has touched are sent on.
    """
    ship(events.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = {job: tuple(rest) for job, *rest in json.loads(state.get[0])} if state.exists else {}
        mark, changed = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values(["ms", "event_id"])
            for job, at, target in zip(rows["job_id"].tolist(), rows["ms"].tolist(), rows["state"].tolist(), strict=True):
                jobs[job] = moved(jobs.get(job, ("QUEUED", 0, 0, 0)), at, target, seconds, most)
                changed.add(job)
        ended = {job: new for job, held in jobs.items() if (new := reclaimed(held, mark, most)) != held}
        jobs |= ended
        changed |= ended.keys()
        state.update((json.dumps([(job, *rest) for job, rest in jobs.items()]),))
        if leases := [lease for *_, lease in jobs.values() if lease]:
            state.setTimeoutTimestamp(max(min(leases), mark + 1))
        if changed:
            yield pd.DataFrame([(job, *jobs[job]) for job in changed], columns=["job_id", "state", "refused", "attempts", "lease_until"])

    timed = events.where("job_id is not null").withWatermark("at", late).select(F.col("job_id").cast("long").alias("job_id"), "event_id", "at", F.unix_millis("at").alias("ms"), "state")
    return timed.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(step, RESULT, "jobs string", "update", GroupStateTimeout.EventTimeTimeout)


def job_states(events: DataFrame, now: Column | int, seconds: int, most: int) -> DataFrame:
    """The same states (RESULT) of all events at once, with leases that ended before now (milliseconds): a fold over each job's events."""
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    start = F.struct(F.lit("QUEUED").alias("state"), F.lit(0).cast("long").alias("refused"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("lease_until"))

    def job(state: Column, refused: Column, attempts: Column, lease: Column) -> Column:
        return F.struct(state.alias("state"), refused.alias("refused"), attempts.alias("attempts"), lease.alias("lease_until"))

    def ended(s: Column, at: Column) -> Column:
        lost = (s["lease_until"] > 0) & (s["lease_until"] < at)
        again = s["attempts"] + 1 <= most
        return F.when(lost & again, job(F.lit("QUEUED"), s["refused"], s["attempts"] + 1, F.lit(0).cast("long"))).when(lost, job(F.lit("FAILED"), s["refused"], s["attempts"], F.lit(0).cast("long"))).otherwise(s)

    def step(s: Column, e: Column) -> Column:
        fine = F.array_contains(F.element_at(allowed, s["state"]), e["state"]) | ((s["state"] == "RUNNING") & (e["state"] == "RUNNING"))
        lease = F.when(e["state"].isin(*HELD), e["ms"] + 1000 * seconds).otherwise(F.lit(0).cast("long"))
        return F.when(fine, job(e["state"], s["refused"], s["attempts"], lease)).otherwise(job(s["state"], s["refused"] + 1, s["attempts"], s["lease_until"]))

    lists = events.where("job_id is not null").groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(F.unix_millis("at").alias("ms"), "event_id", "state"))).alias("e"))
    both = lambda s, e: F.element_at(F.transform(F.array(ended(s, e["ms"])), lambda x: step(x, e)), 1)
    last = F.aggregate("e", start, both)
    now = F.lit(now).cast("long") if isinstance(now, int) else now
    return lists.select("job_id", last.alias("s")).select("job_id", ended(F.col("s"), now).alias("s")).select("job_id", "s.*")
