"""Upserts, deletes, jobs, leases and telemetry as batch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows, and old's whose key new lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def cascade_delete(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone.select(key).distinct(), key, "left_anti")


def telemetry(events: DataFrame, name: str, duration: str, failed: Column, most: int = 50) -> DataFrame:
    """Count, mean duration and failures by name; the `most` names with most rows."""
    return events.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.avg(duration).alias("avg_duration"), F.sum(failed.cast("int")).alias("failures")).orderBy(F.desc("n"), name).limit(most)


def claim(jobs: DataFrame, group: str, types: list[str] | None = None) -> DataFrame:
    """The queued job of each group to run next: least priority, then oldest, then id; of the types asked for, and not to be cancelled."""
    free = jobs.where("state = 'QUEUED'")
    free = free.where(~F.coalesce("cancel_requested", F.lit(False))) if "cancel_requested" in jobs.columns else free
    free = free.where(F.col("type").isin(types)) if types else free
    return free.groupBy(group).agg(F.min(F.struct("priority", "created_at", "job_id")).alias("next")).select(group, F.col("next.job_id").alias("job_id"))


def leased(jobs: DataFrame, taken: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """jobs with the taken ones (job_id) under a lease from now on."""
    mark = taken.select("job_id", F.lit(True).alias("_taken")).distinct()
    own = F.col("_taken") & (F.col("state") == "QUEUED")
    rows = jobs.join(mark, "job_id", "left")
    return rows.withColumns({"lease_until": F.when(own, now + F.expr(f"interval {seconds} seconds")).otherwise(F.col("lease_until")), "state": F.when(own, "LEASED").otherwise(F.col("state"))}).drop("_taken")


def heartbeat(jobs: DataFrame, alive: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """jobs with the leases of those alive (job_id) extended; they are running then."""
    mark = alive.select("job_id", F.lit(True).alias("_alive")).distinct()
    own = F.col("_alive") & F.col("state").isin("LEASED", "RUNNING")
    rows = jobs.join(mark, "job_id", "left")
    return rows.withColumns({"lease_until": F.when(own, now + F.expr(f"interval {seconds} seconds")).otherwise(F.col("lease_until")), "state": F.when(own, "RUNNING").otherwise(F.col("state"))}).drop("_alive")


def reclaim(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """Jobs whose lease ran out go back to the queue with one more attempt, or fail with LEASE_EXPIRED once `most` attempts are spent; either way the lease ends."""
    lost = F.col("state").isin("LEASED", "RUNNING") & F.coalesce(F.col("lease_until") < now, F.lit(False))
    again = lost & (F.col("attempts") + 1 <= most)
    error = F.col("error_code") if "error_code" in jobs.columns else F.lit(None).cast("string")
    return jobs.withColumns({
        "error_code": F.when(lost & ~again, F.coalesce(error, F.lit("LEASE_EXPIRED"))).otherwise(error),
        "state": F.when(again, "QUEUED").when(lost, "FAILED").otherwise(F.col("state")),
        "attempts": F.col("attempts") + again.cast("int"),
        "lease_until": F.when(~lost, F.col("lease_until")),
    })


def cancel(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """jobs with those wanted (job_id) cancelled at once if queued, else asked to stop."""
    rows = jobs.join(wanted.select("job_id", F.lit(True).alias("_c")).distinct(), "job_id", "left").withColumn("_c", F.coalesce("_c", F.lit(False)))
    flag = F.coalesce("cancel_requested", F.lit(False)) if "cancel_requested" in jobs.columns else F.lit(False)
    return rows.withColumns({"cancel_requested": flag | F.col("_c"), "state": F.when(F.col("_c") & (F.col("state") == "QUEUED"), "CANCELLED").otherwise(F.col("state"))}).drop("_c")


#: The states that a job may go to from each state.
MOVES = {"QUEUED": ("LEASED", "CANCELLED"), "LEASED": ("RUNNING", "QUEUED", "DONE", "FAILED", "CANCELLED"), "RUNNING": ("QUEUED", "DONE", "FAILED", "CANCELLED"), "DONE": (), "FAILED": ("QUEUED",), "CANCELLED": ("QUEUED",)}


def final_states(events: DataFrame) -> DataFrame:
    """(job_id, state, refused): where a job's events (job_id, event_id, state) lead from QUEUED, and how many of them were no allowed move."""
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    lists = events.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "state"))).alias("e"))
    start = F.struct(F.lit("QUEUED").alias("state"), F.lit(0).alias("refused"))
    step = lambda s, e: F.when(F.array_contains(F.element_at(allowed, s["state"]), e["state"]), F.struct(e["state"].alias("state"), s["refused"].alias("refused"))).otherwise(F.struct(s["state"].alias("state"), (s["refused"] + 1).alias("refused")))
    return lists.select("job_id", F.aggregate("e", start, step).alias("r")).select("job_id", "r.*")


def latest(rows: DataFrame, order: str, tie: str, most: int = 50) -> DataFrame:
    """The newest rows (a listing of `most`)."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(most)


def smoothed_eta(samples: DataFrame, key: str, alpha: float = 0.3) -> DataFrame:
    """(key, rate, eta): of progress samples (key, at seconds, done, total) the exponential average of the rate, and the seconds left at it."""
    lists = samples.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "done", "total"))).alias("s"))
    pairs = F.zip_with(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(1))), F.slice("s", 2, F.size("s")), lambda a, b: F.when(b["at"] > a["at"], (b["done"] - a["done"]) / (b["at"] - a["at"])))
    rate = F.aggregate(F.filter(pairs, lambda r: r.isNotNull()), F.lit(None).cast("double"), lambda s, r: F.coalesce(alpha * r + (1 - alpha) * s, r))
    last = F.element_at("s", -1)
    return lists.select(key, rate.alias("rate"), last["done"].alias("done"), last["total"].alias("total")).select(key, "rate", F.when(F.col("rate") > 0, F.greatest(F.lit(0.0), (F.col("total") - F.col("done")) / F.col("rate"))).alias("eta"))


def pending(leaves: DataFrame, model_key: str, most: int | None = None) -> DataFrame:
    """Leaves (level, embedding, model_key) that lack a vector of the model, in the order of chunk_id."""
    open_ = leaves.where("level = 'L2'").where(F.col("embedding").isNull() | ~F.col("model_key").eqNullSafe(F.lit(model_key)))
    return open_ if most is None else open_.orderBy("chunk_id").limit(most)


def with_vectors(chunks: DataFrame, vectors: DataFrame, model_key: str) -> DataFrame:
    """chunks with new vectors (chunk_id, embedding) of the model in place of the old."""
    new = vectors.select("chunk_id", F.col("embedding").alias("_new"))
    rows = chunks.join(new, "chunk_id", "left")
    return rows.withColumns({"model_key": F.when(F.col("_new").isNotNull(), F.lit(model_key)).otherwise(F.col("model_key")), "embedding": F.coalesce("_new", "embedding")}).drop("_new")


def facets(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """What leaves are filtered by: (chunk_id, collection_id, document_id, doc_type, language, year, chapter_id)."""
    leaf = chunks.where("level = 'L2'").select("chunk_id", "collection_id", "document_id", "chapter_id")
    return leaf.join(documents.select("document_id", "doc_type", "language", "year"), "document_id")


def cascade(tables: dict[str, tuple[DataFrame, str, str | None]], gone: DataFrame, root: str) -> dict[str, DataFrame]:
    """What is left of tables {name: (rows, own key, parent's name)} once the rows of `root` with the keys in gone are deleted, at any depth.

    A child's column that names its parent is called <parent>_id; gone has the root's own key.
    """
    lost, out = {root: gone.select(F.col(tables[root][1]).alias("_k")).distinct()}, {}
    left = list(tables)
    while left:
        name = next(n for n in left if n == root or tables[n][2] not in left)
        rows, key, parent = tables[name]
        if name != root and parent in lost:
            lost[name] = rows.join(lost[parent], F.col(f"{parent}_id") == F.col("_k"), "left_semi").select(F.col(key).alias("_k"))
        out[name] = rows.join(lost[name], F.col(key) == F.col("_k"), "left_anti") if name in lost else rows
        left.remove(name)
    return out


def integrity(rows: DataFrame, key: str) -> DataFrame:
    """One row: how many rows, null keys and repeated keys there are."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"), (F.count(key) - F.count_distinct(key)).alias("repeats"))


def frames(events: DataFrame) -> DataFrame:
    """(id, frame): events (id, type, data) as server-sent frames."""
    return events.select("id", F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\nevent: "), "type", F.lit("\ndata: "), "data", F.lit("\n\n")).alias("frame"))


def enqueue_once(jobs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted, less what an unfinished job already has, one row per key."""
    active = jobs.where(F.col("state").isin("QUEUED", "LEASED", "RUNNING")).select(key)
    return wanted.select(key).distinct().join(active, key, "left_anti")


def replay(events: DataFrame, after: int, size: int) -> DataFrame:
    """Events after an id, from the ring of the last `size` events."""
    last = events.agg(F.max("event_id").alias("last"))
    return events.crossJoin(F.broadcast(last)).where((F.col("event_id") > after) & (F.col("event_id") > F.col("last") - size)).drop("last")


def changes(polls: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Polls whose value differs from the one before; the first of a key only primes."""
    w = Window.partitionBy(key).orderBy(order)
    return polls.withColumn("before", F.lag(value).over(w)).withColumn("place", F.row_number().over(w)).where((F.col("place") > 1) & ~F.col("before").eqNullSafe(F.col(value))).drop("place")


def rolling_median(samples: DataFrame, key: str, order: str, value: str, rows: int = 24) -> DataFrame:
    return samples.withColumn("median", F.percentile(value, F.lit(0.5)).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)))


def cumulative_map(turns: DataFrame, key: str, order: str, label: str, value: str) -> DataFrame:
    """(key, label, value): of each label the value that the latest turn gave it."""
    return turns.groupBy(key, label).agg(F.max_by(value, F.struct(order, value)).alias(value))
