"""Streams with state: jobs against a plain fold, and a sink that takes a batch once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators.operations import MOVES
from lectern.staging import new_folder, versions
from lectern.streaming import jobs as J
from lectern.streaming.sink import UpsertTable, run

DAY0 = datetime(2024, 1, 1)
EVENTS = "job_id long, event_id long, at timestamp, state string"


def plain_job(events, now, seconds, most):
    """A job's events (ms, id, state) one after another."""
    state, refused, attempts, lease = "QUEUED", 0, 0, 0
    for ms, _, target in [*sorted(events), (now, 0, None)]:
        if lease and lease < ms:
            state, attempts, lease = ("QUEUED", attempts + 1, 0) if attempts < most else ("FAILED", attempts, 0)
        if target is None:
            break
        if target in MOVES[state] or (state, target) == ("RUNNING", "RUNNING"):
            state, lease = target, ms + 1000 * seconds if target in ("LEASED", "RUNNING") else 0
        else:
            refused += 1
    return state, refused, attempts, lease


@pytest.fixture(scope="module")
def events():
    rnd = random.Random(3)
    return [(rnd.randint(1, 12), k, DAY0 + timedelta(seconds=40 * k + rnd.randint(0, 30)), rnd.choice([*MOVES, "RUNNING", "LEASED"])) for k in range(400)] + [(None, 999, DAY0, "DONE")]


def wanted(events, seconds=300, most=2):
    ms = lambda t: (t - datetime(1970, 1, 1)) // timedelta(milliseconds=1)
    now = max(ms(e[2]) for e in events)
    return {j: plain_job([(ms(e[2]), e[1], e[3]) for e in events if e[0] == j], now, seconds, most) for j in {e[0] for e in events} - {None}}, now


def rows(df):
    return {r["job_id"]: (r["state"], r["refused"], r["attempts"], r["lease_until"]) for r in df.collect()}


def test_states_of_all_events_at_once(spark, events):
    want, now = wanted(events)
    assert rows(J.job_states(spark.createDataFrame(events, EVENTS), now, 300, 2)) == want
    assert any(a for _, _, a, _ in want.values())


@pytest.mark.parametrize("cuts", [[400], [150, 160, 400]])
def test_the_stream_ends_where_the_batch_does(spark, events, cuts):
    root, begin = new_folder(spark, "jobs"), 0
    table = UpsertTable(f"{root}/table", ("job_id",), J.RESULT, 4)
    ordered = sorted(events[:-1], key=lambda e: e[2])
    for end in cuts:
        spark.createDataFrame(ordered[begin:end], EVENTS).coalesce(1).write.mode("append").parquet(f"{root}/fed")
        run(J.job_stream(spark.readStream.schema(EVENTS).parquet(f"{root}/fed"), 300, 2), table, f"{root}/progress")
        begin = end
    assert rows(table.read(spark)) == wanted(events[:-1])[0]


def test_a_lease_ends_without_another_event_of_its_job(spark):
    root = new_folder(spark, "timer")
    table = UpsertTable(f"{root}/table", ("job_id",), J.RESULT, 2)
    for part in ([(1, 1, DAY0, "LEASED")], [(2, 2, DAY0 + timedelta(hours=1), "LEASED")]):
        spark.createDataFrame(part, EVENTS).write.mode("append").parquet(f"{root}/fed")
        run(J.job_stream(spark.readStream.schema(EVENTS).parquet(f"{root}/fed"), 60, 3), table, f"{root}/progress")
    assert rows(table.read(spark))[1] == ("QUEUED", 0, 1, 0)
    assert rows(table.read(spark))[2][0] == "LEASED"


def test_jobs_share_states_and_keep_their_own_timers(spark, monkeypatch):
    root, kept = new_folder(spark, "shared"), []
    monkeypatch.setattr(J, "BUCKETS", 2)
    table = UpsertTable(f"{root}/table", ("job_id",), J.RESULT, 2)
    first = [(j, j, DAY0 + timedelta(minutes=j), "LEASED") for j in range(40)]
    for part in (first, [(50, 50, DAY0 + timedelta(minutes=30, seconds=30), "LEASED"), (3, 51, DAY0 + timedelta(minutes=39, seconds=30), "LEASED")]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{root}/fed")
        stream = J.job_stream(spark.readStream.schema(EVENTS).parquet(f"{root}/fed"), 60, 3).writeStream.foreachBatch(table.write)
        query = stream.outputMode("update").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        kept += [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    assert max(kept) == 2  # a state for each bucket, not for each job
    got = rows(table.read(spark))
    # leases of a minute that ended before the last event of the first part, the other ones, and event 50, which came behind the watermark
    assert got == {j: ("QUEUED", 0, 1, 0) for j in range(38)} | {j: got[j] for j in (38, 39)} | {3: got[3]} and {j: got[j][0] for j in (3, 39)} == {3: "LEASED", 39: "LEASED"}


def test_a_batch_that_comes_twice_changes_nothing(spark):
    table = UpsertTable(new_folder(spark, "twice"), ("k",), "k long, v string", 3)
    frame = lambda x: spark.createDataFrame(x, "k long, v string")
    assert table.read(spark).count() == 0
    table.write(frame([(1, "a"), (2, "a"), (3, "a")]), 0)
    table.write(frame([(2, "b"), (4, "b")]), 1)
    before, known = sorted(map(tuple, table.read(spark).collect())), versions(spark, table.root)
    assert before == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    table.write(frame([(2, "b"), (4, "b")]), 1)
    table.write(frame([(1, "z")]), 0)
    assert sorted(map(tuple, table.read(spark).collect())) == before and versions(spark, table.root) == known
    table.write(frame([]), 2)
    table.write(frame([(None, "n"), (1, "c")]), 3)
    assert sorted((r["v"] for r in table.read(spark).collect())) == ["a", "b", "b", "c", "n"]


def test_only_touched_buckets_are_written(spark):
    table = UpsertTable(new_folder(spark, "touched"), ("k",), "k long, v long", 8)
    table.write(spark.range(100).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v")), 0)
    table.write(spark.createDataFrame([(5, 1)], "k long, v long"), 1)
    folders = table._manifest(spark)[1]
    newest = versions(spark, table.root)[-1][1]
    assert sum(f == newest for f in folders.values()) == 1 and len(folders) == 8
    assert table.read(spark).agg(F.count("k"), F.sum("v")).first() == (100, 1)


def test_a_failed_version_is_not_seen(spark, monkeypatch):
    table = UpsertTable(new_folder(spark, "failed"), ("k",), "k long", 2)
    table.write(spark.createDataFrame([(1,)], "k long"), 0)
    import lectern.streaming.sink as sink

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(sink, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        table.write(spark.createDataFrame([(2,)], "k long"), 1)
    assert [r["k"] for r in table.read(spark).collect()] == [1]
    table.write(spark.createDataFrame([(2,)], "k long"), 1)
    assert sorted(r["k"] for r in table.read(spark).collect()) == [1, 2]
