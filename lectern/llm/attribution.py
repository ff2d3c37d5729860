"""Sales attributed to clicks by a stateful stream whose state is columns of hash buckets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.llm.common import crc_mod, discard, shared_root, staged
from lectern.session import ship

BATCHES, LATENESS_H, WINDOW_H, DELAY_H = 10, 48, 168, 240
HOUR = 3_600_000_000
WINDOW = WINDOW_H * HOUR
#: A client's rows are cut into slices of time, no longer than this and so short that all rows of the input, if they were one client's, evenly spread, put so many into one.
SLICE_MOST, SLICE_ROWS = 2 * HOUR, 50_000
#: Slices of clients are hashed to buckets: one for so many rows, and at least so many.
BUCKET_ROWS, BUCKETS_LEAST = 20_000, 64
#: Watermarks before the first and after the last batch; no time and no id are as small as NEVER.
NEVER, ENDED = -(1 << 63), (1 << 63) - 1
#: Kinds of rows that go in, and of rows that come out.
CLICK, UPPER, LOWER, TICK = 0, 1, 2, 3
LATE, SLICE = 4, 5

FED = "bucket long, kind byte, client long, slice long, at long, ref long, sale long, batch int"
EMITTED = "kind byte, ref long, sale long, batch int, client long, slice long, at long, n long, ts long, click long"
STATE = "clicks binary, sales binary, mark long"
RESULT = ["sale_id", "batch", "late", "click_id", "n_clicks"]


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970: of a timestamp without a zone as if in UTC, whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(c)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((days * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + (F.expr(f"extract(second from `{name}`)") * 1_000_000).cast("long")


def arrival_hour(df: DataFrame, key: str) -> Column:
    """Whole hours since 1970 of arrived_at, DELAY_H later for the keys whose crc32 is divisible by 4."""
    hours = F.floor(micros(df, "arrived_at") / HOUR)
    return hours + F.when(crc_mod(key, 4) == 0, DELAY_H).otherwise(0)


def clean_clicks(clicks: DataFrame) -> DataFrame:
    """(click_id, client, ts, h): complete clicks, of rows with one click_id the one that arrived first."""
    whole = clicks.where("click_id is not null and client_id is not null and ts is not null")
    row = F.struct(arrival_hour(clicks, "click_id").alias("h"), micros(clicks, "ts").alias("ts"), F.col("client_id").cast("long").alias("client"))
    return whole.select(F.col("click_id").cast("long").alias("click_id"), row.alias("r")).groupBy("click_id").agg(F.min("r").alias("r")).select("click_id", "r.client", "r.ts", "r.h")


def clean_sales(sales: DataFrame) -> DataFrame:
    return sales.where("client_id is not null and sold_at is not null").select(
        F.coalesce(F.col("sale_id").cast("long"), F.lit(NEVER)).alias("sale"), F.col("client_id").cast("long").alias("client"), micros(sales, "sold_at").alias("at"), arrival_hour(sales, "sale_id").alias("h")
    )


def batch_of(h: str, lo: int, hi: int) -> Column:
    share = F.floor(BATCHES * (F.col(h) - lo) / F.lit(hi - lo + 1))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), share)), F.lit(0)).cast("int")


# ---- the state of a bucket ----


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _block(raw: bytes | None, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    if not raw:
        return {n: np.empty(0, np.int64) for n in names}
    table = pa.ipc.open_stream(raw).read_all()
    return {n: table.column(n).to_numpy() for n in names}


def _joined(old: dict[str, np.ndarray], new: pd.DataFrame, names: dict[str, str]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([old[n], new[c].to_numpy(np.int64)]) for n, c in names.items()}


def _kept(block: dict[str, np.ndarray], mask: np.ndarray) -> dict[str, np.ndarray]:
    return {n: v[mask] for n, v in block.items()}


CLICK_COLUMNS = {"client": "client", "slice": "slice", "ts": "at", "click": "ref"}
SALE_COLUMNS = {"kind": "kind", "client": "client", "slice": "slice", "sold": "at", "ref": "ref", "sale": "sale"}


def _codes(clicks: dict, sales: dict) -> tuple[np.ndarray, np.ndarray]:
    """One number for each (client, slice), in their order, for clicks and for sales."""
    both = [np.concatenate([clicks[n], sales[n]]) for n in ("client", "slice")]
    order = np.lexsort(both[::-1])
    a, b = both[0][order], both[1][order]
    steps = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))]) if len(order) else order
    codes = np.empty(len(order), np.int64)
    codes[order] = steps
    return codes[: len(clicks["ts"])], codes[len(clicks["ts"]) :]


def close(clicks: dict, sales: dict, width: int, before: int, mark: int, batch: int) -> pd.DataFrame:
    """What a bucket knows of closing sales and of slices that end: rows of EMITTED.

    UPPER: clicks of the slice of sold_at up to it, and the last of them. LOWER: clicks of the slice of sold_at - WINDOW from then
    on. SLICE: all clicks of a slice that lies before the watermark now and did not before. Keys are (client, slice, time in the
    slice) in one number, so one sorted array answers all clients of the bucket.
    """
    mine, asked = _codes(clicks, sales)
    order = np.lexsort((clicks["click"], clicks["ts"], mine))
    ts, ids = clicks["ts"][order], clicks["click"][order]
    keys = mine[order] * width + (ts - clicks["slice"][order] * width)
    upper = sales["kind"] == UPPER
    at = np.where(upper, sales["sold"], sales["sold"] - WINDOW) - sales["slice"] * width + asked * width
    first, end = np.searchsorted(keys, asked * width, "left"), np.searchsorted(keys, (asked + 1) * width, "left")
    upto = np.searchsorted(keys, at, "right")
    n = np.where(upper, upto - first, end - np.searchsorted(keys, at, "left"))
    found = upper & (n > 0)
    last = np.where(found, upto - 1, 0)
    best_ts = np.where(found, ts[last], NEVER) if len(ts) else np.full(len(n), NEVER)
    best_id = np.where(found, ids[last], 0) if len(ts) else np.zeros(len(n), np.int64)
    answers = {"kind": sales["kind"], "ref": sales["ref"], "sale": sales["sale"], "client": sales["client"], "slice": sales["slice"], "at": sales["sold"], "n": n, "ts": best_ts, "click": best_id}

    ends = np.flatnonzero(np.diff(mine[order], append=-1)) if len(order) else np.empty(0, np.int64)
    counts = np.diff(ends, prepend=-1)
    close_at = (clicks["slice"][order][ends] + 1) * width
    due = (close_at > before) & (close_at <= mark) if mark != ENDED else close_at > before
    ends, counts = ends[due], counts[due]
    zero = np.zeros(len(ends), np.int64)
    totals = {"kind": zero + SLICE, "ref": zero, "sale": zero, "client": clicks["client"][order][ends], "slice": clicks["slice"][order][ends], "at": zero, "n": counts, "ts": ts[ends], "click": ids[ends]}
    return pd.concat([pd.DataFrame(answers), pd.DataFrame(totals)]).assign(batch=batch)


def bucket_step(width: int):
    """The stream's function: a bucket's rows of one batch, and the tick that carries the watermark, change its blocks."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        tick = rows[rows["kind"] == TICK].iloc[0]
        mark, batch = int(tick["at"]), int(tick["batch"])
        old_clicks, old_sales, before = state.get if state.exists else (None, None, NEVER)
        clicks, sales = _block(old_clicks, tuple(CLICK_COLUMNS)), _block(old_sales, tuple(SALE_COLUMNS))
        clicks = _joined(clicks, rows[(rows["kind"] == CLICK) & (rows["at"] >= mark)], CLICK_COLUMNS)
        asks = rows[rows["kind"].isin((UPPER, LOWER))]
        late = asks[(asks["kind"] == UPPER) & (asks["at"] < mark)]
        sales = _joined(sales, asks[asks["at"] >= mark], SALE_COLUMNS)
        closing = (sales["sold"] < mark) | (mark == ENDED)
        out = [close(clicks, _kept(sales, closing), width, before, mark, batch)] if mark != NEVER else []
        if len(late):
            out.append(pd.DataFrame({"kind": LATE, "ref": late["ref"], "sale": late["sale"], "batch": batch, "client": late["client"], "slice": late["slice"], "at": late["at"], "n": 0, "ts": NEVER, "click": 0}))
        if mark == ENDED:
            state.remove()
        else:
            stay = clicks["ts"] >= mark - WINDOW if mark > NEVER + WINDOW else np.ones(len(clicks["ts"]), bool)
            state.update((_packed(pa.table(_kept(clicks, stay))), _packed(pa.table(_kept(sales, ~closing))), mark))
        for df in out:
            yield df[["kind", "ref", "sale", "batch", "client", "slice", "at", "n", "ts", "click"]].astype({"kind": "int8", "batch": "int32"})

    return step


# ---- the stream ----


def _fed(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """Rows of FED: a click goes to the bucket of its client and slice, a sale to those of both ends of its window."""
    ends = F.when(F.col("kind") == CLICK, F.array(F.struct(F.lit(CLICK).alias("kind"), F.col("at").alias("edge")))).otherwise(
        F.array(F.struct(F.lit(UPPER).alias("kind"), F.col("at").alias("edge")), F.struct(F.lit(LOWER).alias("kind"), (F.col("at") - WINDOW).alias("edge")))
    )
    placed = rows.withColumn("e", F.explode(ends)).withColumn("slice", F.expr(f"(e.edge - pmod(e.edge, {width}L)) div {width}L"))
    bucket = F.pmod(F.xxhash64("client", "slice"), F.lit(buckets))
    return placed.select(bucket.cast("long").alias("bucket"), F.col("e.kind").cast("byte").alias("kind"), "client", "slice", "at", "ref", "sale", F.lit(0).alias("batch"))


def _ticks(spark: SparkSession, buckets: int, mark: int, batch: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    return spark.range(0, buckets, 1, 1).select(F.col("id").alias("bucket"), F.lit(TICK).cast("byte").alias("kind"), zero.alias("client"), zero.alias("slice"), F.lit(mark).cast("long").alias("at"), zero.alias("ref"), zero.alias("sale"), F.lit(batch).alias("batch"))


def watermarks(last_click: list[int | None], last_sale: list[int | None]) -> list[int]:
    """For each batch the smaller of the largest click time and the largest sale time of earlier batches, less LATENESS_H; then ENDED."""
    marks, seen = [], [NEVER, NEVER]
    for pair in zip(last_click, last_sale, strict=True):
        marks.append(min(seen) - LATENESS_H * HOUR if min(seen) > NEVER else NEVER)
        seen = [max(s, NEVER if p is None else p) for s, p in zip(seen, pair, strict=True)]
    return [*marks, ENDED]


def _run(spark: SparkSession, root: str, width: int) -> None:
    """Start the query on its checkpoint, let it take what has been fed since, and stop."""
    answered = spark.readStream.schema(FED).parquet(f"{root}/fed").groupBy("bucket").applyInPandasWithState(bucket_step(width), EMITTED, STATE, "append", GroupStateTimeout.NoTimeout)
    sink = answered.writeStream.format("parquet").option("path", f"{root}/emitted").option("checkpointLocation", f"{root}/progress")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def attribute(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per complete sale: sale_id, batch that emitted it, late, click_id of its client's last click or null, n_clicks.

    Rows come in BATCHES by arrival; a streaming query on one checkpoint is started anew for each. Dropped are clicks without click_id,
    client_id or ts, sales without client_id or sold_at; of clicks with one click_id the first to arrive stays. Sales with equal
    sale_id, or none, are told apart and each give a row; rows without arrived_at belong to the first batch. Clicks at the same
    time: the larger click_id wins. Without clicks all sales close at the end, without any. Further columns are not read.

    State is held by bucket as Arrow blocks, in slices of time of a client, so that a client with any share of the rows is spread
    over all buckets. A sale asks the slices of both ends of its window; the slices between them are complete by then (later clicks for
    them are behind the watermark), and a running sum over a client's slices stands for them.
    """
    spark = clicks.sparkSession
    ship(spark)
    root = f"{shared_root(spark)}/lectern/attribution-{uuid.uuid4().hex}"
    clean = staged(clean_clicks(clicks), "attribution-clicks")
    lo, hi, early, latest, n_clicks = clean.agg(F.min("h"), F.max("h"), F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    rows = clean.select(F.lit(CLICK).alias("kind"), "client", F.col("ts").alias("at"), F.col("click_id").alias("ref"), F.lit(0).cast("long").alias("sale"), batch_of("h", lo, hi).alias("batch")).unionByName(
        clean_sales(sales).select(F.lit(UPPER).alias("kind"), "client", "at", F.monotonically_increasing_id().alias("ref"), "sale", batch_of("h", lo, hi).alias("batch"))
    )
    rows.hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{root}/rows")
    discard(clean)
    rows = spark.read.schema("kind int, client long, at long, ref long, sale long, batch int").parquet(f"{root}/rows")
    last: dict[tuple, int] = {}
    total = 0
    for r in rows.groupBy("batch", "kind").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n")).collect():  # two rows a batch
        last[r["batch"], r["kind"]] = r["at"]
        total += r["n"]
    marks = watermarks(*[[last.get((b, kind)) for b in range(BATCHES)] for kind in (CLICK, UPPER)])
    span = latest - early if n_clicks else 0
    width = max(1_000_000, min(SLICE_MOST, span * SLICE_ROWS // max(1, total))) if span else SLICE_MOST
    buckets = max(BUCKETS_LEAST, -(-total // BUCKET_ROWS))

    for batch, mark in enumerate(marks):
        ticks = _ticks(spark, buckets, mark, batch)
        fed = _fed(rows.where(F.col("batch") == batch), width, buckets).unionByName(ticks) if batch < BATCHES else ticks
        fed.write.mode("append").parquet(f"{root}/fed")
        _run(spark, root, width)
    return _assembled(spark.read.schema(EMITTED).parquet(f"{root}/emitted"))


def _assembled(emitted: DataFrame) -> DataFrame:
    """Both ends of each sale's window with what lies between."""
    never = F.lit(NEVER)
    asks = emitted.where(F.col("kind").isin(UPPER, LOWER))
    known = emitted.where(F.col("kind") == SLICE).select("client", "slice", "n", "ts", "click").unionByName(asks.select("client", "slice", F.lit(0).cast("long").alias("n"), never.alias("ts"), F.lit(0).cast("long").alias("click")))
    slices = known.groupBy("client", "slice").agg(F.sum("n").alias("within"), F.max(F.struct("ts", "click")).alias("own"))
    earlier = Window.partitionBy("client").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a client's slices, not its rows
    slices = slices.select("client", "slice", "within", F.coalesce(F.sum("within").over(earlier), F.lit(0)).alias("before"), F.max("own").over(earlier).alias("prior"))
    up = F.col("kind") == UPPER
    n = F.when(up, F.col("n") + F.col("before")).otherwise(F.col("n") - F.col("before") - F.col("within"))
    best = F.when(up & (F.col("ts") > never), F.struct("ts", "click")).when(up, F.col("prior"))
    sales = (
        asks.join(slices, ["client", "slice"])
        .select("ref", "batch", F.when(up, F.col("sale")).alias("sale"), "at", n.alias("n"), best.alias("best"))
        .groupBy("ref")
        .agg(F.max("sale").alias("sale"), F.max("batch").alias("batch"), F.max("at").alias("at"), F.sum("n").alias("n_clicks"), F.max("best").alias("best"))
    )
    click = F.when((F.col("n_clicks") > 0) & (F.col("best.ts") >= F.col("at") - WINDOW), F.col("best.click"))
    closed = sales.select("sale", "batch", F.lit(False).alias("late"), click.alias("click_id"), "n_clicks")
    late = emitted.where(F.col("kind") == LATE).select("sale", "batch", F.lit(True).alias("late"), F.lit(None).cast("long").alias("click_id"), F.lit(0).cast("long").alias("n_clicks"))
    return closed.unionByName(late).withColumn("sale_id", F.when(F.col("sale") > never, F.col("sale"))).select(RESULT)
