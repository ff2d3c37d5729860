"""Measured pages joined to probed ones, rollups of readings by mode, and boxes on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.staging import staged

#: Measures that a reading may leave out, sizes where 0 is none, and what a reading decides alone.
SCORES = ("parse_score", "layout_score", "table_score", "ocr_score", "lexicon_hit_rate", "cyrillic_ratio", "mojibake_ratio")
SIZES = ("width", "height", "char_from", "char_to", "cost_weight")
DECIDED = ("page_class", "ocr_mode", "page_label")
#: Boxes that a chunk keeps at most, and the gap, in shares of the higher box, that boxes of neighbouring lines may have.
BOXES, GAP = 32, 0.5


def merged_pages(probed: DataFrame, measured: DataFrame, version: str = "version", as_of: DataFrame | None = None) -> DataFrame:
    """Pages (document_id, page) with what their readings measured, and what the probe told of them where those are silent.

    measured holds any number of readings of a page, told apart by `version`. A score is that of the newest reading that has it, else the probe's; a size
    likewise, where a reading's 0 counts as none; class, mode and label are those of the newest reading, be they null, and the probe's on pages without a reading.
    A document with a reading has the pages of its readings only, one without has all that were probed. as_of (document_id, as_of) leaves out later
    readings of its documents. Of readings of one version the larger value counts; rows without document or page are left out, columns of other names too.

    Rows meet by page in one aggregate, however many readings a page has; documents with a reading are known by a distinct.
    """
    names = [n for n in (*SCORES, *SIZES, *DECIDED) if n in probed.columns or n in measured.columns]
    if as_of is not None:
        limit = as_of.groupBy("document_id").agg(F.min("as_of").alias("_limit"))
        measured = measured.join(limit, "document_id", "left").where(F.col("_limit").isNull() | (F.col(version) <= F.col("_limit")))
    kinds = dict(probed.dtypes) | dict(measured.dtypes)

    def side(df: DataFrame, read: bool) -> DataFrame:
        known = [F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names]
        number = F.col(version) if read else F.lit(None).cast(kinds[version])
        return df.where("document_id is not null and page is not null").select("document_id", "page", F.lit(read).alias("_read"), number.alias("_version"), *known)

    rows = side(measured, True)
    both = rows.unionByName(side(probed, False))

    def newest(name: str) -> Column:
        there = F.lit(True) if name in DECIDED else F.col(name).isNotNull() & ((F.col(name) != 0) | ~F.col("_read")) if name in SIZES else F.col(name).isNotNull()
        return F.max(F.when(there, F.struct("_read", "_version", name)))[name].alias(name)

    pages = both.groupBy("document_id", "page").agg(F.max("_read").alias("_read"), F.count_if("_read").alias("readings"), *[newest(n) for n in names])
    some = rows.select("document_id").distinct().withColumn("_some", F.lit(True))
    return pages.join(some, "document_id", "left").where(F.col("_read") | F.col("_some").isNull()).drop("_read", "_some")


def quantiles(rows: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(key, q0, q1, ...): exact quantiles of value with linear interpolation, for few keys of any size; null and NaN values are left out.

    Distinct values are dealt out by ranges and written; sums by key and range say how many rows lie before a range, so no task takes a whole key.
    """
    spark = rows.sparkSession
    per = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = per.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_k", "_v").withColumn("_part", F.spark_partition_id())
    ranged = staged(dealt, "quantiles")
    own = Window.partitionBy("_k")
    parts = ranged.groupBy("_k", "_part").agg(F.sum("_n").alias("_s"))  # as many rows of a key as there are ranges
    parts = parts.select(F.col("_k").alias("_key"), F.col("_part").alias("_p"), (F.sum("_s").over(own.orderBy("_part")) - F.col("_s")).alias("_before"), F.sum("_s").over(own).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy("_k", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_upto", upto).join(parts, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    end, begin = F.col("_upto") + F.col("_before"), F.col("_upto") + F.col("_before") - F.col("_n")
    at = lambda place: F.max(F.when((begin <= place) & (place < end), F.col("_v")))
    out = []
    for i, share in enumerate(shares):
        place = share * (F.col("_all") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"q{i}"))
    return placed.groupBy("_k").agg(*out).withColumnRenamed("_k", key)


def mode_rollup(readings: DataFrame) -> DataFrame:
    """How fast each mode reads: readings (document_id, mode, pages, seconds, peak_mb, error) by mode.

    documents and failures count all readings, the rest those without an error and with a page: seconds per page as mean, median and 95th percentile,
    minutes per 1,000 pages, and the largest peak. A mode without such readings has null there.
    """
    good = F.col("error").isNull() & (F.col("pages") > 0)
    each = readings.withColumn("_each", F.when(good, F.col("seconds") / F.col("pages")))
    sums = each.groupBy("mode").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.when(good, F.col("pages"))), F.lit(0)).cast("long").alias("pages"), F.avg("_each").alias("mean"), (F.avg("_each") * 1000 / 60).alias("minutes_1000"), F.max(F.when(good, F.col("peak_mb"))).alias("peak_mb"), F.count_if(F.col("error").isNotNull()).alias("failures"))
    q = quantiles(each, "mode", "_each", (0.5, 0.95)).select(F.col("mode").alias("_mode"), F.col("q0").alias("median"), F.col("q1").alias("p95"))
    return sums.join(q, F.col("mode").eqNullSafe(F.col("_mode")), "left").drop("_mode")


def grade_rollup(pages: DataFrame) -> DataFrame:
    """(mode, grade, pages, repairs): pages by mode and the grade of the worst score they have, and how many of them need repair."""
    worst = F.least("parse_score", "layout_score", "table_score", "ocr_score")
    repair = T.needs_repair(F.col("parse_score"), F.col("layout_score"), F.col("table_score"), F.col("lexicon_hit_rate"), F.col("cyrillic_ratio"))
    grade = F.when(worst.isNull(), "UNKNOWN").otherwise(T.quality_grade(worst))
    return pages.groupBy(F.col("ocr_mode").alias("mode"), grade.alias("grade")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(repair).alias("repairs"))


def matched_boxes(pages: DataFrame, pattern: str, columns: int = 80, advance: float = 6.0, pitch: float = 14.0, height: float = 12.0) -> DataFrame:
    """(document_id, page, left, top, right, bottom) of each match of pattern on pages (document_id, page, text) of fixed-width text.

    A page is laid out in lines of `columns` characters, whatever line ends it has; a match over a line's end has a box on each line. Lengths of what lies
    between matches give their places. A null text has no box. A pattern must not match the empty string.
    """
    size = lambda x: F.length(x).cast("long")
    parts = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<at: bigint, n: bigint>>)").alias("found"))

    def step(s, x):
        at, n = s["at"] + size(x["gap"]), F.coalesce(size(x["hit"]), F.lit(0).cast("long"))
        one = F.array(F.struct(at.alias("at"), n.alias("n")))
        return F.struct((at + n).alias("at"), F.when(n > 0, F.concat(s["found"], one)).otherwise(s["found"]).alias("found"))

    found = pages.where("text is not null").select("document_id", "page", F.explode(F.aggregate(parts, start, step)["found"]).alias("m"))
    at, end = F.col("m.at"), F.col("m.at") + F.col("m.n")
    lines = found.withColumn("line", F.explode(F.sequence(F.floor(at / columns), F.floor((end - 1) / columns))))
    first = F.col("line") * columns
    left, right = (F.greatest(at, first) - first) * advance, (F.least(end, first + columns) - first) * advance
    return lines.select("document_id", "page", left.alias("left"), (F.col("line") * pitch).alias("top"), right.alias("right"), (F.col("line") * pitch + height).alias("bottom"))


def limited_boxes(boxes: DataFrame, key: str = "chunk_id", order: str = "place", most: int = BOXES) -> DataFrame:
    """The first `most` different boxes (page, left, top, right, bottom) of each key in their order; equal ones count once, where the first stands."""
    sides = [key, "page", "left", "top", "right", "bottom"]
    once = boxes.groupBy(*sides).agg(F.min(order).alias(order))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, *sides[1:]))
    return once.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def box_json(page: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box as it is stored; from_box_json reads it."""
    return F.to_json(F.struct(page.cast("int").alias("page"), *[x.cast("double").alias(n) for x, n in ((left, "l"), (top, "t"), (right, "r"), (bottom, "b"))]))


def from_box_json(stored: Column) -> Column:
    return F.from_json(stored, "page int, l double, t double, r double, b double")


def merged_boxes(boxes: DataFrame, keys: tuple[str, ...] = ("document_id", "page"), gap: float = GAP) -> DataFrame:
    """Boxes (left, top, right, bottom; top is the smaller) of neighbouring lines joined: (keys, block, left, top, right, bottom, n).

    From top to bottom, and left to right on a line, a box joins the block before it if they share a stretch of x and the space between them is at most `gap`
    of the higher one; else it begins a block. n counts a block's different boxes, block numbers them from 0. Boxes without a side, or below a page's
    first line, are left out. Boxes of one page are one row: a page, or limited_boxes, bounds them.
    """
    sides = ("top", "left", "right", "bottom")
    whole = boxes.where(" and ".join(f"{c} is not null" for c in sides) + " and right > left and bottom > top")
    lists = whole.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in sides]).alias("b")).groupBy(*keys).agg(F.sort_array(F.collect_set("b")).alias("all"))
    block = "struct<top: double, left: double, right: double, bottom: double, n: int>"
    none = F.struct(F.expr(f"cast(array() as array<{block}>)").alias("done"), F.expr(f"cast(null as {block})").alias("open"))

    def step(s, b):
        o = s["open"]
        high = F.greatest(o["bottom"] - o["top"], b["bottom"] - b["top"])
        joins = F.coalesce((b["left"] < o["right"]) & (o["left"] < b["right"]) & (b["top"] - o["bottom"] <= high * gap), F.lit(False))
        union = F.struct(F.least(o["top"], b["top"]).alias("top"), F.least(o["left"], b["left"]).alias("left"), F.greatest(o["right"], b["right"]).alias("right"), F.greatest(o["bottom"], b["bottom"]).alias("bottom"), (o["n"] + 1).alias("n"))
        alone = F.struct(*[b[c].alias(c) for c in sides], F.lit(1).alias("n"))
        done = F.when(joins | o.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(o)))
        return F.struct(done.alias("done"), F.when(joins, union).otherwise(alone).alias("open"))

    folded = F.aggregate("all", none, step, lambda s: F.concat(s["done"], F.array(s["open"])))
    return lists.select(*keys, F.posexplode(folded).alias("block", "b")).select(*keys, "block", *[f"b.{c}" for c in ("left", "top", "right", "bottom", "n")])


def references(text: Column) -> Column:
    """What a Markdown text refers to: pictures (description by target; of one target the last), tables (number, rows) and formulas (number, source).

    A table is a run of lines between pipes, its rows without the line of dashes; a formula stands between double dollar signs; descriptions and sources
    are cut at 400 characters. A null text has none.
    """

    def found(lines: Column) -> Column:
        row = lambda x: F.coalesce(F.trim(x).rlike(r"^\|.*\|$"), F.lit(False))
        bare = F.transform(lines, lambda x: F.when(row(x), F.when(F.trim(x).rlike(r"^[|:\s-]+$"), F.lit(0)).otherwise(1)))
        return T.bound(bare, runs)

    def runs(kinds: Column) -> Column:
        edge = lambda k, by: F.get(kinds, k).isNotNull() & F.get(kinds, k + by).isNull()
        edges = lambda by: F.filter(F.transform(kinds, lambda _, k: F.when(edge(k, by), k)), lambda k: k.isNotNull())
        rows = F.zip_with(edges(-1), edges(1), lambda a, b: F.aggregate(F.slice(kinds, a + 1, b - a + 1), F.lit(0), lambda s, x: s + x))
        return F.transform(rows, lambda n, k: F.struct((k + 1).alias("table"), n.alias("rows")))

    text = F.coalesce(text, F.lit(""))
    picture = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(picture), F.lit(1)).alias("said"), F.regexp_extract_all(text, F.lit(picture), F.lit(2)).alias("target"))
    described = lambda p: F.map_from_arrays(F.array_distinct(p["target"]), F.transform(F.array_distinct(p["target"]), lambda t: F.substring(F.element_at(F.filter(p, lambda x: x["target"] == t), -1)["said"], 1, 400)))
    formulas = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1)), lambda x, k: F.struct((k + 1).alias("formula"), F.substring(F.trim(x), 1, 400).alias("source")))
    return F.struct(T.bound(pairs, described).alias("pictures"), T.bound(F.split(text, "\n"), found).alias("tables"), formulas.alias("formulas"))
