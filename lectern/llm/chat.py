"""Collapse of cumulative conversation snapshots, then rendering as chat text, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn template: role and text stand in these places.
TURN_TEMPLATE = "<|im_start|>%s\n%s<|im_end|>"


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of another one.

    A conversation is its turns in the order of (turn, role, text); null role or text counts as
    empty. It goes if a longer conversation begins with the same turns, or an equal one has a
    smaller conv_id. Rows without conv_id belong to no conversation and are ignored.

    Each turn gets a rolling hash of the conversation up to it: the xor of the hashes of
    (position, role, text), 128 bits. Prefixes are grouped by that hash with map-side
    aggregates, so a first turn that most conversations share is no hot group.
    """
    clean = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = clean.withColumn("pos", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    lanes = {name: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "role", "text")).over(running) for name, seed in (("a", 17), ("b", 71))}
    last = F.lead("pos").over(order).isNull()
    prefixes = numbered.select("conv_id", "pos", *[c.alias(n) for n, c in lanes.items()], last.alias("whole"))
    ends = prefixes.where("whole").select("conv_id", F.col("pos").alias("n_turns"), "a", "b")
    reach = prefixes.groupBy("pos", "a", "b").agg(F.max(~F.col("whole")).alias("longer"), F.min(F.when(F.col("whole"), F.col("conv_id"))).alias("least"))
    covered = ends.join(reach, (F.col("n_turns") == F.col("pos")) & (ends["a"] == reach["a"]) & (ends["b"] == reach["b"])).where("longer or least < conv_id").select("conv_id")
    return ends.select("conv_id", "n_turns").join(covered, "conv_id", "left_anti")


def render_conversations(turns: DataFrame, template: str = TURN_TEMPLATE) -> DataFrame:
    """conv_id, n_turns, rendered: each maximal conversation's turns through the template, joined by a line feed.

    Extra columns are ignored; an empty table gives an empty result. A conversation becomes one
    row, so its turns meet in one task; nothing else does.
    """
    keep = maximal_conversations(turns)
    shown = F.format_string(template, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    parts = turns.join(keep, "conv_id", "left_semi").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), shown.alias("shown")).alias("t"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join("t.shown", "\n").alias("rendered"))
