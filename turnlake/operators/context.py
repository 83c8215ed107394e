"""What surrounds a match: positions in a session, anchors, and windows merged where they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "conversation", 0).when(tier == "invocation", 1).when(tier == "result", 2).otherwise(3)


def positions(turns: DataFrame) -> DataFrame:
    """Turns with ``pos``, their place in their session."""
    order = Window.partitionBy("session").orderBy("ts", "uuid", tier_rank(F.col("tier")), *(["seq"] if "seq" in turns.columns else []))
    return turns.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def anchors_of_hits(placed: DataFrame, hits: DataFrame) -> DataFrame:
    """(session, pos) of the turns that hits stand in; of turns with one key the last."""
    last = placed.groupBy("session", "uuid", "tier").agg(F.max("pos").alias("pos"))
    return hits.select("session", "uuid", "tier").distinct().join(last, ["session", "uuid", "tier"]).select("session", "pos")


def anchors_of_turn(placed: DataFrame, uuid: str) -> DataFrame:
    return placed.where(F.col("uuid") == uuid).select("session", "pos")


def anchor_of_tail(placed: DataFrame, k: int) -> DataFrame:
    """The turn whose window is the last 2k + 1 of each session."""
    return placed.groupBy("session").agg(F.greatest(F.max("pos") - k, F.lit(0)).alias("pos"))


def windows(placed: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(session, window_id, lo, hi): k turns to either side of each anchor, touching windows merged."""
    size = placed.groupBy("session").agg((F.max("pos") + 1).alias("size"))
    spread = anchors.distinct().join(size, "session").select("session", F.greatest(F.col("pos") - k, F.lit(0)).alias("lo"), F.least(F.col("pos") + k, F.col("size") - 1).alias("hi"))
    order = Window.partitionBy("session").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)
    marked = spread.withColumn("fresh", fresh).withColumn("window_id", F.sum("fresh").over(order).cast("long"))
    return marked.groupBy("session", "window_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def window_turns(placed: DataFrame, merged: DataFrame, anchors: DataFrame) -> DataFrame:
    """The turns of windows, with window_id and whether they are a match. The range becomes an equality by listing positions."""
    listed = merged.select("session", "window_id", F.explode(F.sequence("lo", "hi")).alias("pos"))
    marks = anchors.distinct().withColumn("is_match", F.lit(True))
    return placed.join(listed, ["session", "pos"]).join(marks, ["session", "pos"], "left").withColumn("is_match", F.coalesce("is_match", F.lit(False)))


def first_value(placed: DataFrame, column: str) -> DataFrame:
    """(session, column): the first value in a session that isn't empty."""
    return placed.where(F.col(column) != "").groupBy("session").agg(F.min_by(column, "pos").alias(column))
