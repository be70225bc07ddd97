"""Joins between rows and time windows, cut into day cells so a busy entity is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells_of(windows: DataFrame, start: str, end: str, out: str, cell: str = "day") -> DataFrame:
    """Windows once per day cell they touch."""
    lo, hi = F.date_trunc(cell, start), F.date_trunc(cell, end)
    return windows.withColumn(out, F.explode(F.sequence(lo, hi, F.expr(f"INTERVAL 1 {cell}"))))


def rows_in_windows(
    rows: DataFrame, windows: DataFrame, t: str = "t", start: str = "start", end: str = "end", key: str = "entity", how: str = "inner"
) -> DataFrame:
    """Rows inside some window of their entity (both ends included); ``how`` may be semi or anti."""
    left = rows.withColumn("_cell", F.date_trunc("day", t))
    right = cells_of(windows, start, end, "_cell")
    if how != "inner":
        right = right.select(F.col(key).alias("_k"), F.col("_cell").alias("_c"), F.col(start).alias("_s"), F.col(end).alias("_e"))
        cond = (F.col(key) == F.col("_k")) & (F.col("_cell") == F.col("_c")) & F.col(t).between(F.col("_s"), F.col("_e"))
        return left.join(right, cond, how).drop("_cell")
    return left.join(right, [key, "_cell"]).where(F.col(t).between(F.col(start), F.col(end))).drop("_cell")


def overlapping(a: DataFrame, b: DataFrame, key: str = "entity") -> DataFrame:
    """Pairs of overlapping windows; ``a`` has (start, end), ``b`` has (start2, end2).

    A pair is kept only in the later of the two first cells, so it appears once.
    """
    left = cells_of(a, "start", "end", "_cell")
    right = cells_of(b, "start2", "end2", "_cell")
    pairs = left.join(right, [key, "_cell"]).where((F.col("start") <= F.col("end2")) & (F.col("start2") <= F.col("end")))
    once = F.col("_cell") == F.greatest(F.date_trunc("day", "start"), F.date_trunc("day", "start2"))
    return pairs.where(once).drop("_cell")


def without_neighbour(points: DataFrame, others: DataFrame, t: str, hours: float, key: str = "entity") -> DataFrame:
    """Points with no other point of the same entity within ``hours`` (inclusive).

    Both sides are cut into cells as wide as the tolerance. Another point in the
    own cell is always close enough; of the two neighbouring cells only the last
    and the first point matter. So every point meets at most three rows.
    """
    if hours == 0:
        return points.join(others.select(key, t).distinct(), [key, t], "left_anti").select(*points.columns)
    width = int(hours * 3600 * 1_000_000)
    us = F.unix_micros(F.col(t))
    cell = F.floor(us / width)
    o = others.select(key, us.alias("_o"), cell.alias("_cell"))
    edge = o.groupBy(key, "_cell").agg(F.min("_o").alias("_lo"), F.max("_o").alias("_hi"))
    p = points.withColumns({"_p": us, "_cell": cell})
    before = edge.select(key, (F.col("_cell") + 1).alias("_cell"), F.col("_hi").alias("_prev"))
    after = edge.select(key, (F.col("_cell") - 1).alias("_cell"), F.col("_lo").alias("_next"))
    here = edge.select(key, "_cell", F.lit(1).alias("_here"))  # an own-cell neighbour is always close enough
    j = p.join(here, [key, "_cell"], "left").join(before, [key, "_cell"], "left").join(after, [key, "_cell"], "left")
    near = (
        F.col("_here").isNotNull()
        | F.coalesce(F.col("_p") - F.col("_prev") <= width, F.lit(False))
        | F.coalesce(F.col("_next") - F.col("_p") <= width, F.lit(False))
    )
    return j.where(~near).drop("_p", "_cell", "_here", "_prev", "_next")
