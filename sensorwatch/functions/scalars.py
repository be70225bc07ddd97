"""Null-safe column expressions shared by the detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column; a missing value stays missing (``least``/``greatest`` would fill it)."""
    out = F.when(F.lit(False), col)
    if low is not None:
        out = out.when(col < low, F.lit(float(low)))
    if high is not None:
        out = out.when(col > high, F.lit(float(high)))
    return out.otherwise(col)


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL instead of an infinity or an error."""
    return num / F.nullif(den, F.lit(0.0))


def at_least(den: Column, floor: Column) -> Column:
    return F.when(den < floor, floor).otherwise(den)


def denominator_floor(typical: Column) -> Column:
    """5 % of the typical positive denominator (1e-6 at least); 1 when none is positive."""
    return F.when(typical.isNotNull(), F.greatest(F.lit(1e-6), typical * 0.05)).otherwise(F.lit(1.0))


def row_mean(*cols: Column) -> Column:
    """Mean across columns of one row, ignoring missing values."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    seen = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return safe_div(total, seen.cast("double"))


def flag(cond: Column) -> Column:
    """Condition as a 0/1 integer; unknown counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def stable_seed(key: Column) -> Column:
    """Unsigned 32-bit seed from the first four bytes of a key's sha-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery (more than one row is an error)."""
    value = row.select(F.struct("*").alias("_row")).scalar()
    return df.withColumn("_row", value).select(*[f"`{c}`" for c in df.columns], "_row.*")
