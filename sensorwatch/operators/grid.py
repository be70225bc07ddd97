"""Raw readings -> one row per entity and time bin, with data coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorwatch.config import SIGNALS, interval_minutes
from sensorwatch.functions import series as S


def bin_start(t, interval: str):
    step = interval_minutes(interval) * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(t) / step) * step)


def present_signals(df: DataFrame) -> list[str]:
    return [s for s in SIGNALS if s in df.columns]


def fill_gaps(binned: DataFrame, interval: str, keys: Sequence[str]) -> DataFrame:
    """Insert the missing bins between two existing ones; values there are NULL.

    Each bin is stretched up to its successor, so no calendar join is needed and
    the exchange on the entity made here serves every later window.
    """
    step = F.expr(f"INTERVAL {interval_minutes(interval)} MINUTES")
    values = [c for c in binned.columns if c not in (*keys, "bin")]
    after = F.lead("bin").over(S.ordered(keys))
    stretched = binned.withColumn("_to", F.coalesce(after - step, F.col("bin")))
    spread = stretched.withColumn("_bin", F.explode(F.sequence("bin", "_to", step)))
    keep = F.col("_bin") == F.col("bin")
    return spread.select(*keys, F.col("_bin").alias("bin"), *[F.when(keep, F.col(c)).alias(c) for c in values])


def bin_readings(raw: DataFrame, interval: str, signals: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Sum, mean and reading count per bin; combined map-side before the shuffle."""
    aggs = [F.count(F.lit(1)).alias("n_raw_samples")]
    for s in signals:
        aggs += [F.sum(s).alias(f"{s}_sum"), F.avg(s).alias(f"{s}_mean")]
    return raw.groupBy(*keys, bin_start(F.col("t"), interval).alias("bin")).agg(*aggs)


def regular_grid(raw: DataFrame, interval: str, keys: Sequence[str] = S.ENTITY) -> DataFrame:
    """Gap-free grid per entity: an empty bin has sum 0, mean NULL and no readings."""
    signals = present_signals(raw)
    full = fill_gaps(bin_readings(raw, interval, signals, keys), interval, keys)
    out = [*keys, "bin"]
    for s in signals:
        out += [F.coalesce(f"{s}_sum", F.lit(0.0)).alias(f"{s}_sum"), F.col(f"{s}_mean")]
    out.append(F.coalesce(F.col("n_raw_samples").cast("double"), F.lit(0.0)).alias("n_raw_samples"))
    return full.select(*out)


def add_coverage(grid: DataFrame, keys: Sequence[str] = S.ENTITY) -> DataFrame:
    """Readings per bin against the entity's usual count, in percent (at most 100)."""
    if not any(c.endswith("_sum") for c in grid.columns):
        return grid.withColumn("coverage_pct", F.lit(0.0))
    some = F.nullif(F.col("n_raw_samples"), F.lit(0.0))
    w = S.whole(keys)
    typical = F.least(F.percentile(some, F.lit(0.5)).over(w), F.percentile(some, F.lit(0.8)).over(w))
    return grid.withColumn(
        "expected_raw_per_bin", F.greatest(F.coalesce(typical, F.lit(1.0)), F.lit(1.0))
    ).withColumn(
        "coverage_pct", F.least(F.col("n_raw_samples") / F.col("expected_raw_per_bin"), F.lit(1.0)) * 100.0
    )


def add_calendar(grid: DataFrame) -> DataFrame:
    """Monday-based weekday, hour, their circular coordinates, and the day."""
    tau = 2 * 3.141592653589793
    hour, dow = F.hour("bin"), F.weekday("bin")
    return grid.withColumns(
        {
            "dow": dow,
            "hour": hour,
            "sin_hour": F.sin(hour * tau / 24),
            "cos_hour": F.cos(hour * tau / 24),
            "sin_dow": F.sin(dow * tau / 7),
            "cos_dow": F.cos(dow * tau / 7),
            "day": F.to_date("bin"),
        }
    )


def slot_of_day(col="bin"):
    return F.hour(col) * 60 + F.minute(col)


def gapped_series(
    raw: DataFrame, value: str, interval: str, order: str, keys: Sequence[str] = S.ENTITY
) -> DataFrame:
    """Values on a regular grid with gaps as NULL; the first reading of a repeated time wins.

    Readings that do not fall on a grid point are left out. The first reading is
    a ``min_by`` aggregate, combined map-side, not a sort of the raw rows.
    """
    first = raw.groupBy(*keys, F.col("t").alias("bin")).agg(F.min_by(value, order).alias(value))
    return fill_gaps(first.where(F.col("bin") == bin_start(F.col("bin"), interval)), interval, keys)


def sampling_cadence(raw: DataFrame, keys: Sequence[str] = S.ENTITY, chunk: str = "hour") -> DataFrame:
    """Median positive spacing of readings, in minutes (15 when there is none).

    Raw rows of a busy entity never meet in one task: spacings are taken inside
    (entity, hour) chunks, the spacings across chunk borders come from the
    chunks' first and last times, and equal spacings are counted before the
    median is read off the counts.
    """
    times = raw.select(*keys, "t", F.date_trunc(chunk, "t").alias("_chunk")).distinct()
    inner = S.ordered((*keys, "_chunk"), "t")
    gap = F.unix_micros("t") - F.lag(F.unix_micros("t")).over(inner)
    within = times.select(*keys, gap.alias("gap"))
    edges = times.groupBy(*keys, "_chunk").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    across = edges.select(
        *keys, (F.unix_micros("lo") - F.lag(F.unix_micros("hi")).over(S.ordered(keys, "_chunk"))).alias("gap")
    )
    counts = within.unionByName(across).where("gap > 0").groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    medians = counts_median(counts, keys)
    return (
        edges.select(*keys).distinct().join(medians, list(keys), "left")
        .select(*keys, F.coalesce(F.col("median") / 60e6, F.lit(15.0)).alias("cadence_minutes"))
    )




def counts_median(counts: DataFrame, keys: Sequence[str], width: int = 1_000_000) -> DataFrame:
    """Exact median of ``gap`` weighted by ``n`` per key.

    First the one-second cells holding the two middle ranks are found from cell
    totals; only the values in those cells are then sorted.
    """
    cells = counts.withColumn("_cell", F.floor(F.col("gap") / width))
    totals = cells.groupBy(*keys, "_cell").agg(F.sum("n").alias("_n"))
    totals = totals.withColumn("_upto", F.sum("_n").over(S.so_far(keys, "_cell"))).withColumn(
        "_all", F.sum("_n").over(S.whole(keys))
    )
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    before = F.col("_upto") - F.col("_n")
    wanted = totals.where(((lo >= before) & (lo < F.col("_upto"))) | ((hi >= before) & (hi < F.col("_upto")))).select(
        *keys, "_cell", before.alias("_before"), lo.alias("_lo"), hi.alias("_hi")
    )
    inside = cells.join(wanted, [*keys, "_cell"]).withColumn(
        "_to", F.col("_before") + F.sum("n").over(S.so_far((*keys, "_cell"), "gap"))
    ).withColumn("_from", F.col("_to") - F.col("n"))

    def value_at(rank):
        return F.min(F.when((F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_to")), F.col("gap")))

    return inside.groupBy(*keys).agg(((value_at("_lo") + value_at("_hi")) / 2).alias("median"))
