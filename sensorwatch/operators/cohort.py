"""Entity cohorts against external labels, and comparison of sources and claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorwatch.functions.scalars import attach

# Fixed values of the admission rules.
WINDOW_DAYS, MIN_BASELINE_DAYS, MIN_COVERAGE = 7, 20, 0.70


def admission(raw: DataFrame, score_time: str, bins_per_day: int, min_days: float = MIN_BASELINE_DAYS, coverage: float = MIN_COVERAGE) -> DataFrame:
    """Per entity: reference length and coverage before the score time, and why it is left out."""
    at = F.lit(score_time).cast("timestamp")
    start = F.lit(score_time).cast("timestamp") - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")
    g = raw.where(F.col("t") < at).groupBy("entity").agg(
        F.min("t").alias("first_time"), F.max("t").alias("last_time"), F.count(F.when(F.col("t") >= start, 1)).alias("_n")
    )
    g = g.withColumns(
        {
            "baseline_days": (F.unix_timestamp(start) - F.unix_timestamp("first_time")) / 86400.0,
            "primary_coverage": F.col("_n") / float(WINDOW_DAYS * bins_per_day),
        }
    ).drop("_n")
    why = F.concat_ws(
        ";",
        F.when(F.col("baseline_days") < min_days, "baseline_trop_courte"),
        F.when(F.col("primary_coverage") < coverage, "couverture_pre7_insuffisante"),
    )
    return g.withColumn("exclusion_reason", why)


def window_features(pred: DataFrame, score_time: str, bins_per_day: int) -> DataFrame:
    """Alert features of the week before the score time, one conditional aggregation."""
    at = F.lit(score_time).cast("timestamp")
    inside = (F.col("bin") >= at - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")) & (F.col("bin") < at)
    win = lambda c: F.when(inside, F.col(c))
    future = F.col("dataset_split") == "futur"
    days = F.greatest(F.lit(1.0 / bins_per_day), F.count(F.when(future, 1)) / float(bins_per_day))
    return pred.where(F.col("bin") < at).groupBy("entity").agg(
        F.sum(win("hybrid_warning_notification")).alias("pre7_hybrid_notifs"),
        F.avg(win("hybrid_warning_episode")).alias("pre7_hybrid_frac_time"),
        F.max(win("hybrid_warning_score")).alias("pre7_hybrid_score_max"),
        F.avg(win("hybrid_warning_surveillance")).alias("pre7_instability_surveillance_frac"),
        F.sum(win("behavioral_warning_notification")).alias("pre7_hypo_notifs"),
        F.sum(win("instability_warning_notification")).alias("pre7_instability_notifs"),
        (F.sum(F.when(future, F.col("hybrid_warning_notification"))) / days).alias("future_hybrid_notif_per_cow_day"),
    )


def with_labels(cohort: DataFrame, labels: DataFrame, key: str, label: str, reason: str) -> DataFrame:
    """Left join of labels; entities without one carry an exclusion reason."""
    out = cohort.join(labels, key, "left")
    return out.withColumn("exclusion_reason", F.when(F.col(label).isNull(), F.lit(reason)))


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that refuses repeated keys on either side, checked in the join's own plan.

    A repeated key that the other side lacks is refused as well: both sides are counted before they meet.
    """
    same = Window.partitionBy(*keys)
    refuse = F.raise_error(F.lit(f"keys {list(keys)} are not unique"))

    def once(side: DataFrame) -> DataFrame:
        counted = side.withColumn("_times", F.count(F.lit(1)).over(same))
        return counted.where(F.when(F.col("_times") > 1, refuse.cast("boolean")).otherwise(F.lit(True))).drop("_times")

    return once(a).join(once(b), list(keys))


def agreement(pairs: DataFrame, columns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Correlation and share of identical values of paired columns (name, left, right), as rows."""
    aggs = []
    for name, a, b in columns:
        x, y = F.col(a), F.col(b)
        known = x.isNotNull() & y.isNotNull()
        aggs.append(
            F.struct(
                F.lit(name).alias("variable"), F.count(F.when(known, 1)).alias("n"), F.corr(x, y).alias("correlation"),
                (F.avg((x == y).cast("double")) * 100.0).alias("pct_identical"),
            ).alias(f"_{name}")
        )
    row = pairs.agg(*aggs)
    return row.select(F.explode(F.array(*[F.col(f"_{n}") for n, _, _ in columns])).alias("r")).select("r.*")


def check_claims(values: DataFrame, claims: DataFrame) -> DataFrame:
    """Claimed numbers against computed ones: (name, value) with (name, claimed, tolerance)."""
    j = claims.join(values, "name", "left")
    return j.withColumn("ok", F.coalesce((F.abs(F.col("value") - F.col("claimed")) <= F.col("tolerance")).cast("int"), F.lit(0)))


def validate_components(sheet: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """Binary components per unit: conflicts, invalid values, and the total score."""
    g = sheet.groupBy(key).agg(
        *[F.max(p).alias(p) for p in parts],
        *[(F.countDistinct(p) > 1).cast("int").alias(f"_c_{p}") for p in parts],
        F.count_if(~F.coalesce(F.expr(" and ".join(f"{p} in (0, 1)" for p in parts)), F.lit(False))).alias("n_invalid"),
    )
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    clash = sum((F.col(f"_c_{p}") for p in parts[1:]), F.col(f"_c_{parts[0]}"))
    return g.withColumns({"conflicts": clash, "score": total}).drop(*[f"_c_{p}" for p in parts])


def timing_stats(runs: DataFrame, by: Sequence[str], seconds: str, rows: str) -> DataFrame:
    """Repeated timings per setting, cost per 1000 rows, and ratios to the full run."""
    g = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("repeats"), F.max(rows).alias("n_rows"), F.avg(seconds).alias("mean"),
        F.percentile(seconds, F.lit(0.5)).alias("median"), F.stddev_pop(seconds).alias("std"), F.min(seconds).alias("min"), F.max(seconds).alias("max"),
    )
    full = g.agg(F.max_by(F.struct("n_rows", "median"), F.struct("n_rows", *by)).alias("_f"))
    return attach(g, full).withColumns(
        {
            "seconds_per_1000_rows": F.col("median") / F.greatest(F.col("n_rows"), F.lit(1)) * 1000.0,
            "rows_ratio_vs_full": F.col("n_rows") / F.col("_f.n_rows"),
            "time_ratio_vs_full": F.col("median") / F.nullif("_f.median", F.lit(0.0)),
        }
    ).drop("_f")


def cumulative_share(df: DataFrame, weight: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Running share of a total, largest first (name settles ties)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(weight), name)
    total = F.sum(weight).over(Window.partitionBy(*keys))
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("cumulative_share", upto / F.nullif(total, F.lit(0.0)))


def position_of_time(grid: DataFrame, times: DataFrame, key: str = "entity") -> DataFrame:
    """Position of the first row at or after a time, per entity."""
    return grid.join(times, key).groupBy(key).agg(F.min(F.when(F.col("bin") >= F.col("at"), F.col("pos"))).alias("pos"))
