"""Passes over whole series against Spark's own windows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorwatch.functions import blocks as B
from sensorwatch.functions import series as S
from sensorwatch.operators import adjust as A
from sensorwatch.operators import baseline as BL
from sensorwatch.operators import fusion as FU
from sensorwatch.operators import grid as G
from sensorwatch.operators import hypo as H


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = random.Random(5), []
    for k, n in enumerate((1, 3, 50, 90, 47)):
        for i in range(n):
            missing = rng.random() < 0.1
            v = [None if missing else float(rng.randint(0, 40)) for _ in range(5)]
            rows.append((None if k == 4 else f"e{k}", datetime(2024, 1, 1) + timedelta(hours=4 * i), float(rng.choice([0, 0, 3, 5, 8])), *v))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "entity string, bin timestamp, n_raw_samples double, " + ", ".join(f"{s}_sum double" for s in H.SIGNALS))
    return df.repartition(3)


@pytest.fixture
def short_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select("entity", "bin", *cols).collect()), key=repr)


def test_totals_and_medians_equal_windows(table, short_batches):
    def fn(b, given):
        v = b.known(given["x"])
        median = B.Slots(b, given["slot"][0]).median(v)
        return {"t": B.total(v, 6, 4), "m": B.Known(B.percentile(v).x + 0 * v.x, B.percentile(v).ok & b.there), "s": median, "lagged": B.lag(v, 2)}

    told = B.series_pass(table, ["entity"], {"x": F.col("steps_sum"), "slot": F.hour("bin") * 60}, "t double, m double, s double, lagged double", fn)
    plain = table.withColumns({
        "t": S.rolling_total(F.col("steps_sum"), 6), "m": S.median_where(None, F.col("steps_sum"), S.whole()),
        "s": S.median_where(None, F.col("steps_sum"), S.whole(("entity", F.hour("bin")))), "lagged": F.lag("steps_sum", 2).over(S.ordered()),
    })
    assert rows(told, "t", "m", "s", "lagged") == rows(plain, "t", "m", "s", "lagged")


def test_coverage_and_split_equal_windows(table, short_batches):
    cols = ("expected_raw_per_bin", "coverage_pct", "pos", "train_candidate", "dataset_split", "train_point")
    assert rows(BL.coverage_and_split(table), *cols) == rows(BL.add_split(G.add_coverage(table)), *cols)


def test_branch_equals_windows(table, short_batches):
    """The pass gives what the windows of the SQL form (still used by sweeps) give."""
    df = BL.add_split(G.add_coverage(table.fillna(0.0)))
    masked = BL.add_reference_masks(df, only_if_missing=False)
    cfg = H.HypoConfig(score_threshold=0.01, min_families=1, cusum_threshold=0.1, coverage_min_pct=1.0)
    plain = H.add_drop_alerts(H.add_drop_changes(masked, "4H", [H.bins(cfg.aggregation_hours, "4H", 4)]), "4H", cfg)
    cols = [c for c in H.hypo_branch(df, "4H", cfg).columns if c.startswith(("warning_", "behavioral_"))]
    got, want = rows(H.hypo_branch(df, "4H", cfg), *cols), rows(plain, *cols)
    assert got == want and any(r[cols.index("behavioral_warning_start") + 2] for r in got)


def test_one_window_serves_both_branches(table):
    """A window operator copies and sorts its rows anew; both branches with their fusion took fifteen."""
    plan = FU.hybrid_warning(BL.add_split(G.add_coverage(table)).localCheckpoint(), "4H")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 1
    wanted = ["hybrid_warning_episode", "hybrid_warning_type"]
    assert FU.hybrid_warning(BL.add_split(G.add_coverage(table)), "4H", only=wanted).columns[-2:] == wanted


def test_areas_need_no_window_over_repeated_series(spark):
    grid = spark.range(40).select(F.lit("a").alias("entity"), F.col("id").cast("int").alias("pos"), *[F.lit(10.0).alias(f"{s}_sum") for s in H.SIGNALS], F.lit(1.0).alias("n_raw_samples"))
    grid = grid.withColumn("bin", F.timestamp_seconds(F.col("pos") * 14400))
    span = spark.createDataFrame([("a", 40, datetime(1970, 1, 1), 5, True)], "entity string, n_bins int, first_bin timestamp, future_pos int, eligible boolean")
    out = A.apply_plan(grid, A.fractional_plan(span, A.STRESS, "4H", (0.5,)), "4H")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    dose = {r["scenario"]: r["dose"] for r in out.groupBy("scenario").agg(F.sum(F.col("env_steps") * F.col("kept")).alias("dose")).collect()}
    assert len(dose) == len(A.STRESS) and max(dose.values()) == pytest.approx(min(dose.values()))
