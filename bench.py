"""Headline timings: prints one JSON line.

Every query runs once on the smallest data set first (starts the JVM's workers
and compiles), then is timed on ``BENCH_SF_DIR`` from building the plan to the last row (better of two runs).
Stage inputs that a stage does not own (features for the rules, the interval
table for the branches) are written once, outside the timing.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="bench-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stages(spark: SparkSession, d: str) -> dict:
    from sensorwatch.config import WatchConfig
    from sensorwatch.operators import features as FE
    from sensorwatch.operators import fusion as FU
    from sensorwatch.operators import grid as G
    from sensorwatch.operators import models as M
    from sensorwatch.operators import report as RP
    from sensorwatch.operators import rules as R
    from sensorwatch.pipeline import run_herd
    from sensorwatch.plans import QUERIES
    from sensorwatch.plans import tables as T
    from sensorwatch.sources.tables import event_readings

    readings = event_readings(spark, d)
    interval, features = T.interval_table(spark, d), T.feature_table(spark, d)
    scored = T.robust_distance_score(features)
    cols = [f"{s}_sum" for s in ("steps", "motion", "lying", "standing", "transitions")]

    def herd():
        table = T.interval_table.uncached(spark, d)
        return RP.rank_entities(RP.entity_summary(FU.hybrid_warning(table, T.INTERVAL)))

    return {
        "regular_grid_15min": lambda: G.regular_grid(readings, "15T"),
        "interval_features": lambda: FE.interval_features(readings, T.INTERVAL),
        "comparator_rules": lambda: R.apply_rules(scored, T.INTERVAL),
        "branches_and_fusion": lambda: FU.hybrid_warning(interval, T.INTERVAL),
        "isolation_forest_800": lambda: M.isolation_scores(interval, cols, n_trees=800),
        "herd_alerts_end_to_end": herd,
        "run_herd_800_trees": lambda: run_herd(readings, WatchConfig(interval=T.INTERVAL))[0],
        "clustered_bootstrap": lambda: QUERIES["x03_clustered_bootstrap"](spark, d),
        "table_diff": lambda: QUERIES["x20_tolerant_table_diff"](spark, d),
    }


def timed(build) -> float:
    t0 = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    target = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warm = os.path.join(os.path.dirname(target.rstrip("/")), "sf0.001")
    spark = session()
    for build in stages(spark, warm if os.path.isdir(warm) else target).values():
        timed(build)
    seconds = {name: round(min(timed(build), timed(build)), 3) for name, build in stages(spark, target).items()}
    sf = os.path.basename(target.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
