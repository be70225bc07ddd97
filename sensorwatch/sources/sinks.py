"""Writing results, resuming finished runs, fingerprints and comparison of tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, by: Sequence[str] = ("entity",), fmt: str = "parquet") -> str:
    """Partitioned result table; rows of one partition value may come from many tasks."""
    df.write.mode("overwrite").partitionBy(*by).format(fmt).save(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    return path


def append_run(df: DataFrame, path: str, run_id: str) -> str:
    """Add one run's rows to a growing table."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return path


def run_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def config_hash(*cols: str) -> Column:
    """Run key of a configuration row: sha-256 of its JSON."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def pending(planned: DataFrame, finished: DataFrame, key: str = "run_id") -> DataFrame:
    """Planned runs without a finished one."""
    return planned.join(finished.select(key).distinct(), key, "left_anti")


def latest_complete(manifest: DataFrame, needed: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Newest run per group that has every needed artefact.

    ``manifest`` has (run_id, completed_at, artefact); one count of distinct
    needed artefacts per run decides completeness.
    """
    runs = manifest.groupBy(*by, "run_id").agg(
        F.max("completed_at").alias("completed_at"),
        F.size(F.collect_set(F.when(F.col("artefact").isin(list(needed)), F.col("artefact")))).alias("_have"),
    )
    done = runs.where(F.col("_have") == len(set(needed)))
    return done.groupBy(*by).agg(
        F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id"), F.max("completed_at").alias("completed_at")
    )


def fingerprint(df: DataFrame, name: str, entity: str = "entity") -> DataFrame:
    """Order-insensitive content hash, row count and number of entities."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in df.columns])
    return df.agg(
        F.lit(name).alias("table"),
        F.sum(row.cast("decimal(38,0)")).cast("string").alias("content_hash"),
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(entity).alias("n_entities"),
    )


def compare_fingerprints(sealed: DataFrame, current: DataFrame) -> DataFrame:
    """Status per table: same, changed, missing or extra."""
    a = sealed.select("table", F.col("content_hash").alias("_a"))
    b = current.select("table", F.col("content_hash").alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra")
        .when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    )
    return a.join(b, "table", "full_outer").select("table", status.alias("status"))


def union_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, duplicates counted (empty when the tables are equal)."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def bootstrap_session(app: str = "sensorwatch") -> SparkSession:
    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").getOrCreate()
