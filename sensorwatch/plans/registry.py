"""Named queries and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorwatch.sources.readings import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SHARED: dict[tuple, DataFrame] = {}


def query(name: str):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn

    return register


def shared(name: str):
    """Build a table once per session and data directory and keep it as parquet.

    Interval tables and campaigns feed many reports. Written to the cluster's
    shared folder they survive lost executors, cut the plan short, and let every
    report read only its columns.
    """

    def wrap(build):
        def get(spark: SparkSession, data_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, data_dir, name)
            if key not in _SHARED:
                path = scratch(spark, name)
                build(spark, data_dir).write.parquet(path)
                _SHARED[key] = spark.read.parquet(path)
            return _SHARED[key]

        get.uncached = build
        return get

    return wrap
