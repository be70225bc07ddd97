"""Tables of a data directory, and the event log seen as sensor readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How the event log plays the part of a sensor feed.
SIGNAL_OF_EVENT = {
    "click": "steps",
    "view": "motion",
    "signup": "transitions",
    "purchase": "lying",
    "error": "standing",
}
USERS_PER_ENTITY = 8


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def event_readings(spark: SparkSession, data_dir: str) -> DataFrame:
    """Readings ``(entity, t, seq, steps, motion, lying, standing, transitions)`` from ``events``.

    Each run of eight user ids is one entity, so the number of entities grows
    with the data; an event's value goes to the signal of its type. Times carry
    no zone, so the session reads them as UTC.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = table(spark, data_dir, "events")
    signal = {s: F.when(F.col("event_type") == e, F.col("value")) for e, s in SIGNAL_OF_EVENT.items()}
    signal["transitions"] = F.coalesce(signal["transitions"], F.lit(0.0))
    return ev.select(
        F.floor(F.col("user_id") / USERS_PER_ENTITY).cast("string").alias("entity"),
        F.col("ts").cast("timestamp").alias("t"),
        F.col("event_id").alias("seq"),
        *[signal[s].alias(s) for s in ("steps", "motion", "lying", "standing", "transitions")],
    )
