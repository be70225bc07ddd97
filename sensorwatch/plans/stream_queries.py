"""Registered queries: the streaming operators, run over the stored feed until it is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorwatch.config import SIGNALS, interval_minutes
from sensorwatch.functions.scalars import attach
from sensorwatch.plans import tables as T
from sensorwatch.plans.output import tidy
from sensorwatch.plans.registry import query
from sensorwatch.sources.readings import scratch, stored
from sensorwatch.sources.tables import event_readings
from sensorwatch.streaming import alerts as ST


def drained(spark, stream, name):
    """Run a stream over everything available, keep it in the shared folder, and read it back."""
    out = scratch(spark, name)
    q = stream.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out)


def as_stream(spark, df, name):
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def closing(df, col):
    """The feed plus one empty reading far ahead, so the watermark closes every real window."""
    end = df.agg((F.max(col) + F.expr("INTERVAL 40 DAYS")).alias(col))
    return df.unionByName(end.withColumn("entity", F.lit("~")), allowMissingColumns=True)


@query("st01_interval_stream")
def _(spark, d):
    feed = as_stream(spark, closing(event_readings(spark, d).drop("seq"), "t"), "feed")
    out = drained(spark, ST.interval_stream(feed, T.INTERVAL), "intervals").where("entity <> '~'")
    return tidy(out, "entity", "bin", "n_raw_samples", *[f"{s}_sum" for s in SIGNALS])


def scored(spark, feed, history, name, **settings):
    ST.use_typed_state(spark)
    return drained(spark, ST.score_stream(feed, stored(ST.frozen_reference(history, T.INTERVAL), "reference"), T.INTERVAL, **settings), name)


BINS = ["entity", "bin", "n_raw_samples", "live", *[f"{s}_sum" for s in SIGNALS]]


def live_bins(spark, d):
    return T.interval_table(spark, d).withColumn("live", (F.col("dataset_split") == "futur").cast("int"))


@query("st02_stateful_scorer")
def _(spark, d):
    df = live_bins(spark, d)
    feed = as_stream(spark, df.select(*BINS), "bins")
    return tidy(scored(spark, feed, df, "scores", late="40 days").where("late = 0").drop("late"))


@query("st02_scorer_with_holes")
def _(spark, d):
    """Only bins with readings, in several micro-batches, the first one sent twice; silent bins must score as in the batch run."""
    df = live_bins(spark, d)
    rows = df.where("n_raw_samples > 0").select(*BINS)
    path = scratch(spark, "holes")
    for low, high in ((0, 8), (8, 17), (17, 32), (0, 8)):
        rows.where(F.dayofmonth("bin").between(low + 1, high)).coalesce(1).write.mode("append").parquet(path)
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scored(spark, feed, df, "scores", late="40 days")
    late = out.groupBy("entity").agg(F.sum("late").alias("late_rows"))
    return tidy(out.where("late = 0").drop("late").join(late, "entity"))


def silent_to_the_end(df, days: int):
    """The grid of every entity prolonged by bins without readings, to ``days`` days after the newest bin of all."""
    end = df.agg(F.max("bin").alias("newest"))
    last = df.groupBy("entity").agg(F.max("bin").alias("bin"), F.max("pos").alias("pos"), F.first("expected_raw_per_bin").alias("expected_raw_per_bin"))
    step = F.expr(f"INTERVAL {interval_minutes(T.INTERVAL)} MINUTES")
    more = attach(last, end).withColumn("k", F.explode(F.sequence(F.col("bin") + step, F.col("newest") + F.expr(f"INTERVAL {days} DAYS"), step))).drop("bin", "newest").withColumnRenamed("k", "bin")
    zero = [F.lit(0.0).alias(c) for c in ("n_raw_samples", "coverage_pct", *[f"{s}_sum" for s in SIGNALS])]
    return df.unionByName(more.select("entity", "bin", "expected_raw_per_bin", F.lit("futur").alias("dataset_split"), F.lit(1).alias("live"), *zero), allowMissingColumns=True).drop("pos")


@query("st02_silent_for_good")
def _(spark, d):
    """Every entity falls silent for good; timers score its silent bins, for ten days, without any new row of its own."""
    df = live_bins(spark, d)
    rows = df.where("n_raw_samples > 0").select(*BINS)
    path = scratch(spark, "silent")
    for low, high in ((0, 12), (12, 32)):
        rows.where(F.dayofmonth("bin").between(low + 1, high)).coalesce(1).write.mode("append").parquet(path)
    clock = df.agg((F.max("bin") + F.expr("INTERVAL 11 DAYS")).alias("bin"), F.lit("~").alias("entity"))  # another entity moves the watermark
    clock.unionByName(rows.limit(0), allowMissingColumns=True).select(*BINS).coalesce(1).write.mode("append").parquet(path)
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scored(spark, feed, silent_to_the_end(df, 10), "silent_scores", late="1 day")
    return tidy(out.where("entity <> '~'").drop("late"))


@query("st03_sliding_windows")
def _(spark, d):
    feed = as_stream(spark, closing(event_readings(spark, d).select("entity", "t", "steps"), "t"), "feed")
    out = drained(spark, ST.sliding_totals(feed, "steps", "12 hours", "4 hours"), "sliding").where("entity <> '~'")
    return tidy(out, "entity", "start", "end", "steps_total")


@query("st03_episode_sessions")
def _(spark, d):
    p = T.branch_predictions(spark, d).where("behavioral_warning_episode = 1").select("entity", "bin")
    return tidy(drained(spark, ST.episode_sessions(as_stream(spark, closing(p, "bin"), "alerts"), "24 hours"), "sessions").where("entity <> '~'"))
