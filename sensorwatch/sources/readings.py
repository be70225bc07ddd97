"""Reading sensor tables of varying shape into one fixed schema."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorwatch.config import COUNT_SIGNALS, DURATION_SIGNALS, SIGNALS

# Accepted column names, the first match wins.
SYNONYMS = {
    "entity": ["Cow", "cow", "ID", "Id", "Animal", "animal", "Cow ID", "cow_id", "cowid"],
    "t": ["T", "t", "Time", "time", "Start", "start", "Timestamp", "DateTime", "Datetime", "date", "Date"],
    "steps": ["Steps", "steps", "Step", "step", "Steps Count", "Step Count"],
    "motion": ["Motion Index", "MotionIndex", "MI", "mi", "Motion index", "Motion_Index"],
    "lying": ["Lying Time", "LyingTime", "Lying Time (s)", "Lying time", "lying time", "Lying (s)"],
    "standing": ["Standing Time", "StandingTime", "Standing Time (s)", "Standing time", "standing time", "Standing (s)"],
    "tr_up": ["Transitions Up", "TransitionsUp", "Transitions_up", "Trans Up", "Up", "Up Transitions"],
    "tr_down": ["Transitions Down", "TransitionsDown", "Transitions_down", "Trans Down", "Down", "Down Transitions"],
    "transitions": ["Transitions", "Transition", "transitions", "Transitions total", "Total Transitions"],
}


def canonical_names(columns: Iterable[str]) -> dict[str, str]:
    """Found name -> canonical name; a canonical name already present stays."""
    have = list(columns)
    out = {}
    for name, accepted in SYNONYMS.items():
        hit = name if name in have else next((c for c in accepted if c in have), None)
        if hit is not None:
            out[hit] = name
    return out


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; have {df.columns[:40]}")
    return df


def duration_minutes(col: Column) -> Column:
    """A number stays as it is; ``H:MM:SS`` and ``MM:SS`` become minutes; anything else is missing."""
    text = F.trim(col.cast("string"))
    parts = F.split(text, ":")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return F.coalesce(
        text.try_cast("double"),
        F.when(F.size(parts) == 3, part(0) * 60.0 + part(1) + part(2) / 60.0).when(
            F.size(parts) == 2, part(0) + part(1) / 60.0
        ),
    )


def number(col: Column) -> Column:
    x = col.cast("string").try_cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def clean_id(col: Column) -> Column:
    return F.trim(F.replace(col.cast("string"), F.lit(".0"), F.lit("")))


def normalise(df: DataFrame) -> DataFrame:
    """Canonical names, parsed times (bad ones dropped), numeric non-negative signals."""
    df = df.withColumnsRenamed(canonical_names(df.columns))
    require_columns(df, "entity", "t")
    cols = {"entity": F.col("entity").cast("string")}
    if dict(df.dtypes)["t"] == "string":
        cols["t"] = F.try_to_timestamp("t")
    for s in DURATION_SIGNALS:
        if s in df.columns:
            cols[s] = duration_minutes(F.col(s))
    for s in COUNT_SIGNALS:
        if s in df.columns:
            cols[s] = number(F.col(s))
    df = df.withColumns(cols).where(F.col("t").isNotNull())
    if "transitions" in df.columns:
        df = df.withColumn("transitions", F.coalesce("transitions", F.lit(0.0)))
    elif {"tr_up", "tr_down"} <= set(df.columns):
        df = df.withColumn("transitions", F.coalesce("tr_up", F.lit(0.0)) + F.coalesce("tr_down", F.lit(0.0)))
    signals = [s for s in (*COUNT_SIGNALS, *DURATION_SIGNALS) if s in df.columns]
    return df.withColumns({s: F.when(F.col(s) < 0, F.lit(0.0)).otherwise(F.col(s)) for s in signals})


def available_signals(df: DataFrame) -> list[str]:
    return [s for s in SIGNALS if s in df.columns]


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).csv(path)


def read_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Nested JSON documents: one per file, or one per line (files then split between tasks)."""
    return spark.read.option("multiLine", not one_per_line).json(path)


def load_readings(spark: SparkSession, path: str, uploaded: str | None = None) -> DataFrame:
    """Normalised readings from CSV or parquet; an uploaded table replaces the built-in one."""
    path = uploaded or path
    return normalise(spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_delimited(spark, path))


def shape_of(df: DataFrame) -> str:
    """``predictions`` or ``raw``, decided by the columns; anything else is an error."""
    names = set(canonical_names(df.columns).values()) | set(df.columns)
    if {"entity", "if_anomaly_point"} <= names and names & {"t", "bin"}:
        return "predictions"
    if {"entity", "t"} <= names and names & {*COUNT_SIGNALS, *DURATION_SIGNALS}:
        return "raw"
    raise ValueError(f"neither raw readings nor predictions: {df.columns[:40]}")


def first_entities(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` entities in name order."""
    keep = df.select("entity").distinct().orderBy("entity").limit(n)
    return df.join(keep, "entity", "left_semi")


def between_days(df: DataFrame, first: str, last: str, col: str = "t") -> DataFrame:
    return df.where(F.to_date(col).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the smallest ``order``. An aggregate, so it combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, the smallest on ties; counted per (key, value) first."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    top = Window.partitionBy(key).orderBy(F.desc("_n"), F.asc(value))
    return n.withColumn("_r", F.row_number().over(top)).where("_r = 1").drop("_r", "_n")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Unset, a temporary folder serves a session whose executors are threads of the
    driver; on a cluster that would split the data over machines, so it is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sensorwatch-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: they are computed once and survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
