"""The corpus pipeline: toxic documents go, near-duplicates are dropped, live secrets are
redacted, sources are mixed to target weights, and what is left is tokenised.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Each stage's rows are written as Parquet and read again as the next
one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorwatch.llm import bpe, common, mixing, neardup, secrets, toxicity
from sensorwatch.llm.queries import remainder, vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold of their language stay."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), remainder(5) != 0)
    score = common.fresh(docs, "toxic_score")  # input columns of any name are kept as they are
    return toxicity.scored(docs, model, score, common.fresh(docs, "language")).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 stays."""
    return neardup.deduplicated(docs, neardup.NearDup(shingle=5, percent=80))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific credentials are replaced in the text; every document stays."""
    rows = secrets.redacted(docs)
    return rows.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else rows


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the weighted mix, repeated where their source's target asks for it."""
    return mixing.mixture(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian 32-bit), their number, and whether they decode to the text."""
    rows = bpe.tokenised(docs, vocabulary())
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]

# The classifier, the redaction and the tokens have no SQL form; tests check the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
