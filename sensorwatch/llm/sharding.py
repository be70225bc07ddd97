"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into buckets that fit a task's memory, by a seeded hash of
id and text. Repeated rows differ in nothing but how often a task has seen them, and that
number salts their hash, so copies of one row spread over all buckets as well. Pass two
shuffles each bucket by Fisher-Yates, seeded by the bucket, and writes it. Buckets in order
are one random permutation of the table; its positions are dealt to the shards in turn, so
shard sizes in rows differ by one at most and slots have no gaps.

Null ids and null texts are hashed as such; an empty table gives no rows. Input columns named
``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from sensorwatch.llm import common as C


def repeats(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """0 for the first row of a hash in this task; for the n-th repetition a number made of the task and n."""
    seen: dict[int, int] = {}
    task = (TaskContext.get().partitionId() + 1) << 32
    for batch in hashes:
        out = np.zeros(len(batch), np.int64)
        for i, h in enumerate(batch.tolist()):
            n = seen.get(h, 0)
            seen[h] = n + 1
            if n:
                out[i] = task + n
        yield pd.Series(out)


def fisher_yates(n: int, seed: int, bucket: int) -> list[int]:
    """A uniform permutation of 0 .. n-1."""
    order = list(range(n))
    draws = np.random.default_rng([seed, bucket]).random(max(n - 1, 0))
    for i, u in zip(range(n - 1, 0, -1), draws.tolist(), strict=True):
        j = int(u * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(docs: DataFrame, seed: int = 17, bucket_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(document, bucket, place): every record once, in a random place of a random bucket."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 64)).first()[0] or 0
    buckets = -(-total // bucket_bytes) or 1
    rows = docs.select(F.struct(*docs.columns).alias("document"), F.xxhash64(key, text).alias("content"))
    rows = rows.withColumn("scatter", F.xxhash64(F.lit(seed), "content", F.pandas_udf(repeats, LongType())("content")))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("scatter", 16), F.lit(buckets)))
    schema = StructType(list(rows.select("document", "bucket").schema.fields)).add("place", LongType())

    def shuffle(bucket: pa.Table) -> pa.Table:
        number = bucket.column("bucket")[0].as_py()
        order = np.lexsort([bucket.column("content").to_numpy(), bucket.column("scatter").to_numpy()])
        order = order[fisher_yates(len(order), seed, number)]
        out = bucket.select(["document", "bucket"]).take(pa.array(order))
        return out.append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))

    return C.written(rows.groupBy("bucket").applyInArrow(shuffle, schema), "shuffled")


def bucket_offsets(shuffled: DataFrame, wide: int = 4096) -> DataFrame:
    """(bucket, offset): records in the buckets before, summed over groups of ``wide`` buckets first."""
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("bucket") / wide))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("all"))
    before = blocks.select("block", F.coalesce(F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("inside", inside).join(before, "block").select("bucket", (F.col("base") + F.col("inside")).alias("offset"))


def dealt(shuffled: DataFrame, shards: int) -> DataFrame:
    """Adds shard and slot to (bucket, place, ...) rows."""
    rows = shuffled.join(bucket_offsets(shuffled), "bucket").withColumn("position", F.col("offset") + F.col("place"))
    return rows.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("position") / shards)).drop("bucket", "place", "offset", "position")


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text") -> None:
    """Write the shuffled records as ``path/shard=<n>``, each file in slot order."""
    rows = dealt(external_shuffle(docs, seed, bucket_bytes, key, text), shards)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows.select(*[F.col(f"document.{c}").alias(c) for c in names], "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
