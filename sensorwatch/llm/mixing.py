"""Mix sources to target weights by weighted fair queueing, with DataFrame functions only.

Documents are shuffled within their source by a seeded hash. Each pass of a document gets a
virtual finish time: the source's tokens up to and including it, divided by the source's
target. Ordered by that time over all sources, passes are taken until the budget is full, so
every source runs out close to its own target.

Running totals never gather a source in one task: a source is cut into cells by hash prefix,
cells add up map-side, and only rows of one cell meet in a window. The cut is found the same
way, in slots of virtual time.

Null texts and empty texts have no tokens and are never taken where their source has none;
null sources form one source, ordered last. Ties of shuffle key (repeated rows) fall in any
order among themselves, which leaves the result the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorwatch.llm import common as C
from sensorwatch.operators.stats import running

CELL_ROWS = 8192


def shuffle_key(seed: str, key: str, text: str) -> Column:
    """Seeded shuffle order of a document."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def source_key(source: str) -> Column:
    """Source names that sort by code point with null last."""
    return F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source_key, source_size, documents, target): weights repeat over sources by code point; a target
    stops at ``repeats`` times its source and the rest is shared again by weight."""
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    placed = running(sizes.withColumn("one", F.lit(1)), "source_key", ["one", "source_size"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("upto_one") - 1) % len(weights) + 1).cast("int"))
    placed = placed.select("source_key", "source_size", "documents", weight.alias("weight"), (F.col("all_source_size") * share).alias("budget"))
    placed = placed.withColumn("cap", F.col("source_size") * repeats).withColumn("level", F.col("cap").cast("double") / F.col("weight"))
    placed = C.written(running(placed, "level", ["cap", "weight"]), "sources")
    own = (F.col("budget") - (F.col("upto_cap") - F.col("cap"))) / (F.col("all_weight") - (F.col("upto_weight") - F.col("weight")))
    level = placed.select(F.max(F.when(own <= F.col("level"), own))).first()[0] or 0.0
    return placed.select("source_key", "source_size", "documents", F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _finish(turn: Column | int) -> Column:
    return F.try_divide((F.col("source_size") * turn + F.col("served")).cast("double"), F.col("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix",
          key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, shuffle_key, size, source_size, target, finish (virtual time of its first pass),
    copies (passes taken), taken (tokens taken, repeats counted)."""
    rows = docs.select(F.col(key).alias("doc_id"), shuffle_key(seed, key, text).alias("shuffle_key"), C.count_words(text).alias("size"), source_key(source).alias("source_key"))
    rows = C.written(rows, "sizes")
    targets = C.written(source_targets(rows, weights, share, repeats), "targets")
    most, budget, documents = targets.agg(F.max("documents"), F.sum("target"), F.sum("documents")).first()
    cells, slots = math.ceil((most or 0) / CELL_ROWS) or 1, math.ceil((documents or 0) * repeats / CELL_ROWS) or 1

    cell = F.floor(F.conv(F.substring("shuffle_key", 1, 7), 16, 10).cast("long") * cells / 2**28)
    rows = rows.withColumn("cell", cell)
    sums = rows.groupBy("source_key", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")).join(targets, "source_key")
    inside = Window.partitionBy("source_key", "cell").orderBy("shuffle_key").rowsBetween(Window.unboundedPreceding, 0)
    queue = rows.withColumn("local", F.sum("size").over(inside)).join(sums, ["source_key", "cell"]).withColumn("served", F.col("local") + F.col("offset"))
    queue = C.written(queue.select("doc_id", "shuffle_key", "source_key", "size", "source_size", "target", "served"), "queue")

    slot = lambda finish: F.floor((F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + finish)) * slots)
    passes = queue.where("target > 0").withColumn("turn", F.explode(F.array(*[F.lit(p) for p in range(repeats)])))
    passes = passes.select(_finish(F.col("turn")).alias("finish"), "source_key", "shuffle_key", "size").withColumn("slot", slot(F.col("finish")))
    totals = running(passes.groupBy("slot").agg(F.sum("size").alias("words")), "slot", ["words"])
    edge = totals.where(F.col("upto_words") > F.lit(budget or 0.0)).agg(F.min_by(F.struct("slot", (F.col("upto_words") - F.col("words")).alias("before")), "slot").alias("e")).select("e.*").first()
    order = ["finish", "source_key", "shuffle_key"]
    if edge is None or edge.slot is None:
        taken = lambda turn: F.col("target") > 0
    else:
        line = Window.partitionBy("slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = passes.where(F.col("slot") == edge.slot).withColumn("upto", F.sum("size").over(line) + F.lit(edge.before)).where(F.col("upto") <= F.lit(budget))
        last = last.agg(F.max(F.struct(*order)).alias("m")).select("m.*").first()

        def taken(turn: int) -> Column:
            at = slot(_finish(turn))
            if last.finish is None:
                return (F.col("target") > 0) & (at < edge.slot)
            return (F.col("target") > 0) & ((at < edge.slot) | ((at == edge.slot) & (F.struct(_finish(turn), "source_key", "shuffle_key") <= F.struct(*[F.lit(last[c]) for c in order]))))

    copies = sum((F.coalesce(taken(p), F.lit(False)).cast("int") for p in range(repeats)), F.lit(0))
    out = queue.withColumn("copies", copies).withColumn("finish", F.when(F.col("target") > 0, _finish(0)))
    return out.select("doc_id", "shuffle_key", "size", "source_size", "target", "source_key", "finish", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix",
            key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents the mix takes, whole, as often as it takes them, range-sorted by virtual finish time. Columns as before.

    Rows that agree in id, text and source are one document here, given out as often as all of them are taken.
    """
    plan = mixed(docs, weights, share, repeats, seed, key, text, source)
    plan = plan.groupBy("shuffle_key", "source_key").agg(F.sum("copies").cast("int").alias("_copies"), F.min("finish").alias("finish")).where("_copies > 0")
    keyed = docs.select(F.struct(*docs.columns).alias("document"), shuffle_key(seed, key, text).alias("shuffle_key"), source_key(source).alias("source_key"))
    rest = [F.col(f"document.`{c}`") for c, t in docs.dtypes if c not in (key, text, source) and not t.startswith("map")]
    one = Window.partitionBy("shuffle_key", "source_key").orderBy(*(rest or [F.lit(0)]))
    keyed = keyed.withColumn("place", F.row_number().over(one)).where("place = 1")
    taken = keyed.join(plan, ["shuffle_key", "source_key"]).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return in_mix_order(taken).select("document.*")


def in_mix_order(rows: DataFrame) -> DataFrame:
    """The rows range-sorted by virtual finish time over the whole table."""
    return rows.repartitionByRange(F.asc_nulls_last("finish"), F.asc("shuffle_key")).sortWithinPartitions(F.asc_nulls_last("finish"), "shuffle_key")
