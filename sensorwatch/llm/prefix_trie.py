"""Conversation prefix trie, built as a burst trie.

A turn is the MD5 of its role and text; a conversation is the chain of its turns. Every distinct
chain of first turns is a node, and a conversation is a member of each node it starts with. Such
shared prefixes are computed once by a trainer or server that packs conversations along the trie.

The root is burst from the start: each first turn heads a container of suffixes. A container of more
than ``most`` suffixes bursts: the turns its suffixes all share become a chain of single-child
nodes, and the next turn deals the suffixes to new containers below it. What remains is sorted by chain and
swept with a stack, so a task holds one open branch and its pending children, never a container.
Bursting ends when no container is too large or all its suffixes are equal. Then heads are put
together from the containers below them, deepest first; only one row per container takes part.

Conversations with equal chains meet as joined lists of ids per range of 4,096 ids, and the digest
of a node's own ids runs over those lists in order, so a chain that a third of all conversations
share is a few rows. A conversation is one row of 40 bytes a turn; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorwatch.llm import common as C

TURN = 16  # bytes of a turn in a path
NONE = sha256(b"").hexdigest()
SWEPT = (
    "level int, burst binary, kind int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
INNER, TOP, ENDED = 0, 1, 2


def sequences(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of ``id`` (hex digest) and ``size`` (UTF-8 bytes of the text).

    Turns come by number, null first, equal numbers by digest; repeated rows are repeated turns. A
    null role or text is empty. Rows without a conversation id take no part.
    """
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"))
    turns = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("place"), digest.alias("id"), F.octet_length(what).cast("long").alias("size")).alias("turn"))
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"], t["size"])).alias("turns"))


def _container(depth: Column) -> Column:
    """Name of the container below the head of a depth: the head's turns and the next one, if the path goes on."""
    return F.unhex(F.md5(F.concat(depth.cast("string").cast("binary"), F.lit(":").cast("binary"), F.substring("path", F.lit(1), ((depth + 1) * TURN).cast("int")))))


def _suffixes(seqs: DataFrame) -> DataFrame:
    """Equal chains by range of ids: path, sizes, least id, number and joined list of ids; all below the root."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = seqs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"), F.shiftright("conv_id", 12).alias("cell"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    rows = rows.groupBy("path", "cell").agg(F.first("sizes").alias("sizes"), F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), ids.alias("ids"))
    return rows.select(F.lit(0).alias("level"), F.lit(b"").alias("burst"), F.lit(0).cast("long").alias("depth"), _container(F.lit(0)).alias("container"), *rows.columns)


def _shared_turns(low: Column, high: Column) -> Column:
    """Turns at the start of both paths."""
    part = lambda x, i: F.substring(x, (i * TURN + 1).cast("int"), F.lit(TURN))
    both = (F.least(F.octet_length(low), F.octet_length(high)) / TURN).cast("long")
    differ = F.filter(F.sequence(F.lit(0).cast("long"), both), lambda i: (i < both) & (part(low, i) != part(high, i)))
    return F.coalesce(F.get(differ, F.lit(0)), both)


class _Open:
    """A node on the branch that the sweep stands on."""

    __slots__ = ("children", "depth", "digest", "leaves", "least", "n", "saved", "size")

    def __init__(self, depth: int, size: int):
        self.depth, self.size, self.n, self.least, self.leaves, self.saved, self.digest, self.children = depth, size, 0, None, 0, 0, None, []

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)

    def told(self) -> tuple:
        return self.depth, self.least, self.n, len(self.children), self.leaves or 1, self.saved, self.digest.hexdigest() if self.digest else NONE


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers of a partition, sorted by container, path and cell."""
    names = [c.split()[0] for c in SWEPT.split(", ")]
    types = [pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 7, pa.string()]
    out: list[tuple] = []
    stack: list[_Open] = []
    container = path = level = burst = None

    def close(depth: int) -> None:
        """End all open nodes deeper than that; children are told once their parent's members are known."""
        while len(stack) > 1 and stack[-1].depth > depth:
            node = stack.pop()
            node.saved += (node.n - 1) * node.size
            top = stack[-1]
            top.add(node.n, node.least)
            top.leaves += node.leaves or 1
            top.saved += node.saved
            top.children.append(node.told())
            for d, least, *rest in node.children:
                out.append((level, burst, INNER, d, least, node.least, *rest))

    def end() -> None:
        close(-1)
        head = stack.pop()
        for d, least, *rest in head.children:
            out.append((level, burst, TOP, d, least, None, *rest))
        if head.digest:
            out.append((level, burst, ENDED, head.depth, head.least, None, head.n, 0, 0, 0, head.digest.hexdigest()))

    def told() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("container", "level", "burst", "depth", "path", "sizes", "n", "least", "ids")), strict=True):
            own, own_level, own_burst, depth, now, sizes, n, least, ids = row
            if own != container:
                if stack:
                    end()
                container, level, burst, path = own, own_level, own_burst, b""
                stack.append(_Open(depth, 0))
                same = depth
            else:
                same, most = depth, min(len(path), len(now)) // TURN
                while same < most:  # turns shared with the path before
                    middle = (same + most + 1) // 2
                    same, most = (middle, most) if path[depth * TURN : middle * TURN] == now[depth * TURN : middle * TURN] else (same, middle - 1)
                close(same)
            for d in range(max(same, stack[-1].depth), len(now) // TURN):
                stack.append(_Open(d + 1, sizes[d]))
            node, path = stack[-1], now
            node.add(n, least)
            if node.digest:
                node.digest.update(b",")
            else:
                node.digest = sha256()
            node.digest.update(ids.encode())
            if len(out) >= 8192:
                yield told()
    if stack:
        end()
    yield told()


def _heads(tops: DataFrame, *keys: str) -> DataFrame:
    """The nodes above some containers, put together from their top nodes and the conversations that end at the head."""
    is_top = F.col("kind") == TOP
    return tops.groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count_if(is_top).alias("n_children"), F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.coalesce(F.max(F.when(~is_top, F.col("ends_sha256"))), F.lit(NONE)).alias("ends_sha256"),
    )


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(seqs: DataFrame, most: int = 4096) -> DataFrame:
    """One row per node of the trie over ``sequences``: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves (childless nodes in its subtree), saved_tokens (over its subtree, each node's other members times its last text's
    size) and ends_sha256 (of the members that end there, ascending, comma-joined).

    A conversation without turns belongs to the root alone. An empty table has no node.
    """
    items, ready, bursts = _suffixes(seqs), [], []
    while True:
        items = C.written(items, "suffixes")
        crowded = C.written(items.groupBy("container").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most).select("container"), "crowded")
        if crowded.isEmpty():
            ready.append(items)
            break
        ends = items.join(crowded, "container").groupBy("container").agg(F.min(F.struct("path", "sizes")).alias("low"), F.max("path").alias("high"), F.first("burst").alias("up"), F.first("depth").alias("depth"))
        ends = ends.where(F.col("low.path") != F.col("high")).withColumn("reach", _shared_turns(F.col("low.path"), F.col("high")))
        own = ends.select("container", "up", "depth", "reach", F.slice("low.sizes", F.lit(1), F.col("reach").cast("int")).alias("sizes"))
        burst = C.written(own, "bursts")
        if burst.isEmpty():  # what is still crowded are equal chains
            ready.append(items)
            break
        ready.append(items.join(burst, "container", "left_anti"))
        bursts.append(burst)
        below = items.drop("burst", "depth").join(burst.select("container", "reach"), "container")
        items = below.select((F.col("level") + 1).alias("level"), F.col("container").alias("burst"), F.col("reach").alias("depth"), _container(F.col("reach")).alias("container"), "path", "cell", "sizes", "least", "n", "ids")
    waiting = reduce(DataFrame.unionByName, ready).repartition("container").sortWithinPartitions("container", "path", "cell")
    swept = C.written(waiting.mapInArrow(_sweep, SWEPT), "swept")

    told, tops = [swept.where(F.col("kind") == INNER).select(*NODE)], swept.where(F.col("kind") != INNER)
    for level in range(len(bursts), 0, -1):
        own = tops.where(F.col("level") == level)
        heads = C.written(_heads(own, "burst"), "heads")
        parents = heads.select("burst", F.col("conv_id").alias("above"))
        told.append(own.where(F.col("kind") == TOP).join(parents, "burst").withColumn("parent_conv_id", F.col("above")).select(*NODE))
        chain = bursts[level - 1].withColumnRenamed("container", "burst").join(heads, "burst")
        chain = chain.withColumnRenamed("depth", "head").withColumn("depth", F.explode(F.sequence(F.col("head") + 1, "reach")))
        at_end, below = F.col("depth") == F.col("reach"), F.aggregate(F.slice("sizes", F.col("depth").cast("int"), (F.col("reach") - F.col("depth") + 1).cast("int")), F.lit(0).cast("long"), lambda s, x: s + x)
        chain = chain.select(
            F.lit(level - 1).alias("level"), F.col("up").alias("burst"), F.when(F.col("depth") == F.col("head") + 1, TOP).otherwise(INNER).alias("kind"), "depth", "conv_id",
            F.col("conv_id").alias("parent_conv_id"), "n_convs", F.when(at_end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * below).alias("saved_tokens"), F.when(at_end, F.col("ends_sha256")).otherwise(F.lit(NONE)).alias("ends_sha256"),
        )
        chain = C.written(chain, "chains")
        told.append(chain.where(F.col("kind") == INNER).select(*NODE))
        tops = tops.where(F.col("level") < level).unionByName(chain.where(F.col("kind") == TOP))
    root = _heads(tops).where("conv_id is not null").withColumn("depth", F.lit(0).cast("long")).withColumn("parent_conv_id", F.lit(None).cast("long"))
    least = tops.agg(F.min("conv_id")).first()[0]
    told += [tops.where(F.col("kind") == TOP).withColumn("parent_conv_id", F.lit(least).cast("long")).select(*NODE), root.select(*NODE)]
    return reduce(DataFrame.union, told)
