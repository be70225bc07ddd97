"""Hard negatives from exact integer scores of anchors and candidates.

Components become floor(scale * x) in 64-bit integers. Scores come tile by tile, anchors times
candidates, as a product by Strassen's recursion with zero padding; all additions are exact integer
ones. A first pass keeps a heap of the best positives per anchor, a second one a heap per (anchor,
positive) of the rows whose score lies in the window below the positive's. Heaps of different tasks merge:
the best few of a union are among the best few of its parts.

Anchors and candidates meet in blocks: every (anchor block, candidate split) is a task that holds
the block and streams the split. Heaps are all that leaves a task. Labels play no part in how rows are dealt, so a label
of a third of the rows is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorwatch.llm import common as C

LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 3
    low: int = 50  # a negative's score lies between these percentages of its positive's
    high: int = 95
    scale: int = 256
    block: int = 1 << 16  # anchors of a task
    split: int = 1 << 16  # candidates of a task, at most on average
    rows: int = 1024  # anchors and candidates of a tile
    columns: int = 4096
    leaf: int = 32  # a product with a side up to this is not divided


def _padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if x.shape == (rows, columns):
        return x
    out = np.zeros((rows, columns), np.int64)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of a leaf. Doubles hold integers below 2^53 exactly; where no partial sum can reach that, they do the sums."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    largest = max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min()))) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if largest < 2**53 else a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """Exact product of int64 matrices (modulo 2^64 where a score does not fit): seven half-size products per level."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return _plain(a, b)
    p, q, r = -(-m // 2), -(-k // 2), -(-n // 2)
    a, b = _padded(a, 2 * p, 2 * q), _padded(b, 2 * q, 2 * r)
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    out = np.zeros((2 * p, 2 * r), np.int64)
    c11, c12, c21, c22 = out[:p, :r], out[:p, r:], out[p:, :r], out[p:, r:]
    for left, right, plus, minus in (
        (a11 + a22, b11 + b22, (c11, c22), ()), (a21 + a22, b11, (c21,), (c22,)), (a11, b12 - b22, (c12, c22), ()), (a22, b21 - b11, (c11, c21), ()),
        (a11 + a12, b22, (c12,), (c11,)), (a21 - a11, b11 + b12, (c22,), ()), (a12 - a22, b21 + b22, (c11,), ()),
    ):
        part = strassen(left, right, leaf)
        for c in plus:
            c += part
        for c in minus:
            c -= part
    return out[:m, :n]


class Heaps:
    """The best ``k`` (score, id) of every row, highest score first, ties by smaller id; candidates arrive by ascending id."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), LEAST, np.int64), np.zeros((rows, k), np.int64)
        self.full = np.zeros((rows, k), bool)

    def push(self, rows: slice, score: np.ndarray, able: np.ndarray, ids: np.ndarray) -> None:
        """Offer a tile's columns; ``able`` tells which may enter."""
        k = self.score.shape[1]
        held = self.full[rows].all(axis=1)
        able = able & ((score > self.score[rows][:, -1:]) | ~held[:, None])
        some = np.flatnonzero(able.any(axis=1))
        if not len(some):
            return
        open_, left = np.where(able[some], score[some], LEAST), able[some]
        at = np.arange(len(some))
        best, found = np.zeros((len(some), k), np.int64), np.zeros((len(some), k), bool)
        for j in range(k):
            best[:, j] = open_.argmax(axis=1)
            lowest = ~left[at, best[:, j]]  # only the least value is left: an able column of that very score, if any
            if lowest.any():
                best[lowest, j] = left[lowest].argmax(axis=1)
            found[:, j] = left[at, best[:, j]]
            open_[at, best[:, j]], left[at, best[:, j]] = LEAST, False
        where = np.arange(len(self.score))[rows][some]
        scores = np.concatenate([self.score[where], np.where(found, score[some[:, None], best], LEAST)], axis=1)
        all_ids = np.concatenate([self.id[where], ids[best]], axis=1)
        full = np.concatenate([self.full[where], found], axis=1)
        order = np.lexsort((-np.maximum(scores, LEAST + 1), ~full), axis=1)[:, :k]  # stable: what was held before comes first among equals
        self.score[where], self.id[where], self.full[where] = (np.take_along_axis(x, order, axis=1) for x in (scores, all_ids, full))


def _whole(column: pa.Array, scale: int) -> np.ndarray:
    """(rows, dimension) integers of a column of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), len(flat) // max(len(column), 1))


def _meet(cfg: Mining, k: int, offer: Callable, schema: str, extra: list[str]):
    """Stream (dimension, block, split) groups, anchors first; ``offer`` sees every tile, the heaps of a group leave at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        anchors: list[pa.Table] = []
        vectors = heaps = whole = None

        def told() -> Iterator[pa.RecordBatch]:
            if heaps is not None and len(heaps.score):
                at, _ = np.nonzero(heaps.full)
                ids = whole.column("id").to_numpy()
                per = len(heaps.score) // len(ids)
                columns = [pa.array(ids[at // per]), pa.array((at % per).astype(np.int32)), pa.array(heaps.score[heaps.full]), pa.array(heaps.id[heaps.full])]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "place", "score", "id"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table.column(c).to_numpy() for c in ("bits", "block", "split", "part")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]) if len(keys) else [0]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                piece, own = table.slice(low, high - low), tuple(keys[low][:3])
                if own != key:
                    yield from told()
                    key, anchors, heaps = own, [], None
                if keys[low][3] == 0:
                    anchors.append(piece)
                    continue
                if not anchors:
                    continue
                if heaps is None:
                    whole = pa.concat_tables(anchors)
                    vectors = _whole(whole.column("vector").combine_chunks(), cfg.scale)
                    heaps = Heaps(len(whole) * k[0], k[1])
                for start in range(0, len(piece), cfg.columns):
                    tile = piece.slice(start, cfg.columns)
                    held = _whole(tile.column("vector").combine_chunks(), cfg.scale)
                    ids, labels = tile.column("id").to_numpy(), tile.column("label").to_numpy()
                    for first in range(0, len(whole), cfg.rows):
                        rows = slice(first, min(first + cfg.rows, len(whole)))
                        offer(heaps, whole.slice(first, cfg.rows), rows, strassen(vectors[rows], held.T, cfg.leaf), ids, labels)
        yield from told()

    return lambda df: df.repartition("bits", "block", "split").sortWithinPartitions("bits", "block", "split", "part", "id").select("bits", "block", "split", "part", "id", "label", "vector", *extra).mapInArrow(run, schema)


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vector, bits): rows with an id, a label and a vector of finite components. Of rows that repeat an id the
    smallest by label, then vector, stays."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    some = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & finite)
    some = some.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.struct(F.col(label).cast("long").alias("label"), x.alias("vector"))).alias("row"))
    return some.select("id", "row.label", "row.vector", F.size("row.vector").alias("bits"))


def hard_negatives(rows: DataFrame, asked: Column, cfg: Mining = Mining(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row that ``asked`` selects (of ``id``).

    Positives are the highest-scoring other rows of the anchor's label, negatives the highest-scoring
    rows of other labels inside the window; ties go to the smaller id. An anchor without positives,
    or a positive without negatives, has no row. Vectors of different length never meet. Scores are
    exact while they fit 64 bits.
    """
    held = C.written(usable(rows, key, vector, label), "vectors")
    n, wanted = held.count(), held.where(asked).count()
    blocks = max(1, -(-wanted // cfg.block))
    splits = max(1, -(-n // cfg.split), min(32, n // 2048))  # a few tasks for a small table too
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")

    def meeting(anchors: DataFrame, extra: list[str]) -> DataFrame:
        left = anchors.withColumn("split", each(splits)).withColumn("block", dealt(blocks)).withColumn("part", F.lit(0))
        right = held.withColumn("block", each(blocks)).withColumn("split", dealt(splits)).withColumn("part", F.lit(1))
        names = ["bits", "block", "split", "part", "id", "label", "vector"]
        return left.select(*names, *extra).unionByName(right.select(*names), allowMissingColumns=True)

    def same(heaps: Heaps, anchors: pa.Table, rows: slice, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        own = anchors.column("label").to_numpy()[:, None] == labels
        heaps.push(rows, score, own & (anchors.column("id").to_numpy()[:, None] != ids), ids)

    def window(heaps: Heaps, anchors: pa.Table, rows: slice, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        other = anchors.column("label").to_numpy()[:, None] != labels
        wide = np.array([x + [None] * (cfg.positives - len(x)) for x in anchors.column("goals").to_pylist()], object)
        for j in range(cfg.positives):
            low = np.array([1 if g is None else -(-cfg.low * g // 100) for g in wide[:, j]], np.int64)[:, None]
            high = np.array([0 if g is None else cfg.high * g // 100 for g in wide[:, j]], np.int64)[:, None]
            heaps.push(slice(rows.start * cfg.positives + j, (rows.stop - 1) * cfg.positives + j + 1, cfg.positives), score, other & (score >= low) & (score <= high), ids)

    schema = "anchor_id long, place int, score long, id long"
    best = lambda df, keys, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    found = _meet(cfg, (1, cfg.positives), same, schema, [])(meeting(held.where(asked), []))
    positives = C.written(best(found, ["anchor_id"], cfg.positives).drop("place"), "positives")
    goals = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("goals"))
    mined = _meet(cfg, (cfg.positives, cfg.negatives), window, schema, ["goals"])(meeting(held.join(goals, "id"), ["goals"]))
    mined = best(mined, ["anchor_id", "place"], cfg.negatives).withColumn("place", F.col("place") + 1)
    told = mined.select("anchor_id", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return told.join(positives.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
