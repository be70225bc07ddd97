"""Isolation forest per entity: trees are fitted once into a table of arrays, rows are scored against it in one pass.

A tree is a heap: node 1 is the root, node i has children 2i and 2i + 1. Its row holds, by node
number, the feature asked (-1 at a leaf), the cut, and the path length that ends there in
millionths, so sums of paths are exact in any order. Every choice (sample, features of a tree, feature
and cut of a node) is a hash of seed, tree and node: a repeated task grows the same tree, trees do not
depend on how they are dealt to tasks, and SQL can grow them too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorwatch.functions.scalars import stable_seed

EULER = 0.5772156649015329
UNIT = 1_000_000  # path lengths are counted in millionths
U64 = np.uint64
# Odd 32-bit multipliers of the hash.
MIX = (0x85EBCA6B, 0xC2B2AE35)
SALT, TREE, NODE = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
SAMPLE, KEPT, ASKED, CUT = 1, 2, 3, 4  # what a hash decides
FEATURES = 1024  # node and feature share a number, so a forest has fewer features than this


@dataclass(frozen=True)
class Forest:
    n_trees: int = 800
    max_samples: int = 256
    feature_share: float = 0.8
    seed: int = 42
    block: int = 400  # trees of a fitting task
    rows: int = 20_000  # bins of a scoring task


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(16))) * U64(MIX[0]) & U64(0xFFFFFFFF)
    h = (h ^ (h >> U64(13))) * U64(MIX[1]) & U64(0xFFFFFFFF)
    return h ^ (h >> U64(16))


def draw(seed: int, tree: np.ndarray, node: np.ndarray, salt: int) -> np.ndarray:
    """32-bit hashes, by (seed, decision, tree, node)."""
    tree, node = np.broadcast_arrays(np.asarray(tree, np.uint64), np.asarray(node, np.uint64))
    h = _mixed(np.full(tree.shape, (seed + salt * SALT) % 2**32, np.uint64))
    h = _mixed((h + tree * U64(TREE)) & U64(0xFFFFFFFF))
    return _mixed((h + node * U64(NODE)) & U64(0xFFFFFFFF))


def usual_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * (np.log(m - 1.0) + EULER) - 2.0 * (m - 1.0) / m))


def depth_of(rows: int, max_samples: int) -> int:
    return int(np.ceil(np.log2(max(min(rows, max_samples), 2))))


def grown(rows: np.ndarray, seed: int, trees: np.ndarray, cfg: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, cuts, paths) of some trees over an entity's training rows, by heap number; all trees grow level by level.

    Features come up in the order of their hashes, and only the one whose turn it is is measured.
    """
    n, f = rows.shape
    depth, size, count = depth_of(n, cfg.max_samples), min(cfg.max_samples, n), len(trees)
    width = 2 ** (depth + 1)
    features, cuts = np.full((count, width // 2), -1, np.int16), np.zeros((count, width // 2))
    paths = np.tile(np.concatenate([[0], np.floor(np.log2(np.arange(1, width))) * UNIT]).astype(np.int32), (count, 1))
    sample = ((draw(seed, trees[:, None], np.arange(size)[None, :], SAMPLE) * U64(n)) >> U64(32)).astype(int)
    order = np.argsort(-draw(seed, trees[:, None], np.arange(f)[None, :], KEPT).astype(np.int64), axis=1, kind="stable")
    kept = np.zeros((count, f), bool)
    np.put_along_axis(kept, order[:, : max(1, int(cfg.feature_share * f))], True, axis=1)
    key = (np.arange(count)[:, None] * width + np.ones((1, size), int)).ravel()
    sample = sample.ravel()
    for level in range(depth + 1):
        by = np.argsort(key, kind="stable")
        key, sample = key[by], sample[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        held = np.diff(np.append(first, len(key)))
        tree, node = key[first] // width, key[first] % width
        own = np.repeat(np.arange(len(first)), held)
        asked, low, high = np.full(len(first), -1), np.zeros(len(first)), np.zeros(len(first))
        if level < depth:
            turn = np.where(kept[tree], draw(seed, trees[tree][:, None], node[:, None] * FEATURES + np.arange(f)[None, :], ASKED).astype(np.int64), -1)
            waiting = np.flatnonzero(held > 1)
            while len(waiting):
                best = turn[waiting].argmax(axis=1)
                some = turn[waiting, best] >= 0
                waiting, best = waiting[some], best[some]
                if not len(waiting):
                    break
                place = np.full(len(first), -1)
                place[waiting] = np.arange(len(waiting))
                mine = np.flatnonzero(place[own] >= 0)
                x = rows[sample[mine], best[place[own[mine]]]]
                cut = np.flatnonzero(np.diff(own[mine], prepend=-1))
                lo, hi = np.minimum.reduceat(x, cut), np.maximum.reduceat(x, cut)
                good = hi > lo
                asked[waiting[good]], low[waiting[good]], high[waiting[good]] = best[good], lo[good], hi[good]
                turn[waiting, best] = -1
                waiting = waiting[~good]
        split = asked >= 0
        paths[tree[~split], node[~split]] = level * UNIT + np.rint(usual_path(held[~split]) * UNIT).astype(np.int32)
        share = draw(seed, trees[tree], node, CUT).astype(float) / 2.0**32
        at = low + share * (high - low)
        features[tree[split], node[split]], cuts[tree[split], node[split]] = asked[split], at[split]
        stays = split[own]
        own, sample = own[stays], sample[stays]
        if not len(own):
            break
        key = tree[own] * width + 2 * node[own] + (rows[sample, asked[own]] > at[own])
    return features, cuts, paths


def path_sums(x: np.ndarray, features: np.ndarray, cuts: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """Summed path length of every row over some trees, in millionths."""
    total, inner = np.zeros(len(x), np.int64), features.shape[1]
    depth = inner.bit_length() - 1
    columns, rows = np.ascontiguousarray(x.T), np.arange(len(x))[None, :]
    step = max(1, 1_000_000 // max(len(x), 1))
    for low in range(0, len(features), step):
        f, c, p = features[low : low + step], cuts[low : low + step], paths[low : low + step]
        tree = np.arange(len(f))[:, None]
        node = np.ones((len(f), len(x)), int)
        for _ in range(depth):
            at = np.minimum(node, inner - 1)
            ask = np.where(node < inner, f[tree, at], -1)
            node = np.where(ask >= 0, 2 * node + (columns[np.maximum(ask, 0), rows] > c[tree, at]), node)
        total += p[tree, node].sum(axis=0, dtype=np.int64)
    return total


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _rows(table: pa.Table, cols: Sequence[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in cols], axis=1).astype(float)


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is large beside its rows: their number is told to Spark, which would else join small inputs in a few."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def fitted(df: DataFrame, cols: Sequence[str], cfg: Forest = Forest()) -> DataFrame:
    """One row per (entity, tree): ``features``, ``cuts`` and ``paths`` by heap number, grown on the rows with ``train_point`` 1.

    A missing feature counts as 0. An entity without training rows has no trees.
    """
    if len(cols) >= FEATURES:
        raise ValueError(f"a forest takes fewer than {FEATURES} features")
    names = [f"x{i}" for i in range(len(cols))]
    seed = stable_seed(F.concat(F.col("entity").cast("string"), F.lit(f":{cfg.seed}")))
    blocks = -(-cfg.n_trees // cfg.block)
    train = df.where("train_point = 1").select("entity", "pos", seed.alias("seed"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(cols, names, strict=True)])
    train = train.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def fit(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        block = part.column("block")[0].as_py()
        trees = np.arange(block * cfg.block, min(cfg.n_trees, (block + 1) * cfg.block))
        features, cuts, paths = grown(_rows(part, names), part.column("seed")[0].as_py(), trees, cfg)
        entity = pa.array([part.column("entity")[0].as_py()] * len(trees), part.schema.field("entity").type)
        return pa.table({"entity": entity, "tree": pa.array(trees, pa.int32()), "features": _lists(features, pa.int16()), "cuts": _lists(cuts, pa.float64()), "paths": _lists(paths, pa.int32())})

    kind = df.schema["entity"].dataType.simpleString()
    return train.repartition(_tasks(df), "entity", "block").groupBy("entity", "block").applyInArrow(fit, f"entity {kind}, tree int, features array<smallint>, cuts array<double>, paths array<int>")


def mean_paths(df: DataFrame, trees: DataFrame, cols: Sequence[str], cfg: Forest = Forest()) -> DataFrame:
    """(entity, pos, path): mean path length over the entity's trees. A task holds one block of an entity's bins and its trees."""
    names = [f"x{i}" for i in range(len(cols))]
    part = F.floor(F.col("pos") / cfg.rows).cast("int").alias("part")
    rows = df.select("entity", "pos", part, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(cols, names, strict=True)])
    parts = rows.groupBy("entity", "part").agg(F.lit(1).alias("_one")).drop("_one")
    dealt = trees.join(parts, "entity").select(F.col("entity").alias("e"), F.col("part").alias("p"), "features", "cuts", "paths")

    def score(own: pa.Table, forest: pa.Table) -> pa.Table:
        sums = np.zeros(len(own))
        if len(own) and len(forest):
            width = lambda c: forest.column(c).combine_chunks().flatten().to_numpy().reshape(len(forest), -1)
            sums = path_sums(_rows(own, names), width("features"), width("cuts"), width("paths")) / (UNIT * len(forest))
        return pa.table({"entity": own.column("entity"), "pos": own.column("pos"), "path": pa.array(sums, pa.float64(), mask=np.full(len(own), not len(forest)))})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    n = _tasks(df)
    both = rows.repartition(n, "entity", "part").groupBy("entity", "part").cogroup(dealt.repartition(n, "e", "p").groupBy("e", "p"))
    return both.applyInArrow(score, f"entity {kinds['entity']}, pos {kinds['pos']}, path double")


def raw_scores(df: DataFrame, cols: Sequence[str], cfg: Forest = Forest(), trees: DataFrame | None = None) -> DataFrame:
    """``_raw``: minus 2 to the power of the mean path over the usual one. ``trees`` is a stored model of ``fitted``; without
    it the trees are fitted here, once, and go straight to the tasks that score."""
    trees = fitted(df, cols, cfg) if trees is None else trees
    sizes = df.groupBy("entity").agg(F.sum("train_point").alias("_train"))
    n = F.least(F.col("_train"), F.lit(cfg.max_samples)).cast("double")
    usual = F.when(n > 2, 2.0 * (F.ln(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n).otherwise(F.lit(1.0))
    out = df.join(mean_paths(df, trees, cols, cfg), ["entity", "pos"], "left").join(sizes, "entity")
    return out.withColumn("_raw", -F.pow(F.lit(2.0), -F.col("path") / usual)).drop("path", "_train")
