"""Approximate nearest neighbours by largest cosine: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by hash. In a shard, nodes are numbered by falling level, so the nodes of a
level are the first ones and its links are one flat array (nodes x places, -1 for none); no
pointers. New nodes come in batches: each batch searches the graph so far with beams that advance
side by side, is compared with itself exhaustively, and takes the nearest candidates that are not nearer to
one already taken (then the nearest of the others). A node whose list is full keeps the links that
the same rule chooses. The graph of a shard is one row of a table: ids, vectors, levels, links.

A query searches every shard, and the shards' nearest are merged. Scores are exact cosines in double
precision on the original vectors; only the choice of candidates is approximate.

Equal vectors are one node that keeps its smallest k + 1 ids, which is all that a top-k with ties by
id can need, so a vector that a third of all rows share is one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorwatch.llm import common as C


@dataclass(frozen=True)
class Hnsw:
    links: int = 16  # places of a new node; lists hold twice as many
    build: int = 64  # beam of an insertion
    search: int = 128  # beam of a query
    upper: int = 16  # beam above the ground level
    ahead: int = 4  # nodes of a beam that open together
    batch: int = 512  # nodes inserted, or queries asked, side by side
    shard: int = 1 << 14  # vectors of a shard, at most on average
    asked: int = 1 << 15  # queries of a task


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, for the graph."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of rows with rows, in doubles; components far from 1 are scaled first, lest squares overflow or vanish."""

    def safe(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        most = np.abs(x).max(axis=-1, keepdims=True)
        return np.where((most > 1e100) | (most < 1e-100), x / most, x)

    a, b = safe(query), safe(vectors)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, likeness), nearest first, of a search of one level from ``start``; all queries advance together."""
    n, asked = len(links), len(queries)
    nodes, likeness = np.full((asked, width), n, np.int32), np.full((asked, width), -np.inf, np.float32)
    waiting = np.zeros((asked, width), bool)
    seen = np.zeros((asked, n + 1), bool)
    seen[:, n] = True
    first = start[:, :width]
    every = np.arange(asked)
    seen[every[:, None], np.where(first < 0, n, first)] = True
    known = (first >= 0) & (first < n)
    got = np.where(known, np.einsum("bsd,bd->bs", vectors[np.where(known, first, 0)], queries), -np.inf)
    order = np.argsort(-got, axis=1, kind="stable")
    s = first.shape[1]
    nodes[:, :s], likeness[:, :s] = np.take_along_axis(np.where(known, first, n), order, axis=1), np.take_along_axis(got, order, axis=1)
    waiting[:, :s] = nodes[:, :s] < n
    live = every
    while len(live):
        wait = waiting[live]
        turn = np.cumsum(wait, axis=1)
        row, at = np.nonzero(wait & (turn <= ahead))
        waiting[live[row], at] = False
        met = links[nodes[live[row], at]]
        pair = np.unique(np.repeat(row.astype(np.int64), met.shape[1]) * (n + 1) + np.where(met < 0, n, met).ravel())
        row, node = pair // (n + 1), pair % (n + 1)
        fresh = ~seen[live[row], node]
        row, node = row[fresh], node[fresh]
        if len(row):
            seen[live[row], node] = True
            got = np.einsum("nd,nd->n", vectors[node], queries[live[row]])
            near = got > likeness[live[row], -1]
            row, node, got = row[near], node[near], got[near]
        if len(row):
            counts = np.bincount(row, minlength=len(live))
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            some = np.flatnonzero(counts)
            slim = np.full(len(live), -1)
            slim[some] = np.arange(len(some))
            more, score = np.full((len(some), counts.max()), n, np.int32), np.full((len(some), counts.max()), -np.inf, np.float32)
            more[slim[row], place], score[slim[row], place] = node, got
            to = live[some]
            score = np.concatenate([likeness[to], score], axis=1)
            order = np.argsort(-score, axis=1, kind="stable")[:, :width]
            nodes[to] = np.take_along_axis(np.concatenate([nodes[to], more], axis=1), order, axis=1)
            waiting[to] = np.take_along_axis(np.concatenate([waiting[to], more < n], axis=1), order, axis=1)
            likeness[to] = np.take_along_axis(score, order, axis=1)
        live = live[waiting[live].any(axis=1)]
    return np.where(nodes == n, -1, nodes), likeness


def chosen(vectors: np.ndarray, nodes: np.ndarray, likeness: np.ndarray, most: int, fill: bool) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) those not nearer to one already chosen; ``fill`` adds the nearest others."""
    v = vectors[np.where(nodes < 0, 0, nodes)]
    between = v @ v.transpose(0, 2, 1)
    blocked, taken = nodes < 0, np.zeros(nodes.shape, bool)
    count = np.zeros(len(nodes), int)
    for j in range(nodes.shape[1]):
        take = ~blocked[:, j] & (count < most)
        taken[take, j] = True
        count += take
        blocked |= take[:, None] & (between[:, j] > likeness)
    if fill:
        rest = (nodes >= 0) & ~taken
        taken |= rest & (np.cumsum(rest, axis=1) <= (most - count)[:, None])
    order = np.argsort(~taken, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(taken, order, axis=1), np.take_along_axis(nodes, order, axis=1), -1)


class Graph:
    """Flat arrays of one shard: unit vectors and, per level, links of its nodes (the first ones)."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.links = vectors, links

    @staticmethod
    def levels(n: int, cfg: Hnsw, rng: np.random.Generator) -> np.ndarray:
        """Level of each node, falling."""
        return -np.sort(-np.minimum((-np.log(1 - rng.random(n)) / np.log(cfg.links)).astype(int), 12))

    @classmethod
    def built(cls, vectors: np.ndarray, cfg: Hnsw) -> Graph:
        level = cls.levels(len(vectors), cfg, np.random.default_rng(len(vectors)))
        top = int(level[0]) if len(level) else 0
        graph = cls(vectors, [np.full((int((level >= x).sum()), 2 * cfg.links), -1, np.int32) for x in range(top + 1)])
        done = 0
        while done < len(vectors):
            size = min(cfg.batch, max(16, done // 2))
            graph._insert(np.arange(done, min(done + size, len(vectors))), cfg)
            done = min(done + size, len(vectors))
        return graph

    def _descend(self, queries: np.ndarray, stop: int, cfg: Hnsw, upto: int) -> np.ndarray:
        """Starting nodes on level ``stop``, found on the levels above it among the first ``upto`` nodes."""
        start = np.zeros((len(queries), 1), np.int32)
        for x in range(len(self.links) - 1, stop, -1):
            if min(len(self.links[x]), upto):
                start = beam(self.vectors, self.links[x][:upto], queries, start, cfg.upper, 1)[0]
        return start

    def _insert(self, new: np.ndarray, cfg: Hnsw) -> None:
        first, queries = int(new[0]), self.vectors[new]
        own = queries @ queries.T
        np.fill_diagonal(own, -np.inf)
        start = np.zeros((len(new), 1), np.int32)
        for x in range(len(self.links) - 1, -1, -1):
            links = self.links[x]
            old = min(first, len(links))
            if old:
                start, likeness = beam(self.vectors, links[:old], queries, start, cfg.build if len(links) > first else cfg.upper, cfg.ahead if x == 0 else 1)
            here = min(len(links), int(new[-1]) + 1) - first  # how many of the batch are on this level
            if here <= 0:
                continue
            near = np.argsort(-own[:here, :here], axis=1, kind="stable")[:, : min(cfg.links, here - 1)]
            nodes, score = (near + first).astype(np.int32), np.take_along_axis(own[:here, :here], near, axis=1)
            if old:
                nodes, score = np.concatenate([start[:here], nodes], axis=1), np.concatenate([likeness[:here], score], axis=1)
                order = np.argsort(-score, axis=1, kind="stable")
                nodes, score = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(score, order, axis=1)
            picked = chosen(self.vectors, nodes, score, cfg.links, True)
            links[first : first + here, : picked.shape[1]] = picked
            self._link_back(links, np.repeat(np.arange(first, first + here), picked.shape[1]), picked.ravel(), cfg)

    def _link_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray, cfg: Hnsw) -> None:
        """Enter ``source`` in the lists of its neighbours; full lists are chosen anew, with some room left."""
        some = target >= 0
        source, target = source[some], target[some]
        mutual = (links[target] == source[:, None]).any(axis=1)
        source, target = source[~mutual], target[~mutual]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        owners, counts = np.unique(target, return_counts=True)
        place = np.arange(len(target)) - np.repeat(np.cumsum(counts) - counts, counts)
        used = (links[owners] >= 0).sum(axis=1)
        room = np.repeat(used + counts <= links.shape[1], counts)
        links[target[room], (np.repeat(used, counts) + place)[room]] = source[room]
        full = used + counts > links.shape[1]
        if not full.any():
            return
        crowd = owners[full]
        number = np.cumsum(full) - 1
        more = np.full((len(crowd), int(counts[full].max())), -1, np.int32)
        more[np.repeat(number, counts)[~room], place[~room]] = source[~room]
        for low in range(0, len(crowd), 512):
            at = crowd[low : low + 512]
            nodes = np.concatenate([links[at], more[low : low + 512]], axis=1)
            score = np.where(nodes < 0, -np.inf, np.einsum("bsd,bd->bs", self.vectors[np.where(nodes < 0, 0, nodes)], self.vectors[at]))
            order = np.argsort(-score, axis=1, kind="stable")
            order = order[:, : 4 * links.shape[1]]
            nodes, score = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(score, order, axis=1)
            kept = chosen(self.vectors, nodes, score.astype(np.float32), links.shape[1] * 3 // 4, False)
            links[at] = -1
            links[at[:, None], np.arange(kept.shape[1])] = kept

    def nearest(self, queries: np.ndarray, cfg: Hnsw) -> np.ndarray:
        """(queries, beam) nodes, nearest first, -1 for none."""
        if not len(self.vectors):
            return np.full((len(queries), 0), -1)
        start = self._descend(queries, 0, cfg, len(self.vectors))
        return beam(self.vectors, self.links[0], queries, start, cfg.search, cfg.ahead)[0]


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector, bits): rows with an id and a vector of finite components that are not all zero. Of rows that repeat an id the
    smallest vector stays."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    some = rows.where(F.col(key).isNotNull() & x.isNotNull() & finite).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(x).alias("vector"))
    return some.select("id", "vector", F.size("vector").alias("bits"))


INDEX = "shard int, bits int, nodes int, places int, ids array<array<long>>, vectors binary, links array<binary>"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """(rows, dimension) components of a column of vectors of one length, as they are stored."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def indexed(entries: DataFrame, cfg: Hnsw) -> DataFrame:
    """One row per (shard, dimension) of ``entries`` (shard, bits, ids, vector): the shard's graph as flat arrays."""

    def build(part: pa.Table) -> pa.Table:
        part = part.take(np.random.default_rng(len(part)).permutation(np.argsort([x[0] for x in part.column("ids").to_pylist()])))
        vectors = _matrix(part.column("vector"))
        graph = Graph.built(unit(vectors), cfg)
        row = {
            "shard": part.column("shard")[:1], "bits": part.column("bits")[:1], "nodes": pa.array([len(part)], pa.int32()), "places": pa.array([2 * cfg.links], pa.int32()),
            "ids": pa.array([part.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))), "vectors": pa.array([vectors.astype(np.float64).tobytes()], pa.binary()),
            "links": pa.array([[x.tobytes() for x in graph.links]], pa.list_(pa.binary())),
        }
        return pa.table(row)

    return entries.select("shard", "bits", "ids", "vector").groupBy("shard", "bits").applyInArrow(build, INDEX)


def loaded(row: dict) -> tuple[Graph, np.ndarray, list[list[int]]]:
    """Graph, original vectors and ids of an index row."""
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["nodes"], row["bits"])
    return Graph(unit(vectors), [np.frombuffer(x, np.int32).reshape(-1, row["places"]) for x in row["links"]]), vectors, row["ids"]


def nearest(rows: DataFrame, asked: Column, k: int = 5, cfg: Hnsw = Hnsw(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row that ``asked`` selects (of ``id``), itself left out.

    Nearest first, ties by smaller id; all candidates if fewer. Rows without id, and vectors that are null, zero or not finite,
    take no part; vectors of different length never meet.
    """
    held = C.written(usable(rows, key, vector), "vectors")
    first = Window.partitionBy("bits", "vector").orderBy("id")
    some = held.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    entries = C.written(some.groupBy("bits", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    n = entries.count()
    shards = max(1, -(-n // cfg.shard), min(8, n // 2048))  # a few tasks for a small table too
    index = C.written(indexed(entries.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")), cfg), "graphs")

    queries = C.written(held.where(asked).select("bits", "vector").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    asks = max(1, -(-queries.count() // cfg.asked))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.withColumn("shard", each(shards)).withColumn("ask", F.pmod(F.xxhash64("query"), F.lit(asks)).cast("int"))
    right = index.withColumn("ask", each(asks))

    def search(wanted: pa.Table, held: pa.Table) -> pa.Table:
        query, score, ids = [], [], []
        if len(wanted) and len(held):
            graph, vectors, own = loaded(held.to_pylist()[0])
            original, names = _matrix(wanted.column("vector")), wanted.column("query").to_numpy()
            for low in range(0, len(original), cfg.batch):
                part = original[low : low + cfg.batch]
                nodes = graph.nearest(unit(part), cfg)[:, : 2 * k + 8]
                exact = np.where(nodes < 0, -np.inf, cosines(part[:, None, :], vectors[np.where(nodes < 0, 0, nodes)]))
                for i, (found, values) in enumerate(zip(nodes.tolist(), exact.tolist(), strict=True)):
                    best = sorted((-v, x) for f, v in zip(found, values, strict=True) if f >= 0 for x in own[f])[: k + 1]
                    query += [names[low + i]] * len(best)
                    score += [-v for v, _ in best]
                    ids += [x for _, x in best]
        return pa.table({"query": pa.array(query, pa.int64()), "score": pa.array(score, pa.float64()), "id": pa.array(ids, pa.int64())})

    by = ["bits", "shard", "ask"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "query long, score double, id long")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    best = best.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id", "score"))), lambda x: F.struct(x["id"], x["score"])).alias("near"))
    near = C.written(queries.join(best, "query").select("bits", "vector", "near"), "near")
    told = held.where(asked).select(F.col("id").alias("query_id"), "bits", "vector").join(near, ["bits", "vector"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    told = told.select("query_id", F.posexplode(others).alias("place", "x"))
    return told.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
