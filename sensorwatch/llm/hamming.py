"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each positive component. Codes are cut into 16-bit segments, and a
block of codes is indexed by every segment's value. A query grows the search radius of one segment
at a time: all codes within it are verified by their full distance, and a code not seen yet differs
by more than the radius in every segment, hence by at least the sum of (radius + 1). The search ends
when the k-th verified distance is below that sum.

Equal codes are one entry that keeps its smallest k + 1 ids, which is all that a top-k with ties
by id can need; so a vector shared by a third of all rows is one entry. Queries and codes meet in
blocks. Rows without a vector are neither found nor asked; codes of different length never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorwatch.llm import common as C

SEGMENT = 16
_WEIGHT = np.array([bin(x).count("1") for x in range(1 << SEGMENT)], np.uint8)
_BY_WEIGHT = [np.flatnonzero(_WEIGHT == r).astype(np.uint16) for r in range(SEGMENT + 1)]


def codes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, bits, code): sign bits packed to bytes; a null component counts as not positive."""

    def pack(batch: pa.RecordBatch) -> list[pa.Array]:
        out = [np.packbits(np.array([x is not None and x > 0 for x in v], bool)).tobytes() for v in batch.column(2).to_pylist()]
        return [batch.column(0), batch.column(1), C.binary(out)]

    some = rows.select(F.col(key).cast("long").alias("id"), F.size(vector).alias("bits"), vector).where(F.col(vector).isNotNull() & (F.col("bits") > 0) & F.col(key).isNotNull())
    return C.map_arrow(some, pack, "id long, bits int, code binary", rows=4096)


def _segments(packed: list[bytes]) -> np.ndarray:
    """(codes, segments) of 16 bits each, padded with zero bits."""
    width = len(packed[0])
    whole = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), width)
    if width % 2:
        whole = np.concatenate([whole, np.zeros((len(packed), 1), np.uint8)], axis=1)
    return whole.copy().view(np.uint16)


class MultiIndex:
    """Index of distinct codes with their ids."""

    def __init__(self, packed: list[bytes], ids: list[list[int]]):
        self.codes, self.ids = _segments(packed), ids
        self.tables = []
        for s in range(self.codes.shape[1]):
            order = np.argsort(self.codes[:, s], kind="stable")
            self.tables.append((order, np.searchsorted(self.codes[order, s], np.arange((1 << SEGMENT) + 1))))

    def top(self, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k nearest (distance, id), ties by id."""
        need = min(k, sum(map(len, self.ids))) if len(self.ids) <= k else k
        distance = np.full(len(self.codes), -1, np.int32)
        radius = [-1] * len(self.tables)
        counts = np.zeros(self.codes.shape[1] * SEGMENT + 1, np.int64)  # ids verified at each distance
        sizes = np.array([len(x) for x in self.ids])
        seen = 0
        while seen < len(self.codes):
            s = int(np.argmin(radius))
            radius[s] += 1
            order, first = self.tables[s]
            probes = _BY_WEIGHT[radius[s]] ^ query[s]
            low, high = first[probes], first[probes.astype(np.int64) + 1]
            full = np.flatnonzero(high > low)
            if len(full):
                found = np.concatenate([order[low[i] : high[i]] for i in full])
                found = found[distance[found] < 0]
                distance[found] = _WEIGHT[self.codes[found] ^ query].sum(axis=1)
                np.add.at(counts, distance[found], sizes[found])
                seen += len(found)
            covered = sum(radius) + len(radius)  # every code nearer than this has been verified
            if counts[:covered].sum() >= need:
                break
        last = int(np.searchsorted(np.cumsum(counts), need))
        near = np.flatnonzero((distance >= 0) & (distance <= last))
        return sorted((int(distance[i]), x) for i in near for x in self.ids[i])[:k]


def nearest(rows: DataFrame, asked: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", code_block: int = 1 << 18, query_block: int = 1 << 16) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other rows of every row that ``asked`` selects (of ``id``)."""
    packed = C.written(codes(rows, key, vector).distinct(), "codes")
    first = Window.partitionBy("bits", "code").orderBy("id")
    some = packed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    entries = C.written(some.groupBy("bits", "code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    queries = C.written(packed.where(asked).select("bits", "code").distinct(), "queries")
    blocks, wanted = -(-entries.count() // code_block) or 1, queries.count()
    asks = max(1, -(-wanted // query_block), min(8, wanted // 256))  # a few tasks even for a small query set
    dealt = lambda df, n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("block", each(blocks)).withColumn("ask", dealt(queries, asks))
    right = entries.withColumn("ask", each(asks)).withColumn("block", dealt(entries, blocks))

    def search(asked_codes: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[bytes, int, int]] = []
        if len(asked_codes) and len(held):
            index = MultiIndex(held.column("code").to_pylist(), held.column("ids").to_pylist())
            wanted = asked_codes.column("code").to_pylist()
            for code, query in zip(wanted, _segments(wanted), strict=True):
                out += [(code, d, i) for d, i in index.top(query, k + 1)]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        bits = asked_codes.column("bits")[0].as_py() if len(asked_codes) else 0
        return pa.table({"bits": pa.array([bits] * len(out), pa.int32()), "code": C.binary(list(columns[0])), "distance": pa.array(columns[1], pa.int32()), "id": pa.array(columns[2], pa.int64())})

    by = ["bits", "block", "ask"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "bits int, code binary, distance int, id long")
    best = C.written(hits.groupBy("bits", "code").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "id"))), 1, k + 1).alias("near")), "near")
    told = packed.where(asked).withColumnRenamed("id", "query_id").join(best, ["bits", "code"])
    others = F.slice(F.filter("near", lambda n: ~((n["distance"] == 0) & (n["id"] == F.col("query_id")))), 1, k)
    told = told.select("query_id", F.posexplode(others).alias("place", "n"))
    return told.select("query_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("neighbor_id"), F.col("n.distance").alias("distance"))
