"""MinHash near-duplicates by a chosen-path set similarity join.

Documents become sets of word shingles; equal sets are one class. Each class walks
several independent trees: at a node, one or two coordinates of its minwise
signature are selected by the node's own hash (1/similarity of them on average), and
the tokens found there name the child nodes. Similar sets share a node far below
the root; unlike ones part soon. Nodes that are still large branch further, small
nodes are compared exhaustively on sketches of the signatures (four bits a coordinate). Deeper trees lose
more pairs, so the number of trees is computed from the depth; classes whose nodes
branch further walk additional trees to that depth.

Only a spanning forest of what the sketches cannot rule out leaves a node, so a group of
copies gives as many rows as it has members. Its components are loose clusters: every
link lies inside one. Each cluster is then settled on the full sets, fetched once from the
texts: a search from member to member, each held against those not reached yet. Clusters
beyond ``block`` different texts are settled in pairs of blocks. Nothing is capped.

Work tables go to the shared checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorwatch.llm import common as C

U64 = np.uint64


@dataclass(frozen=True)
class NearDup:
    """A pair at the threshold is missed with a chance of at most ``missed`` at any table size; a pair in nodes that
    branch further adds at most as much for each deeper level. The number of trees follows from it (``trees_for``)."""

    shingle: int = 5
    percent: int = 80  # least similarity, in hundredths; above 50
    missed: float = 1e-6
    coordinates: int = 128
    slack: float = 0.2  # ruled out when sketches say this much less than the threshold (3e-9 of pairs at it)
    node: int = 4000  # nodes up to this size are compared exhaustively
    deeper: int = 6  # levels that larger nodes may branch further
    block: int = 10_000  # texts of a cluster that one task settles
    screen: int = 1 << 18  # 64-bit words of the screen over texts that clusters need

    @property
    def smallest(self) -> int:
        """Two different sets can only be similar from this size on."""
        return max(1, math.ceil(self.percent / (100 - self.percent))) if self.percent < 100 else 1


def _signatures(cfg: NearDup) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, cfg.coordinates, dtype=np.uint64) * U64(2) + U64(1), rng.integers(0, 2**63, cfg.coordinates, dtype=np.uint64)


def _signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), 2**32 - 1, np.uint64)
    for low in range(0, len(values), 2048):
        part = a[:, None] * values[None, low : low + 2048]
        part += b[:, None]
        part >>= U64(32)
        np.minimum(least, part.min(axis=1), out=least)
    return least.astype(np.uint32)


def profiles(docs: DataFrame, cfg: NearDup, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, a row key, set size, set hash (128 bits, null for an empty set) and signature."""
    a, b = _signatures(cfg)

    def profile(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, hashes, marks = [], [], []
        for _, _, data, offsets in C.text_chunks(batch.column(2)):
            shingles, first = C.shingle_hashes(C.Words(data, offsets), cfg.shingle)
            for d in range(len(offsets) - 1):
                values = np.unique(shingles[first[d] : first[d + 1]])
                sizes.append(len(values))
                hashes.append(blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                marks.append(_signature(values, a, b).tobytes() if len(values) >= cfg.smallest else None)
        return [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), C.binary(hashes), C.binary(marks)]

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.xxhash64(text)).alias("row_key"), F.col(text).alias("text"))
    return C.map_arrow(rows, profile, "doc_id long, row_key long, n_shingles long, set_key binary, sig binary")


def _branch(paths: np.ndarray, marks: np.ndarray, rows: np.ndarray, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes: (path, row) again; each node selects one coordinate, and a second one with chance ``extra``."""
    t = U64(marks.shape[1])
    u = C.mix(paths)
    one = u % t
    two = (one + U64(1) + C.mix(u) % (t - U64(1))) % t
    second = np.flatnonzero((u >> U64(11)).astype(np.float64) / 2.0**53 < extra)
    node, at, row = np.concatenate([paths, paths[second]]), np.concatenate([one, two[second]]), np.concatenate([rows, rows[second]])
    return C.mix((node * U64(0xD6E8FEB86659FD93) + at) * U64(0xA0761D6478BD642F) + marks[row, at.astype(np.int64)]), row


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def miss_rate(cfg: NearDup, depth: int, trees: int) -> float:
    """Chance that two sets at the threshold share no node of a depth in any of some trees, all on the same coordinates."""
    t, extra = cfg.coordinates, 100 / cfg.percent - 1
    same = np.arange(t + 1)  # coordinates that agree
    one = same / t
    both = one * (same - 1) / (t - 1)
    lost = np.zeros(t + 1)  # in one tree
    for _ in range(depth):
        lost = (1 - extra) * (1 - one + one * lost) + extra * (both * lost**2 + 2 * (one - both) * lost + 1 - 2 * one + both)
    chance = np.array([math.comb(t, k) * (cfg.percent / 100) ** k * (1 - cfg.percent / 100) ** (t - k) for k in range(t + 1)])
    return float(chance @ lost**trees)


def trees_for(cfg: NearDup, depth: int) -> int:
    """Fewest trees that miss a pair at the threshold with a chance of at most ``missed``."""
    high = 1
    while miss_rate(cfg, depth, high) > cfg.missed:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if miss_rate(cfg, depth, middle) <= cfg.missed else (middle, high)
    return high


def _walk(cfg: NearDup, depth: int, trees: range):
    extra = 100 / cfg.percent - 1

    def walk(batch: pa.RecordBatch) -> list[pa.Array]:
        marks = _matrix(batch.column(1), cfg.coordinates)
        ends, owners = [], []
        for tree in trees:
            rows = np.arange(len(marks))
            paths = np.full(len(marks), C.mix(np.array([tree + 1], np.uint64))[0])
            for _ in range(depth):
                paths, rows = _branch(paths, marks, rows, extra)
            ends.append(paths)
            owners.append(rows)
        rows = np.concatenate(owners)
        order = np.argsort(rows, kind="stable")
        rep = batch.column(0).to_numpy(zero_copy_only=False)
        return [pa.array(np.concatenate(ends)[order].view(np.int64)), pa.array(rep[rows[order]])]

    return walk


def _deepen(cfg: NearDup):
    extra = 100 / cfg.percent - 1

    def deepen(batch: pa.RecordBatch) -> list[pa.Array]:
        marks = _matrix(batch.column(2), cfg.coordinates)
        paths, rows = _branch(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), marks, np.arange(len(marks)), extra)
        return [pa.array(paths.view(np.int64)), pa.array(batch.column(1).to_numpy(zero_copy_only=False)[rows])]

    return deepen


def depth_for(classes: int) -> int:
    """Levels of the first walk: unlike documents share a token at a node with a chance of about a twentieth."""
    return max(2, math.ceil(math.log(max(classes, 2)) / math.log(20)))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of the undirected edges (x, y).

    Every node points at its smallest smaller neighbour, pointers are followed to their roots by
    doubling, and edges are redrawn between roots until none is left.
    """
    high, low = F.greatest("x", "y"), F.least("x", "y")
    left = C.written(edges.where("x <> y").select(high.alias("x"), low.alias("y")).distinct(), "edges")
    labels = left.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        roots = held = C.written(left.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root")), "roots")
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
            further = C.written(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
            C.discard(held)
            held, roots = further, further.select("node", "root")
            if further.where("moved").isEmpty():
                break
        over = roots.select(F.col("node").alias("label"), "root")
        named = C.written(labels.join(over, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        if hasattr(labels, "work_path"):
            C.discard(labels)
        labels = named
        x, y = roots.select(F.col("node").alias("x"), F.col("root").alias("rx")), roots.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        redrawn = left.join(x, "x").join(y, "y", "left").select("rx", F.coalesce("ry", "y").alias("ry")).where("rx <> ry")
        before, left = left, C.written(redrawn.select(F.greatest("rx", "ry").alias("x"), F.least("rx", "ry").alias("y")).distinct(), "edges")
        C.discard(before, held)
        if left.isEmpty():
            return labels


def _groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], list[pa.Array]], schema: str) -> DataFrame:
    """Run ``fn`` on the rows of each key group, streaming over sorted partitions; a group is held whole, a partition never."""
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(part: pa.Table) -> Iterator[pa.RecordBatch]:
            cut = np.zeros(max(len(part) - 1, 0), bool)
            for i in range(len(keys)):
                column = part.column(i).to_numpy()
                cut |= column[1:] != column[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(part)]])
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high - low > 1:
                    out = fn(part.slice(low, high - low))
                    if len(out[0]):
                        yield pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if all(batch.column(i)[-1] == held[0].column(i)[0] for i in range(len(keys))):
                continue  # one group so far
            whole = pa.Table.from_batches(held)
            same = np.ones(len(whole), bool)
            for i in range(len(keys)):
                column = whole.column(i).to_numpy()
                same &= column == column[-1]
            last = int(np.flatnonzero(~same)[-1]) + 1  # the last group may go on in the next batch
            yield from settle(whole.slice(0, last))
            held = whole.slice(last).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _loose_forest(cfg: NearDup):
    """Spanning forest of the pairs of a node that sketches and sizes leave possible."""
    least = math.floor((cfg.percent / 100 - cfg.slack) * cfg.coordinates)

    def forest(node: pa.Table) -> list[pa.Array]:
        rep, n = node.column("rep").to_numpy(), node.column("n").to_numpy()
        halves = np.frombuffer(b"".join(node.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
        sketch = np.concatenate([halves >> 4, halves & 15], axis=1)
        rest, stack, own, a, b = np.arange(len(rep)), [], [], [], []
        while len(rest) or stack:
            if not stack:
                own, stack, rest = [int(rest[0])], [int(rest[0])], rest[1:]
            i = stack.pop()
            near = (np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * cfg.percent) & ((sketch[rest] == sketch[i]).sum(axis=1) >= least)
            found = rest[near].tolist()
            rest = rest[~near]
            stack += found
            own += found
            if not stack and len(own) > 1:  # every member with the smallest one: the same few in most nodes of a group
                members = rep[own]
                a.append(members[members != members.min()])
                b.append(np.full(len(a[-1]), members.min()))
        return [pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in (a, b)]

    return forest


class _Postings:
    """Which of some sets hold a token; tokens of one set only are left out."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        tokens = np.concatenate([sets[i] for i in members])
        owner = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
        order = np.argsort(tokens, kind="stable")
        self.members, self.owner, tokens = members, owner[order], tokens[order]
        self.first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.tokens, self.end = tokens[self.first], np.append(self.first[1:], len(tokens))

    def common(self, own: np.ndarray) -> np.ndarray:
        """Size of the intersection with each member."""
        at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        at = at[self.tokens[at] == own]
        if not len(at):
            return np.zeros(len(self.members), np.int64)
        return np.bincount(np.concatenate([self.owner[self.first[i] : self.end[i]] for i in at]), minlength=len(self.members))


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component number of every set: searched from set to set, each held against those not reached yet."""
    size = np.array([len(x) for x in sets])
    part = np.full(len(sets), -1)
    postings = _Postings(sets, np.arange(len(sets)))
    left, stack, current = len(sets), [], -1
    for start in range(len(sets)):
        if part[start] >= 0:
            continue
        current += 1
        part[start] = current
        left -= 1
        stack = [start]
        while stack and left:
            if left * 2 < len(postings.members):
                postings = _Postings(sets, np.flatnonzero(part < 0))
            i = stack.pop()
            members = postings.members
            common = postings.common(sets[i])
            near = members[(part[members] < 0) & (100 * common >= percent * (size[i] + size[members] - common))]
            part[near] = current
            left -= len(near)
            stack += near.tolist()
    return part


def _settle(cfg: NearDup):
    """Links between set hashes of a cluster: each with the smallest one of its component."""

    def settle(cluster: pa.Table) -> list[pa.Array]:
        keys = cluster.column("set_key").to_pylist()
        part = linked([np.frombuffer(x, np.uint64) for x in cluster.column("full").to_pylist()], cfg.percent)
        least: dict[int, bytes] = {}
        for k, p in zip(keys, part, strict=True):
            least[p] = min(k, least.get(p, k))
        pairs = [(k, least[p]) for k, p in zip(keys, part, strict=True) if k != least[p]]
        return [C.binary([k for k, _ in pairs]), C.binary([m for _, m in pairs])]

    return settle


def _in_blocks(df: DataFrame, group: str, own: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows of groups up to ``size`` rows, rows of larger ones repeated for every pair of blocks they are in)."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    large = counts.where(F.col("members") > size).withColumn("blocks", F.ceil(F.col("members") / (size / 2)).cast("int"))
    small = df.join(large.select(group), group, "left_anti")
    split = df.join(large, group).withColumn("block", F.pmod(F.xxhash64(own, F.lit(1)), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    split = split.select("*", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    return small, split.drop("members", "blocks", "block", "other")


def screened(rows: DataFrame, wanted: DataFrame, key: str, words: int) -> DataFrame:
    """Rows whose key may be among the wanted ones: all that are, and few others while the keys are fewer than the bits.

    The bits are a table of at most ``words`` rows whatever the input, so it can be broadcast; large
    rows that nobody wants are left out before a join moves them.
    """
    slot = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(64 * words))
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    masks = wanted.select(slot.alias("_slot")).groupBy(F.floor(F.col("_slot") / 64).alias("_word")).agg(F.bit_or(bit).alias("_mask"))
    out = rows.withColumn("_slot", slot).withColumn("_word", F.floor(F.col("_slot") / 64)).join(F.broadcast(masks), "_word")
    return out.where(F.col("_mask").bitwiseAND(bit) != 0).select(*rows.columns)


def links(docs: DataFrame, profile: DataFrame, cfg: NearDup, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, label) over the set hashes that are linked with a different set."""
    reps = profile.where("sig is not null").groupBy("set_key").agg(F.min("row_key").alias("row_key"), F.first("n_shingles").cast("int").alias("n"), F.first("sig").alias("sig"))
    reps = C.written(reps.withColumn("rep", F.xxhash64("set_key")), "classes")
    sketches = reps.select("rep", "n", F.unhex(F.regexp_replace(F.hex("sig"), "(.).......", "$1")).alias("sketch"))  # four bits of each coordinate
    depth = depth_for(reps.count())
    trees = trees_for(cfg, depth)
    paths = C.map_arrow(reps.select("rep", "sig"), _walk(cfg, depth, range(trees)), "path long, rep long", rows=2048)
    forests, superseded = [], []
    for level in range(cfg.deeper + 1):
        if level:  # the first walk is the bulk: walked anew by each reader, it never lies on disk
            paths = C.written(paths, "paths")
        C.discard(*superseded)
        nodes = C.written(paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "nodes")
        crowded = C.written(nodes.where(F.col("size") > cfg.node).select("path"), "crowded")
        small = paths.join(nodes.where(F.col("size") <= cfg.node).select("path"), "path").join(sketches, "rep").select("path", "rep", "n", "sketch")
        forests.append(C.written(_groups(small, ["path"], _loose_forest(cfg), "x long, y long"), "forest"))
        superseded = [nodes, crowded] + ([paths] if level else [])
        if crowded.isEmpty():
            break
        large = C.written(paths.join(crowded, "path", "left_semi").select("path", "rep"), "large")
        superseded.append(large)
        if level == cfg.deeper:
            _, split = _in_blocks(large, "path", "rep", cfg.node)
            split = split.join(sketches, "rep").select("path", "lo", "hi", "rep", "n", "sketch")
            forests.append(C.written(_groups(split, ["path", "lo", "hi"], _loose_forest(cfg), "x long, y long"), "forest"))
            break
        paths = C.map_arrow(large.join(reps.select("rep", "sig"), "rep").select("path", "rep", "sig"), _deepen(cfg), "path long, rep long", rows=8192)
        depth, walked = depth + 1, trees
        trees = trees_for(cfg, depth)
        in_large = reps.select("rep", "sig").join(large.select("rep").distinct(), "rep", "left_semi")  # deeper nodes take more trees
        paths = paths.union(C.map_arrow(in_large, _walk(cfg, depth, range(walked, trees)), "path long, rep long", rows=2048)) if trees > walked else paths
    clusters = components(reduce(DataFrame.union, forests))
    C.discard(*superseded, *forests)
    clusters = C.written(clusters.select(F.col("node").alias("rep"), F.col("label").alias("cluster")), "clusters")

    needed = C.written(reps.join(clusters, "rep").select("row_key").distinct(), "needed")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.xxhash64(text)).alias("row_key"), F.col(text).alias("text"))
    rows = screened(rows, needed, "row_key", cfg.screen).join(needed, "row_key", "left_semi").select("text")

    def sets(batch: pa.RecordBatch) -> list[pa.Array]:
        hashes, values = [], []
        for _, _, data, offsets in C.text_chunks(batch.column(0)):
            shingles, first = C.shingle_hashes(C.Words(data, offsets), cfg.shingle)
            for d in range(len(offsets) - 1):
                own = np.unique(shingles[first[d] : first[d + 1]]).tobytes()
                hashes.append(blake2b(own, digest_size=16).digest() if own else None)
                values.append(own)
        return [C.binary(hashes), C.binary(values)]

    full = C.map_arrow(rows, sets, "set_key binary, full binary").where("set_key is not null").groupBy("set_key").agg(F.first("full").alias("full"))
    full = C.written(full.withColumn("rep", F.xxhash64("set_key")).join(clusters, "rep").select("cluster", "set_key", "full"), "sets")
    small, split = _in_blocks(full, "cluster", "set_key", cfg.block)
    small = C.written(_groups(small.select("cluster", "set_key", "full"), ["cluster"], _settle(cfg), "x binary, y binary"), "links")
    split = C.written(_groups(split.select("cluster", "lo", "hi", "set_key", "full"), ["cluster", "lo", "hi"], _settle(cfg), "x binary, y binary"), "links")
    settled = small.select(F.col("x").alias("node"), F.col("y").alias("label")).union(small.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())
    return settled if split.isEmpty() else settled.union(components(split))


def near_duplicates(docs: DataFrame, cfg: NearDup = NearDup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, set_key, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links (null only where all ids of the
    group are null). A document with an empty set is alone. Repeated rows stay; ``kept`` marks
    each row whose id is its component's.
    """
    profile = C.written(profiles(docs, cfg, key, text), "profiles")
    labels = links(docs, profile, cfg, key, text)
    rows = profile.drop("sig").join(labels, profile.set_key == labels.node, "left").withColumn("part", F.coalesce("label", "set_key")).drop("node", "label")
    rows = C.written(rows, "placed")
    least = rows.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    out = rows.where("part is not null").join(least, "part").select("doc_id", "row_key", "n_shingles", "set_key", "component_id")
    alone = rows.where("part is null").select("doc_id", "row_key", "n_shingles", "set_key", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, cfg: NearDup = NearDup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group (smallest id; of repeated rows one), and every document without words. Other columns may have any names."""
    row, place = C.fresh(docs, "_row"), C.fresh(docs, "_place")
    row_key = F.coalesce(F.col(key).cast("long"), F.xxhash64(text))
    worded = F.coalesce(F.regexp_like(F.col(text), F.lit(C.WORD)), F.lit(False))
    groups = near_duplicates(docs.where(worded), cfg, key, text)
    best = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("set_key")).alias("other")).agg(F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias(row))
    best = best.select(row).distinct()
    with_words = docs.where(worded).withColumn(row, row_key)
    first = Window.partitionBy(row).orderBy(text, *[c for c, t in docs.dtypes if c not in (key, text) and not t.startswith("map")])
    kept = with_words.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).join(best, row, "left_semi")
    return kept.select(*docs.columns).union(docs.where(~worded))
