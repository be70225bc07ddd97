"""Prefix trie, hard negatives and graph search against plain versions."""

import hashlib
import math
import os
import random
import zlib
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorwatch.llm import hnsw, negatives, prefix_trie
from sensorwatch.llm.queries import CHECKS, QUERIES, rebuilt

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ------------------------------------------------------------------ trie


def plain_trie(chains):
    """Node rows of {conv_id: list of (role, text)}."""
    nodes = {}
    for c, chain in chains.items():
        for d in range(len(chain) + 1):
            nodes.setdefault(tuple(chain[:d]), []).append(c)
    rows = {}
    for at in sorted(nodes, key=len, reverse=True):
        below = [x for x in rows if len(x) == len(at) + 1 and x[: len(at)] == at]
        own = (len(nodes[at]) - 1) * len(at[-1][1].encode()) if at else 0
        ends = ",".join(str(c) for c in sorted(nodes[at]) if len(chains[c]) == len(at))
        rows[at] = (
            min(nodes[at]), len(at), min(nodes[at[:-1]]) if at else None, len(nodes[at]), len(below), sum(rows[x][5] for x in below) or 1,
            own + sum(rows[x][6] for x in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(rows.values(), key=str)


def plain_sequences(rows):
    """{conv_id: turns} by turn, null first, equal numbers by digest."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def plain_rebuilt(own):
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks(spark):
    """Shared first turns, whole copies, prefixes of other conversations, one long chain, nulls, repeated rows, turnless rebuilds."""
    rng = random.Random(3)
    rows = []
    for c in range(-7, 160):
        if c % 23 == 5:
            continue
        copy = rng.choice([None, 1, 2, 3])
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, ["user", "assistant"][t % 2], f"hello {t} é" if copy else f"turn {rng.randrange(3)} {t}"))
    rows += [(1000 + c, t, "user", f"long {t}") for c in range(12) for t in range(40 - c % 5)]
    rows += [(None, 0, "user", "nobody"), (2000, None, None, None), (2000, 0, "user", "x"), (2000, 0, "user", "x"), (2001, 1, "", "y" * 100_000), (2**60 + 3, 0, "user", "hello 0 é")]
    return rows, spark.createDataFrame([(*r, "extra", 1) for r in rows], CONVERSATION + ", path string, least int").repartition(5)


@pytest.mark.parametrize("most", [1, 3, 20, 4096])
def test_trie_equals_plain_one_at_every_container_size(talks, most):
    rows, df = talks
    assert told(prefix_trie.trie(prefix_trie.sequences(df), most)) == plain_trie(plain_sequences(rows))


def test_rebuilt_trie_equals_plain_one(talks):
    rows, df = talks
    chains = plain_rebuilt(plain_sequences(rows))
    assert any(not c for c in chains.values())
    assert told(prefix_trie.trie(rebuilt(prefix_trie.sequences(df)), 7)) == plain_trie(chains)


def test_empty_and_turnless_tries(spark):
    none = spark.createDataFrame([], CONVERSATION)
    assert prefix_trie.trie(prefix_trie.sequences(none)).collect() == []
    one = spark.createDataFrame([(None, 1, "a", "b"), (3, None, None, None)], CONVERSATION)
    assert told(prefix_trie.trie(prefix_trie.sequences(one))) == plain_trie({3: [("", "")]})
    turnless = prefix_trie.sequences(one).withColumn("turns", F.slice("turns", 1, 0))
    assert told(prefix_trie.trie(turnless)) == plain_trie({3: []})


@needs_data
@pytest.mark.parametrize("name", ["op11_burst_prefix_trie", "op12_strassen_hard_negatives"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(CHECKS[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda v: "~" if pd.isna(v) else f"{v:.0f}" if not isinstance(v, str) else v
    key = lambda f: sorted(tuple(map(text, r)) for r in f[sorted(f.columns)].itertuples(index=False))
    assert key(got) == key(want) and len(got)


# ------------------------------------------------------------------ hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (33, 65, 130), (0, 4, 5), (40, 0, 40)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    for most in (3, 300, 2**30, 2**62):  # the last one wraps, alike in both
        a, b = rng.integers(-most, most, shape[:2]), rng.integers(-most, most, shape[1:])
        assert (negatives.strassen(a, b, 4) == a @ b).all()


def test_heaps_merge_ties_and_least_scores():
    heaps = negatives.Heaps(3, 3)
    heaps.push(slice(0, 3), np.array([[5, 5, 1, 7]] * 3), np.array([[True] * 4, [False] * 4, [True, False, True, False]]), np.array([1, 2, 3, 4]))
    heaps.push(slice(0, 2), np.array([[5, 7, 9]] * 2), np.array([[True, True, False]] * 2), np.array([5, 6, 7]))
    assert heaps.id[0].tolist() == [4, 6, 1] and heaps.score[0].tolist() == [7, 7, 5]
    assert heaps.id[1][heaps.full[1]].tolist() == [6, 5] and heaps.id[2][heaps.full[2]].tolist() == [1, 3]


def plain_negatives(rows, cfg, asked):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    least = {}
    for r in rows:
        least[r[0]] = min(r, least.get(r[0], r), key=lambda x: (x[2], x[1]))
    whole = {i: ([math.floor(cfg.scale * x) for x in v], y) for i, v, y in least.values()}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a][0], whole[b][0], strict=True))
    out = []
    for a in sorted(x for x in whole if x % asked == 0):
        others = [(-score(a, b), b) for b in whole if b != a and len(whole[a][0]) == len(whole[b][0])]
        for s, p in sorted(x for x in others if whole[x[1]][1] == whole[a][1])[: cfg.positives]:
            fits = sorted(x for x in others if whole[x[1]][1] != whole[a][1] and cfg.low * -s <= 100 * -x[0] <= cfg.high * -s)
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(fits[: cfg.negatives], 1)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, equal vectors, repeated ids, nulls, zero and other lengths, columns named like the operators' own."""
    rng = np.random.default_rng(5)
    rows = [(i, [round(float(x), 2) for x in rng.normal(0, 0.3, 6) + (i % 3)], int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, [0.5] * 6, i % 2) for i in range(30)] + [(200, [0.5] * 6, 0), (200, [0.1] * 6, 1), (10, rows[10][1], rows[10][2])]
    rows += [(300, None, 1), (301, [1.0, None] * 3, 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1), (304, [0.0] * 6, 2), (None, [0.5] * 6, 1), (305, [1.0, 2.0], 1), (310, [2.0, 2.0], 1), (311, [1.0, 1.0], 0), (312, [], 0), (320, [1.0] * 6, None)]
    return rows, spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS + ", id string, rank int, bits string").repartition(4)


@pytest.mark.parametrize("cfg", [negatives.Mining(), negatives.Mining(block=4, split=40, rows=2, columns=7, leaf=2, negatives=8, low=-100)])
def test_negatives_equal_plain_ones(vectors, cfg):
    rows, df = vectors
    got = told(negatives.hard_negatives(df, F.col("id") % 10 == 0, cfg))
    assert got == plain_negatives(rows, cfg, 10) and got


def test_negatives_of_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none, F.col("id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 2)], VECTORS)
    assert negatives.hard_negatives(alone, F.col("id") % 10 == 0).collect() == []


# ------------------------------------------------------------------ graph search


def plain_nearest(rows, asked, k):
    some = [(i, np.array(v)) for i, v, _ in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    least = {}
    for i, v in some:
        least[i] = min(v.tolist(), least.get(i, v.tolist()))
    some, out = [(i, np.array(v)) for i, v in least.items()], []
    for i, v in some:
        if i % asked == 0:
            near = sorted((-float(hnsw.cosines(v, w)), j) for j, w in some if j != i and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near[:k], 1)]
    return sorted(out, key=str)


def test_search_of_a_small_table_is_exact(vectors):
    """Beams wider than the table find everything, ties and copies included."""
    rows, df = vectors
    got = hnsw.nearest(df, F.col("id") % 10 == 0, 5)
    assert [f"{r[0]} {r[1]} {r[2]} {r[3]:.12f}" for r in told(got)] == [f"{r[0]} {r[1]} {r[2]} {r[3]:.12f}" for r in plain_nearest(rows, 10, 5)]


def test_search_of_empty_and_tiny_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hnsw.nearest(none, F.col("id") % 10 == 0).collect() == []
    two = spark.createDataFrame([(10, [1e200, 0.0], 1), (11, [1e-200, 1e-200], 2), (12, [0.0, 0.0], 1)], VECTORS)
    assert [(r[0], r[1], r[2], round(r[3], 9)) for r in hnsw.nearest(two, F.col("id") % 10 == 0).collect()] == [(10, 1, 11, round(math.sqrt(0.5), 9))]


@pytest.mark.parametrize("clusters", [0, 12])
def test_graph_links_and_recall(clusters):
    """A graph of 6,000 vectors: whole lists without repeats, recall of at least 0.9 with a tenth of the beam."""
    rng = np.random.default_rng(clusters)
    v = rng.normal(size=(6000, 32))
    if clusters:
        v[::2] = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 3000)] + 0.02 * rng.normal(size=(3000, 32))
    v = hnsw.unit(v)
    cfg = hnsw.Hnsw(search=96)
    graph = hnsw.Graph.built(v, cfg)
    assert len(graph.links[0]) == len(v) and len(graph.links) > 1
    for links in graph.links:
        assert links.shape[1] == 2 * cfg.links and links.max() < len(links)
        for row, own in zip(range(0, len(links), 97), links[::97], strict=False):
            own = own[own >= 0]
            assert len(set(own.tolist())) == len(own) and row not in own
    asked = rng.permutation(len(v))[:300]
    found = graph.nearest(v[asked], cfg)[:, :6]
    likeness = v[asked] @ v.T
    worst = -np.sort(-likeness, axis=1)[:, 5]
    hits = sum(likeness[i, n] >= worst[i] - 1e-6 for i, n in product(range(len(asked)), range(6)) for n in [found[i, n]] if n >= 0)
    assert hits / (6 * len(asked)) >= 0.9


@needs_data
def test_recall_of_the_query(spark):
    got = QUERIES["op13_sharded_hnsw"](spark, DATA).toPandas()
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    ids, v = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s = hnsw.cosines(v[q], v)
        s[q] = -np.inf
        want |= {(ids[q], j) for j in ids[np.lexsort((ids, -s))[:5]]}
    assert len(got) == len(want) and len(want & set(zip(got.query_id, got.vec_id, strict=True))) >= 0.9 * len(want)
