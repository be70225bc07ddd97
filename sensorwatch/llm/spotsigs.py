"""SpotSigs document fingerprints.

A signature starts at an anchor, a very common word, and is the chain of content words (all
others) that follow it at a fixed spacing. A fingerprint is the set of a text's signatures, so
it stays where the running prose stays and ignores menus and tables, which have few anchors. A
text with words but without a full chain has one signature, of all its words; a text without
words has none.

Likeness is the Jaccard similarity of two sets, pruned by their lengths. ``near_groups`` splits
the sets into length partitions so narrow that similar sets lie in the same or the next one,
and compares those that share one of their rarest signatures there.

Null texts count as empty. ``with_next`` orders a table by descending id over range cells;
each cell also gets the first row of the next one, so no row needs more than its neighbour.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sensorwatch.llm import common as C
from sensorwatch.llm import neardup as ND

# Anchor words.
ANCHORS = "a an the is was are of to in and that with der die das ist war den dem ein und le la les est un une de des et el los es una que y"


@dataclass(frozen=True)
class Spots:
    spacing: int = 2  # content words from one word of a chain to the next
    chain: int = 2  # content words in a chain


_ANCHORS = np.sort(np.array([C.word_hash(w) for w in ANCHORS.split()], np.uint64))


def fingerprints(texts: list[str], cfg: Spots = Spots()) -> list[np.ndarray]:
    """Sorted 32-bit signatures of every text."""
    out = []
    for _, _, data, offsets in C.text_chunks(pa.array(texts, pa.large_string())):
        words = C.Words(data, offsets, letters=True)
        h = words.hash
        at = np.minimum(np.searchsorted(_ANCHORS, h), len(_ANCHORS) - 1)
        anchor = _ANCHORS[at] == h
        content = np.flatnonzero(~anchor)
        spots = np.flatnonzero(anchor)
        doc = np.searchsorted(words.first, spots, "right") - 1
        first = np.searchsorted(content, spots)
        last = first + cfg.spacing * cfg.chain - 1
        end = np.searchsorted(content, words.first[1:])[doc] if len(spots) else np.zeros(0, np.int64)
        full = last < end
        spots, doc, first = spots[full], doc[full], first[full]
        sig = h[spots]
        for step in range(1, cfg.chain + 1):
            sig = C.mix(sig * np.uint64(0xD6E8FEB86659FD93) + h[content[first + cfg.spacing * step - 1]])
        sig = (sig >> np.uint64(32)).astype(np.uint32)
        cuts = np.searchsorted(doc, np.arange(len(offsets)))
        for d in range(len(offsets) - 1):
            own = np.unique(sig[cuts[d] : cuts[d + 1]])
            if not len(own) and words.first[d] < words.first[d + 1]:
                whole = np.zeros(1, np.uint64)
                for x in h[words.first[d] : words.first[d + 1]]:
                    whole = C.mix(whole * np.uint64(0xD6E8FEB86659FD93) + x)
                own = (whole >> np.uint64(32)).astype(np.uint32)
            out.append(own)
    return out


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where their lengths alone rule ``least`` out. Two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large or not small:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (small + large - common)


def packed(signatures: np.ndarray) -> str:
    """A fingerprint as text: base64 of its sorted signatures."""
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def with_next(docs: DataFrame, key: str, text: str, cells: int) -> DataFrame:
    """Rows (doc_id, text, cell, ahead, down, h) where, sorted by cell, ahead, down (nulls last), h, every row is followed
    by the next document in descending id; the row after a cell's last one is marked ``ahead``. Equal ids go by text hash."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.bitwise_not(F.col(key).cast("long")).alias("down"), F.xxhash64(text).alias("h"))
    cuts = rows.agg(F.percentile_approx("down", [i / cells for i in range(1, cells)], 10 * cells)).first()[0] or []
    bounds = np.array(sorted(set(cuts)), np.int64)
    often = np.array(sorted({x for x in cuts if cuts.count(x) > 1}), np.int64)

    def cell(down: pd.Series, none: pd.Series, h: pd.Series) -> pd.Series:
        missing, value = none.to_numpy(bool), down.to_numpy()
        base = np.where(missing, len(bounds) + 1, np.searchsorted(bounds, value, "right"))
        part = np.where(missing | np.isin(value, often), (h.to_numpy() >> 56) + 128, 256)  # frequent ids are cut by text hash
        return pd.Series(base * 512 + part)

    # A column with nulls would reach pandas as floats and lose digits, so the null flag travels apart.
    placed = rows.withColumn("cell", F.pandas_udf(cell, LongType())(F.coalesce("down", F.lit(0)), F.col("down").isNull(), "h"))
    firsts = placed.groupBy("cell").agg(F.min(F.struct(F.col("down").isNull().alias("last"), "down", "h")).alias("m")).select("cell", "m.down", "m.h").collect()
    order = sorted(firsts, key=lambda r: r.cell)  # a row per cell
    number = [r.cell for r in order]
    heads = {r.cell: (r.down, r.h) for r in order}

    def before(cells_: pd.Series, down: pd.Series, none: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for c, d, n, x in zip(cells_.tolist(), down.tolist(), none.tolist(), h.tolist(), strict=True):
            out.append(number[bisect.bisect_left(number, c) - 1] if heads[c] == (None if n else d, x) else -1)
        return pd.Series(out, dtype="int64")

    back = F.pandas_udf(before, LongType())("cell", F.coalesce("down", F.lit(0)), F.col("down").isNull(), "h")
    own = F.struct("cell", F.lit(False).alias("ahead"))
    both = placed.withColumn("back", back).withColumn("to", F.explode(F.when(F.col("back") >= 0, F.array(own, F.struct(F.col("back").alias("cell"), F.lit(True).alias("ahead")))).otherwise(F.array(own))))
    return both.select("doc_id", "text", F.col("to.cell").alias("cell"), F.col("to.ahead").alias("ahead"), "down", "h")


def edited_fingerprints(docs: DataFrame, cfg: Spots = Spots(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of the text whose last third is replaced by the beginning of the next
    document (descending id, the first after the last), and the likeness to it and to the next document."""
    cells = 2 * max(4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = with_next(docs, key, text, cells).repartition(cells // 2, "cell").sortWithinPartitions("cell", "ahead", F.asc_nulls_last("down"), "h")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row whose follower has not come yet

        def told(pairs: list[tuple]) -> pa.RecordBatch:
            edited = []
            for (_, own, _, _), (_, following, _, _) in pairs:
                cut = len(own) // 3
                edited.append(own[: len(own) - cut] + following[:cut])
            a, b, c = (fingerprints(x, cfg) for x in ([p[0][1] for p in pairs], [p[1][1] for p in pairs], edited))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0][0] for p in pairs], pa.int64()), pa.array([len(p[0][1]) for p in pairs], pa.int64()),
                    pa.array([sha256(x.encode()).hexdigest() for x in edited], pa.string()), pa.array(map(packed, a), pa.string()), pa.array(map(packed, c), pa.string()),
                    pa.array([likeness(x, y) for x, y in zip(a, c, strict=True)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(a, b, strict=True)], pa.float64()),
                    pa.array([len(x) for x in a], pa.int64()),
                ],
                names=names,
            )

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                pairs = []
                for row in zip(part.column(0).to_pylist(), C.python_texts(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if held and held[0][2] == row[2]:
                        pairs.append((held[0], row))
                    held = [] if row[3] else [row]
                if pairs:
                    yield told(pairs)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long")


def near_groups(docs: DataFrame, percent: int = 80, cfg: Spots = Spots(), key: str = "doc_id", text: str = "text", block: int = 10_000) -> DataFrame:
    """(doc_id, group): documents whose fingerprints are similar, directly or in steps, share the group's smallest fingerprint hash."""

    def sign(batch: pa.RecordBatch) -> list[pa.Array]:
        return [batch.column(0), C.binary([np.sort(x.astype(np.uint64)).tobytes() for x in fingerprints(C.python_texts(batch.column(1)), cfg)])]

    rows = C.written(C.map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), sign, "doc_id long, full binary").withColumn("set_key", F.unhex(F.md5("full"))), "spots")
    sets = rows.where("octet_length(full) > 0").groupBy("set_key").agg(F.first("full").alias("full"))
    step = math.log(100 / percent) if percent < 100 else 1.0

    def tokens(batch: pa.RecordBatch) -> list[pa.Array]:
        own = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        return [pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own])), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))]

    counts = C.map_arrow(sets, tokens, "at long, sig long").groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    listed = C.map_arrow(sets, lambda b: [b.column(0), pa.array([np.frombuffer(x, np.int64).tolist() for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], "set_key binary, sigs array<long>")
    ranked = listed.select("set_key", F.size("sigs").alias("len"), F.explode("sigs").alias("sig")).join(counts, "sig")
    rare = ranked.groupBy("set_key", "len").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("s"))
    prefix = F.slice("s", 1, (F.col("len") - F.ceil(F.col("len") * percent / 100) + 1).cast("int"))
    slot = F.floor(F.log(F.col("len").cast("double")) / step)
    placed = rare.select("set_key", F.explode(F.transform(prefix, lambda x: x["sig"])).alias("sig"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    placed = placed.select(F.xxhash64("sig", "slot").alias("cluster"), "set_key").distinct().join(sets, "set_key").select("cluster", "set_key", "full")
    small, split = ND._in_blocks(C.written(placed, "lists"), "cluster", "set_key", block)
    settle = ND._settle(ND.NearDup(percent=percent))
    found = ND._groups(small.select("cluster", "set_key", "full"), ["cluster"], settle, "x binary, y binary")
    found = found.union(ND._groups(split.select("cluster", "lo", "hi", "set_key", "full"), ["cluster", "lo", "hi"], settle, "x binary, y binary"))
    labels = ND.components(found)
    return rows.join(labels, rows.set_key == labels.node, "left").select("doc_id", F.hex(F.coalesce("label", "set_key")).alias("group"))
