"""Text quality by a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a shallow tree on one binned feature and
adds it to that feature's lookup table. The pairs whose joint bins explain most of what is left
then get two-dimensional tables in the same way. A text's score is the sum of its bins' entries.

Features come from the whole text only. Training takes at most ``positives`` and ``negatives``
labelled rows, weighed back to the classes' true shares. Null and empty texts have all features 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from sensorwatch.llm import common as C
from sensorwatch.llm import toxicity as TX

FEATURES = [
    "log_words", "word_bytes", "upper", "symbols", "digits", "stops", "exclamations", "same_as_before", "distinct", "distinct_pairs",
    "most_frequent", "no_letter", "symbol_end", "lines", "function_words", "words_per_stop",
]


@dataclass(frozen=True)
class QualityConfig:
    positives: int = 6000
    negatives: int = 4000
    bins: int = 32
    rounds: int = 120
    rate: float = 0.1
    pairs: int = 6
    pair_bins: int = 8
    pair_rounds: int = 120
    leaf: float = 20.0  # least weight of a leaf
    ridge: float = 2.0
    seed: int = 5


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: np.ndarray  # (features, bins)
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: np.ndarray  # (pairs, bins, bins)
    base: float


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_STOP = _class(".?!")
_BANG = _class("!")
_LINE = _class("\n")
_SYMBOL = _class("#$%&*+/<=>@\\^_`{|}~[]")
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)], np.int64)
_SPACE = np.array([b in C.SPACES for b in range(256)], np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, features) of consecutive texts."""
    docs, n_bytes = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    words = C.Words(data, offsets)
    n_words = np.diff(words.first)
    some = np.maximum(n_words, 1)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    by_word = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[words.first])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    stops = sums(_STOP[data])
    same = np.zeros(len(words.hash), np.int64)
    same[1:] = words.hash[1:] == words.hash[:-1]
    same[words.first[:-1][n_words > 0]] = 0
    pairs = C.mix(words.hash[:-1] * np.uint64(0xD6E8FEB86659FD93) + words.hash[1:]) if len(words.hash) else words.hash
    distinct, distinct_pairs, most = np.zeros(docs), np.zeros(docs), np.zeros(docs)
    for d in np.flatnonzero(n_words > 0):
        low, high = words.first[d], words.first[d + 1]
        _, counts = np.unique(words.hash[low:high], return_counts=True)
        distinct[d], most[d] = len(counts), counts.max()
        distinct_pairs[d] = len(np.unique(pairs[low : high - 1])) if high - low > 1 else 1
    at = np.minimum(np.searchsorted(TX._MARKS, words.hash), len(TX._MARKS) - 1)
    return np.column_stack([
        np.log1p(n_words), by_word(words.end - words.start) / some, sums(_UPPER[data]) / n_bytes, sums(_SYMBOL[data]) / n_bytes, sums(_DIGIT[data]) / n_bytes,
        stops / n_bytes, sums(_BANG[data]) / n_bytes, by_word(same) / some, distinct / some, distinct_pairs / np.maximum(n_words - 1, 1),
        most / some, by_word(letters[words.end] == letters[words.start]) / some, by_word(_SYMBOL[data[words.end - 1]] if len(words.end) else same) / some,
        sums(_LINE[data]) / some, by_word(TX._MARKS[at] == words.hash) / some, n_words / (stops + 1.0),
    ])


def _tree(g: np.ndarray, h: np.ndarray, cfg: QualityConfig, depth: int = 2) -> np.ndarray:
    """Values of a shallow tree over ordered bins with gradient and weight sums g, h."""
    out = np.full(len(g), -g.sum() / (h.sum() + cfg.ridge))
    if depth == 0 or len(g) < 2:
        return out
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - lg, h.sum() - lh
    gain = lg**2 / (lh + cfg.ridge) + rg**2 / (rh + cfg.ridge) - g.sum() ** 2 / (h.sum() + cfg.ridge)
    gain[(lh < cfg.leaf * 0.05) | (rh < cfg.leaf * 0.05)] = 0
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= 1e-9:
        return out
    out[:cut], out[cut:] = _tree(g[:cut], h[:cut], cfg, depth - 1), _tree(g[cut:], h[cut:], cfg, depth - 1)
    return out


def _plane(g: np.ndarray, h: np.ndarray, cfg: QualityConfig) -> np.ndarray:
    """A tree over two binned features: the better first axis is cut once, each half along the other."""
    best, kept = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        lg, lh = np.cumsum(a.sum(axis=1))[:-1], np.cumsum(b.sum(axis=1))[:-1]
        gain = lg**2 / (lh + cfg.ridge) + (a.sum() - lg) ** 2 / (b.sum() - lh + cfg.ridge)
        cut = int(np.argmax(gain)) + 1
        values = np.zeros_like(a)
        for rows in (slice(0, cut), slice(cut, None)):
            values[rows] = _tree(a[rows].sum(axis=0), b[rows].sum(axis=0), cfg, 1)[None, :]
        worth = float(-(values * a).sum() - 0.5 * (values**2 * b).sum())
        if worth > best:
            best, kept = worth, values if axis == 0 else values.T
    return kept


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cfg: QualityConfig) -> Model:
    k = x.shape[1]
    edges = [_edges(x[:, f], cfg.bins) for f in range(k)]
    pair_edges = [_edges(x[:, f], cfg.pair_bins) for f in range(k)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], "right") for f in range(k)]) if len(x) else np.zeros((0, k), np.int64)
    coarse = np.column_stack([np.searchsorted(pair_edges[f], x[:, f], "right") for f in range(k)]) if len(x) else binned
    share = (weight * y).sum() / weight.sum() if len(y) else 0.5
    base = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))))
    model = Model(edges, np.zeros((k, cfg.bins)), [], pair_edges, np.zeros((0, cfg.pair_bins, cfg.pair_bins)), base)
    if len(set(y.tolist())) < 2:
        return model
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(cfg.rounds):
        for f in range(k):
            g, h = (np.bincount(binned[:, f], s, cfg.bins) for s in slopes())
            step = cfg.rate * _tree(g, h, cfg)
            model.tables[f] += step
            z += step[binned[:, f]]
    g, h = slopes()
    worth = []
    for a in range(k):
        for b in range(a + 1, k):
            at = coarse[:, a] * cfg.pair_bins + coarse[:, b]
            gg, hh = (np.bincount(at, s, cfg.pair_bins**2).reshape(cfg.pair_bins, -1) for s in (g, h))
            values = _plane(gg, hh, cfg)
            worth.append((float(-(values * gg).sum() - 0.5 * (values**2 * hh).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(worth, key=lambda t: (-t[0], t[1], t[2]))[: cfg.pairs]]
    model.pair_tables = np.zeros((len(model.pairs), cfg.pair_bins, cfg.pair_bins))
    for _ in range(cfg.pair_rounds):
        for i, (a, b) in enumerate(model.pairs):
            at = coarse[:, a] * cfg.pair_bins + coarse[:, b]
            gg, hh = (np.bincount(at, s, cfg.pair_bins**2).reshape(cfg.pair_bins, -1) for s in slopes())
            step = cfg.rate * _plane(gg, hh, cfg)
            model.pair_tables[i] += step
            z += step.ravel()[at]
    return model


def logits(model: Model, x: np.ndarray) -> np.ndarray:
    """Sum of the bins' table entries."""
    z = np.full(len(x), model.base)
    for f, edges in enumerate(model.edges):
        z += model.tables[f][np.searchsorted(edges, x[:, f], "right")]
    for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
        z += table[np.searchsorted(model.pair_edges[a], x[:, a], "right"), np.searchsorted(model.pair_edges[b], x[:, b], "right")]
    return z


def _features_of(column: pa.Array) -> np.ndarray:
    parts = [features(data, offsets) for _, _, data, offsets in C.text_chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, cfg: QualityConfig = QualityConfig()) -> Model:
    """The sampled rows' features are computed where the rows are; only they come to the driver."""
    rows = TX.labelled_sample(docs, labels, "quality", allowed, cfg.positives, cfg.negatives, cfg.seed)
    schema = "doc_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = C.map_arrow(rows, lambda b: [b.column(0), b.column(1), *[pa.array(c) for c in _features_of(b.column(2)).T]], schema)
    frame = rows.toPandas().sort_values(["doc_id", "label", *FEATURES])
    y = frame["label"].to_numpy(float)
    counts = dict(labels.where(allowed & F.col("quality").isin(0, 1)).groupBy("quality").count().collect())
    weight = np.ones(len(y))
    for c in (0, 1):
        weight[y == c] = counts.get(c, 0) / max((y == c).sum(), 1)
    return train(frame[FEATURES].to_numpy(float), y, weight / (weight.mean() if len(weight) else 1), cfg)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns plus ``quality_score`` (0 to 1)."""
    kept = docs.drop("quality_score")
    place = kept.columns.index("text")

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        return [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(logits(model, _features_of(batch.column(place))), -30, 30))))]

    return C.map_arrow(kept, score, StructType(list(kept.schema.fields)).add("quality_score", DoubleType()))
