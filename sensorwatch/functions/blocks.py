"""Whole series as matrices: what long chains of windows compute, in one ordered Arrow pass.

Spark deals the series to tasks and sorts them; a pass then sees whole series, some ten thousand rows at a time, as
matrices (series x place). A window operator of Spark copies and sorts its rows again, dozens of times in a branch;
here every step is a few vector operations on columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorwatch.functions import series as S


class Known:
    """Numbers of which some are unknown (SQL's null): values and where they are known."""

    def __init__(self, x: np.ndarray, ok: np.ndarray):
        self.x, self.ok = x, ok

    def _with(self, other, fn) -> Known:
        if isinstance(other, Known):
            return Known(fn(self.x, other.x), self.ok & other.ok)
        return Known(fn(self.x, other), self.ok)

    def __add__(self, other) -> Known:
        return self._with(other, np.add)

    def __sub__(self, other) -> Known:
        return self._with(other, np.subtract)

    def __truediv__(self, other) -> Known:
        return self._with(other, np.divide)

    def fill(self, value) -> np.ndarray:
        return np.where(self.ok, self.x, value)

    def held(self, low: float | None, high: float | None) -> Known:
        """Within bounds; like in SQL, not-a-number is beyond any."""
        x = self.x if high is None else np.where(self.x <= high, self.x, high)
        return Known(x if low is None else np.where(self.x < low, low, x), self.ok)

    def where(self, cond: np.ndarray) -> Known:
        return Known(self.x, self.ok & cond)

    def at_least(self, value) -> np.ndarray:
        """Where the value is known and not below; not-a-number counts as large."""
        return self.ok & ~(self.x < value)


class Block:
    """Some complete series: flat rows in the order of their series, and as matrices whose places past an end are unknown."""

    def __init__(self, first: np.ndarray):
        at = np.flatnonzero(first)
        lengths = np.diff(np.append(at, len(first)))
        self.row, self.place = np.repeat(np.arange(len(at)), lengths), np.arange(len(first)) - np.repeat(at, lengths)
        self.shape, self.lengths = (len(at), int(lengths.max())), lengths[:, None]
        self.there = np.arange(self.shape[1]) < self.lengths

    def matrix(self, flat: np.ndarray, fill=0) -> np.ndarray:
        out = np.full(self.shape, fill, flat.dtype)
        out[self.row, self.place] = flat
        return out

    def known(self, column: tuple[np.ndarray, np.ndarray]) -> Known:
        return Known(self.matrix(column[0]), self.matrix(column[1], False))

    def whole(self, column: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Numbers or flags as a matrix, unknown ones as 0."""
        return self.matrix(np.where(column[1], column[0], 0))

    def flat(self, matrix: np.ndarray) -> np.ndarray:
        return np.broadcast_to(matrix, self.shape)[self.row, self.place]


def percentile(v: Known, share: float = 0.5) -> Known:
    """Per row of a matrix, as SQL's ``percentile``; a column, unknown where nothing is known."""
    ordered, n = np.sort(v.fill(np.nan), axis=1), v.ok.sum(axis=1)
    place = np.maximum(n - 1, 0) * share
    low, high = np.floor(place), np.ceil(place)
    i = np.arange(len(n))
    a, b = ordered[i, low.astype(int)], ordered[i, high.astype(int)]
    return Known(np.where((low == high) | (a == b), a, (high - place) * a + (place - low) * b)[:, None], (n > 0)[:, None])


class Slots:
    """Rows of a block by series and slot of the day."""

    def __init__(self, block: Block, slot: np.ndarray):
        _, self.group = np.unique(block.row * 1440 + slot, return_inverse=True)
        self.block, order = block, np.argsort(self.group, kind="stable")
        counts = np.bincount(self.group)
        self.rank = np.empty(len(slot), int)
        self.rank[order] = np.arange(len(slot)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.shape = (len(counts), int(counts.max()))

    def median(self, v: Known) -> Known:
        """Of the rows in the same series and slot."""
        x, ok = np.zeros(self.shape), np.zeros(self.shape, bool)
        x[self.group, self.rank], ok[self.group, self.rank] = self.block.flat(v.x), self.block.flat(v.ok)
        m = percentile(Known(x, ok))
        return self.block.known((m.x[self.group, 0], m.ok[self.group, 0]))


def before(x: np.ndarray, n: int, fill=0) -> np.ndarray:
    """The value ``n`` places earlier."""
    out = np.full_like(x, fill)
    out[:, n:] = x[:, : max(x.shape[1] - n, 0)]
    return out


def lag(v: Known, n: int) -> Known:
    return Known(before(v.x, n), before(v.ok, n, False))


def total(v: Known, n: int, least: int, mean: bool = False) -> Known:
    """Sum (or mean) of the known ones among the last ``n``, added up from the oldest on, where at least ``least`` are known."""
    x, added, seen = v.fill(0.0), np.zeros(v.x.shape), np.zeros(v.x.shape, int)
    width = x.shape[1]
    for k in range(min(n, width) - 1, -1, -1):
        added[:, k:] += x[:, : width - k]
        seen[:, k:] += v.ok[:, : width - k]
    return Known(added / np.maximum(seen, 1) if mean else added, seen >= least)


def share(on: np.ndarray, there: np.ndarray, n: int) -> Known:
    """Share of ones among exactly the last ``n``."""
    t = total(Known(on.astype(float), there), n, 0)
    return Known(t.x / n, there & (np.arange(on.shape[1]) >= n - 1))


def cusum(evidence: np.ndarray, drift: float) -> np.ndarray:
    c = np.cumsum(evidence - drift, axis=1)
    return c - np.fmin(0.0, np.fmin.accumulate(c, axis=1))


def rising(on: np.ndarray) -> np.ndarray:
    return on & ~before(on, 1, False)


def within(on: np.ndarray, most: int, least: int) -> np.ndarray:
    """Where one is on between ``most`` and ``least`` places earlier (negative: later)."""
    width = on.shape[1]
    upto = np.concatenate([np.zeros((len(on), 1), int), np.cumsum(on, axis=1)], axis=1)
    place = np.arange(width)
    low, high = np.clip(place - most, 0, width), np.clip(place - least + 1, 0, width)
    return upto[:, np.maximum(low, high)] > upto[:, low]


def fired(start: np.ndarray, pos: np.ndarray, wait: int) -> np.ndarray:
    """Starts more than ``wait`` away from the last one that fired."""
    out = np.zeros(start.shape, int)
    series, last = -1, None
    for i, j in zip(*(x.tolist() for x in np.nonzero(start)), strict=True):
        if i != series:
            series, last = i, None
        if last is None or pos[i, j] - last > wait:
            out[i, j], last = 1, pos[i, j]
    return out


def _list(values: list) -> tuple[np.ndarray, np.ndarray]:
    pairs = [x if isinstance(x, tuple) else (x, np.ones(len(x), bool)) for x in values]
    return np.stack([x for x, _ in pairs], axis=1), np.stack([ok for _, ok in pairs], axis=1)


def _arrow(x) -> pa.Array:
    """A flat result as an Arrow column: an array, a pair (values, where known) or a list of these, one array a row."""
    if isinstance(x, list):
        values, ok = _list(x)
        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(x))
        return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), mask=None if ok.all() else ~ok.ravel()))
    return pa.array(x[0], mask=~x[1]) if isinstance(x, tuple) else pa.array(x)


def _numpy(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, where known); arrays of one length become rows of a matrix."""
    ok = x.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_list(x.type):
        values = x.flatten().fill_null(0).to_numpy(zero_copy_only=False)
        out = np.zeros((len(x), len(values) // max(int(ok.sum()), 1)), values.dtype)
        out[ok] = values.reshape(int(ok.sum()), out.shape[1])
        return out, ok
    if pa.types.is_timestamp(x.type):
        x = x.cast(pa.int64())
    return x.fill_null(False if pa.types.is_boolean(x.type) else 0).to_numpy(zero_copy_only=False), ok


KINDS = {"int": np.int32, "double": np.float64, "array<int>": np.int32, "array<double>": np.float64}


class _Steps:
    """``fn`` on the complete series among the rows that arrive in order, series of about one length at a time."""

    def __init__(self, names: Sequence[str], schema: StructType, fn: Callable[[Block, dict], dict], each: bool):
        self.names, self.fn, self.each = names, fn, each
        self.kinds = {f.name: KINDS[f.dataType.simpleString()] for f in schema.fields}

    def _flat(self, b: Block, name: str, x):
        if isinstance(x, list):
            return [self._flat(b, name, y) for y in x]
        if isinstance(x, Known):
            return self._flat(b, name, x.x), self._flat(b, None, x.ok)
        x = np.asarray(x)
        x = b.flat(x) if self.each else x.reshape(b.shape[0], -1)[:, 0]
        return x if name is None else x.astype(self.kinds[name])

    def settle(self, first: np.ndarray, columns: list[pa.Array]) -> dict[str, pa.Array]:
        given = {k: _numpy(x) for k, x in zip(self.names, columns, strict=True)}
        at = np.flatnonzero(first)
        lengths = np.diff(np.append(at, len(first)))
        size = np.ceil(np.log2(lengths))
        done, places = [], []
        for c in np.unique(size):
            own = np.flatnonzero(np.repeat(size == c, lengths))
            b = Block(first[own])
            with np.errstate(all="ignore"):
                out = self.fn(b, {k: (x[own], ok[own]) for k, (x, ok) in given.items()})
            done.append({name: self._flat(b, name, out[name]) for name in self.kinds})
            places.append(own if self.each else np.flatnonzero(size == c))
        back = np.argsort(np.concatenate(places))

        def joined(parts):
            if isinstance(parts[0], list | tuple):
                return type(parts[0])(joined([p[k] for p in parts]) for k in range(len(parts[0])))
            return np.concatenate(parts)[back]

        return {name: _arrow(joined([d[name] for d in done])) for name in self.kinds}

    def run(self, batches: Iterator[Sequence[pa.Array]]) -> Iterator[tuple[np.ndarray, list[pa.Array], dict[str, pa.Array]]]:
        """(first rows?, columns, results) of runs of complete series; a column beyond the inputs is passed on only."""
        held, rows = None, 0

        def settled(n: int):
            whole = [pa.concat_arrays(x) if len(x) > 1 else x[0] for x in held]
            first = whole[0].slice(0, n).to_numpy(zero_copy_only=False)
            columns = [x.slice(0, n) for x in whole[1:]]
            return (first, columns, self.settle(first, columns[: len(self.names)])), [[x.slice(n)] for x in whole]

        for batch in batches:
            if not len(batch[0]):
                continue
            opens = np.flatnonzero(batch[0].to_numpy(zero_copy_only=False))
            held = [[x] for x in batch] if held is None else [h + [x] for h, x in zip(held, batch, strict=True)]
            cut = rows + int(opens[-1]) if len(opens) else 0
            rows += len(batch[0])
            if cut:  # all but the last series are complete
                out, held = settled(cut)
                rows -= cut
                yield out
        if rows:
            yield settled(rows)[0]


def _in_order(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """``_first`` marks a key's first row; the lag makes Spark bring a key's rows together, in the order of ``by``."""
    return df.withColumn("_first", F.lag(F.lit(1)).over(S.ordered(keys, by)).isNull()).sortWithinPartitions(*keys, by)


def series_pass(
    df: DataFrame, keys: Sequence[str], inputs: Mapping[str, Column], outputs: str, fn: Callable[[Block, dict], dict], by: str = "bin", only: Sequence[str] | None = None
) -> DataFrame:
    """Add the columns ``outputs`` (DDL of int, double and arrays of them) that ``fn`` computes of whole series.

    ``fn`` gets a ``Block`` and its inputs as pairs of flat arrays (values, where known) and returns matrices. A series is
    held whole, a task's rows never; other columns stay with their rows. ``only`` names the outputs that are wanted, if not all.
    """
    schema = StructType.fromDDL(outputs)
    schema = StructType([f for f in schema.fields if only is None or f.name in only])
    steps = _Steps(list(inputs), schema, fn, each=True)

    def run(batches):
        for _, _, told in steps.run(batches):
            yield pa.StructArray.from_arrays(list(told.values()), list(told))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    step = F.arrow_udf(run, schema).asNondeterministic()  # it depends on the order of rows, so the sort below it must stay
    df = _in_order(df, keys, by).withColumn("_told", step(F.col("_first"), *inputs.values()))
    kept = [c for c in df.columns if c not in {"_first", "_told", *schema.fieldNames()}]
    return df.select(*[f"`{c}`" for c in kept], *[F.col(f"_told.{c}").alias(c) for c in schema.fieldNames()])


def series_reduce(
    df: DataFrame, keys: Sequence[str], carry: Sequence[str], inputs: Mapping[str, Column], outputs: str, fn: Callable[[Block, dict], dict], by: str = "bin"
) -> DataFrame:
    """One row per series: its keys, the columns ``carry`` of its first row, and what ``fn`` (as in ``series_pass``) makes of the whole series."""
    own = [*keys, *carry]
    made, given = StructType.fromDDL(outputs), len(inputs)
    schema = StructType([*df.select(*own).schema.fields, *made.fields])
    steps = _Steps(list(inputs), made, fn, each=False)
    rows = _in_order(df, keys, by).select("_first", *[c.alias(f"_in{i}") for i, c in enumerate(inputs.values())], *own)

    def run(batches):
        for first, columns, told in steps.run(b.columns for b in batches):
            at = pa.array(np.flatnonzero(first))
            yield pa.RecordBatch.from_arrays([*[x.take(at) for x in columns[given:]], *told.values()], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
