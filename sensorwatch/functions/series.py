"""Windows and order-dependent expressions over one entity's regular grid.

All of them run on binned rows, so a window partition holds at most
(span / interval) rows however many raw readings the entity produced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

ENTITY = ("entity",)


def whole(keys: Sequence[str] = ENTITY):
    return Window.partitionBy(*keys)


def ordered(keys: Sequence[str] = ENTITY, by: str = "bin"):
    return Window.partitionBy(*keys).orderBy(by)


def trailing(n: int, keys: Sequence[str] = ENTITY, by: str = "bin"):
    """The current row and the ``n - 1`` rows before it."""
    return ordered(keys, by).rowsBetween(-(n - 1), 0)


def so_far(keys: Sequence[str] = ENTITY, by: str = "bin"):
    return ordered(keys, by).rowsBetween(Window.unboundedPreceding, 0)


def rolling_total(col: Column, n: int, keys: Sequence[str] = ENTITY, least: int | None = None) -> Column:
    w = trailing(n, keys)
    enough = max(4, n // 2) if least is None else least
    return F.when(F.count(col).over(w) >= enough, F.sum(col).over(w))


def rolling_mean(col: Column, n: int, least: int, keys: Sequence[str] = ENTITY) -> Column:
    w = trailing(n, keys)
    return F.when(F.count(col).over(w) >= least, F.avg(col).over(w))


def median_where(cond: Column | None, col: Column, spec) -> Column:
    return F.percentile(col if cond is None else F.when(cond, col), F.lit(0.5)).over(spec)


def beside(df: DataFrame, needed: Sequence[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` on the ``needed`` columns of ``df``; its other columns travel as one struct and come back in their places.

    Every window and projection copies its rows column by column, so a chain of dozens of windows over a hundred idle
    columns spends its time on copying them.
    """
    columns = df.columns
    idle = [c for c in columns if c not in set(needed)]
    if len(idle) < 2:
        return step(df)
    pack = "_idle" + "_" * sum(c.startswith("_idle") for c in columns)  # a step may itself set columns aside
    out = step(df.select(*[f"`{c}`" for c in columns if c not in set(idle)], F.struct(*[F.col(f"`{c}`") for c in idle]).alias(pack)))
    new, old = out.columns, set(columns)
    back = [F.col(f"`{c}`") if c in set(new) else F.col(f"{pack}.`{c}`").alias(c) for c in columns if c in set(new) or c in set(idle)]
    return out.select(*back, *[f"`{c}`" for c in new if c not in old and c != pack])


TASK_ROWS = 60_000  # a chain of windows sorts its rows several times over, at about 10 kB a row


def spread(df: DataFrame, rows: int, keys: Sequence[str] = ENTITY, most: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by key to as many tasks as ``rows`` need at ``most`` a task, so that a task's sorts don't grow with the table.

    Shuffled bytes, which Spark sizes its partitions by, say little here: sorted series pack well and widen in the task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-rows // most), min(cores, -(-rows // 4000)), 1), *keys)


def add_position(df: DataFrame, keys: Sequence[str] = ENTITY, name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(ordered(keys)) - 1)


def rising(col: str, keys: Sequence[str] = ENTITY, by: str = "bin") -> Column:
    """1 where a 0/1 column turns on."""
    before = F.coalesce(F.lag(col).over(ordered(keys, by)), F.lit(0))
    return ((F.col(col) == 1) & (before == 0)).cast("int")


def add_cusums(df: DataFrame, items: Sequence[tuple], keys: Sequence[str] = ENTITY) -> DataFrame:
    """One-sided CUSUMs as differences of running sums: S = C - min(0, running min of C).

    ``items`` are (evidence column, drift as a number or SQL text, output name); all share two windows.
    """
    w = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    kept = [f"`{c}`" for c in df.columns if c not in {out for *_, out in items}]
    drift = lambda x: x if isinstance(x, str) else f"{float(x)!r}D"
    df = df.selectExpr(*kept, *[f"sum(coalesce({e}, 0D) - {drift(x)}) {w} AS _c_{out}" for e, x, out in items])
    return df.selectExpr(*kept, *[f"_c_{out} - least(0D, min(_c_{out}) {w}) AS {out}" for _, _, out in items])


def add_cusum(df: DataFrame, evidence: str, drift, out: str, keys: Sequence[str] = ENTITY) -> DataFrame:
    return add_cusums(df, [(evidence, drift, out)], keys)


NONE_YET = np.iinfo(np.int64).min


def _last_fired(items: int):
    """Column function (first row of a key?, position, then start and wait of each item) -> struct of the position of each item's
    last fired start before the row.

    One pass over rows that arrive by key and time. All it keeps between rows is the last fired position of each item, and
    only rows with a start cost a step in Python.
    """

    def run(batches):
        held = [NONE_YET] * items
        for first, pos, *pairs in batches:
            opens, at = np.flatnonzero(first.to_numpy(zero_copy_only=False)), pos.to_numpy(zero_copy_only=False).astype(np.int64)
            told = []
            for k in range(items):
                start, wait = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in pairs[2 * k : 2 * k + 2])
                rows = np.flatnonzero(start == 1)
                fired, last, key = [], held[k], 0
                for i, p, w, own in zip(rows.tolist(), at[rows].tolist(), wait[rows].tolist(), np.searchsorted(opens, rows, "right").tolist(), strict=True):
                    if own != key:
                        last, key = NONE_YET, own
                    if last == NONE_YET or p - last > w:
                        fired.append(i)
                        last = p
                hit = np.array(fired, np.int64)
                value, given = np.full(len(at) + 1, held[k]), np.zeros(len(at) + 1, bool)
                value[hit + 1], value[opens] = at[hit], NONE_YET
                given[hit + 1] = given[opens] = given[0] = True
                value = value[np.maximum.accumulate(np.where(given, np.arange(len(given)), 0))]
                held[k] = int(value[-1])
                told.append(pa.array(value[:-1], mask=value[:-1] == NONE_YET))
            yield pa.StructArray.from_arrays(told, [f"last{k}" for k in range(items)])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    schema = StructType([StructField(f"last{k}", LongType()) for k in range(items)])
    return F.arrow_udf(run, schema).asNondeterministic()  # it depends on the order of rows, so the sort below it must stay


def add_cooldowns(df: DataFrame, items: Sequence[tuple], keys: Sequence[str] = ENTITY, pos: str = "pos", last: bool = False) -> DataFrame:
    """Let a start fire only when the last fired one is more than ``wait`` bins away.

    ``items`` are (start column, wait in bins, output name). One ordered pass serves all of them: linear in the rows, with one
    position per item as its state. The lag below it makes Spark bring a key's rows together. ``last`` keeps the
    position of the last fired start before each row as ``_last_<output>``.
    """
    df = df.withColumn("_first", F.lag(pos).over(ordered(keys)).isNull()).sortWithinPartitions(*keys, "bin")
    items = [(start, F.expr(wait) if isinstance(wait, str) else wait if isinstance(wait, Column) else F.lit(wait), out) for start, wait, out in items]
    pairs = [c for start, wait, _ in items for c in (F.col(start).cast("int"), wait.cast("long"))]
    df = df.withColumn("_fired", _last_fired(len(items))(F.col("_first"), F.col(pos).cast("long"), *pairs))
    before = {f"_last_{out}": F.col(f"_fired.last{k}") for k, (_, _, out) in enumerate(items)}
    df = df.withColumns(before).drop("_fired", "_first")
    free = {out: F.coalesce(F.col(pos) - F.col(f"_last_{out}") > wait, F.lit(True)) for _, wait, out in items}
    df = df.withColumns({out: F.when(F.col(start) == 1, free[out].cast("int")).otherwise(F.lit(0)) for start, _, out in items})
    return df if last else df.drop(*before)


def add_cooldown(
    df: DataFrame, start: str, wait: int | Column, out: str, keys: Sequence[str] = ENTITY, pos: str = "pos"
) -> DataFrame:
    return add_cooldowns(df, [(start, wait, out)], keys, pos)


def add_prior_event(
    df: DataFrame, start: str, least: int, most: int, out: str, keys: Sequence[str] = ENTITY
) -> DataFrame:
    """1 where some start lies between ``most`` and ``least`` bins earlier (never the row itself)."""
    w = ordered(keys).rowsBetween(-most, -max(1, least))
    return df.withColumn(out, F.coalesce(F.max(start).over(w), F.lit(0)).cast("int"))


def add_islands(df: DataFrame, flag_col: str, out: str, keys: Sequence[str] = ENTITY, by: str = "bin") -> DataFrame:
    """Number the runs of consecutive 1s of a flag (NULL outside runs)."""
    return (
        df.withColumn("_on", rising(flag_col, keys, by))
        .withColumn(out, F.when(F.col(flag_col) == 1, F.sum("_on").over(so_far(keys, by))))
        .drop("_on")
    )
