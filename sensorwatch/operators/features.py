"""Robust per-entity features on the regular grid."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from sensorwatch.config import interval_minutes
from sensorwatch.functions import series as S
from sensorwatch.operators import grid as G

# Fixed values of the robust scale estimates.
MAD_TO_SIGMA = 1.4826
IQR_TO_SIGMA = 1.349
TINY = 1e-9


def log_level(col: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(col, F.lit(0.0)), F.lit(0.0)))


def base_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith(("_sum", "_mean", "_sum_log", "_mean_log"))]


# A feature family is a list of layers, each a list of "expression AS name"
# texts that only need the layers before. Families are run side by side, so
# expressions of one layer share their windows.


def run_layers(df: DataFrame, families: Sequence[list[list[str]]]) -> DataFrame:
    """Add the layers of all families; only names without a leading underscore are kept."""
    kept = list(df.columns)
    for layer in zip_longest(*families, fillvalue=[]):
        exprs = [e for part in layer for e in part]
        if exprs:
            df = df.selectExpr("*", *exprs)
    return df.select(*kept, *[c for c in df.columns if c not in set(kept) and not c.startswith("_")])


def _over(keys: Sequence[str], n: int | None = None, order: bool = True) -> str:
    rows = f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if n else ""
    return f"OVER (PARTITION BY {', '.join(keys)}{' ORDER BY bin' if order else ''}{rows})"


def _quantile(a: str, q: float) -> str:
    """Linearly interpolated quantile of a sorted array."""
    at = f"{q}D * (size({a}) - 1)"
    low = f"CAST(floor({at}) AS INT)"
    base = f"get({a}, {low})"
    return f"({base} + (coalesce(get({a}, {low} + 1), {base}) - {base}) * ({at} - {low}))"


def rolling_z_layers(cols: Sequence[str], window: int, keys: Sequence[str]) -> list[list[str]]:
    """``<col>_rrz``: deviation from the trailing window's median in MAD units (IQR, then std as fallbacks).

    The window's values arrive once per column as a sorted array, from which all
    three quartiles are read; a sliding ``percentile`` would rebuild its
    histogram three times per row.
    """
    w, enough = _over(keys, window), max(5, window // 4)
    first, second, third, fourth, last = [], [], [], [], []
    for c in cols:
        ready = f"CASE WHEN size(_a_{c}) >= {enough} THEN"
        first += [f"sort_array(collect_list({c}) {w}) AS _a_{c}", f"stddev_samp({c}) {w} AS _sd_{c}"]
        second += [
            f"{ready} {_quantile(f'_a_{c}', 0.5)} END AS _med_{c}",
            f"{ready} ({_quantile(f'_a_{c}', 0.75)} - {_quantile(f'_a_{c}', 0.25)}) / {IQR_TO_SIGMA}D END AS _iqr_{c}",
        ]
        third.append(f"sort_array(collect_list(abs({c} - _med_{c})) {w}) AS _b_{c}")
        fourth.append(f"CASE WHEN size(_b_{c}) >= {enough} THEN {_quantile(f'_b_{c}', 0.5)} * {MAD_TO_SIGMA}D END AS _mad_{c}")
        dev = f"({c} - _med_{c})"
        last.append(
            f"coalesce(CASE WHEN _mad_{c} >= {TINY}D THEN {dev} / _mad_{c} ELSE {dev} / nullif(_iqr_{c}, 0D) END, "
            f"CASE WHEN size(_a_{c}) >= {enough} THEN {dev} / nullif(_sd_{c}, 0D) END, 0D) AS {c}_rrz"
        )
    return [first, second, third, fourth, last]


def global_z_layers(cols: Sequence[str], keys: Sequence[str]) -> list[list[str]]:
    """``<col>_rz``: deviation from the entity median in MAD units (IQR, then std as fallbacks)."""
    w = _over(keys, order=False)
    first, third, last = [], [], []
    for c in cols:
        first += [
            f"percentile({c}, array(0.25D, 0.5D, 0.75D)) {w} AS _q_{c}",
            f"stddev_pop({c}) {w} AS _sp_{c}", f"count({c}) {w} AS _n_{c}",
        ]
        third.append(f"percentile(abs({c} - _q_{c}[1]), 0.5D) {w} * {MAD_TO_SIGMA}D AS _gm_{c}")
        iqr = f"(_q_{c}[2] - _q_{c}[0])"
        scale = (
            f"CASE WHEN _gm_{c} >= {TINY}D THEN _gm_{c} WHEN _n_{c} >= 5 AND {iqr} > {TINY}D THEN {iqr} / {IQR_TO_SIGMA}D "
            f"WHEN _sp_{c} > {TINY}D THEN _sp_{c} ELSE 1D END"
        )
        last.append(f"coalesce(({c} - _q_{c}[1]) / ({scale}), 0D) AS {c}_rz")
    return [first, [], third, [], last]


def difference_layers(cols: Sequence[str], interval: str, keys: Sequence[str]) -> list[list[str]]:
    """First difference (also per hour), 7-bin mean and the deviation from it."""
    hours, w, e = interval_minutes(interval) / 60.0, _over(keys, 7), _over(keys)
    first = [
        x
        for c in cols
        for x in (f"{c} - lag({c}) {e} AS {c}_d1", f"CASE WHEN count({c}) {w} >= 3 THEN avg({c}) {w} END AS {c}_mm7")
    ]
    last = [x for c in cols for x in (f"{c}_d1 / {hours}D AS {c}_d1_per_hour", f"{c} - {c}_mm7 AS {c}_vs_mm7")]
    return [first, [], [], [], last]


def add_global_z(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = S.ENTITY) -> DataFrame:
    return run_layers(df, [global_z_layers(cols, keys)])


def add_rolling_z(df: DataFrame, cols: Sequence[str], window: int, keys: Sequence[str] = S.ENTITY) -> DataFrame:
    return run_layers(df, [rolling_z_layers(cols, window, keys)])


def add_differences(df: DataFrame, cols: Sequence[str], interval: str, keys: Sequence[str] = S.ENTITY) -> DataFrame:
    return run_layers(df, [difference_layers(cols, interval, keys)])


def add_log_levels(df: DataFrame) -> DataFrame:
    logs = {f"{c}_log": log_level(F.col(c)) for c in ("motion_sum", "motion_mean") if c in df.columns}
    return df.withColumns(logs) if logs else df


def feature_pass(cols: Sequence[str], interval: str, window: int):
    """Function adding the rolling scores, differences and whole-entity scores of one entity's bins, array-wise.

    The same features as the layers above; each window is a row of a strided view, so
    twenty columns cost a few array sorts instead of two sorted lists per bin and column.
    """
    hours, enough = interval_minutes(interval) / 60.0, max(5, window // 4)

    def windows(x, n):
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)

    def quantiles(rows, *shares):
        """Interpolated quantiles of every row's known values, and their number."""
        rows = np.sort(rows, axis=1)  # unknown values last
        size = (~np.isnan(rows)).sum(axis=1)
        at = [q * np.maximum(size - 1, 0) for q in shares]
        low = [np.floor(x).astype(int) for x in at]
        take = lambda i: np.take_along_axis(rows, np.minimum(i, rows.shape[1] - 1)[:, None], axis=1)[:, 0]
        out = []
        for x, i in zip(at, low, strict=True):
            base, after = take(i), take(i + 1)
            out.append(base + (np.where(i + 1 < size, after, base) - base) * (x - i))
        return out, size

    def safe(num, den):
        return np.divide(num, den, out=np.full(len(num), np.nan), where=~np.isnan(den) & (den != 0))

    def spread(rows, size, ddof):
        mean = np.nansum(rows, axis=1) / np.maximum(size, 1)
        square = np.nansum((rows - mean[:, None]) ** 2, axis=1)
        return np.where(size > ddof, np.sqrt(square / np.maximum(size - ddof, 1)), np.nan)

    def rolling(x):
        rows = windows(x, window)
        (q1, med, q3), size = quantiles(rows, 0.25, 0.5, 0.75)
        ready = size >= enough
        med, iqr = np.where(ready, med, np.nan), np.where(ready, (q3 - q1) / IQR_TO_SIGMA, np.nan)
        (mad,), known = quantiles(windows(np.abs(x - med), window), 0.5)
        mad = np.where(known >= enough, mad * MAD_TO_SIGMA, np.nan)
        dev = x - med
        z = np.where(mad >= TINY, safe(dev, mad), safe(dev, iqr))
        z = np.where(np.isnan(z) & ready, safe(dev, spread(rows, size, 1)), z)
        return np.where(np.isnan(z), 0.0, z)

    def overall(x):
        (q1, med, q3), size = quantiles(x[None, :], 0.25, 0.5, 0.75)
        (gm,), _ = quantiles(np.abs(x - med)[None, :], 0.5)
        gm, iqr, sp = gm[0] * MAD_TO_SIGMA, q3[0] - q1[0], spread(x[None, :], size, 0)[0]
        scale = gm if gm >= TINY else iqr / IQR_TO_SIGMA if size[0] >= 5 and iqr > TINY else sp if sp > TINY else 1.0
        z = (x - med) / scale
        return np.where(np.isnan(z), 0.0, z)

    def add(bins: pa.Table) -> pa.Table:
        bins = bins.sort_by("bin")
        values = {c: bins.column(c).to_numpy().astype(float) for c in cols}
        new: dict[str, np.ndarray] = {}
        for c, x in values.items():
            seven = windows(x, 7)
            known = (~np.isnan(seven)).sum(axis=1)
            new[f"{c}_d1"] = np.diff(x, prepend=np.nan)
            new[f"{c}_mm7"] = np.where(known >= 3, np.nansum(seven, axis=1) / np.maximum(known, 1), np.nan)
        new |= {f"{c}_rrz": rolling(x) for c, x in values.items()}
        for c, x in values.items():
            new[f"{c}_d1_per_hour"], new[f"{c}_vs_mm7"] = new[f"{c}_d1"] / hours, x - new[f"{c}_mm7"]
        new |= {f"{c}_rz": overall(x) for c, x in values.items()}
        for name, x in new.items():
            bins = bins.append_column(name, pa.array(x, from_pandas=True))
        return bins

    return add


def feature_names(cols: Sequence[str]) -> list[str]:
    """Columns that ``feature_pass`` adds, in order."""
    pairs = [f"{c}_{x}" for c in cols for x in ("d1", "mm7")]
    more = [f"{c}_{x}" for c in cols for x in ("d1_per_hour", "vs_mm7")]
    return [*pairs, *[f"{c}_rrz" for c in cols], *more, *[f"{c}_rz" for c in cols]]


def interval_features(
    raw: DataFrame, interval: str = "15T", window: int = 24, keys: Sequence[str] = S.ENTITY
) -> DataFrame:
    """Full feature table: grid, coverage, robust scores, differences, calendar."""
    df = G.add_coverage(add_log_levels(G.regular_grid(raw, interval, keys)), keys)
    cols = base_columns(df)
    if cols:
        schema = StructType(list(df.schema.fields))
        for name in feature_names(cols):
            schema = schema.add(name, DoubleType())
        df = df.groupBy(*keys).applyInArrow(feature_pass(cols, interval, window), schema)
    return G.add_calendar(df)
