"""Chronological reference period of each entity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorwatch.functions import blocks as B
from sensorwatch.functions import series as S

MIN_TRAIN = 30
BASE = ("_base", "_future")


def add_split(
    df: DataFrame,
    ratio: float | None = 0.6,
    coverage_min_pct: float = 25.0,
    warmup_bins: int = 3,
    keys: Sequence[str] = S.ENTITY,
) -> DataFrame:
    """Label bins ``baseline``/``futur``/``excluded`` (``all``/``excluded`` without a ratio).

    Candidates are well-covered bins from the end of the first warm-up streak
    on; an entity without any falls back to its covered bins, then to all bins.
    """
    w, e = S.whole(keys), S.ordered(keys)
    valid = F.coalesce(F.col("coverage_pct") >= coverage_min_pct, F.lit(False)) if "coverage_pct" in df.columns else F.lit(True)
    df = S.add_position(df, keys).withColumn("_ok", valid.cast("int"))
    streak = F.sum("_ok").over(S.trailing(max(1, warmup_bins), keys))
    df = df.withColumn("_warm", (streak >= max(1, warmup_bins)).cast("int"))
    df = df.withColumn("_first", F.min(F.when(F.col("_warm") == 1, F.col("pos"))).over(w))
    df = df.withColumn(
        "_cand", F.when((F.col("_ok") == 1) & (F.coalesce(F.col("pos") >= F.col("_first"), F.lit(True))), 1).otherwise(0)
    )
    df = df.withColumn("_n_cand", F.sum("_cand").over(w)).withColumn("_n_ok", F.sum("_ok").over(w))
    df = df.withColumn(
        "train_candidate",
        F.when(F.col("_n_cand") > 0, F.col("_cand")).when(F.col("_n_ok") > 0, F.col("_ok")).otherwise(1),
    )
    if ratio is None:
        df = df.withColumn("dataset_split", F.when(F.col("train_candidate") == 1, "all").otherwise("excluded"))
        df = df.withColumn("train_point", F.col("train_candidate"))
    else:
        share = min(0.95, max(0.05, float(ratio)))
        df = df.withColumn("_n", F.sum("train_candidate").over(w)).withColumn(
            "_rank", F.sum("train_candidate").over(S.so_far(keys))
        )
        n_train = F.least(F.greatest(F.lit(MIN_TRAIN), F.rint(F.col("_n") * share).cast("int")), F.col("_n"))
        df = df.withColumn(
            "dataset_split",
            F.when(F.col("train_candidate") == 0, "excluded").when(F.col("_rank") <= n_train, "baseline").otherwise("futur"),
        ).withColumn("train_point", (F.col("dataset_split") == "baseline").cast("int"))
    return df.drop("_ok", "_warm", "_first", "_cand", "_n_cand", "_n_ok", "_n", "_rank")


def add_reference_masks(
    df: DataFrame, only_if_missing: bool, keys: Sequence[str] = S.ENTITY, names: tuple[str, str] = BASE
) -> DataFrame:
    """Boolean columns ``names`` from the split labels, or from the first 60 % of the bins.

    ``only_if_missing`` keeps labels whenever the column exists; otherwise an
    entity whose labels lack a baseline or a future also falls back.
    """
    w = S.whole(keys)
    if "pos" not in df.columns:
        df = S.add_position(df, keys)
    cut = F.greatest(F.lit(MIN_TRAIN), F.rint(F.count(F.lit(1)).over(w) * 0.60).cast("int"))
    if "dataset_split" not in df.columns:
        return df.withColumn(names[0], F.col("pos") < cut).withColumn(names[1], ~F.col(names[0]))
    base = F.coalesce(F.col("dataset_split") == "baseline", F.lit(False))
    future = F.coalesce(F.col("dataset_split") == "futur", F.lit(False))
    if only_if_missing:
        return df.withColumns({names[0]: base, names[1]: future})
    df = df.withColumns(
        {
            "_cut": cut,
            "_usable": (F.max(base.cast("int")).over(w) + F.max(future.cast("int")).over(w)) == 2,
        }
    )
    return df.withColumns(
        {
            names[0]: F.when(F.col("_usable"), base).otherwise(F.col("pos") < F.col("_cut")),
            names[1]: F.when(F.col("_usable"), future).otherwise(F.col("pos") >= F.col("_cut")),
        }
    ).drop("_cut", "_usable")


def _over(keys: Sequence[str], *more: str, order: str | None = None) -> str:
    by = ", ".join((*keys, *more))
    return f"OVER (PARTITION BY {by}{f' ORDER BY {order}' if order else ''})"


def add_expected(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = S.ENTITY, mask: dict[str, str] | None = None, extra: Sequence[str] = ()
) -> DataFrame:
    """``_exp_<col>``: baseline median of the same slot of day, else of the whole baseline, else of all rows.

    The expressions are written as SQL text: there are dozens per column, and
    text reaches the JVM in one call.
    """
    whole, slot = _over(keys), _over(keys, "hour(bin) * 60 + minute(bin)")
    exprs = []
    for c in cols:
        known = f"CASE WHEN {(mask or {}).get(c, '_base')} THEN {c} END"
        exprs += [f"percentile({known}, 0.5D) {slot} AS _slot_{c}", f"percentile({known}, 0.5D) {whole} AS _med_{c}", f"percentile({c}, 0.5D) {whole} AS _all_{c}"]
    kept = [f"`{c}`" for c in df.columns]
    df = df.selectExpr("*", *exprs, *extra)
    names = [e.rsplit(" AS ", 1)[1] for e in extra]
    return df.selectExpr(*kept, *names, *[f"coalesce(_slot_{c}, _med_{c}, _all_{c}, 0D) AS _exp_{c}" for c in cols])


def add_reference_ratios(
    df: DataFrame, cols: Sequence[str], day_bins: int, keys: Sequence[str] = S.ENTITY, high: Sequence[str] = (),
    mask: dict[str, str] | None = None,
) -> DataFrame:
    """``_ratio_<col>``: the column against its expectation and against the same time yesterday.

    The smaller of the two ratios is kept (the larger for columns in ``high``),
    so one unusual reference alone cannot create a change. Denominators are held
    above 5 % of their typical positive value, ratios within [0, 3].
    """
    kept, whole = [f"`{c}`" for c in df.columns], _over(keys)
    lags = [f"lag({c}, {day_bins}) {_over(keys, order='bin')} AS _lag_{c}" for c in cols]
    df = add_expected(df, cols, keys, mask, lags)
    refs = [f"_{kind}_{c}" for c in cols for kind in ("exp", "lag")]
    df = df.selectExpr("*", *[f"percentile(CASE WHEN {r} > 0 THEN {r} END, 0.5D) {whole} AS _mid{r}" for r in refs])
    df = df.selectExpr("*", *[f"CASE WHEN _mid{r} IS NULL THEN 1D ELSE greatest(1e-6D, _mid{r} * 0.05D) END AS _fl{r}" for r in refs])
    df = df.selectExpr(*kept, *refs, *[f"{c} / CASE WHEN {r} < _fl{r} THEN _fl{r} ELSE {r} END AS _q{r}" for c in cols for r in (f"_exp_{c}", f"_lag_{c}")])

    def held(q: str) -> str:
        return f"CASE WHEN {q} < 0D THEN 0D WHEN {q} > 3D THEN 3D ELSE {q} END"

    return df.selectExpr(
        *kept, *[f"{'greatest' if c in high else 'least'}({held(f'_q_exp_{c}')}, {held(f'_q_lag_{c}')}) AS _ratio_{c}" for c in cols]
    )


def reference_inputs(df: DataFrame) -> dict[str, Column]:
    """What ``masks`` and ``reference_ratio`` read of a table with positions."""
    split = F.col("dataset_split") if "dataset_split" in df.columns else F.lit("")
    code = F.when(split == "baseline", 1).when(split == "futur", 2).when(split == "", -1).otherwise(0)
    return {"pos": F.col("pos").cast("long"), "slot": F.hour("bin") * 60 + F.minute("bin"), "split": code}


def masks(b: B.Block, given: dict, only_if_missing: bool, labelled: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``add_reference_masks`` of a block."""
    pos, split = b.whole(given["pos"]), b.whole(given["split"])
    early = pos < np.maximum(MIN_TRAIN, np.rint(b.lengths * 0.60))
    if not labelled:
        return early & b.there, ~early & b.there
    base, future = split == 1, split == 2
    usable = only_if_missing | (base.any(axis=1, keepdims=True) & future.any(axis=1, keepdims=True))
    return np.where(usable, base, early) & b.there, np.where(usable, future, ~early) & b.there


def positive_floor(v: B.Known) -> np.ndarray:
    """5 % of the typical positive value of a series (1e-6 at least); 1 when none is positive."""
    typical = B.percentile(v.where(~(v.x <= 0)))
    return np.where(typical.ok, np.maximum(1e-6, typical.x * 0.05), 1.0)


def reference_ratio(b: B.Block, v: B.Known, base: np.ndarray, slots: B.Slots, day_bins: int, high: bool = False) -> B.Known:
    """``add_reference_ratios`` of a block's column."""
    known = v.where(base)
    slot, median, every = slots.median(known), B.percentile(known), B.percentile(v)
    usual = np.where(slot.ok, slot.x, np.where(median.ok, median.x, np.where(every.ok, every.x, 0.0)))
    ratios = []
    for ref in (B.Known(usual, b.there), B.lag(v, day_bins)):
        floor = positive_floor(ref)
        ratios.append((v / B.Known(np.where(ref.x < floor, floor, ref.x), ref.ok)).held(0.0, 3.0))
    own, day = ratios
    both = np.maximum(own.x, day.x) if high else np.minimum(own.x, day.x)
    return B.Known(np.where(own.ok & day.ok, both, np.where(own.ok, own.x, day.x)), own.ok | day.ok)


def _split_labels(b: B.Block, coverage: B.Known, ratio: float, coverage_min_pct: float, warmup_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(train candidates, 1 for baseline, 2 for futur, 0 for excluded) as ``add_split`` labels them."""
    ok = coverage.at_least(coverage_min_pct)
    warm = B.total(B.Known(ok.astype(float), b.there), max(1, warmup_bins), 0).x >= max(1, warmup_bins)
    warm &= b.there
    first = np.where(warm.any(axis=1, keepdims=True), warm.argmax(axis=1)[:, None], 0)
    late = ok & (np.arange(b.shape[1]) >= first)
    has = lambda x: x.any(axis=1, keepdims=True)
    train = np.where(has(late), late, np.where(has(ok), ok, True)) & b.there
    n = train.sum(axis=1, keepdims=True)
    n_train = np.minimum(np.maximum(MIN_TRAIN, np.rint(n * min(0.95, max(0.05, float(ratio))))), n)
    return train, np.where(~train, 0, np.where(np.cumsum(train, axis=1) <= n_train, 1, 2))


def coverage_and_split(
    df: DataFrame, keys: Sequence[str] = S.ENTITY, ratio: float = 0.6, coverage_min_pct: float = 25.0, warmup_bins: int = 3
) -> DataFrame:
    """``add_split`` of ``add_coverage`` in one pass over whole series."""

    def fn(b: B.Block, given: dict) -> dict:
        n = b.known(given["n"])
        some = n.where(n.x != 0)
        half, most = B.percentile(some), B.percentile(some, 0.8)
        usual = np.where(half.ok, np.maximum(np.minimum(half.x, most.x), 1.0), 1.0)
        coverage = np.where(n.ok, np.minimum(n.x / usual, 1.0), 1.0) * 100.0
        train, label = _split_labels(b, B.Known(coverage, b.there), ratio, coverage_min_pct, warmup_bins)
        return {"expected_raw_per_bin": usual, "coverage_pct": coverage, "pos": np.arange(b.shape[1])[None, :], "train_candidate": train, "_label": label}

    outputs = "expected_raw_per_bin double, coverage_pct double, pos int, train_candidate int, _label int"
    df = S.beside(df, [*keys, "bin", "n_raw_samples"], lambda own: B.series_pass(own, keys, {"n": F.col("n_raw_samples").cast("double")}, outputs, fn))
    label = F.when(F.col("_label") == 1, "baseline").when(F.col("_label") == 2, "futur").otherwise("excluded")
    return df.withColumns({"dataset_split": label, "train_point": (F.col("_label") == 1).cast("int")}).drop("_label")


def heldout_start(df: DataFrame, keys: Sequence[str] = S.ENTITY) -> DataFrame:
    return df.where(F.col("dataset_split") == "futur").groupBy(*keys).agg(F.min("bin").alias("heldout_start"))
