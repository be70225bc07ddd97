"""Sweeps as lanes: many settings of the branches over one copy of each series.

A setting is a lane, an element of array columns, not another copy of the rows. All lanes share
the exchange, the sort and the windows of their series: every lane's running sums, persistence
and starts are further columns of the same window. Ratios are computed once per distinct
aggregation length. The lanes of the fusion, and the evaluation of all lanes, are each one pass over whole series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorwatch.config import FusionConfig, HypoConfig, InstabilityConfig, bins, interval_minutes
from sensorwatch.functions import blocks as B
from sensorwatch.functions import series as S
from sensorwatch.operators import evaluate as E
from sensorwatch.operators import fusion as FU
from sensorwatch.operators import hypo as H
from sensorwatch.operators import instability as I
from sensorwatch.operators.baseline import add_reference_masks, add_reference_ratios, masks

LANES = ("episodes", "starts", "scores")


def _drop_changes(df: DataFrame, interval: str, lengths: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """``warning_change_<family>_<n>`` and ``warning_ratio_<signal>_<n>`` for every aggregation length ``n``."""
    df = df if "pos" in df.columns else S.add_position(df, keys)
    totals = {f"{c}_{n}": total for n in lengths for c, total in H.drop_totals(df, [n], keys).items()}
    df = df.withColumns(totals)
    df = add_reference_ratios(df, list(totals), bins(24, interval, 4), keys, high=[c for c in totals if c.startswith("_t_lying")])
    for n in lengths:
        own = {c: c.removesuffix(f"_{n}") for c in df.columns if c.startswith(("_t_", "_ratio__t_")) and c.endswith(f"_{n}") and c.removesuffix(f"_{n}").rsplit("_", 1)[-1] in H.SIGNALS}
        before = set(df.columns)
        df = H.drop_changes(df.withColumnsRenamed(own))
        df = df.withColumnsRenamed({c: f"{c}_{n}" for c in df.columns if c not in before and c.startswith("warning_")})
    return df


def drop_lanes(df: DataFrame, interval: str, configs: Mapping[str, HypoConfig], keys: Sequence[str] = S.ENTITY, notify: bool = False) -> DataFrame:
    """Rows of ``df`` with arrays ``episodes``, ``starts``, ``scores`` and, if asked for, ``notifications``: an element per configuration."""
    return S.beside(df, [*keys, *H.BRANCH_INPUTS], lambda own: _drop_lanes(own, interval, configs, keys, notify))


def _drop_lanes(df: DataFrame, interval: str, configs: Mapping[str, HypoConfig], keys: Sequence[str], notify: bool) -> DataFrame:
    kept = df.columns
    lengths = {name: bins(c.aggregation_hours, interval, 4) for name, c in configs.items()}
    df = add_reference_masks(df, only_if_missing=False, keys=keys)
    df = _drop_changes(df, interval, sorted(set(lengths.values())), keys)
    names = [f"lane{i}" for i in range(len(configs))]
    df = H.add_stages(df, [(p, H.candidate_stages(df, interval, c, keys, prefix=p, changes=f"_{lengths[name]}")) for p, (name, c) in zip(names, configs.items(), strict=True)])
    streams = [
        H.AlertStream(p, c.cusum_drift, c.cusum_threshold, H.PERSISTENCE_SHARE, [bins(c.persistence_hours, interval, 2)], None, bins(c.cooldown_hours, interval, 1))
        for p, c in zip(names, configs.values(), strict=True)
    ]
    df = H.finish_alerts(df, streams, keys, notify)
    packed = [f"array({', '.join(f'{p}_{out}' for p in names)}) AS {out}s" for out in ("episode", "start", "score", *["notification"] * notify)]
    return df.selectExpr(*[f"`{c}`" for c in kept], *packed)


def fusion_lanes(
    df: DataFrame, interval: str, runs: Mapping[str, tuple[InstabilityConfig, FusionConfig]], hypo: HypoConfig = HypoConfig(), keys: Sequence[str] = S.ENTITY, notify: bool = False
) -> DataFrame:
    """Rows of ``df`` with lanes of the instability stream (``instability_<lanes>``) and of the fused one (``hybrid_<lanes>``).

    The drop branch runs once, the instability branch once per distinct setting, the fusion per run.
    """
    return S.beside(df, [*keys, *H.BRANCH_INPUTS], lambda own: _fusion_lanes(own, interval, runs, hypo, keys, notify))


def _fusion_lanes(
    df: DataFrame, interval: str, runs: Mapping[str, tuple[InstabilityConfig, FusionConfig]], hypo: HypoConfig, keys: Sequence[str], notify: bool
) -> DataFrame:
    df = df if "pos" in df.columns else S.add_position(df, keys)
    labelled, distinct = "dataset_split" in df.columns, list(dict.fromkeys(c for c, _ in runs.values()))
    lengths = [bins(c.aggregation_hours, interval, 4) for c in distinct]

    def fn(b: B.Block, given: dict) -> dict:
        slots = B.Slots(b, given["slot"][0])
        base, future = masks(b, given, False, labelled)
        base_i, future_i = masks(b, given, True, labelled)
        drop = H.drop_evidence(b, given, interval, hypo, base, future, slots)
        told = H.alerts(b, drop, H.drop_stream(interval, hypo))
        h, hs, drop_score = told["episode"], told["start"], drop.columns["behavioral_warning_score"]
        changes = {n: I.excesses(b, given, interval, n, base_i, slots) for n in dict.fromkeys(lengths)}
        other = {}
        for cfg, n in zip(distinct, lengths, strict=True):
            own = I.decided(b, given, changes[n], cfg, future_i)
            x = H.alerts(b, own, I.instability_stream(interval, cfg))
            other[cfg] = (x["episode"], x["start"], own.columns["instability_warning_score"], B.rising(h & x["episode"]))
        out = {f"{label}_{x}": [] for label in ("instability", "hybrid") for x in LANES}
        for cfg, fusion in runs.values():
            i, i_start, score, mixed = other[cfg]
            seq = hs & B.within(i_start, *FU.sequence_reach(interval, fusion))
            episode, start = FU.fused(fusion.mode.upper(), h, hs, i, i_start, seq, mixed, FU.any_of)
            for label, lane in (("instability", (i, i_start, score)), ("hybrid", (episode, start, np.maximum(drop_score, score)))):
                for x, value in zip(LANES, lane, strict=True):
                    out[f"{label}_{x}"].append(value)
        if notify:
            waits = [bins(fusion.cooldown_hours, interval, 1) for _, fusion in runs.values()]
            out["hybrid_notifications"] = [B.fired(x, b.whole(given["pos"]), wait) for x, wait in zip(out["hybrid_starts"], waits, strict=True)]
        return out

    kinds = dict(zip(LANES, ("array<int>", "array<int>", "array<double>"), strict=True))
    outputs = ", ".join([*[f"{label}_{x} {kind}" for label in ("instability", "hybrid") for x, kind in kinds.items()], *["hybrid_notifications array<int>"] * notify])
    return B.series_pass(df, keys, H.branch_inputs(df), outputs, fn)


def reference_lanes(clean: DataFrame, interval: str, lanes: Sequence[str] = LANES[:2], keys: Sequence[str] = S.ENTITY, tolerance_hours: float = E.MATCH_TOLERANCE_HOURS) -> DataFrame:
    """An untouched run as events are held against it: (keys, bin, ``ref_episodes``, ``near_starts``), the latter 1 where a start
    lies within the tolerance."""
    episodes, starts = lanes
    reach = int(tolerance_hours * 60 // interval_minutes(interval))
    near = S.ordered(keys).rowsBetween(-reach, reach)
    n = F.size(starts)
    around = F.flatten(F.collect_list(F.filter(F.transform(F.col(starts), lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())).over(near))  # lanes that start nearby
    marked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains("_near", i).cast("int"))
    rows = clean.select(*keys, "bin", F.col(episodes).alias("ref_episodes"), starts, around.alias("_near"))
    return rows.select(*keys, "bin", "ref_episodes", marked.alias("near_starts"))


def evaluated(
    df: DataFrame, reference: DataFrame, interval: str, names: Sequence[str], keys: Sequence[str] = ("entity", "event_id"),
    carry: Sequence[str] = (), lanes: Sequence[str] | Mapping[str, Sequence[str]] = LANES, clean_keys: Sequence[str] = S.ENTITY, size: int | None = None,
) -> DataFrame:
    """One row per (event, configuration) with the measures of ``evaluate.attributable``.

    ``df`` holds every bin of every adjusted series with its window (``start``, ``end``; at least one bin of
    the series) and lanes; ``reference`` is ``reference_lanes`` of the untouched run. Several streams are evaluated side by side if
    ``lanes`` names them: prefix -> lanes, with the prefix before the columns of ``reference`` and before the measures. With ``size``,
    the number of rows of ``df``, the tasks are as many as its rows need, those of the join with ``reference`` too: lanes pack to a
    few bytes a row, so Spark would send the untouched run of whole tables around, or deal it to tasks by its packed size.
    """
    streams, bin_s = lanes if isinstance(lanes, Mapping) else {"": lanes}, interval_minutes(interval) * 60
    if size is not None:
        df, reference = (S.spread(x, size, (*clean_keys, "bin")) for x in (df, reference))
        reference = reference.hint("merge")
    rows = df.join(reference, [*clean_keys, "bin"], "left")
    rows = rows if size is None else S.spread(rows, size, keys)
    inputs = E.event_inputs()
    for p, (episodes, starts, scores) in streams.items():
        whole = {"ep": episodes, "st": starts, "ref": f"{p}ref_episodes", "near": f"{p}near_starts"}
        inputs |= {f"{p}{x}": F.col(c).cast("array<int>") for x, c in whole.items()} | {f"{p}score": F.col(scores).cast("array<double>")}

    def fn(b: B.Block, given: dict) -> dict:
        window = E.EventWindow(b, given, bin_s)
        out: dict[str, list] = {"_kept": []}
        for i in range(len(names)):
            kept = True
            for p in streams:
                own = {x: (given[f"{p}{x}"][0][:, i], given[f"{p}{x}"][1]) if given[f"{p}{x}"][0].shape[1] else (np.zeros(len(b.row), int), given[f"{p}{x}"][1]) for x in ("ep", "st", "ref", "near", "score")}
                ep, st, ref, near = (b.whole(own[x]) == 1 for x in ("ep", "st", "ref", "near"))
                for m, x in window.measures(ep, st, ref, near, b.known(own["score"])).items():
                    out.setdefault(f"{p}{m}", []).append(x)
                kept = kept & (window.inside | ep).any(axis=1, keepdims=True)
            out["_kept"].append(kept)
        return out

    outputs = ", ".join(["_kept array<int>", *[f"{p}{m} array<{kind}>" for p in streams for m, kind in E.MEASURES.items()]])
    told = B.series_reduce(rows, keys, carry, inputs, outputs, fn)
    measures = [f"{p}{m}" for p in streams for m in E.MEASURES]
    config = F.array(*[F.lit(n) for n in names]).alias("config")
    each = told.select(*keys, *carry, F.explode(F.arrays_zip(config, "_kept", *measures)).alias("x"))
    return each.where("x._kept = 1").select(*keys, *carry, "x.config", *[f"x.{m}" for m in measures])


def notified(clean: DataFrame, names: Sequence[str], lane: str = "notifications", keys: Sequence[str] = S.ENTITY, where: Column | None = None) -> DataFrame:
    """(keys, config, notifications) of an untouched run: sums per lane, added up side by side before any row is repeated."""
    rows = clean if where is None else clean.where(where)
    sums = rows.groupBy(*keys).agg(*[F.sum(F.get(lane, F.lit(i))).alias(f"_{i}") for i in range(len(names))])
    each = F.array(*[F.struct(F.lit(n).alias("config"), F.col(f"_{i}").alias("notifications")) for i, n in enumerate(names)])
    return sums.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")
