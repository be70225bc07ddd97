"""Instability branch: movement and transitions out of proportion to steps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorwatch.config import InstabilityConfig, bins
from sensorwatch.functions import blocks as B
from sensorwatch.functions import series as S
from sensorwatch.functions.scalars import at_least, clip, denominator_floor, flag, safe_div
from sensorwatch.operators.baseline import masks, positive_floor, reference_ratio
from sensorwatch.operators.hypo import BRANCH_INPUTS, AlertStream, Evidence, alerts, branch_inputs, covered, with_scope

# Fixed values of the score.
FAMILY_WEIGHTS = {"restless_motion": 0.35, "transition_density": 0.30, "fragmentation": 0.20, "posture_volatility": 0.15}
EXCESS_CAP = 1.5
PERSISTENCE_SHARE = 0.50
SCOPE = "instabilite comportementale a verifier, non diagnostique"
MOVEMENTS = ("steps", "motion", "transitions")


def _sum(df: DataFrame, signal: str):
    name = f"{signal}_sum"
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def add_densities(df: DataFrame, n: int, keys: Sequence[str] = S.ENTITY, more: dict | None = None) -> DataFrame:
    """Motion per step, transitions per step and per posture minute, and posture volatility.

    ``more`` are further columns to compute in the same first pass.
    """
    w = S.whole(keys)
    posture = _sum(df, "lying") + _sum(df, "standing")
    df = df.withColumns(
        {f"_i_{s}": S.rolling_total(_sum(df, s), n, keys) for s in MOVEMENTS}
        | {
            "_i_posture": S.rolling_total(posture, n, keys),
            "_lying_share": clip(F.when(posture > 0, safe_div(_sum(df, "lying"), posture)), 0, 1),
        }
        | (more or {})
    )
    floors = {
        f"_floor_{s}": denominator_floor(S.median_where(F.col(f"_i_{s}") > 0, F.col(f"_i_{s}"), w))
        for s in ("steps", "posture")
    }
    df = df.withColumns(floors).withColumn(
        "_swing", F.abs(F.col("_lying_share") - F.lag("_lying_share").over(S.ordered(keys)))
    )

    def per(a: str, b: str):
        return F.col(f"_i_{a}") / at_least(F.col(f"_i_{b}"), F.col(f"_floor_{b}"))

    return df.withColumns(
        {
            "_i_restless_motion": per("motion", "steps"),
            "_i_transition_density": per("transitions", "steps"),
            "_i_fragmentation": per("transitions", "posture"),
            "_i_posture_volatility": S.rolling_mean(F.col("_swing"), n, max(4, n // 2), keys),
        }
    ).drop("_i_posture", "_lying_share", "_swing", *floors)


NAMES = (*MOVEMENTS, *FAMILY_WEIGHTS)
MEASURES = tuple(f"_i_{x}" for x in NAMES)


def instability_changes(df: DataFrame) -> DataFrame:
    """Ratios and excesses per family, and the rises of steps and motion: what no setting of the alerts changes."""
    gone = {*MEASURES, *[f"_ratio_{m}" for m in MEASURES]}
    df = df.selectExpr(*[f"`{c}`" for c in df.columns if c not in gone], *[f"_ratio__i_{x} AS instability_ratio_{x}" for x in NAMES])
    over = lambda x, cap: f"CASE WHEN instability_ratio_{x} - 1D < 0D THEN 0D {cap} ELSE instability_ratio_{x} - 1D END"
    capped = lambda x: over(x, f"WHEN instability_ratio_{x} - 1D > {EXCESS_CAP}D THEN {EXCESS_CAP}D")
    return df.selectExpr("*", *[f"{capped(f)} AS instability_change_{f}" for f in FAMILY_WEIGHTS], *[f"{over(m, '')} AS _up_{m}" for m in ("steps", "motion")])


def add_decisions(df: DataFrame, cfg: InstabilityConfig, future: str, prefix: str = "instability_warning", coordinated: str = "instability_coordinated_activity") -> DataFrame:
    """Score, agreeing families, the coordinated-activity veto, candidates and evidence under one setting, from ``instability_changes``."""
    hit = {f: flag(F.col(f"instability_change_{f}") >= getattr(cfg, f"{f}_min_change")) for f in FAMILY_WEIGHTS}
    score = reduce(
        lambda a, b: a + b,
        [F.lit(w) * F.coalesce(F.col(f"instability_change_{f}"), F.lit(0.0)) for f, w in FAMILY_WEIGHTS.items()],
    )
    df = df.withColumns({f"{prefix}_score": score} | {f"_hit_{f}": h for f, h in hit.items()})
    h = {f: F.col(f"_hit_{f}") for f in FAMILY_WEIGHTS}
    least = cfg.coordinated_activity_min_change
    df = df.withColumns(
        {
            f"{prefix}_families": reduce(lambda a, b: a + b, h.values()),
            coordinated: flag(
                (F.col("_up_steps") >= least)
                & (F.col("_up_motion") >= least)
                & (F.abs(F.col("_up_motion") - F.col("_up_steps")) <= cfg.coordinated_activity_tolerance)
                & (h["transition_density"] == 0)
                & (h["fragmentation"] == 0)
            ),
        }
    )
    df = df.withColumn(
        f"{prefix}_candidate",
        flag(
            (F.col(f"{prefix}_score") >= cfg.score_threshold)
            & (F.col(f"{prefix}_families") >= cfg.min_families)
            & (h["restless_motion"] == 1)
            & (F.greatest(h["transition_density"], h["fragmentation"], h["posture_volatility"]) == 1)
            & (F.col(coordinated) == 0)
            & covered(df, cfg.coverage_min_pct)
            & F.col(future)
        ),
    )
    on = F.col(f"{prefix}_candidate") == 1
    return df.withColumns(
        {
            f"_ev_{prefix}": F.when(on, F.col(f"{prefix}_score")).otherwise(0.0),
            f"{prefix}_score": clip(F.col(f"{prefix}_score"), 0, 1),
        }
    ).drop(*[f"_hit_{f}" for f in h])


def instability_candidates(df: DataFrame, cfg: InstabilityConfig, future: str = "_future") -> DataFrame:
    """Excesses, score, agreeing families, the coordinated-activity veto, candidates and evidence."""
    df = add_decisions(instability_changes(df), cfg, future)
    return df.withColumn("instability_warning_scope", F.lit(SCOPE)).drop("_up_steps", "_up_motion")


def instability_stream(interval: str, cfg: InstabilityConfig, prefix: str = "instability_warning") -> AlertStream:
    return AlertStream(
        prefix, cfg.cusum_drift, cfg.cusum_threshold, PERSISTENCE_SHARE,
        [bins(cfg.persistence_hours, interval, 2)], None, bins(cfg.cooldown_hours, interval, 1),
    )


def measures(b: B.Block, given: dict, n: int) -> dict[str, B.Known]:
    """``add_densities`` of a block, by name."""
    least = max(4, n // 2)
    lying = b.known(given["lying"])
    posture = lying + b.known(given["standing"])
    out = {s: B.total(b.known(given[s]), n, least) for s in MOVEMENTS}
    under = {"steps": out["steps"], "posture": B.total(posture, n, least)}
    for k, v in under.items():
        floor = positive_floor(v)
        under[k] = B.Known(np.where(v.x < floor, floor, v.x), v.ok)
    lain = (lying / posture).where(~(posture.x <= 0)).held(0.0, 1.0)
    swing = lain - B.lag(lain, 1)
    return out | {
        "restless_motion": out["motion"] / under["steps"],
        "transition_density": out["transitions"] / under["steps"],
        "fragmentation": out["transitions"] / under["posture"],
        "posture_volatility": B.total(B.Known(np.abs(swing.x), swing.ok), n, least, mean=True),
    }


def excesses(b: B.Block, given: dict, interval: str, n: int, base: np.ndarray, slots: B.Slots) -> dict[str, B.Known]:
    """``instability_changes`` of a block: ratios, changes and rises."""
    ratio = {m: reference_ratio(b, v, base, slots, bins(24, interval, 4)) for m, v in measures(b, given, n).items()}
    out = {f"instability_ratio_{m}": r for m, r in ratio.items()}
    out |= {f"instability_change_{f}": (ratio[f] - 1.0).held(0.0, EXCESS_CAP) for f in FAMILY_WEIGHTS}
    return out | {f"_up_{m}": (ratio[m] - 1.0).held(0.0, None) for m in ("steps", "motion")}


def decided(b: B.Block, given: dict, changes: dict[str, B.Known], cfg: InstabilityConfig, future: np.ndarray) -> Evidence:
    """``add_decisions`` of a block."""
    change = {f: changes[f"instability_change_{f}"] for f in FAMILY_WEIGHTS}
    hit = {f: x.at_least(getattr(cfg, f"{f}_min_change")) for f, x in change.items()}
    score = reduce(np.add, [w * change[f].fill(0.0) for f, w in FAMILY_WEIGHTS.items()])
    families = reduce(np.add, [h.astype(int) for h in hit.values()])
    steps, motion, least = changes["_up_steps"], changes["_up_motion"], cfg.coordinated_activity_min_change
    together = steps.at_least(least) & motion.at_least(least) & (np.abs(motion.x - steps.x) <= cfg.coordinated_activity_tolerance)
    together &= ~hit["transition_density"] & ~hit["fragmentation"]
    other = hit["transition_density"] | hit["fragmentation"] | hit["posture_volatility"]
    candidate = ~(score < cfg.score_threshold) & (families >= cfg.min_families) & hit["restless_motion"] & other & ~together
    candidate &= b.known(given["coverage"]).at_least(cfg.coverage_min_pct) & future
    prefix = "instability_warning"
    columns = {f"{prefix}_score": B.Known(score, b.there).held(0.0, 1.0).x, f"{prefix}_families": families, "instability_coordinated_activity": together, f"{prefix}_candidate": candidate}
    return Evidence(columns, candidate, np.where(candidate, score, 0.0))


INSTABILITY_TYPES = ", ".join([*[f"instability_ratio_{m} double" for m in NAMES], *[f"instability_change_{f} double" for f in FAMILY_WEIGHTS],
                               "instability_warning_score double, instability_warning_families int, instability_coordinated_activity int, instability_warning_candidate int"])


def instability_branch(
    df: DataFrame, interval: str, cfg: InstabilityConfig = InstabilityConfig(), keys: Sequence[str] = S.ENTITY, notify: bool = True
) -> DataFrame:
    """Add the instability columns to an interval table (``notify``: with notifications), in one pass over whole series."""
    labelled, stream, prefix = "dataset_split" in df.columns, instability_stream(interval, cfg), "instability_warning"

    def fn(b: B.Block, given: dict) -> dict:
        base, future = masks(b, given, True, labelled)
        changes = excesses(b, given, interval, bins(cfg.aggregation_hours, interval, 4), base, B.Slots(b, given["slot"][0]))
        own = decided(b, given, changes, cfg, future)
        out = changes | own.columns | {f"{prefix}_{k}": x for k, x in alerts(b, own, stream).items()}
        return out | ({f"{prefix}_notification": B.fired(out[f"{prefix}_start"], b.whole(given["pos"]), stream.wait)} if notify else {})

    outputs = f"{INSTABILITY_TYPES}, {prefix}_cusum double, {prefix}_episode int, {prefix}_start int" + f", {prefix}_notification int" * notify

    def step(own: DataFrame) -> DataFrame:
        own = own if "pos" in own.columns else S.add_position(own, keys)
        return with_scope(B.series_pass(own, keys, branch_inputs(own), outputs, fn), prefix, SCOPE)

    return S.beside(df, [*keys, *BRANCH_INPUTS], step)
