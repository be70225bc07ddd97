"""Sustained-drop branch: several behaviours low together, for long enough."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorwatch.config import SIGNALS, HypoConfig, bins
from sensorwatch.functions import blocks as B
from sensorwatch.functions import series as S
from sensorwatch.functions.scalars import clip, flag, row_mean
from sensorwatch.operators.baseline import add_reference_ratios, masks, reference_inputs, reference_ratio

# Fixed values of the score.
FAMILY_WEIGHTS = {"steps": 0.30, "motion": 0.30, "transitions": 0.20, "posture": 0.20}
PROGRESSIVE_WEIGHT = 0.35
PROGRESSIVE_HOURS = 6
PERSISTENCE_SHARE = 0.45
# What the branches read of an interval table, besides its keys.
BRANCH_INPUTS = ("bin", "pos", "dataset_split", "coverage_pct", *[f"{s}_sum" for s in SIGNALS])
SCOPE = "alerte comportementale a verifier, non diagnostique"


def choose(col: Column | None, options: dict) -> Column:
    """The option named by an integer column; the only option when there is no column."""
    if col is None:
        return next(iter(options.values()))
    return reduce(lambda acc, kv: acc.when(col == kv[0], kv[1]), options.items(), F.when(F.lit(False), None))


def drop_totals(df: DataFrame, lengths: Sequence[int], keys: Sequence[str] = S.ENTITY, length: Column | None = None) -> dict:
    """Rolling totals ``_t_<signal>``; with several lengths, ``length`` says which one a row uses."""
    return {
        f"_t_{s}": choose(length, {n: S.rolling_total(F.col(f"{s}_sum"), n, keys) for n in lengths})
        if f"{s}_sum" in df.columns
        else F.lit(None).cast("double")
        for s in SIGNALS
    }


def drop_changes(df: DataFrame) -> DataFrame:
    """Change per behaviour family from the ratios ``_ratio__t_<signal>``."""
    held = lambda x: f"CASE WHEN {x} < 0D THEN 0D WHEN {x} > 1D THEN 1D ELSE {x} END"
    names = [f"_ratio__t_{s}" for s in SIGNALS]
    gone = {*names, *[f"_t_{s}" for s in SIGNALS]}
    df = df.selectExpr(*[f"`{c}`" for c in df.columns if c not in gone], *[f"_ratio__t_{s} AS warning_ratio_{s}" for s in SIGNALS])
    df = df.selectExpr(
        "*",
        *[f"{held(f'(1D - warning_ratio_{s})')} AS warning_change_{s}" for s in ("steps", "motion", "transitions")],
        f"{held('(warning_ratio_lying - 1D)')} AS _up", f"{held('(1D - warning_ratio_standing)')} AS _down",
    )
    return df.withColumn("warning_change_posture", row_mean(F.col("_up"), F.col("_down"))).drop("_up", "_down")


def add_drop_changes(
    df: DataFrame, interval: str, lengths: Sequence[int], keys: Sequence[str] = S.ENTITY, length: Column | None = None
) -> DataFrame:
    """Ratios to the entity's references and the resulting change per behaviour family."""
    totals = drop_totals(df, lengths, keys, length)
    df = df.withColumns(totals)
    return drop_changes(add_reference_ratios(df, list(totals), bins(24, interval, 4), keys, high=["_t_lying"]))


def family_weights(active: Sequence[str]) -> dict[str, float]:
    """Weights of the active families scaled to sum 1; 0 marks an inactive family."""
    chosen = [f for f in FAMILY_WEIGHTS if f in active] or list(FAMILY_WEIGHTS)
    total = sum(FAMILY_WEIGHTS[f] for f in chosen)
    return {f: FAMILY_WEIGHTS[f] / total if f in chosen else 0.0 for f in FAMILY_WEIGHTS}


def _sql(x) -> str:
    """A setting as SQL: a number, or text that names a column."""
    return x if isinstance(x, str) else repr(float(x)) + "D"


def candidate_stages(
    df: DataFrame, interval: str, cfg, keys: Sequence[str], weights: dict | None = None, future: str = "_future",
    prefix: str = "behavioral_warning", changes: str = "",
) -> list[dict[str, str]]:
    """SQL of score, agreeing families, candidate bins and their evidence, by column name and stage by stage.

    They read ``warning_change_<family><changes>`` and ``warning_ratio_<family><changes>``. Stages of several settings can be
    put side by side: every stage is one projection over the same rows. It is text because a sweep has
    thousands of terms, and text reaches the JVM in one call.
    """
    w = {f: _sql(x) for f, x in (weights or family_weights(cfg.active_families)).items()}
    change = {f: f"warning_change_{f}{changes}" for f in w}
    least = {f: _sql(cfg.posture_min_change if f == "posture" else cfg.family_min_change) for f in w}
    hits = {f: f"CASE WHEN {w[f]} > 0D AND {change[f]} >= {least[f]} THEN 1 ELSE 0 END" for f in w}
    activity = [f"CASE WHEN {w[f]} > 0D THEN warning_ratio_{f}{changes} END" for f in w if f != "posture"]
    known = " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN 1 ELSE 0 END" for x in activity)
    mean = f"({' + '.join(f'coalesce({x}, 0D)' for x in activity)}) / nullif({known}, 0)"
    lag = f"lag(_activity_{prefix}, {bins(PROGRESSIVE_HOURS, interval, 2)}) OVER (PARTITION BY {', '.join(keys)} ORDER BY bin) - _activity_{prefix}"
    enough = f"coalesce(coverage_pct, 0D) >= {_sql(cfg.coverage_min_pct)}" if "coverage_pct" in df.columns else "true"
    held = lambda x: f"CASE WHEN {x} < 0D THEN 0D WHEN {x} > 1D THEN 1D ELSE {x} END"
    score = f"{prefix}_score"
    return [
        {
            score: " + ".join(f"{w[f]} * coalesce({change[f]}, 0D)" for f in w),
            f"_activity_{prefix}": mean,
            f"{prefix}_families": " + ".join(hits.values()),
            f"_core_{prefix}": f"greatest({hits['steps']}, {hits['motion']}, CASE WHEN {w['steps']} + {w['motion']} = 0D THEN 1 ELSE 0 END)",
        },
        {f"_rise_{prefix}": lag},
        {
            f"_drop_{prefix}": f"coalesce({held(f'_rise_{prefix}')}, 0D)",
            f"{prefix}_candidate": f"CASE WHEN {score} >= {_sql(cfg.score_threshold)} AND {prefix}_families >= {_sql(cfg.min_families)} AND _core_{prefix} = 1 AND {enough} AND {future} THEN 1 ELSE 0 END",
        },
        {f"_ev_{prefix}": f"CASE WHEN {prefix}_candidate = 1 THEN {score} + {PROGRESSIVE_WEIGHT}D * _drop_{prefix} ELSE 0D END", f"{prefix}_known": held(score)},
    ]


def add_stages(df: DataFrame, items: Sequence[tuple[str, list[dict[str, str]]]]) -> DataFrame:
    """Apply the stages of several (prefix, stages) side by side."""
    for step in zip(*[stages for _, stages in items], strict=True):
        df = df.selectExpr("*", *[f"{text} AS {name}" for stage in step for name, text in stage.items()])
    gone = {f"{x}{p}" for p, _ in items for x in ("_activity_", "_core_", "_rise_", "_drop_")} | {f"{p}_score" for p, _ in items}
    return df.drop(*gone).withColumnsRenamed({f"{p}_known": f"{p}_score" for p, _ in items})


def drop_candidates(
    df: DataFrame, interval: str, cfg, keys: Sequence[str] = S.ENTITY, weights: dict | None = None, future: str = "_future"
) -> DataFrame:
    """Score, agreeing families, candidate bins and their evidence. Settings are numbers, or SQL text that names a column."""
    df = add_stages(df, [("behavioral_warning", candidate_stages(df, interval, cfg, keys, weights, future))])
    return df.withColumn("behavioral_warning_scope", F.lit(SCOPE))


def drop_stream(interval: str, cfg, persist=None, wait=None) -> AlertStream:
    lengths, length = persist or ([bins(cfg.persistence_hours, interval, 2)], None)
    pause = bins(cfg.cooldown_hours, interval, 1) if wait is None else wait
    return AlertStream("behavioral_warning", cfg.cusum_drift, cfg.cusum_threshold, PERSISTENCE_SHARE, lengths, length, pause)


def add_drop_alerts(
    df: DataFrame,
    interval: str,
    cfg,
    keys: Sequence[str] = S.ENTITY,
    weights: dict | None = None,
    persist: tuple[Sequence[int], str | None] | None = None,
    wait: str | None = None,
    notify: bool = True,
) -> DataFrame:
    """Score, candidate, CUSUM, episode, start and notification from the family changes.

    Thresholds and weights may be numbers or text that names columns: with columns, one
    table holding every (entity, configuration) is a whole sweep in one job.
    """
    df = drop_candidates(df, interval, cfg, keys, weights)
    return finish_alerts(df, [drop_stream(interval, cfg, persist, wait)], keys, notify)


def covered(df: DataFrame, least: float):
    if "coverage_pct" not in df.columns:
        return F.lit(True)
    return F.coalesce(F.col("coverage_pct"), F.lit(0.0)) >= least


@dataclass(frozen=True)
class AlertStream:
    """How candidates of one branch (``<prefix>_candidate``, ``_ev_<prefix>``) become notifications."""

    prefix: str
    drift: float | str  # numbers, or SQL text that names a column
    level: float | str
    share: float
    lengths: Sequence[int]
    length: str | None
    wait: int | str


def cooldowns(streams: Sequence[AlertStream]) -> list[tuple]:
    """What ``add_cooldowns`` needs to turn the streams' starts into notifications."""
    return [(f"{a.prefix}_start", a.wait, f"{a.prefix}_notification") for a in streams]


def finish_alerts(df: DataFrame, streams: Sequence[AlertStream], keys: Sequence[str], notify: bool = True) -> DataFrame:
    """CUSUM, episode, start and (if ``notify``) notification of every stream; the streams share their windows.

    Episode: enough candidates among exactly the last ``k`` bins, and a high CUSUM.
    """
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY bin"

    def rate(prefix: str, k: int) -> str:
        w = f"{over} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count(1) {w} = {k} THEN avg({prefix}_candidate) {w} END"

    def rates(a: AlertStream) -> str:
        if a.length is None:
            return rate(a.prefix, a.lengths[0])
        return f"CASE {' '.join(f'WHEN {a.length} = {k} THEN {rate(a.prefix, k)}' for k in a.lengths)} END"

    df = S.add_cusums(df, [(f"_ev_{a.prefix}", _sql(a.drift), f"{a.prefix}_cusum") for a in streams], keys)
    df = df.selectExpr("*", *[f"{rates(a)} AS _rate_{a.prefix}" for a in streams])
    df = df.selectExpr("*", *[f"CASE WHEN _rate_{a.prefix} >= {a.share}D AND {a.prefix}_cusum >= {_sql(a.level)} THEN 1 ELSE 0 END AS {a.prefix}_episode" for a in streams])
    rising = "CASE WHEN {0}_episode = 1 AND coalesce(lag({0}_episode) {1}), 0) = 0 THEN 1 ELSE 0 END AS {0}_start"
    df = df.selectExpr("*", *[rising.format(a.prefix, over) for a in streams])
    df = S.add_cooldowns(df, cooldowns(streams), keys) if notify else df
    return df.drop(*[f"_{x}_{a.prefix}" for x in ("ev", "rate") for a in streams])


def branch_inputs(df: DataFrame) -> dict[str, Column]:
    """What both branches read of a table with positions; a missing signal is unknown, a missing coverage full."""
    sums = {s: F.col(f"{s}_sum") if f"{s}_sum" in df.columns else F.lit(None) for s in SIGNALS}
    full = F.coalesce(F.col("coverage_pct"), F.lit(0.0)) if "coverage_pct" in df.columns else F.lit(float("inf"))
    return reference_inputs(df) | {"coverage": full.cast("double")} | {s: c.cast("double") for s, c in sums.items()}


@dataclass(frozen=True)
class Evidence:
    """What a branch makes of a block: its own columns, candidate bins and their evidence."""

    columns: dict
    candidate: np.ndarray
    evidence: np.ndarray


def drop_evidence(b: B.Block, given: dict, interval: str, cfg: HypoConfig, base: np.ndarray, future: np.ndarray, slots: B.Slots) -> Evidence:
    """``add_drop_changes`` and ``drop_candidates`` of a block."""
    n, day = bins(cfg.aggregation_hours, interval, 4), bins(24, interval, 4)
    ratio = {s: reference_ratio(b, B.total(b.known(given[s]), n, max(4, n // 2)), base, slots, day, s == "lying") for s in SIGNALS}
    change = {s: B.Known(1.0 - ratio[s].x, ratio[s].ok).held(0.0, 1.0) for s in ("steps", "motion", "transitions", "standing")}
    up, down = (ratio["lying"] - 1.0).held(0.0, 1.0), change.pop("standing")
    seen = up.ok.astype(int) + down.ok
    change["posture"] = B.Known((up.fill(0.0) + down.fill(0.0)) / np.maximum(seen, 1), seen > 0)
    w = family_weights(cfg.active_families)
    hit = {f: (w[f] > 0) & change[f].at_least(cfg.posture_min_change if f == "posture" else cfg.family_min_change) for f in w}
    score = reduce(np.add, [w[f] * change[f].fill(0.0) for f in w])
    active = [ratio[f] for f in w if f != "posture" and w[f] > 0]
    known = reduce(np.add, [x.ok.astype(int) for x in active], np.zeros(b.shape, int))
    activity = B.Known(reduce(np.add, [x.fill(0.0) for x in active], np.zeros(b.shape)) / np.maximum(known, 1), known > 0)
    rise = (B.lag(activity, bins(PROGRESSIVE_HOURS, interval, 2)) - activity).held(0.0, 1.0).fill(0.0)
    families = reduce(np.add, [h.astype(int) for h in hit.values()])
    core = hit["steps"] | hit["motion"] | (w["steps"] + w["motion"] == 0)
    candidate = ~(score < cfg.score_threshold) & (families >= cfg.min_families) & core & b.known(given["coverage"]).at_least(cfg.coverage_min_pct) & future
    columns = {f"warning_ratio_{s}": x for s, x in ratio.items()} | {f"warning_change_{f}": x for f, x in change.items()}
    columns |= {"behavioral_warning_families": families, "behavioral_warning_candidate": candidate, "behavioral_warning_score": B.Known(score, b.there).held(0.0, 1.0).x}
    return Evidence(columns, candidate, np.where(candidate, score + PROGRESSIVE_WEIGHT * rise, 0.0))


def alerts(b: B.Block, own: Evidence, stream: AlertStream) -> dict[str, np.ndarray]:
    """CUSUM, episode and start of ``finish_alerts`` for a block."""
    rise = B.cusum(own.evidence, stream.drift)
    episode = B.share(own.candidate, b.there, stream.lengths[0]).at_least(stream.share) & ~(rise < stream.level)
    return {"cusum": rise, "episode": episode, "start": B.rising(episode)}


DROP_TYPES = ", ".join([*[f"warning_ratio_{s} double" for s in SIGNALS], *[f"warning_change_{f} double" for f in ("steps", "motion", "transitions", "posture")],
                        "behavioral_warning_families int, behavioral_warning_candidate int, behavioral_warning_score double"])


def with_scope(df: DataFrame, prefix: str, scope: str) -> DataFrame:
    """The column ``<prefix>_scope`` behind the branch's own columns."""
    at = df.columns.index(f"{prefix}_cusum")
    return df.select(*[f"`{c}`" for c in df.columns[:at]], F.lit(scope).alias(f"{prefix}_scope"), *[f"`{c}`" for c in df.columns[at:]])


def hypo_branch(
    df: DataFrame, interval: str, cfg: HypoConfig = HypoConfig(), keys: Sequence[str] = S.ENTITY, notify: bool = True, only: Sequence[str] | None = None
) -> DataFrame:
    """Add the sustained-drop columns (or ``only`` some of those that are not text) to an interval table (``notify``: with notifications), in one pass over whole series."""
    labelled, stream, prefix = "dataset_split" in df.columns, drop_stream(interval, cfg), "behavioral_warning"

    def fn(b: B.Block, given: dict) -> dict:
        base, future = masks(b, given, False, labelled)
        own = drop_evidence(b, given, interval, cfg, base, future, B.Slots(b, given["slot"][0]))
        out = own.columns | {f"{prefix}_{k}": x for k, x in alerts(b, own, stream).items()}
        return out | ({f"{prefix}_notification": B.fired(out[f"{prefix}_start"], b.whole(given["pos"]), stream.wait)} if notify else {})

    outputs = f"{DROP_TYPES}, {prefix}_cusum double, {prefix}_episode int, {prefix}_start int" + f", {prefix}_notification int" * notify

    def step(own: DataFrame) -> DataFrame:
        own = own if "pos" in own.columns else S.add_position(own, keys)
        told = B.series_pass(own, keys, branch_inputs(own), outputs, fn, only=only)
        return told if only is not None else with_scope(told, prefix, SCOPE)

    return S.beside(df, [*keys, *BRANCH_INPUTS], step)
