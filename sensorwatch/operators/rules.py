"""Comparator rules: outlier flags + agreeing signal families -> episodes, levels, confidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorwatch.config import RulesConfig, bins
from sensorwatch.functions import series as S
from sensorwatch.functions.scalars import clip, flag

# Family of a signal, columns asked first, and confidence weights.
FAMILY_OF_SIGNAL = {
    "motion": "activity",
    "steps": "activity",
    "lying": "rest",
    "standing": "rest",
    "transitions": "transitions",
}
FAMILIES = ("activity", "rest", "transitions", "other")
PREFERRED = (
    "motion_sum_log_rrz",
    "motion_sum_rrz",
    "steps_sum_rrz",
    "lying_sum_rrz",
    "standing_sum_rrz",
    "transitions_sum_rrz",
)
SPIKE_COLUMNS = ("motion_sum_log_rrz", "motion_sum_rrz", "motion_mean_log_rrz", "motion_mean_rrz")
CONFIDENCE_WEIGHTS = {"family": 30, "anomaly_rate": 30, "spike": 20, "score": 20}
FAMILY_RATE = {"MIX": 0.35, "IF-ONLY": 0.10}


def family_of(column: str) -> str:
    return FAMILY_OF_SIGNAL.get(column.split("_")[0], "other")


def voters(columns: Sequence[str], asked: Sequence[str] | None = None) -> list[str]:
    """Columns that vote: those the settings list, all of them; else the comparator's standard panel.

    The panel is part of the comparator's definition: the preferred rolling-z columns filled up
    to ten places in table order, or the first eight where none of them is there.
    """
    if asked is not None:
        missing = [c for c in asked if c not in columns]
        if missing:
            raise ValueError(f"voting columns not in the table: {missing}")
        return list(asked)
    z = [c for c in columns if c.endswith("_rrz")]
    first = [c for c in PREFERRED if c in z]
    return (first + [c for c in z if c not in first])[:10] if first else z[:8]


def _any(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def anomaly_points(df: DataFrame) -> Column:
    if "if_anomaly_point" in df.columns:
        return F.coalesce(F.col("if_anomaly_point").cast("int"), F.lit(0))
    if "if_anomaly" in df.columns:
        return F.coalesce(F.col("if_anomaly").cast("int"), F.lit(0))
    if "if_pred" in df.columns:
        return flag(F.col("if_pred") == -1)
    return F.lit(0)


def add_percent_rank(df: DataFrame, col: str, out: str, keys: Sequence[str] = S.ENTITY) -> DataFrame:
    """Average-tie rank of non-null values as a share of their number, in percent."""
    ranked = Window.partitionBy(*keys).orderBy(F.col(col).asc_nulls_last())
    tied = Window.partitionBy(*keys, col)
    share = (F.rank().over(ranked) + (F.count(col).over(tied) - 1) / 2.0) / F.count(col).over(S.whole(keys))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), share * 100.0))


def score_quantile(col: str, keys: Sequence[str] = S.ENTITY) -> Column:
    """5 % quantile of an entity's scores; needs more than 10 bins and 5 scores."""
    w = S.whole(keys)
    return F.when(
        (F.count(F.lit(1)).over(w) > 10) & (F.count(col).over(w) > 5), F.percentile(col, F.lit(0.05)).over(w)
    )


def add_family_votes(
    df: DataFrame, cfg: RulesConfig, k: int, keys: Sequence[str] = S.ENTITY
) -> DataFrame:
    """``hit_<family>``: some voter beyond its bounds; ``fam_<family>``: often enough in the window."""
    cols = voters(df.columns, cfg.vote_columns)
    hits = {}
    for fam in FAMILIES:
        z = [F.coalesce(F.col(c), F.lit(0.0)) for c in cols if family_of(c) == fam]
        hits[f"hit_{fam}"] = flag(_any([(x <= cfg.z_low_thr) | (x >= cfg.z_high_thr) for x in z]))
    df = df.withColumns(hits)
    rate = FAMILY_RATE["MIX" if cfg.mixed else "IF-ONLY"]
    w = S.trailing(k, keys)
    return df.withColumns({f"fam_{f}": flag(F.avg(f"hit_{f}").over(w) >= rate) for f in FAMILIES})


def inputs(columns: Sequence[str], cfg: RulesConfig = RulesConfig(), keys: Sequence[str] = S.ENTITY) -> list[str]:
    """Columns the rules read, of a table with ``columns``."""
    flags = ("if_anomaly_point", "if_anomaly", "if_pred", "if_score")
    wanted = {*keys, "bin", "pos", "coverage_pct", *flags, *voters(columns, cfg.vote_columns), *[c for c in SPIKE_COLUMNS if c in columns][:1]}
    return [c for c in columns if c in wanted]


def apply_rules(
    df: DataFrame, interval: str, cfg: RulesConfig = RulesConfig(), keys: Sequence[str] = S.ENTITY
) -> DataFrame:
    """Add the comparator's columns; needs rolling-z columns and, optionally, ``if_*`` scores."""
    return S.beside(df, inputs(df.columns, cfg, keys), lambda own: _apply_rules(own, interval, cfg, keys))


def _apply_rules(df: DataFrame, interval: str, cfg: RulesConfig, keys: Sequence[str]) -> DataFrame:
    k = bins(cfg.persist_hours, interval, 1)
    w = S.trailing(k, keys)
    if "pos" not in df.columns:
        df = S.add_position(df, keys)
    low = (
        F.coalesce(F.col("coverage_pct") < cfg.coverage_min_pct, F.lit(False))
        if "coverage_pct" in df.columns
        else F.lit(False)
    )

    def gate(col: Column) -> Column:
        return F.when(F.col("_low"), F.lit(0)).otherwise(col)

    df = df.withColumns({"K": F.lit(k), "_low": low})
    df = df.withColumn("if_anomaly_point", gate(anomaly_points(df)))
    df = add_family_votes(df, cfg, k, keys)
    gated = [f"{p}_{f}" for p in ("fam", "hit") for f in FAMILIES]
    df = df.withColumns({c: gate(F.col(c)) for c in gated})
    spike_col = next((c for c in SPIKE_COLUMNS if c in df.columns), None)
    spike = flag(F.col(spike_col) >= cfg.mi_z_high_thr) if spike_col else F.lit(0)
    df = df.withColumns(
        {
            "n_families": reduce(lambda a, b: a + b, [F.col(f"fam_{f}") for f in FAMILIES]),
            "mi_spike": gate(spike),
            "mi_feat_used": F.lit(spike_col or ""),
        }
    )
    df = df.withColumns(
        {
            "if_anom_k": F.sum("if_anomaly_point").over(w).cast("int"),
            "anom_rate_k": F.sum("if_anomaly_point").over(w) / float(k),
            "n_families_k": F.max("n_families").over(w),
            "mi_spike_k": F.sum("mi_spike").over(w).cast("int"),
            "has_core_family": F.greatest("fam_activity", "fam_rest"),
        }
    )
    need = 2 if cfg.require_two_signals else cfg.episode_min_families
    if cfg.mixed:
        need = max(2, need)
    coherent = (F.col("n_families") >= need) & (F.col("has_core_family") == 1)
    if not cfg.mixed and cfg.episode_allow_mi_alone:
        coherent = coherent | (F.col("mi_spike") == 1)
    if not cfg.episode_requires_coherence:
        coherent = F.lit(True)
    lame = (F.col("n_families") >= cfg.lameness_min_families) | (
        (F.col("fam_activity") == 1) & (F.col("mi_spike") == 1)
    )
    if cfg.require_mi_for_lameness:
        lame = lame & (F.col("mi_spike") == 1)
    df = df.withColumns(
        {
            "flag_coherent_episode": flag(coherent),
            "coherence_boiterie": flag(lame),
            "n_signals": F.col("n_families") + F.col("mi_spike"),
        }
    )
    often = (F.col("anom_rate_k") >= cfg.mix_rate_thr) & (F.col("if_anom_k") >= cfg.alert_min)
    if cfg.mixed:
        often = often & (F.col("flag_coherent_episode") == 1)
    df = df.withColumn("episode_anormal", flag(often))
    df = df.withColumn(
        "boiterie_probable", flag((F.col("episode_anormal") == 1) & (F.col("coherence_boiterie") == 1))
    )
    df = df.withColumns(
        {
            "episode_anormal_start": S.rising("episode_anormal", keys),
            "boiterie_start": S.rising("boiterie_probable", keys),
        }
    )
    if "if_score" in df.columns:
        df = df.withColumn("if_score_q05", score_quantile("if_score", keys))
        df = add_percent_rank(df, "if_score", "if_score_pct", keys)
    else:
        df = df.withColumns({c: F.lit(None).cast("double") for c in ("if_score", "if_score_q05", "if_score_pct")})
    return _outputs(df, interval, cfg, gate, gated, keys)


def _outputs(df: DataFrame, interval: str, cfg: RulesConfig, gate, gated, keys: Sequence[str]) -> DataFrame:
    """Gate the outputs on coverage, then cooldown, level and confidence.

    Starts were found before this gate and are not found again, so an episode
    interrupted by a badly covered bin resumes without a new start.
    """
    zeroed = [
        "if_anom_k", "mi_spike_k", "flag_coherent_episode", "episode_anormal", "episode_anormal_start",
        "boiterie_probable", "boiterie_start", "coherence_boiterie", "n_signals", "n_families", "n_families_k", *gated,
    ]
    df = df.withColumns(
        {c: gate(F.col(c)) for c in zeroed}
        | {"anom_rate_k": F.when(F.col("_low"), F.lit(0.0)).otherwise(F.col("anom_rate_k"))}
    )
    df = df.withColumns(
        {
            "pred_problem_episode": F.col("episode_anormal"),
            "pred_problem_start": F.col("episode_anormal_start"),
            "pred_lameness_episode": F.col("boiterie_probable"),
            "pred_lameness_start": F.col("boiterie_start"),
        }
    )
    wait = bins(cfg.cooldown_hours, interval, 1)
    df = S.add_cooldowns(df, [("pred_lameness_start", wait, "notif_lameness")], keys, last=True)
    df = df.withColumn("in_cooldown", flag(F.col("pos") - F.col("_last_notif_lameness") <= wait)).drop("_last_notif_lameness")
    critical = (F.col("if_score") <= F.col("if_score_q05")) & (F.col("if_score_pct") <= cfg.pct_crit_thr)
    level = (
        F.when(F.col("_low"), "normal")
        .when((F.col("pred_lameness_episode") == 1) & F.coalesce(critical, F.lit(False)), "critique")
        .when(F.col("pred_lameness_episode") == 1, "probable")
        .when(F.col("if_anomaly_point") == 1, "suspect")
        .otherwise("normal")
    )
    weights = CONFIDENCE_WEIGHTS
    confidence = (
        weights["family"] * clip(F.col("n_families_k") / 3.0, 0, 1)
        + weights["anomaly_rate"] * clip(F.col("anom_rate_k"), 0, 1)
        + weights["spike"] * clip(F.col("mi_spike_k") / F.col("K"), 0, 1)
        + weights["score"] * F.coalesce(clip(1 - F.col("if_score_pct") / 100.0, 0, 1), F.lit(0.0))
    )
    return df.withColumns(
        {
            "alert_level": level,
            "is_critique": flag(level == "critique"),
            "in_cooldown": gate(F.col("in_cooldown")),
            "notif_lameness": gate(F.col("notif_lameness")),
            "lame_confidence": F.when(F.col("_low"), F.lit(0.0)).otherwise(F.bround(confidence, 1)),
        }
    ).drop("_low")
