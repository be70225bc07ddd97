"""Parameter sweeps: configurations as rows, so a sweep is one job over (entity, config)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, replace
from types import SimpleNamespace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorwatch.config import FusionConfig, HypoConfig, InstabilityConfig, RulesConfig, bins
from sensorwatch.functions import series as S
from sensorwatch.functions.scalars import attach
from sensorwatch.operators import hypo as H
from sensorwatch.operators import rules as R
from sensorwatch.operators.baseline import add_reference_masks

# The one-factor-at-a-time variants around the reference.
OFAT = {
    "aggregation_hours": (6.0, 24.0),
    "persistence_hours": (3.0, 12.0),
    "cooldown_hours": (12.0, 48.0),
    "family_min_change": (0.05, 0.15),
    "posture_min_change": (0.025, 0.10),
    "score_threshold": (0.08, 0.16),
    "cusum_drift": (0.04, 0.10),
    "cusum_threshold": (0.80, 1.60),
    "min_families": (2, 4),
    "coverage_min_pct": (50.0, 75.0),
}
# Instability variants.
INSTABILITY = {
    "reference": InstabilityConfig(),
    "persistence_3h": InstabilityConfig(persistence_hours=3.0),
    "thresholds_strict": InstabilityConfig(
        restless_motion_min_change=0.30, transition_density_min_change=0.30, fragmentation_min_change=0.30,
        posture_volatility_min_change=0.30, score_threshold=0.25, cusum_threshold=1.00,
    ),
    "aggregation_4h": InstabilityConfig(aggregation_hours=4.0, persistence_hours=3.0),
}


# Fusion variants.
FUSIONS = {
    "hypo_only": FusionConfig("HYPO_ONLY"),
    "instability_only": FusionConfig("INSTABILITY_ONLY"),
    "or": FusionConfig("OR"),
    "hierarchical": FusionConfig("HIERARCHICAL"),
    "sequential_24_72h": FusionConfig("SEQUENTIAL", sequence_min_hours=24.0, sequence_max_hours=72.0),
}


def fusion_runs() -> dict[str, tuple[InstabilityConfig, FusionConfig]]:
    """Every fusion with the reference instability settings, and every instability variant under the hierarchical fusion."""
    fused = {f"fusion__{name}": (InstabilityConfig(), f) for name, f in FUSIONS.items()}
    return fused | {f"parameter__{name}": (i, FUSIONS["hierarchical"]) for name, i in INSTABILITY.items()}


def ofat_configs() -> dict[str, tuple[str, str, HypoConfig]]:
    """Name -> (parameter, direction, settings): the reference and twenty single changes."""
    ref = HypoConfig()
    out = {"reference": ("reference", "reference", ref)}
    for name, values in OFAT.items():
        for v in values:
            side = "lower" if v < getattr(ref, name) else "higher"
            out[f"{name}__{str(v).replace('.', 'p')}"] = (name, side, replace(ref, **{name: v}))
    return out


def assert_one_factor(configs: dict[str, tuple[str, str, HypoConfig]]) -> None:
    """Every variant differs from the reference in exactly its own parameter."""
    if next(iter(configs), None) != "reference":
        raise ValueError("the first configuration must be the reference")
    base = asdict(configs["reference"][2])
    for name, (parameter, _, cfg) in configs.items():
        changed = [k for k, v in asdict(cfg).items() if v != base[k]]
        if name != "reference" and changed != [parameter]:
            raise ValueError(f"{name}: changes {changed}, expected [{parameter!r}]")


def settings_in_bins(cfg: HypoConfig, interval: str) -> dict:
    """A configuration as plain numbers: window lengths in bins, thresholds, family weights."""
    out = {
        "agg": bins(cfg.aggregation_hours, interval, 4),
        "persist": bins(cfg.persistence_hours, interval, 2),
        "wait": bins(cfg.cooldown_hours, interval, 1),
    }
    out |= {n: getattr(cfg, n) for n in OFAT if not n.endswith("_hours")}
    return out | {f"w_{f}": w for f, w in H.family_weights(cfg.active_families).items()}


def sweep(df: DataFrame, interval: str, configs: dict[str, HypoConfig], keys: Sequence[str] = S.ENTITY) -> DataFrame:
    """Drop branch under every configuration, keyed by (entity, config), in one job.

    Only the aggregation window changes the ratios, so the table is repeated
    once per distinct window for those, and once per configuration (a literal
    list filtered on the window) for the alerts.
    """
    rows = {name: settings_in_bins(c, interval) for name, c in configs.items()}
    lengths = sorted({r["agg"] for r in rows.values()})
    persists = sorted({r["persist"] for r in rows.values()})
    df = add_reference_masks(df, only_if_missing=False, keys=keys)
    df = df.withColumn("agg", F.explode(F.array(*[F.lit(n) for n in lengths])))
    df = H.add_drop_changes(df, interval, lengths, (*keys, "agg"), F.col("agg"))
    listed = F.array(*[F.struct(F.lit(n).alias("config"), *[F.lit(v).alias(k) for k, v in r.items()]) for n, r in rows.items()])
    df = df.withColumn("cfg", F.explode(F.filter(listed, lambda c: c["agg"] == F.col("agg"))))
    df = df.withColumn("config", F.col("cfg.config"))
    cfg = SimpleNamespace(**{n: f"cfg.{n}" for n in OFAT if not n.endswith("_hours")})
    weights = {f: f"cfg.w_{f}" for f in H.FAMILY_WEIGHTS}
    out = H.add_drop_alerts(
        df, interval, cfg, (*keys, "config"), weights, (persists, "cfg.persist"), "cfg.wait"
    )
    return out.drop("_base", "_future", "cfg", "agg")


def channel_ablation(df: DataFrame, interval: str, keys: Sequence[str] = S.ENTITY) -> DataFrame:
    """Each behaviour family alone (its weight 1, one family required)."""
    return sweep(df, interval, {f: HypoConfig(active_families=(f,), min_families=1) for f in H.FAMILY_WEIGHTS}, keys)


def ofat_sweep(df: DataFrame, interval: str, keys: Sequence[str] = S.ENTITY) -> DataFrame:
    """The reference and all one-factor variants."""
    configs = ofat_configs()
    assert_one_factor(configs)
    return sweep(df, interval, {name: c for name, (_, _, c) in configs.items()}, keys)


def entity_thresholds(
    df: DataFrame, interval: str, factors: DataFrame, fixed: HypoConfig = HypoConfig(), keys: Sequence[str] = S.ENTITY
) -> DataFrame:
    """Drop branch with each entity's own score threshold (``factor`` x the common one)."""
    df = add_reference_masks(df, only_if_missing=False, keys=keys)
    df = H.add_drop_changes(df, interval, [bins(fixed.aggregation_hours, interval, 4)], keys)
    df = df.join(factors.select("entity", "factor"), "entity", "left")
    own = asdict(fixed) | {"score_threshold": f"(coalesce(factor, 1D) * {fixed.score_threshold}D)"}
    return H.add_drop_alerts(df, interval, SimpleNamespace(**own), keys).drop("_base", "_future", "factor")


def calibration_factors(background: DataFrame, low: float = 0.6, high: float = 1.8) -> DataFrame:
    """Per entity: spread of its reference scores against the median spread, kept within bounds.

    ``background`` has (entity, baseline_std); the median is one number read off
    an exact aggregate over entities.
    """
    mid = background.agg(F.percentile("baseline_std", F.lit(0.5)).alias("_mid"))
    raw = F.col("baseline_std") / F.nullif(F.col("_mid"), F.lit(0.0))
    return attach(background, mid).withColumn(
        "factor", F.least(F.greatest(F.coalesce(raw, F.lit(1.0)), F.lit(low)), F.lit(high))
    ).drop("_mid")


# Expected anomaly shares of the comparator sweep.
CONTAMINATIONS = (0.02, 0.04, 0.06, 0.08, 0.10)


def contamination_sweep(df: DataFrame, raw: str, interval: str, shares: Sequence[float] = CONTAMINATIONS, cfg: RulesConfig = RulesConfig(), keys: Sequence[str] = S.ENTITY) -> DataFrame:
    """Comparator rules at several contaminations of one outlier score (column ``raw``), keyed by (entity, config).

    All cuts of an entity come from one sort of its training scores.
    """
    cuts = F.percentile(F.when(F.col("dataset_split") == "baseline", F.col(raw)), F.array(*[F.lit(x) for x in shares])).over(S.whole(keys))
    names = F.array(*[F.struct(F.lit(f"contamination_{x:.2f}").alias("config"), F.lit(i + 1).alias("i")) for i, x in enumerate(shares)])
    df = df.withColumn("_cuts", cuts).withColumn("_c", F.explode(names)).withColumn("config", F.col("_c.config"))
    df = df.withColumn("if_score", F.col(raw) - F.element_at("_cuts", F.col("_c.i")))
    df = df.withColumn("if_anomaly_point", F.coalesce((F.col("if_score") < 0).cast("int"), F.lit(0))).drop("_cuts", "_c", raw)
    return R.apply_rules(df, interval, cfg, (*keys, "config"))


def contamination_summary(swept: DataFrame) -> DataFrame:
    """Anomalies, episode bins and notifications (also per entity-day) of every contamination, most notifying first."""
    g = swept.groupBy("config").agg(
        F.sum("if_anomaly_point").cast("long").alias("anomalies"), F.sum("pred_lameness_episode").cast("long").alias("episode_bins"),
        F.sum("notif_lameness").cast("long").alias("notifications"), F.count_distinct("entity", F.to_date("bin")).alias("_days"),
    )
    g = g.withColumn("notifications_per_entity_day", F.col("notifications") / F.col("_days")).drop("_days")
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.desc("notifications"), "config")).cast("int"))  # a row per configuration
