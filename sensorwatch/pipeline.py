"""The whole run over all entities in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sensorwatch.config import WatchConfig
from sensorwatch.operators.baseline import add_split
from sensorwatch.operators.features import interval_features
from sensorwatch.operators.fusion import hybrid_warning
from sensorwatch.operators.models import isolation_scores
from sensorwatch.operators.report import entity_summary, model_features, rank_entities
from sensorwatch.operators.rules import apply_rules
from sensorwatch.sources.readings import stored


def run_herd(readings: DataFrame, cfg: WatchConfig = WatchConfig(), comparator: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ranked summary per entity, predictions per interval) of normalised readings.

    ``comparator`` adds the outlier forest and its rules; without it only the two branches and their
    fusion run. Features and predictions are written to the shared folder once each, so neither the
    forest's joins nor the summary compute them again.
    """
    table = add_split(
        interval_features(readings, cfg.interval, cfg.window_baseline), ratio=cfg.baseline_ratio, warmup_bins=cfg.warmup_bins, coverage_min_pct=cfg.coverage_min_pct
    )
    if comparator:
        table, m = stored(table, "features"), cfg.model
        table = isolation_scores(
            table, model_features(table.columns), n_trees=m.n_trees, contamination=m.contamination, max_samples=m.max_samples,
            feature_share=m.feature_fraction, seed=m.seed, coverage_min_pct=cfg.coverage_min_pct,
        )
        table = apply_rules(table, cfg.interval, cfg.rules)
    intervals = stored(hybrid_warning(table, cfg.interval, cfg.hypo, cfg.instability, cfg.fusion), "intervals")
    return rank_entities(entity_summary(intervals)), intervals
