"""Detector settings.

The defaults are fixed values: alerts are only comparable between sites when
every site runs the same numbers.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

SIGNALS = ("steps", "motion", "lying", "standing", "transitions")
COUNT_SIGNALS = ("steps", "motion", "tr_up", "tr_down", "transitions")
DURATION_SIGNALS = ("lying", "standing")
INTERVALS = ("15T", "30T", "1H", "2H", "4H")
FUSION_MODES = ("HYPO_ONLY", "INSTABILITY_ONLY", "OR", "HIERARCHICAL", "SEQUENTIAL")


def interval_minutes(label: str) -> int:
    """Minutes in an interval label such as ``15T``, ``30min`` or ``4H``."""
    text = str(label).strip().upper()
    for suffix, factor in (("MIN", 1), ("T", 1), ("H", 60)):
        number = text.removesuffix(suffix)
        if number != text and number.isdigit() and int(number) > 0:
            return int(number) * factor
    raise ValueError(f"unsupported interval: {label}")


def bins(hours: float, interval: str, floor: int) -> int:
    """Whole bins covering ``hours`` (half-even rounding), never below ``floor``."""
    return max(floor, round(hours * 60 / interval_minutes(interval)))


@dataclass(frozen=True)
class HypoConfig:
    aggregation_hours: float = 12.0
    persistence_hours: float = 6.0
    cooldown_hours: float = 24.0
    family_min_change: float = 0.10
    posture_min_change: float = 0.05
    score_threshold: float = 0.12
    cusum_drift: float = 0.070
    cusum_threshold: float = 1.20
    min_families: int = 3
    coverage_min_pct: float = 25.0
    active_families: tuple[str, ...] = ("steps", "motion", "transitions", "posture")


@dataclass(frozen=True)
class InstabilityConfig:
    aggregation_hours: float = 3.0
    persistence_hours: float = 2.0
    cooldown_hours: float = 12.0
    restless_motion_min_change: float = 0.20
    transition_density_min_change: float = 0.20
    fragmentation_min_change: float = 0.20
    posture_volatility_min_change: float = 0.20
    score_threshold: float = 0.18
    cusum_drift: float = 0.06
    cusum_threshold: float = 0.70
    min_families: int = 2
    coordinated_activity_min_change: float = 0.15
    coordinated_activity_tolerance: float = 0.20
    coverage_min_pct: float = 25.0


@dataclass(frozen=True)
class FusionConfig:
    mode: str = "HIERARCHICAL"
    cooldown_hours: float = 12.0
    sequence_min_hours: float = 0.0
    sequence_max_hours: float = 72.0

    def __post_init__(self):
        if self.mode.upper() not in FUSION_MODES:
            raise ValueError(f"unknown fusion mode {self.mode!r}; expected one of {FUSION_MODES}")


@dataclass(frozen=True)
class RulesConfig:
    persist_hours: float = 7
    alert_min: int = 2
    mix_mode: str = "MIX"
    mix_rate_thr: float = 0.24
    z_low_thr: float = -2.0
    z_high_thr: float = 2.0
    require_two_signals: bool = False
    cooldown_hours: float = 12
    pct_crit_thr: float = 10.0
    mi_z_high_thr: float = 2.2
    episode_requires_coherence: bool = True
    episode_min_families: int = 1
    episode_allow_mi_alone: bool = True
    lameness_min_families: int = 2
    require_mi_for_lameness: bool = False
    coverage_min_pct: float = 25.0
    vote_columns: tuple[str, ...] | None = None  # rolling-z columns that vote; None: the standard panel

    @property
    def mixed(self) -> bool:
        return self.mix_mode.strip().upper() != "IF-ONLY"


@dataclass(frozen=True)
class ModelConfig:
    n_trees: int = 800
    contamination: float = 0.06
    feature_fraction: float = 0.8
    max_samples: int = 256
    seed: int = 42


@dataclass(frozen=True)
class WatchConfig:
    """Everything one run over all entities needs."""

    interval: str = "15T"
    window_baseline: int = 24
    baseline_ratio: float | None = 0.6
    warmup_bins: int = 3
    coverage_min_pct: float = 25.0
    hypo: HypoConfig = HypoConfig()
    instability: InstabilityConfig = InstabilityConfig()
    fusion: FusionConfig = FusionConfig()
    rules: RulesConfig = RulesConfig()
    model: ModelConfig = ModelConfig()

    def as_dict(self) -> dict:
        return asdict(self)
