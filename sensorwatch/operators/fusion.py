"""Fusion of the two branches into one notification stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorwatch.config import FusionConfig, HypoConfig, InstabilityConfig, bins
from sensorwatch.functions import blocks as B
from sensorwatch.functions import series as S
from sensorwatch.functions.scalars import flag
from sensorwatch.operators.baseline import masks
from sensorwatch.operators.hypo import BRANCH_INPUTS, DROP_TYPES, SCOPE, alerts, branch_inputs, drop_evidence, drop_stream
from sensorwatch.operators.hypo import cooldowns as branch_cooldowns
from sensorwatch.operators.instability import INSTABILITY_TYPES, decided, excesses, instability_branch, instability_stream
from sensorwatch.operators.instability import SCOPE as INSTABILITY_SCOPE

def any_of(*flags: np.ndarray) -> np.ndarray:
    return reduce(np.logical_or, flags)


def fused(mode: str, h: Column, hs: Column, i: Column, i_start: Column, seq: Column, mix_start: Column, either: Callable = F.greatest) -> tuple[Column, Column]:
    """Episode and start under a mode, from episodes and starts of both branches, sequence starts and starts of mixed runs
    (columns, or matrices of flags with ``any_of``)."""
    return {
        "HYPO_ONLY": (h, hs),
        "INSTABILITY_ONLY": (i, i_start),
        "OR": (either(h, i), either(hs, i_start)),
        "SEQUENTIAL": (seq, seq),
        "HIERARCHICAL": (h, either(hs, mix_start, seq)),
    }[mode]


def fuse(
    df: DataFrame, interval: str, cfg: FusionConfig = FusionConfig(), keys: Sequence[str] = S.ENTITY, waiting: Sequence[tuple] = (),
    notify: bool = True,
) -> DataFrame:
    """Combine branch episodes and starts under the chosen mode.

    ``waiting`` are cooldowns that the branches have left to this step: one ordered pass then serves branches and fusion.
    ``notify=False`` leaves the fused stream's own cooldown to the caller too.
    """
    mode = cfg.mode.upper()
    least = bins(cfg.sequence_min_hours, interval, 0)
    most = bins(cfg.sequence_max_hours, interval, least + 1)
    if "pos" not in df.columns:
        df = S.add_position(df, keys)
    df = df.withColumns(
        {
            "_h": F.coalesce(F.col("behavioral_warning_episode").cast("int"), F.lit(0)),
            "_i": F.coalesce(F.col("instability_warning_episode").cast("int"), F.lit(0)),
            "_is": F.coalesce(F.col("instability_warning_start").cast("int"), F.lit(0)),
        }
    )
    hs = (
        F.coalesce(F.col("behavioral_warning_start").cast("int"), F.lit(0))
        if "behavioral_warning_start" in df.columns
        else S.rising("_h", keys)
    )
    df = df.withColumns({"_hs": hs, "_mix": flag((F.col("_h") == 1) & (F.col("_i") == 1))})
    df = S.add_prior_event(df, "_is", least, most, "_prior", keys)
    df = df.withColumns(
        {
            "hybrid_warning_sequence_start": flag((F.col("_hs") == 1) & (F.col("_prior") == 1)),
            "_mix_start": S.rising("_mix", keys),
        }
    )
    h, i, seq, mix = (F.col(c) for c in ("_h", "_i", "hybrid_warning_sequence_start", "_mix"))
    episode, start = fused(mode, h, F.col("_hs"), i, F.col("_is"), seq, F.col("_mix_start"))
    df = df.withColumns(
        {
            "hybrid_warning_score": F.greatest("behavioral_warning_score", "instability_warning_score"),
            "hybrid_warning_episode": episode,
            "hybrid_warning_start": start,
            "hybrid_warning_surveillance": flag((i == 1) & (h == 0)),
            "hybrid_warning_type": F.when(seq == 1, "SEQUENCE")
            .when(mix == 1, "MIXTE")
            .when(h == 1, "HYPO")
            .when(i == 1, "INSTABILITE")
            .otherwise("AUCUN"),
            "hybrid_warning_priority": F.when((seq == 1) | (mix == 1), 3).when(h == 1, 2).when(i == 1, 1).otherwise(0),
            "hybrid_warning_fusion_mode": F.lit(mode),
            "hybrid_warning_scope": F.lit(SCOPE),
        }
    )
    own = ("hybrid_warning_start", bins(cfg.cooldown_hours, interval, 1), "hybrid_warning_notification")
    df = S.add_cooldowns(df, [*waiting, own], keys) if notify else df
    return df.drop("_h", "_i", "_hs", "_is", "_prior", "_mix", "_mix_start")


def hybrid_warning(
    df: DataFrame,
    interval: str,
    hypo: HypoConfig = HypoConfig(),
    instability: InstabilityConfig = InstabilityConfig(),
    fusion: FusionConfig = FusionConfig(),
    keys: Sequence[str] = S.ENTITY,
    notify: bool = True,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Both branches and their fusion (``notify``: with notifications); a drop branch already present is kept.

    Both branches and the fusion are one pass over whole series. ``only`` names the added columns that are wanted, if not all.
    """
    branch = [f"behavioral_warning_{x}" for x in ("score", "episode", "start")]
    return S.beside(df, [*keys, *BRANCH_INPUTS, *branch], lambda own: _hybrid_warning(own, interval, hypo, instability, fusion, keys, notify, only))


def sequence_reach(interval: str, cfg: FusionConfig) -> tuple[int, int]:
    """How many bins (most, least) an instability start may lie before a drop start to open a sequence."""
    least = bins(cfg.sequence_min_hours, interval, 0)
    return bins(cfg.sequence_max_hours, interval, least + 1), max(1, least)


PREFIXES = ("behavioral_warning", "instability_warning")


def _hybrid_warning(
    df: DataFrame, interval: str, hypo: HypoConfig, instability: InstabilityConfig, fusion: FusionConfig, keys: Sequence[str], notify: bool, only: Sequence[str] | None
) -> DataFrame:
    if "behavioral_warning_episode" in df.columns:
        given = [*df.columns]
        df = instability_branch(df, interval, instability, keys, notify=False)
        df = fuse(df, interval, fusion, keys, branch_cooldowns([instability_stream(interval, instability)]), notify)
        return df if only is None else df.select(*[c for c in df.columns if c in {*given, *only}])
    df = df if "pos" in df.columns else S.add_position(df, keys)
    labelled, mode = "dataset_split" in df.columns, fusion.mode.upper()
    streams = (drop_stream(interval, hypo), instability_stream(interval, instability))
    waits = {**{s.prefix: s.wait for s in streams}, "hybrid_warning": bins(fusion.cooldown_hours, interval, 1)}

    def fn(b: B.Block, given: dict) -> dict:
        slots = B.Slots(b, given["slot"][0])
        base, future = masks(b, given, False, labelled)
        base_i, future_i = masks(b, given, True, labelled)
        drop = drop_evidence(b, given, interval, hypo, base, future, slots)
        changes = excesses(b, given, interval, bins(instability.aggregation_hours, interval, 4), base_i, slots)
        other = decided(b, given, changes, instability, future_i)
        out = drop.columns | changes | other.columns
        for own, stream in zip((drop, other), streams, strict=True):
            out |= {f"{stream.prefix}_{k}": x for k, x in alerts(b, own, stream).items()}
        (h, i), (hs, i_start) = ([out[f"{p}_{x}"] for p in PREFIXES] for x in ("episode", "start"))
        seq = hs & B.within(i_start, *sequence_reach(interval, fusion))
        episode, start = fused(mode, h, hs, i, i_start, seq, B.rising(h & i), any_of)
        out |= {"hybrid_warning_sequence_start": seq, "hybrid_warning_score": np.maximum(*[out[f"{p}_score"] for p in PREFIXES])}
        out |= {"hybrid_warning_episode": episode, "hybrid_warning_start": start, "hybrid_warning_surveillance": i & ~h}
        return out | ({f"{p}_notification": B.fired(out[f"{p}_start"], b.whole(given["pos"]), wait) for p, wait in waits.items()} if notify else {})

    told = [f"{p}_cusum double" for p in PREFIXES] + [f"{p}_{x} int" for x in ("episode", "start") for p in PREFIXES]
    fusion_types = "hybrid_warning_sequence_start int, hybrid_warning_score double, hybrid_warning_episode int, hybrid_warning_start int, hybrid_warning_surveillance int"
    outputs = ", ".join([DROP_TYPES, INSTABILITY_TYPES, *told, fusion_types, *[f"{p}_notification int" for p in waits if notify]])
    derived, given = set(only or ()) - set(outputs.replace(",", "").split()), set(df.columns)
    df = B.series_pass(df, keys, branch_inputs(df), outputs, fn, only=None if derived else only)
    if only is not None and not derived:
        return df
    h, i = (F.col(f"{p}_episode") for p in PREFIXES)
    seq = F.col("hybrid_warning_sequence_start")
    after = {
        "behavioral_warning_score": {"behavioral_warning_scope": F.lit(SCOPE)},
        "instability_warning_candidate": {"instability_warning_scope": F.lit(INSTABILITY_SCOPE)},
        "hybrid_warning_surveillance": {
            "hybrid_warning_type": F.when(seq == 1, "SEQUENCE").when((h == 1) & (i == 1), "MIXTE").when(h == 1, "HYPO").when(i == 1, "INSTABILITE").otherwise("AUCUN"),
            "hybrid_warning_priority": F.when((seq == 1) | ((h == 1) & (i == 1)), 3).when(h == 1, 2).when(i == 1, 1).otherwise(0),
            "hybrid_warning_fusion_mode": F.lit(mode),
            "hybrid_warning_scope": F.lit(SCOPE),
        },
    }
    df = df.select(*[x for c in df.columns for x in (F.col(f"`{c}`"), *[v.alias(k) for k, v in after.get(c, {}).items()])])
    return df if only is None else df.select(*[f"`{c}`" for c in df.columns if c in given or c in only])
