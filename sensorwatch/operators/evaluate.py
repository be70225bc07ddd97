"""Credit an alert only for what an adjustment adds over the untouched run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorwatch.config import interval_minutes
from sensorwatch.functions import blocks as B
from sensorwatch.functions import series as S
from sensorwatch.functions.scalars import flag

IOU_LEVEL = 0.20
MATCH_TOLERANCE_HOURS = 1.0


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column, bin_s: int) -> Column:
    """Shared time of two inclusive bin ranges; one common bin counts its full length."""
    lo, hi = F.greatest(a0, b0), F.least(a1, b1)
    return F.when(hi < lo, F.lit(0.0)).otherwise((F.unix_timestamp(hi) - F.unix_timestamp(lo) + bin_s).cast("double"))


def iou(a0: Column, a1: Column, b0: Column, b1: Column, bin_s: int) -> Column:
    inter = overlap_seconds(a0, a1, b0, b1, bin_s)
    la = F.unix_timestamp(a1) - F.unix_timestamp(a0) + bin_s
    lb = F.unix_timestamp(b1) - F.unix_timestamp(b0) + bin_s
    return F.when(inter > 0, inter / F.greatest(F.lit(1e-9), la + lb - inter)).otherwise(F.lit(0.0))


def segments(df: DataFrame, flag_col: str, keys: Sequence[str] = S.ENTITY) -> DataFrame:
    """Runs of 1s as rows (start, end, n_bins)."""
    df = S.add_islands(df, flag_col, "segment", keys)
    return df.where(F.col("segment").isNotNull()).groupBy(*keys, "segment").agg(
        F.min("bin").alias("start"), F.max("bin").alias("end"), F.count(F.lit(1)).alias("n_bins")
    )


def _islands_iou(df: DataFrame, flags: dict[str, str], bin_s: int, keys: Sequence[str]) -> DataFrame:
    """Per row and flag (flag column -> output): IoU between the row's run of 1s and the event window (0 outside runs).

    A run begins at the last row before that turned the flag on and ends at the next one that turns it off, so all flags
    share one sort by time and one against it.
    """
    e = S.ordered(keys)
    df = df.withColumns(
        {f"_on_{c}": F.when(S.rising(c, keys) == 1, F.col("bin")) for c in flags}
        | {f"_off_{c}": F.when((F.col(c) == 1) & (F.coalesce(F.lead(c).over(e), F.lit(0)) != 1), F.col("bin")) for c in flags}
    )
    back = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_s0_{c}": F.max(f"_on_{c}").over(S.so_far(keys)) for c in flags})
    df = df.withColumns({f"_s1_{c}": F.min(f"_off_{c}").over(back) for c in flags})
    value = {out: F.when(F.col(c) == 1, iou(F.col("start"), F.col("end"), F.col(f"_s0_{c}"), F.col(f"_s1_{c}"), bin_s)).otherwise(F.lit(0.0)) for c, out in flags.items()}
    return df.withColumns(value).drop(*[f"{x}_{c}" for c in flags for x in ("_on", "_off", "_s0", "_s1")])


def _island_iou(df: DataFrame, flag_col: str, out: str, bin_s: int, keys: Sequence[str]) -> DataFrame:
    return _islands_iou(df, {flag_col: out}, bin_s, keys)


def attributable(
    df: DataFrame,
    interval: str,
    episode: str,
    start: str,
    score: str,
    ref_episode: str = "ref_episode",
    ref_start: str = "ref_start",
    keys: Sequence[str] = ("entity", "event_id"),
    tolerance_hours: float = MATCH_TOLERANCE_HOURS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per event: new starts, attributable overlap, best IoU, delay, peak score.

    ``df`` holds every bin of every adjusted series with the window (``start``,
    ``end``) and the untouched run's flags alongside. Everything is a window of
    the same key, followed by one combined aggregation.
    """
    streams = {"": (episode, start, score, ref_episode, ref_start)}
    return attributable_streams(df, interval, streams, keys, tolerance_hours, carry)


def attributable_streams(
    df: DataFrame,
    interval: str,
    streams: Mapping[str, tuple[str, str, str, str, str]],
    keys: Sequence[str] = ("entity", "event_id"),
    tolerance_hours: float = MATCH_TOLERANCE_HOURS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``attributable`` of several alert streams side by side; a stream's measures begin with its name.

    ``streams`` maps the prefix to (episode, start, score, untouched episode, untouched start). One pass over whole series
    evaluates all of them; ``carry`` are columns that are the same in every row of an event.
    """
    minutes = interval_minutes(interval)
    reach = int(tolerance_hours * 60 // minutes)
    names = ("ep", "st", "score", "ref", "ref_st")
    inputs = event_inputs()
    for i, columns in enumerate(streams.values()):
        inputs |= {f"{name}{i}": F.col(c).cast("double" if name == "score" else "int") for name, c in zip(names, columns, strict=True)}

    def fn(b: B.Block, given: dict) -> dict:
        out, window = {}, EventWindow(b, given, minutes * 60)
        for i, p in enumerate(streams):
            ep, st, ref, ref_st = (b.whole(given[f"{x}{i}"]) for x in ("ep", "st", "ref", "ref_st"))
            own = window.measures(ep == 1, st == 1, ref == 1, B.within(ref_st != 0, reach, -reach), b.known(given[f"score{i}"]))
            out |= {f"{p}{m}": x for m, x in own.items()}
        return out

    outputs = ", ".join(f"`{p}{m}` {kind}" for p in streams for m, kind in MEASURES.items())
    return B.series_reduce(df, keys, carry, inputs, outputs, fn)


MEASURES = {
    "detected_any_overlap": "int", "novel_start_count": "int", "episode_overlap": "int", "detected_iou20": "int", "best_iou": "double",
    "episode_overlap_raw": "int", "detected_iou20_raw": "int", "best_iou_raw": "double", "attributable_interval_count": "int",
    "onset_delay_hours": "double", "score_max": "double",
}


def event_inputs() -> dict[str, Column]:
    return {"bin": F.unix_micros(F.col("bin").cast("timestamp")), "from": F.unix_micros(F.col("start").cast("timestamp")), "to": F.unix_micros(F.col("end").cast("timestamp"))}


class EventWindow:
    """The event windows of a block's series, and the measures of alert streams on them."""

    def __init__(self, b: B.Block, given: dict, bin_s: int):
        self.b, self.bin_s, self.bin = b, bin_s, b.whole(given["bin"])
        self.lo, self.hi = b.known(given["from"]), b.known(given["to"])
        self.inside = b.there & self.lo.ok & self.hi.ok & (self.bin >= self.lo.x) & (self.bin <= self.hi.x)

    def _iou(self, on: np.ndarray) -> np.ndarray:
        """IoU between the event window and a row's run of flags (0 outside runs)."""
        opens, closes = np.where(B.rising(on), np.arange(on.shape[1]), 0), on & ~np.roll(on, -1, axis=1)
        closes[:, -1] = on[:, -1]
        upto = np.where(closes, np.arange(on.shape[1]), on.shape[1] - 1)
        i = np.arange(len(on))[:, None]
        s0 = self.bin[i, np.maximum.accumulate(opens, axis=1)]
        s1 = self.bin[i, np.minimum.accumulate(upto[:, ::-1], axis=1)[:, ::-1]]
        second = lambda x: x // 1_000_000
        lo, hi = np.where(self.lo.ok, np.maximum(self.lo.x, s0), s0), np.where(self.hi.ok, np.minimum(self.hi.x, s1), s1)
        shared = np.where(hi < lo, 0.0, (second(hi) - second(lo) + self.bin_s).astype(float))
        own = second(self.hi.x) - second(self.lo.x) + self.bin_s
        whole = np.maximum(1e-9, own + (second(s1) - second(s0) + self.bin_s) - shared)
        return np.where(on & (shared > 0), shared / np.where(self.lo.ok & self.hi.ok, whole, 1e-9), 0.0)

    def measures(self, episode: np.ndarray, start: np.ndarray, ref: np.ndarray, near: np.ndarray, score: B.Known) -> dict:
        """``event_measures`` of a stream: its episodes and starts, the untouched run's episodes, and where one of its starts is near."""
        attributable, novel = episode & ~ref & self.b.there, self.inside & start & ~near
        own, raw = self._iou(attributable), self._iou(episode & self.b.there)
        most = lambda x: x.max(axis=1, keepdims=True)
        top = np.iinfo(np.int64).max
        new = np.where(novel, self.bin, top).min(axis=1, keepdims=True)
        begin = np.where(self.lo.ok, self.lo.x, top).min(axis=1, keepdims=True)
        peak = score.where(self.inside)
        return {
            "detected_any_overlap": most(novel), "novel_start_count": novel.sum(axis=1, keepdims=True), "episode_overlap": most(own > 0),
            "detected_iou20": most(own >= IOU_LEVEL), "best_iou": most(own), "episode_overlap_raw": most(raw > 0), "detected_iou20_raw": most(raw >= IOU_LEVEL),
            "best_iou_raw": most(raw), "attributable_interval_count": attributable.sum(axis=1, keepdims=True),
            "onset_delay_hours": B.Known((new // 1_000_000 - begin // 1_000_000) / 3600.0, most(novel) & (begin < top)),
            "score_max": B.Known(most(peak.fill(-np.inf)), most(peak.ok)),
        }


def event_measures(score: str, tag: str = "", prefix: str = "") -> list[Column]:
    """Measures of an event from its rows with ``_in``, ``_att``, ``_novel``, ``_iou`` and ``_iou_raw`` (each but ``_in`` with ``tag`` at its end)."""
    novel, att, own, raw = (F.col(f"{c}{tag}") for c in ("_novel", "_att", "_iou", "_iou_raw"))
    first_new = F.min(F.when(novel == 1, F.col("bin")))
    return [
        F.max(novel).alias(f"{prefix}detected_any_overlap"),
        F.sum(novel).cast("int").alias(f"{prefix}novel_start_count"),
        F.max((own > 0).cast("int")).alias(f"{prefix}episode_overlap"),
        F.max((own >= IOU_LEVEL).cast("int")).alias(f"{prefix}detected_iou20"),
        F.max(own).alias(f"{prefix}best_iou"),
        F.max((raw > 0).cast("int")).alias(f"{prefix}episode_overlap_raw"),
        F.max((raw >= IOU_LEVEL).cast("int")).alias(f"{prefix}detected_iou20_raw"),
        F.max(raw).alias(f"{prefix}best_iou_raw"),
        F.sum(att).cast("int").alias(f"{prefix}attributable_interval_count"),
        ((F.unix_timestamp(first_new) - F.unix_timestamp(F.min("start"))) / 3600.0).alias(f"{prefix}onset_delay_hours"),
        F.max(F.when(F.col("_in") == 1, F.col(score))).alias(f"{prefix}score_max"),
    ]


def with_reference(pred: DataFrame, clean: DataFrame, episode: str, start: str) -> DataFrame:
    """Attach an untouched run held in another table: left join on (entity, bin), last duplicate wins."""
    ref = clean.groupBy("entity", "bin").agg(
        F.max_by(episode, "seq").alias("ref_episode"), F.max_by(start, "seq").alias("ref_start")
    ) if "seq" in clean.columns else clean.select(
        "entity", "bin", F.col(episode).alias("ref_episode"), F.col(start).alias("ref_start")
    )
    return pred.join(ref, ["entity", "bin"], "left")


def explained_matches(
    pred: DataFrame, interval: str, persist_bins: int, alert_min: int, rate_thr: float,
    keys: Sequence[str] = ("entity", "event_id"), carry: Sequence[str] = (),
) -> DataFrame:
    """Raw overlap of rule episodes with event windows, and a sentence saying why an event was missed."""
    minutes = interval_minutes(interval)
    df = pred.withColumn("_in", flag((F.col("bin") >= F.col("start")) & (F.col("bin") <= F.col("end"))))
    df = _island_iou(df, "pred_lameness_episode", "_iou", minutes * 60, keys)
    win = lambda c: F.when(F.col("_in") == 1, F.col(c))
    g = df.groupBy(*keys, *carry).agg(
        F.max((F.col("_iou") > 0).cast("int")).alias("detected_any_overlap"),
        F.max((F.col("_iou") >= IOU_LEVEL).cast("int")).alias("detected_iou20"),
        F.max("_iou").alias("best_iou"),
        F.sum("_in").cast("int").alias("duration_bins"),
        F.max(win("if_anom_k")).cast("double").alias("if_anom_k_max"),
        F.max(win("anom_rate_k")).alias("anom_rate_k_max"),
        F.avg(win("coherence_boiterie")).alias("coherence_boiterie_mean"),
        F.avg(win("in_cooldown")).alias("cooldown_ratio"),
    )
    n, k, rate, coh = (F.col(c) for c in ("duration_bins", "if_anom_k_max", "anom_rate_k_max", "coherence_boiterie_mean"))
    why = F.concat_ws(
        " ",
        F.when(n < persist_bins, F.format_string(f"Duration too short for persistence window: %d < K={persist_bins}.", n)),
        F.when(rate < rate_thr, F.format_string(f"anom_rate_k peak %.3f below threshold {rate_thr:.3f}.", rate)),
        F.when(k < alert_min, F.format_string(f"if_anom_k peak %.1f below alert_min {alert_min}.", k)),
        F.when(coh < 0.5, F.lit("Low coherence_boiterie on injected window.")),
        F.when(F.col("cooldown_ratio") >= 0.8, F.lit("Most of the window is under cooldown.")),
    )
    return g.withColumn(
        "why",
        F.when(F.col("detected_any_overlap") == 1, "Overlap with at least one predicted behavioral-warning episode.")
        .when(why == "", "Signal remained below decision rules or was too fragmented.")
        .otherwise(why),
    )
