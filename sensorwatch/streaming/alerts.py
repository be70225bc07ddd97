"""The alert pipeline on a live feed (an extension; results agree with the batch run).

Late readings are handled by a watermark on the interval aggregation. The
scorer keeps, per entity and in typed state, its reference and only what the batch windows reach back to:
recent totals, the CUSUM, the episode flag and the last fired bin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sensorwatch.config import SIGNALS, HypoConfig, bins, interval_minutes
from sensorwatch.functions import series as S
from sensorwatch.operators.baseline import add_expected, add_reference_masks
from sensorwatch.operators.grid import slot_of_day
from sensorwatch.operators.hypo import PERSISTENCE_SHARE, PROGRESSIVE_HOURS, PROGRESSIVE_WEIGHT, family_weights


def interval_stream(readings: DataFrame, interval: str, late: str = "1 hour", signals: Sequence[str] = SIGNALS) -> DataFrame:
    """Tumbling interval sums and counts with late data accepted for ``late``."""
    length = f"{interval_minutes(interval)} minutes"
    g = readings.withWatermark("t", late).groupBy("entity", F.window("t", length).alias("w")).agg(
        F.count(F.lit(1)).alias("n_raw_samples"), *[F.coalesce(F.sum(s), F.lit(0.0)).alias(f"{s}_sum") for s in signals]
    )
    return g.select("entity", F.col("w.start").alias("bin"), "n_raw_samples", *[f"{s}_sum" for s in signals])


def sliding_totals(readings: DataFrame, signal: str, length: str = "12 hours", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Overlapping windows of one signal."""
    g = readings.withWatermark("t", late).groupBy("entity", F.window("t", length, step).alias("w")).agg(F.sum(signal).alias(f"{signal}_total"))
    return g.select("entity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), f"{signal}_total")


def episode_sessions(alerts: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Alert bins of an entity merged into sessions separated by at least ``gap``."""
    g = alerts.withWatermark("bin", late).groupBy("entity", F.session_window("bin", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_bins"))
    return g.select("entity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_bins")


def frozen_reference(history: DataFrame, interval: str, cfg: HypoConfig = HypoConfig()) -> DataFrame:
    """What the scorer needs from the reference period: expected totals per slot, denominator floors, usual count.

    One row per (entity, slot of day), computed in batch from the history. ``live_from`` is the first bin
    that may alert, where the history tells its splits.
    """
    n = bins(cfg.aggregation_hours, interval, 4)
    cols = [f"_t_{s}" for s in SIGNALS]
    df = add_reference_masks(history, only_if_missing=False)
    df = df.withColumns({c: S.rolling_total(F.col(f"{s}_sum"), n) for c, s in zip(cols, SIGNALS)})
    df = add_expected(df, cols)
    df = df.withColumns({f"_lag_{c}": F.lag(c, bins(24, interval, 4)).over(S.ordered()) for c in cols})
    whole = S.whole()
    floors = {}
    for c, s in zip(cols, SIGNALS):
        for kind, x in (("exp", f"_exp_{c}"), ("lag", f"_lag_{c}")):
            mid = F.percentile(F.when(F.col(x) > 0, F.col(x)), F.lit(0.5)).over(whole)
            floors[f"floor_{kind}_{s}"] = F.when(mid.isNotNull(), F.greatest(F.lit(1e-6), mid * 0.05)).otherwise(F.lit(1.0))
    live_from = F.min(F.when(F.col("dataset_split") == "futur", F.col("bin"))).over(whole) if "dataset_split" in df.columns else F.lit(None).cast("timestamp")
    df = df.withColumns(floors).withColumns({"slot": slot_of_day(), "live_from": live_from})
    return df.groupBy("entity", "slot").agg(
        *[F.first(f"_exp_{c}").alias(f"exp_{s}") for c, s in zip(cols, SIGNALS)],
        *[F.first(c).alias(c) for c in floors],
        F.first("expected_raw_per_bin").alias("expected_raw_per_bin"), F.first("live_from").alias("live_from"),
    )


def use_typed_state(spark: SparkSession) -> None:
    """Typed state and timers need the RocksDB state store; call this once per session before ``score_stream``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


REFERENCE = "slots array<int>, expected array<double>, floors array<double>, usual double, live_from long"


def initial_state(reference: DataFrame) -> DataFrame:
    """One row per entity of ``frozen_reference``: slots of the day, expected totals by slot and signal, floors, usual count, first bin that may alert."""
    slot = F.struct("slot", F.array(*[f"exp_{s}" for s in SIGNALS]).alias("expected"))
    floors = F.array(*[F.first(f"floor_{kind}_{s}") for kind in ("exp", "lag") for s in SIGNALS])
    by_entity = reference.groupBy("entity").agg(F.sort_array(F.collect_list(slot)).alias("x"), floors.alias("floors"), F.first("expected_raw_per_bin").alias("usual"), F.first("live_from").alias("live_from"))
    return by_entity.select("entity", F.col("x.slot").alias("slots"), F.flatten("x.expected").alias("expected"), "floors", "usual", "live_from")


# Times in state are microseconds of the session's clock, so that no worker's time zone plays a part.
RECENT = "last long, heard long, timer long, i long, cusum double, episode int, fired long, sums array<double>, totals array<double>, levels array<double>, cands array<int>"
OUT = "entity string, bin timestamp, score double, cusum double, candidate int, episode int, start int, notification int, late int"
NEVER = -(10**9)


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


@dataclass
class Recent:
    """What an entity's next bins depend on: the tails that the windows reach back to, and five scalars."""

    last: pd.Timestamp | None = None  # last scored bin, and last one with a reading
    heard: pd.Timestamp | None = None
    timer: int | None = None
    i: int = -1
    cusum: float = 0.0
    episode: int = 0
    fired: int = NEVER
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, len(SIGNALS))))
    totals: np.ndarray = field(default_factory=lambda: np.zeros((0, len(SIGNALS))))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cands: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    @classmethod
    def of(cls, row: tuple) -> Recent:
        last, heard, timer, i, cusum, episode, fired, sums, totals, levels, cands = row
        tail = lambda x: np.array([np.nan if v is None else v for v in x], float)
        return cls(_time(last), _time(heard), timer, i, cusum, episode, fired, tail(sums).reshape(-1, len(SIGNALS)), tail(totals).reshape(-1, len(SIGNALS)), tail(levels), np.array(cands, int))

    def row(self) -> tuple:
        return (
            _micros(self.last), _micros(self.heard), self.timer, int(self.i), float(self.cusum), int(self.episode), int(self.fired),
            self.sums.ravel().tolist(), self.totals.ravel().tolist(), self.levels.tolist(), [int(x) for x in self.cands],
        )


def _windows(tail: np.ndarray, new: np.ndarray, n: int) -> np.ndarray:
    """(new rows, n, ...) values of the window that ends at each new row; NaN before the first row."""
    missing = np.full((max(0, n - 1 - len(tail)), *new.shape[1:]), np.nan)
    whole = np.concatenate([missing, tail[max(0, len(tail) - n + 1) :], new])
    return np.moveaxis(np.lib.stride_tricks.sliding_window_view(whole, n, axis=0), -1, 1)


def _before(tail: np.ndarray, new: np.ndarray, lag: int) -> np.ndarray:
    """Each new row's value ``lag`` rows earlier, NaN where there is none."""
    whole = np.concatenate([np.full((max(0, lag - len(tail)), *new.shape[1:]), np.nan), tail[max(0, len(tail) - lag) :], new])
    return whole[: len(new)]


class Rules:
    """The drop branch over a run of consecutive bins, continued from an entity's state."""

    def __init__(self, cfg: HypoConfig, interval: str):
        self.cfg, self.weights = cfg, np.array([family_weights(cfg.active_families)[f] for f in ("steps", "motion", "transitions", "posture")])
        self.n, self.day, self.k = bins(cfg.aggregation_hours, interval, 4), bins(24, interval, 4), bins(cfg.persistence_hours, interval, 2)
        self.lag, self.wait = bins(PROGRESSIVE_HOURS, interval, 2), bins(cfg.cooldown_hours, interval, 1)

    def advance(self, s: Recent, values: np.ndarray, counts: np.ndarray, live: np.ndarray, expected: np.ndarray, floors: np.ndarray, usual: float) -> dict[str, np.ndarray]:
        """Score the next bins of ``s`` in order and move it on; ``expected`` has their slots' totals, NaN where unknown."""
        cfg, names = self.cfg, list(SIGNALS)
        window = _windows(s.sums, values, self.n)
        known = (~np.isnan(window)).sum(axis=1)
        totals = np.where(known >= max(4, self.n // 2), np.nansum(window, axis=1), np.nan)
        yesterday = _before(s.totals, totals, self.day)
        five = len(names)
        floors = np.where(np.isnan(floors), 1.0, floors)
        ratios = [np.clip(totals / np.maximum(ref, floor), 0.0, 3.0) for ref, floor in ((expected, floors[:five]), (yesterday, floors[five:]))]
        ratio = np.where(np.array(names) == "lying", np.fmax(*ratios), np.fmin(*ratios))
        by = {x: ratio[:, j] for j, x in enumerate(names)}
        low = {x: np.clip(1.0 - by[x], 0.0, 1.0) for x in names}
        mean = lambda *xs: np.where((c := sum((~np.isnan(x)).astype(int) for x in xs)) > 0, sum(np.nan_to_num(x) for x in xs) / np.maximum(c, 1), np.nan)
        posture = mean(np.clip(by["lying"] - 1.0, 0.0, 1.0), low["standing"])
        change = np.stack([low["steps"], low["motion"], low["transitions"], posture], axis=1)
        score = (self.weights * np.nan_to_num(change)).sum(axis=1)
        least = np.array([cfg.family_min_change] * 3 + [cfg.posture_min_change])
        hit = (self.weights > 0) & (np.nan_to_num(change, nan=-1.0) >= least)
        active = [by[x] for x, w in zip(("steps", "motion", "transitions"), self.weights, strict=False) if w > 0]
        level = mean(*active) if active else np.full(len(values), np.nan)
        drop = np.nan_to_num(np.clip(_before(s.levels, level, self.lag) - level, 0.0, 1.0))
        covered = (np.minimum(counts / usual, 1.0) * 100.0 >= cfg.coverage_min_pct) if usual > 0 else np.zeros(len(values), bool)
        core = hit[:, 0] | hit[:, 1] | (self.weights[0] + self.weights[1] == 0)
        cand = (live.astype(bool) & (score >= cfg.score_threshold) & (hit.sum(axis=1) >= cfg.min_families) & core & covered).astype(int)
        path = s.cusum + np.cumsum(np.where(cand == 1, score + PROGRESSIVE_WEIGHT * drop, 0.0) - cfg.cusum_drift)
        cusum = path - np.minimum(0.0, np.minimum.accumulate(path))
        recent = _windows(s.cands.astype(float), cand.astype(float), self.k)
        episode = ((~np.isnan(recent)).all(axis=1) & (np.nansum(recent, axis=1) / self.k >= PERSISTENCE_SHARE) & (cusum >= cfg.cusum_threshold)).astype(int)
        start = episode * (1 - np.concatenate([[s.episode], episode[:-1]]))
        fire = np.zeros(len(values), int)
        for j in np.flatnonzero(start):
            at = s.i + 1 + int(j)
            if at - s.fired > self.wait:
                fire[j], s.fired = 1, at
        s.i, s.cusum, s.episode = s.i + len(values), float(cusum[-1]), int(episode[-1])
        for name, new, keep in (("sums", values, self.n - 1), ("totals", totals, self.day), ("levels", level, self.lag), ("cands", cand, self.k - 1)):
            both = np.concatenate([getattr(s, name), new])
            setattr(s, name, both[max(0, len(both) - keep) :])
        return {"score": np.clip(score, 0.0, 1.0), "cusum": cusum, "candidate": cand, "episode": episode, "start": start, "notification": fire}


class Scorer(StatefulProcessor):
    """Typed state per entity: its reference and its recent bins. An event-time timer settles silent bins."""

    def __init__(self, rules: Rules, interval: str, forget: pd.Timedelta, zone: str):
        self.rules, self.step, self.forget, self.zone = rules, pd.Timedelta(minutes=interval_minutes(interval)), forget, zone

    def init(self, handle) -> None:
        self.handle, self.reference, self.recent = handle, handle.getValueState("reference", REFERENCE), handle.getValueState("recent", RECENT)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        listed = lambda x, kind: [None if v is None or v != v else kind(v) for v in x]
        live = None if pd.isna(row["live_from"]) else _micros(row["live_from"])
        self.reference.update((listed(row["slots"], int), listed(row["expected"], float), listed(row["floors"], float), None if pd.isna(row["usual"]) else float(row["usual"]), live))

    def _profile(self) -> tuple[dict[int, np.ndarray], np.ndarray, float, pd.Timestamp | None]:
        five = len(SIGNALS)
        if not self.reference.exists():
            return {}, np.full(2 * five, np.nan), 0.0, None
        slots, expected, floors, usual, live = self.reference.get()
        nan = lambda xs: np.array([np.nan if v is None else v for v in xs], float)
        return dict(zip(slots, nan(expected).reshape(-1, five), strict=True)), nan(floors), usual or 0.0, None if live is None else _time(live)

    def _score(self, s: Recent, times: pd.DatetimeIndex, at: np.ndarray, values: np.ndarray, counts: np.ndarray, live: np.ndarray) -> pd.DataFrame:
        """Score consecutive bins ``times`` of which ``at`` have readings; silent ones may alert from ``live_from`` on, or as the next reading says."""
        by_slot, floors, usual, live_from = self._profile()
        n, five = len(times), len(SIGNALS)
        all_values, all_counts = np.zeros((n, five)), np.zeros(n)
        all_values[at], all_counts[at] = values, counts
        follows = np.minimum(np.searchsorted(at, np.arange(n)), max(len(at) - 1, 0))
        may = live[follows] if len(at) else np.ones(n)
        if live_from is not None:
            silent = np.ones(n, bool)
            silent[at] = False
            may = np.where(silent, times >= live_from, may)
        unknown = np.full(five, np.nan)
        expected = np.array([by_slot.get(t.hour * 60 + t.minute, unknown) for t in times])
        out = pd.DataFrame({"bin": times} | self.rules.advance(s, all_values, all_counts, may, expected, floors, usual))
        s.last = times[-1]
        return out

    def _silence(self, s: Recent, upto: pd.Timestamp) -> list[pd.DataFrame]:
        """Scores of the silent bins after the last scored one."""
        times, nothing = pd.date_range(s.last + self.step, upto, freq=self.step), np.zeros(0, int)
        return [self._score(s, times, nothing, np.zeros((0, len(SIGNALS))), nothing, nothing).assign(late=0)] if len(times) else []

    def _keep(self, s: Recent) -> None:
        """Store the state and ask to be woken when the next bin can no longer get a reading."""
        due = (s.last + self.step).tz_localize(self.zone, ambiguous=True, nonexistent="shift_forward").value // 10**6 + 1
        if s.timer is not None and s.timer != due:
            self.handle.deleteTimer(s.timer)
        if s.timer != due:
            self.handle.registerTimer(due)
        s.timer = due
        self.recent.update(s.row())

    def _told(self, key, frames: list[pd.DataFrame]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        told = pd.concat(frames) if frames else pd.DataFrame(columns=names[1:])
        told.insert(0, "entity", key[0])
        return told.reindex(columns=names).astype({c: "Int64" for c in ("candidate", "episode", "start", "notification", "late")} | {c: "float64" for c in ("score", "cusum")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Bins after the last scored one, silent ones between them included; earlier or repeated ones are passed on as late."""
        data = pd.concat(list(rows)).sort_values("bin", kind="stable")
        s = Recent.of(self.recent.get()) if self.recent.exists() else Recent()
        fresh = ~data["bin"].duplicated().to_numpy() & (np.ones(len(data), bool) if s.last is None else (data["bin"] > s.last).to_numpy())
        frames = [pd.DataFrame({"bin": data["bin"][~fresh], "late": 1})] if not fresh.all() else []
        data = data[fresh]
        if len(data):
            gap = data["bin"].diff().fillna(data["bin"].iloc[0] - s.heard if s.heard is not None else pd.Timedelta(0))
            for _, part in data.groupby((gap > self.forget).cumsum(), sort=True):
                if s.heard is not None and part["bin"].iloc[0] - s.heard > self.forget:
                    frames += self._silence(s, s.heard + self.forget)
                    s = Recent(timer=s.timer)  # heard of too long ago: as a new entity
                first = part["bin"].iloc[0] if s.last is None else s.last + self.step
                times = pd.date_range(first, part["bin"].iloc[-1], freq=self.step)
                at = ((part["bin"] - first) // self.step).to_numpy(int)
                frames.append(self._score(s, times, at, part[[f"{x}_sum" for x in SIGNALS]].to_numpy(float), part["n_raw_samples"].to_numpy(float), part["live"].to_numpy(float)).assign(late=0))
                s.heard = part["bin"].iloc[-1]
            self._keep(s)
        yield self._told(key, frames)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Score the bins that stayed silent up to the watermark; an entity silent for longer than ``forget`` is forgotten."""
        if not self.recent.exists():
            return
        s = Recent.of(self.recent.get())
        settled = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms", tz="UTC").tz_convert(self.zone).tz_localize(None)
        frames = self._silence(s, min(settled, s.heard + self.forget))
        if settled > s.heard + self.forget:
            self.recent.clear()
        elif frames:
            s.timer = None
            self._keep(s)
        yield self._told(key, frames)

    def close(self) -> None:
        pass


def score_stream(rows: DataFrame, reference: DataFrame, interval: str, settings: HypoConfig = HypoConfig(), late: str = "1 day", forget: str = "60 days") -> DataFrame:
    """Drop-branch alerts per bin of a stream, equal to the batch branch over the same bins.

    ``reference`` (``frozen_reference`` of the history) is the initial state: it is loaded into each entity's state once and never
    travels with the rows. The state besides holds the last day of totals and a few scalars. A bin is
    scored when it arrives, together with the silent bins before it; rows of a micro-batch are put in order. When the watermark
    (``late`` behind the newest bin) has passed a silent bin, a timer scores it without any new row, until the
    entity has been silent for ``forget``: then its state goes, and a later row starts it anew. A row that is
    not after the entity's last scored bin leaves the state alone and is passed on with ``late`` 1 and no scores; rows
    behind the watermark are dropped by Spark and counted in its progress. A row's ``live`` column (default 1) says
    whether it may alert; for silent bins ``live_from`` does. Entities without a reference never alert on it.
    """
    if "live" not in rows.columns:
        rows = rows.withColumn("live", F.lit(1))
    narrow = rows.select("entity", "bin", "n_raw_samples", "live", *[f"{s}_sum" for s in SIGNALS]).withWatermark("bin", late)
    scorer = Scorer(Rules(settings, interval), interval, pd.Timedelta(forget), rows.sparkSession.conf.get("spark.sql.session.timeZone"))
    return narrow.groupBy("entity").transformWithStateInPandas(scorer, OUT, "append", "EventTime", initial_state(reference).groupBy("entity"))
