"""Checks of the streaming queries: the same results from a batch over everything."""

from __future__ import annotations

from oracle import base as B
from oracle import detectors as D
from oracle.campaign import TS
from oracle.core import BRANCH, GRID, SPLIT

SUMS = ", ".join(f"{s}_sum" for s in B.SIGNALS)
CHECKS: dict[str, str] = {
    "st01_interval_stream": B.sql(f"SELECT entity, {TS('bin')}, n AS n_raw_samples, " + ", ".join(f"round(coalesce({s}_sum, 0), 6) + 0.0 AS {s}_sum" for s in B.SIGNALS) + " FROM grid_bins", *GRID),
    "st02_stateful_scorer": B.sql(f"SELECT entity, {TS('bin')}, round(behavioral_warning_score, 6) + 0.0 AS score, round(behavioral_warning_cusum, 6) + 0.0 AS cusum, behavioral_warning_candidate AS candidate, behavioral_warning_episode AS episode, behavioral_warning_start AS start, behavioral_warning_notification AS notification FROM hyp", *SPLIT, *D.hypo()),
    "st02_scorer_with_holes": B.sql(f"SELECT entity, {TS('bin')}, round(behavioral_warning_score, 6) + 0.0 AS score, round(behavioral_warning_cusum, 6) + 0.0 AS cusum, behavioral_warning_candidate AS candidate, behavioral_warning_episode AS episode, behavioral_warning_start AS start, behavioral_warning_notification AS notification, "
    "count(*) FILTER (WHERE n_raw_samples > 0 AND day(bin) <= 8) OVER (PARTITION BY entity) AS late_rows FROM hyp", *SPLIT, *D.hypo()),
    "st02_silent_for_good": B.sql(f"SELECT entity, {TS('bin')}, round(behavioral_warning_score, 6) + 0.0 AS score, round(behavioral_warning_cusum, 6) + 0.0 AS cusum, behavioral_warning_candidate AS candidate, behavioral_warning_episode AS episode, behavioral_warning_start AS start, behavioral_warning_notification AS notification FROM hyp", *SPLIT,
        ("long_grid", f"SELECT entity, bin, pos, dataset_split, coverage_pct, {SUMS} FROM spl UNION ALL SELECT entity, b, p + (epoch(b) - epoch(l)) / 14400, 'futur', 0, {', '.join('0' for _ in B.SIGNALS)} FROM "
         "(SELECT entity, l, p, unnest(generate_series(l + INTERVAL 4 HOUR, (SELECT max(bin) FROM spl) + INTERVAL 10 DAY, INTERVAL 4 HOUR)) AS b FROM (SELECT entity, max(bin) AS l, max(pos) AS p FROM spl GROUP BY entity))"), *D.hypo("long_grid")),
    "st03_sliding_windows": B.sql(f"SELECT entity, {TS('s', 'start')}, strftime(s + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", round(sum(steps), 6) + 0.0 AS steps_total FROM (SELECT entity, steps, unnest([time_bucket(INTERVAL 4 HOUR, t), time_bucket(INTERVAL 4 HOUR, t) - INTERVAL 4 HOUR, time_bucket(INTERVAL 4 HOUR, t) - INTERVAL 8 HOUR]) AS s FROM raw) GROUP BY entity, s", B.RAW),
    "st03_episode_sessions": B.sql(f"SELECT entity, {TS('min(bin)', 'start')}, strftime(max(bin) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n_bins FROM (SELECT *, sum(op) OVER (PARTITION BY entity ORDER BY bin) AS g FROM (SELECT entity, bin, CASE WHEN bin - lag(bin) OVER (PARTITION BY entity ORDER BY bin) <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS op FROM fus WHERE behavioral_warning_episode = 1)) GROUP BY entity, g", *BRANCH),
}
