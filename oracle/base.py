"""Building blocks of the DuckDB checks: named CTEs joined into one statement.

Written from the definitions of the operators, with other means than the Spark
side (calendar join for gaps, running folds for cooldowns, quantile_cont).
"""

from __future__ import annotations

SIGNALS = ("steps", "motion", "lying", "standing", "transitions")
FEATURES = [f"{s}_{a}" for s in SIGNALS for a in ("sum", "mean")] + ["motion_sum_log", "motion_mean_log"]


def sql(final: str, *ctes: tuple[str, str]) -> str:
    seen, parts = set(), []
    for name, body in ctes:
        if name not in seen:
            seen.add(name)
            parts.append(f"{name} AS MATERIALIZED ({body})")
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


RAW = (
    "raw",
    """SELECT CAST(user_id // 8 AS VARCHAR) AS entity, ts AS t, event_id AS seq,
  CASE WHEN event_type = 'click' THEN value END AS steps,
  CASE WHEN event_type = 'view' THEN value END AS motion,
  CASE WHEN event_type = 'purchase' THEN value END AS lying,
  CASE WHEN event_type = 'error' THEN value END AS standing,
  CASE WHEN event_type = 'signup' THEN value ELSE 0.0 END AS transitions
FROM events""",
)


def grid(minutes: int = 240, src: str = "raw", name: str = "grid", keys: str = "entity") -> list[tuple[str, str]]:
    step = f"INTERVAL {minutes} MINUTES"
    aggs = ", ".join(f"sum({s}) AS {s}_sum, avg({s}) AS {s}_mean" for s in SIGNALS)
    out = ", ".join(f"coalesce({s}_sum, 0.0) AS {s}_sum, {s}_mean" for s in SIGNALS)
    return [
        (f"{name}_bins", f"SELECT {keys}, time_bucket({step}, t) AS bin, count(*) AS n, {aggs} FROM {src} GROUP BY ALL"),
        (
            f"{name}_cal",
            f"SELECT {keys}, unnest(generate_series(min(bin), max(bin), {step})) AS bin FROM {name}_bins GROUP BY {keys}",
        ),
        (
            f"{name}_full",
            f"SELECT {keys}, bin, {out}, CAST(coalesce(n, 0) AS DOUBLE) AS n_raw_samples "
            f"FROM {name}_cal LEFT JOIN {name}_bins USING ({keys}, bin)",
        ),
        (
            name,
            f"""SELECT *, least(n_raw_samples / expected_raw_per_bin, 1.0) * 100.0 AS coverage_pct,
  row_number() OVER (PARTITION BY {keys} ORDER BY bin) - 1 AS pos
FROM (SELECT *, greatest(1.0, least(
    quantile_cont(nullif(n_raw_samples, 0), 0.5) OVER (PARTITION BY {keys}),
    quantile_cont(nullif(n_raw_samples, 0), 0.8) OVER (PARTITION BY {keys}))) AS expected_raw_per_bin
  FROM {name}_full)""",
        ),
    ]


def split(src: str = "grid", name: str = "spl", keys: str = "entity", ratio: float = 0.6, cov: float = 25.0) -> list[tuple[str, str]]:
    return [
        (
            f"{name}_warm",
            f"""SELECT *, min(CASE WHEN streak >= 3 THEN pos END) OVER (PARTITION BY {keys}) AS first_warm
FROM (SELECT *, CAST(coalesce(coverage_pct, 0) >= {cov} AS INTEGER) AS ok,
  sum(CAST(coalesce(coverage_pct, 0) >= {cov} AS INTEGER)) OVER (PARTITION BY {keys} ORDER BY bin ROWS 2 PRECEDING) AS streak FROM {src})""",
        ),
        (
            f"{name}_cand",
            f"""SELECT * REPLACE (CASE WHEN sum(cand) OVER (PARTITION BY {keys}) > 0 THEN cand
    WHEN sum(ok) OVER (PARTITION BY {keys}) > 0 THEN ok ELSE 1 END AS cand)
FROM (SELECT *, CAST(ok = 1 AND pos >= coalesce(first_warm, 0) AS INTEGER) AS cand FROM {name}_warm)""",
        ),
        (
            name,
            f"""SELECT * EXCLUDE (ok, streak, first_warm, cand, rk, n), CAST(cand AS INTEGER) AS train_candidate,
  CASE WHEN cand = 0 THEN 'excluded' WHEN rk <= least(greatest(30, round_even(n * {ratio}, 0)), n) THEN 'baseline' ELSE 'futur' END AS dataset_split
FROM (SELECT *, sum(cand) OVER (PARTITION BY {keys} ORDER BY bin) AS rk, sum(cand) OVER (PARTITION BY {keys}) AS n FROM {name}_cand)""",
        ),
    ]


def clip(x: str, lo=None, hi=None) -> str:
    low = f"WHEN {x} < {lo} THEN {lo} " if lo is not None else ""
    high = f"WHEN {x} > {hi} THEN {hi} " if hi is not None else ""
    return f"(CASE {low}{high}ELSE {x} END)"


def frame(keys: str, n: int) -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY bin ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling_total(x: str, n: int, keys: str = "entity", least: int | None = None) -> str:
    m = max(4, n // 2) if least is None else least
    return f"CASE WHEN count({x}) {frame(keys, n)} >= {m} THEN sum({x}) {frame(keys, n)} END"


def reference_ratios(src: str, name: str, cols: list[str], day: int, keys: str, high: tuple[str, ...] = (), base: str = "base") -> list[tuple[str, str]]:
    """CTEs adding r_<col> for every col."""
    med = ", ".join(
        f"coalesce(median(CASE WHEN {base} THEN {c} END) OVER (PARTITION BY {keys}, slot), "
        f"median(CASE WHEN {base} THEN {c} END) OVER (PARTITION BY {keys}), "
        f"median({c}) OVER (PARTITION BY {keys}), 0.0) AS e_{c}, "
        f"lag({c}, {day}) OVER (PARTITION BY {keys} ORDER BY bin) AS y_{c}"
        for c in cols
    )
    refs = [f"{p}_{c}" for c in cols for p in ("e", "y")]
    flo = ", ".join(
        f"coalesce(CASE WHEN count(CASE WHEN {r} > 0 THEN 1 END) OVER (PARTITION BY {keys}) > 0 THEN "
        f"greatest(1e-6, 0.05 * median(CASE WHEN {r} > 0 THEN {r} END) OVER (PARTITION BY {keys})) END, 1.0) AS f_{r}"
        for r in refs
    )

    def ratio(c, p):
        r = f"{p}_{c}"
        return clip(f"({c} / (CASE WHEN {r} < f_{r} THEN f_{r} ELSE {r} END))", "0.0", "3.0")

    out = ", ".join(
        f"{'greatest' if c in high else 'least'}({ratio(c, 'e')}, {ratio(c, 'y')}) AS r_{c}" for c in cols
    )
    drop = ", ".join(refs + [f"f_{r}" for r in refs])
    return [
        (f"{name}_med", f"SELECT *, {med} FROM (SELECT *, hour(bin) * 60 + minute(bin) AS slot FROM {src})"),
        (f"{name}_flo", f"SELECT *, {flo} FROM {name}_med"),
        (name, f"SELECT * EXCLUDE (slot, {drop}), {out} FROM {name}_flo"),
    ]


def cusum_cooldown(
    src: str, name: str, prefix: str, drift: float, thr: float, k: int, share: float, wait: int, keys: str
) -> list[tuple[str, str]]:
    """Evidence -> CUSUM, persistence, episode, start, notification (columns prefixed)."""
    part = f"PARTITION BY {keys} ORDER BY bin"
    return [
        (f"{name}_c", f"SELECT *, sum(evidence - {drift}) OVER ({part} ROWS UNBOUNDED PRECEDING) AS csum FROM {src}"),
        (
            f"{name}_s",
            f"SELECT *, csum - least(0.0, min(csum) OVER ({part} ROWS UNBOUNDED PRECEDING)) AS {prefix}_cusum, "
            f"CASE WHEN count(*) {frame(keys, k)} = {k} THEN avg({prefix}_candidate) {frame(keys, k)} END AS prate FROM {name}_c",
        ),
        (
            f"{name}_e",
            f"SELECT *, CAST(coalesce(prate >= {share} AND {prefix}_cusum >= {thr}, false) AS INTEGER) AS {prefix}_episode FROM {name}_s",
        ),
        (
            f"{name}_st",
            f"SELECT *, CAST({prefix}_episode = 1 AND coalesce(lag({prefix}_episode) OVER ({part}), 0) = 0 AS INTEGER) AS {prefix}_start FROM {name}_e",
        ),
        *cooldown(f"{name}_st", name, f"{prefix}_start", f"{prefix}_notification", wait, keys),
    ]


def cooldown(src: str, name: str, start: str, out: str, wait: int, keys: str) -> list[tuple[str, str]]:
    """Greedy firing by folding the list of starts seen so far."""
    part = f"PARTITION BY {keys} ORDER BY bin ROWS UNBOUNDED PRECEDING"
    return [
        (f"{name}_l", f"SELECT *, list(pos) FILTER (WHERE {start} = 1) OVER ({part}) AS started FROM {src}"),
        (
            name,
            f"SELECT * EXCLUDE (started), CAST(CASE WHEN {start} = 1 THEN "
            f"list_reduce(started, lambda a, x: CASE WHEN x - a > {wait} THEN x ELSE a END, CAST(-1000000000 AS BIGINT)) = pos "
            f"ELSE false END AS INTEGER) AS {out} FROM {name}_l",
        ),
    ]
