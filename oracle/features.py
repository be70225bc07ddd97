"""Checks of the feature table and the comparator rules."""

from __future__ import annotations

from oracle import base as B


def logs(src: str = "grid", name: str = "lg") -> list[tuple[str, str]]:
    x = ", ".join(f"ln(1 + greatest(coalesce(motion_{a}, 0.0), 0.0)) AS motion_{a}_log" for a in ("sum", "mean"))
    return [(name, f"SELECT *, {x} FROM {src}")]


def rolling_z(src: str = "lg", name: str = "rrz", cols=tuple(B.FEATURES), w: int = 24, keys: str = "entity") -> list[tuple[str, str]]:
    f, mp = B.frame(keys, w), max(5, w // 4)
    one = ", ".join(
        f"CASE WHEN count({c}) {f} >= {mp} THEN quantile_cont({c}, 0.5) {f} END AS m_{c}, "
        f"CASE WHEN count({c}) {f} >= {mp} THEN quantile_cont({c}, 0.75) {f} - quantile_cont({c}, 0.25) {f} END AS i_{c}, "
        f"CASE WHEN count({c}) {f} >= {mp} THEN stddev_samp({c}) {f} END AS s_{c}"
        for c in cols
    )
    dev = ", ".join(f"abs({c} - m_{c}) AS d_{c}" for c in cols)
    mad = ", ".join(f"CASE WHEN count(d_{c}) {f} >= {mp} THEN 1.4826 * quantile_cont(d_{c}, 0.5) {f} END AS a_{c}" for c in cols)
    out = ", ".join(
        f"coalesce(CASE WHEN a_{c} >= 1e-9 THEN ({c} - m_{c}) / a_{c} ELSE ({c} - m_{c}) / nullif(i_{c} / 1.349, 0) END, "
        f"({c} - m_{c}) / nullif(s_{c}, 0), 0.0) AS {c}_rrz"
        for c in cols
    )
    drop = ", ".join(f"{p}_{c}" for p in "misda" for c in cols)
    return [
        (f"{name}_1", f"SELECT *, {one} FROM {src}"),
        (f"{name}_2", f"SELECT *, {dev} FROM {name}_1"),
        (f"{name}_3", f"SELECT *, {mad} FROM {name}_2"),
        (name, f"SELECT * EXCLUDE ({drop}), {out} FROM {name}_3"),
    ]


def global_z(src: str = "lg", name: str = "rz", cols=tuple(B.FEATURES), keys: str = "entity") -> list[tuple[str, str]]:
    p = f"OVER (PARTITION BY {keys})"
    one = ", ".join(
        f"median({c}) {p} AS m_{c}, quantile_cont({c}, 0.75) {p} - quantile_cont({c}, 0.25) {p} AS i_{c}, stddev_pop({c}) {p} AS s_{c}, count({c}) {p} AS n_{c}"
        for c in cols
    )
    two = ", ".join(f"1.4826 * median(abs({c} - m_{c})) {p} AS a_{c}" for c in cols)
    out = ", ".join(
        f"coalesce(({c} - m_{c}) / (CASE WHEN a_{c} >= 1e-9 THEN a_{c} WHEN n_{c} >= 5 AND i_{c} > 1e-9 THEN i_{c} / 1.349 "
        f"WHEN s_{c} > 1e-9 THEN s_{c} ELSE 1.0 END), 0.0) AS {c}_rz"
        for c in cols
    )
    drop = ", ".join(f"{x}_{c}" for x in "misna" for c in cols)
    return [
        (f"{name}_1", f"SELECT *, {one} FROM {src}"),
        (f"{name}_2", f"SELECT *, {two} FROM {name}_1"),
        (name, f"SELECT * EXCLUDE ({drop}), {out} FROM {name}_2"),
    ]


def differences(src: str, name: str = "dif", cols=tuple(B.FEATURES), minutes: int = 240, keys: str = "entity") -> list[tuple[str, str]]:
    p, f = f"OVER (PARTITION BY {keys} ORDER BY bin)", B.frame(keys, 7)
    x = ", ".join(f"{c} - lag({c}) {p} AS {c}_d1, CASE WHEN count({c}) {f} >= 3 THEN avg({c}) {f} END AS {c}_mm7" for c in cols)
    y = ", ".join(f"{c}_d1 / {minutes / 60} AS {c}_d1_per_hour, {c} - {c}_mm7 AS {c}_vs_mm7" for c in cols)
    return [(f"{name}_1", f"SELECT *, {x} FROM {src}"), (name, f"SELECT *, {y} FROM {name}_1")]


CALENDAR = (
    "CAST(isodow(bin) - 1 AS INTEGER) AS dow, CAST(hour(bin) AS INTEGER) AS hour, sin(2 * pi() * hour(bin) / 24) AS sin_hour, "
    "cos(2 * pi() * hour(bin) / 24) AS cos_hour, sin(2 * pi() * (isodow(bin) - 1) / 7) AS sin_dow, "
    "cos(2 * pi() * (isodow(bin) - 1) / 7) AS cos_dow, strftime(bin, '%Y-%m-%d') AS day"
)

VOTERS = [
    ("motion_sum_log_rrz", "activity"), ("motion_sum_rrz", "activity"), ("steps_sum_rrz", "activity"), ("lying_sum_rrz", "rest"),
    ("standing_sum_rrz", "rest"), ("transitions_sum_rrz", "transitions"), ("steps_mean_rrz", "activity"), ("motion_mean_rrz", "activity"),
    ("lying_mean_rrz", "rest"), ("standing_mean_rrz", "rest"),
]


def distance_score(src: str = "spl", name: str = "scored", keys: str = "entity") -> list[tuple[str, str]]:
    z = " + ".join(f"least(abs({s}_sum_rrz), 6.0)" for s in B.SIGNALS)
    return [
        (f"{name}_1", f"SELECT *, CASE WHEN coverage_pct >= 25 THEN 0.0 - ({z}) / 5.0 END AS raw_score FROM {src}"),
        (f"{name}_2", f"SELECT *, quantile_cont(CASE WHEN dataset_split = 'baseline' THEN raw_score END, 0.06) OVER (PARTITION BY {keys}) AS offs FROM {name}_1"),
        (name, f"SELECT * EXCLUDE (raw_score, offs), raw_score - offs AS if_score, CAST(coalesce(raw_score - offs < 0, false) AS INTEGER) AS if_anomaly_point FROM {name}_2"),
    ]


def rules(src: str = "scored", name: str = "rul", mixed: bool = True, minutes: int = 240, keys: str = "entity", persist: float = 7) -> list[tuple[str, str]]:
    k = max(1, round(persist * 60 / minutes))
    wait = max(1, round(12 * 60 / minutes))
    f, p = B.frame(keys, k), f"PARTITION BY {keys} ORDER BY bin"
    fams = ("activity", "rest", "transitions", "other")
    hit = {
        fam: " OR ".join(f"{c} <= -2.0 OR {c} >= 2.0" for c, x in VOTERS if x == fam) or "false" for fam in fams
    }
    rate = 0.35 if mixed else 0.10
    g = lambda x: f"CASE WHEN low THEN 0 ELSE {x} END"
    coh = f"(nf >= {2 if mixed else 1} AND corefam = 1){'' if mixed else ' OR spike = 1'}"
    return [
        (
            f"{name}_1",
            f"SELECT * REPLACE (CASE WHEN coalesce(coverage_pct < 25, false) THEN 0 ELSE coalesce(if_anomaly_point, 0) END AS if_anomaly_point), "
            f"coalesce(coverage_pct < 25, false) AS low, {', '.join(f'CAST({h} AS INTEGER) AS h_{x}' for x, h in hit.items())} FROM {src}",
        ),
        (
            f"{name}_2",
            f"SELECT *, {', '.join(f'{g(f'CAST(avg(h_{x}) {f} >= {rate} AS INTEGER)')} AS f_{x}' for x in fams)}, "
            f"{g('CAST(motion_sum_log_rrz >= 2.2 AS INTEGER)')} AS spike FROM {name}_1",
        ),
        (f"{name}_3", f"SELECT *, f_activity + f_rest + f_transitions + f_other AS nf, greatest(f_activity, f_rest) AS corefam FROM {name}_2"),
        (
            f"{name}_4",
            f"SELECT *, sum(if_anomaly_point) {f} AS ak, sum(if_anomaly_point) {f} / {float(k)} AS rk, max(nf) {f} AS nfk, sum(spike) {f} AS sk, "
            f"CAST({coh} AS INTEGER) AS coherent, CAST(nf >= 2 OR (f_activity = 1 AND spike = 1) AS INTEGER) AS lame FROM {name}_3",
        ),
        (f"{name}_5", f"SELECT *, CAST(rk >= 0.24 AND ak >= 2 {'AND coherent = 1' if mixed else ''} AS INTEGER) AS ep0 FROM {name}_4"),
        (f"{name}_6", f"SELECT *, ep0 * lame AS lam0, CAST(ep0 = 1 AND coalesce(lag(ep0) OVER ({p}), 0) = 0 AS INTEGER) AS eps0 FROM {name}_5"),
        (
            f"{name}_7",
            f"SELECT *, CAST(lam0 = 1 AND coalesce(lag(lam0) OVER ({p}), 0) = 0 AS INTEGER) AS lams0, "
            f"CASE WHEN count(*) OVER (PARTITION BY {keys}) > 10 AND count(if_score) OVER (PARTITION BY {keys}) > 5 THEN quantile_cont(if_score, 0.05) OVER (PARTITION BY {keys}) END AS q05, "
            f"CASE WHEN if_score IS NOT NULL THEN 100.0 * (rank() OVER (PARTITION BY {keys} ORDER BY if_score NULLS LAST) + (count(*) OVER (PARTITION BY {keys}, if_score) - 1) / 2.0) / count(if_score) OVER (PARTITION BY {keys}) END AS pct FROM {name}_6",
        ),
        (
            f"{name}_8",
            f"SELECT *, {g('ep0')} AS pred_problem_episode, {g('eps0')} AS pred_problem_start, {g('lam0')} AS pred_lameness_episode, {g('lams0')} AS pred_lameness_start FROM {name}_7",
        ),
        *B.cooldown(f"{name}_8", f"{name}_9", "pred_lameness_start", "fire", wait, keys),
        (f"{name}_10", f"SELECT *, max(CASE WHEN fire = 1 THEN pos END) OVER ({p} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastfire FROM {name}_9"),
        (
            name,
            f"SELECT *, {g('fire')} AS notif_lameness, {g(f'CAST(coalesce(pos - lastfire <= {wait}, false) AS INTEGER)')} AS in_cooldown, "
            f"CASE WHEN low THEN 'normal' WHEN pred_lameness_episode = 1 AND coalesce(if_score <= q05 AND pct <= 10.0, false) THEN 'critique' "
            f"WHEN pred_lameness_episode = 1 THEN 'probable' WHEN if_anomaly_point = 1 THEN 'suspect' ELSE 'normal' END AS alert_level, "
            f"CASE WHEN low THEN 0.0 ELSE 30 * least({g('nfk')} / 3.0, 1.0) + 30 * least(rk, 1.0) + 20 * (sk / {float(k)}) + 20 * coalesce(1 - pct / 100.0, 0) END AS conf, "
            f"{g('ak')} AS if_anom_k, {g('nf')} AS n_families, {g('coherent')} AS flag_coherent_episode, {g('lame')} AS coherence_boiterie FROM {name}_10",
        ),
    ]
