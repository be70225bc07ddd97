"""Checks of adjustments, attributable evaluation, campaigns and their reports."""

from __future__ import annotations

from oracle import base as B
from oracle import detectors as D
from oracle import features as FX
from oracle.core import BRANCH, PRED, RULES, SPLIT, SUMS, cols
from sensorwatch.config import HypoConfig
from sensorwatch.operators import adjust as A
from sensorwatch.operators.sweep import INSTABILITY, OFAT, fusion_runs

SIG = ("steps", "motion", "lying", "standing", "transitions")
FAM = A.FAMILIES
STEP = 14400


def seed(text: str) -> str:
    return f"CAST('0x' || substr(sha256({text}), 1, 8) AS BIGINT)"


SPANS = (
    "spn",
    "SELECT entity, CAST(count(*) AS INTEGER) AS n_bins, min(bin) AS first_bin, min(fp) AS future_pos, min(CASE WHEN pos >= fp THEN bin END) AS heldout_start, max(bin) AS last_bin, "
    f"(epoch(max(bin)) - epoch(min(CASE WHEN pos >= fp THEN bin END)) + {STEP}) / 86400 AS monitored_days, (epoch(max(bin)) - epoch(min(bin))) / 86400 AS span_days, "
    "(epoch(max(bin)) - epoch(min(bin))) / 86400 >= 14 AND " + " AND ".join(f"coalesce(sum(CASE WHEN pos >= fp THEN {s}_sum END), 0) > 0" for s in ("steps", "motion", "transitions"))
    + " AS eligible FROM (SELECT *, min(CASE WHEN dataset_split = 'futur' THEN pos END) OVER (PARTITION BY entity) AS fp FROM spl) GROUP BY entity",
)


def lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)


def profiles(name: str, catalogue: dict) -> tuple[str, str]:
    rows = [A.plan_fields(k, p, "4H") | {"k": i} for i, (k, p) in enumerate(catalogue.items())]
    return name, "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r.values()) + ")" for r in rows) + f") v({', '.join(rows[0])})"


FINISH = (f"entity || '_' || scenario || '_' || start_pos AS event_id, first_bin + start_pos * INTERVAL 4 HOUR AS start, "
          f"first_bin + (start_pos + n - 1) * INTERVAL 4 HOUR AS \"end\"")


def rotated(name: str = "gplan") -> list[tuple[str, str]]:
    m, total = len(A.GRADUAL), sum(A.plan_fields(k, p, "4H")["n"] for k, p in A.GRADUAL.items())
    return [
        profiles("gprof", A.GRADUAL),
        (f"{name}_1", f"SELECT s.*, p.*, {seed(chr(39).join(['entity || ', '|schedule|42', '']))} % {m} AS rotation, n_bins - future_pos - 8 AS room FROM spn s, gprof p WHERE eligible"),
        (f"{name}_2", f"SELECT *, greatest(4, (room - {total}) // {m + 1}) AS gap, (k - rotation + {m}) % {m} AS ord FROM {name}_1 WHERE room > {total}"),
        (f"{name}_3", f"SELECT * EXCLUDE (room, gap, ord), CAST(future_pos + 4 + gap + coalesce(sum(n + gap) OVER (PARTITION BY entity ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_pos FROM {name}_2"),
        (name, f"SELECT *, {FINISH} FROM {name}_3 WHERE start_pos + n < n_bins"),
    ]


def placed(name: str, catalogue: dict, fractions) -> list[tuple[str, str]]:
    fr = ", ".join(f"({f})" for f in fractions)
    return [
        profiles(f"{name}_p", catalogue),
        (f"{name}_1", f"SELECT s.*, p.*, f.fraction::DOUBLE AS fraction, n_bins - future_pos - 8 - n AS room FROM spn s, {name}_p p, (VALUES {fr}) f(fraction) WHERE eligible"),
        (name, f"SELECT *, {FINISH} FROM (SELECT * EXCLUDE (room), CAST(future_pos + 4 + round_even(fraction * room, 0) AS INTEGER) AS start_pos FROM {name}_1 WHERE room > 0)"),
    ]


def slotted(name: str = "hplan") -> list[tuple[str, str]]:
    m = len(A.HYBRID)
    return [
        profiles(f"{name}_p", A.HYBRID),
        (f"{name}_1", f"SELECT s.*, p.*, ((k + {seed('entity')} % {m}) % {m} + 1) / {float(m + 1)} AS fr, n_bins - future_pos - 8 - n AS room FROM spn s, {name}_p p WHERE eligible"),
        (name, f"SELECT *, {FINISH} FROM (SELECT * EXCLUDE (room, fr), CAST(future_pos + 4 + round_even(fr * room, 0) AS INTEGER) AS start_pos FROM {name}_1 WHERE room > 0)"),
    ]


def env(i: str, n: str, up: str, down: str) -> str:
    rise = f"CASE WHEN {up} > 1 THEN ({i}) / ({up} - 1.0) ELSE 0.0 END"
    fall = f"CASE WHEN {down} > 1 THEN 1.0 - (({i}) - ({n} - {down})) / ({down} - 1.0) ELSE lone END"
    x = f"(CASE WHEN ({i}) < {up} THEN {rise} WHEN ({i}) >= {n} - {down} THEN {fall} ELSE 1.0 END)"
    return f"(CASE WHEN ({i}) < 0 OR ({i}) >= {n} THEN 0.0 WHEN bent = 1 THEN {x} * {x} * (3.0 - 2.0 * {x}) ELSE {x} END)"


def dose() -> float:
    """Area of the 12-bin reference envelope, from its definition."""
    n, up, down = 12, 4, 2
    x = [k / (up - 1) for k in range(up)] + [1.0] * (n - up - down) + [1.0 - k / (down - 1) for k in range(down)]
    return sum(v * v * (3 - 2 * v) for v in x)


def apply(plan: str, name: str, src: str = "fus") -> list[tuple[str, str]]:
    keep = ", ".join(f"g.{c}" for c in ["bin", "pos", "n_raw_samples", *[f"{s}_sum" for s in SIG]])
    refs = ", ".join(f"g.{long}_{x} AS ref_{short}_{x}" for long, short in (("behavioral_warning", "hypo"), ("instability_warning", "instability"), ("hybrid_warning", "hybrid")) for x in ("episode", "start"))
    envs = ", ".join(f"CASE WHEN i >= 0 AND i < n THEN {env(f'i - lag_{f}', 'n1', 'up', 'down')} ELSE 0.0 END AS e_{f}" for f in FAM)
    area = ", ".join(f"sum(e_{f} * kept) OVER (PARTITION BY entity, event_id) AS a_{f}" for f in FAM)
    scaled = ", ".join(f"e_{f} * CASE WHEN matched = 1 AND a_{f} > 0 THEN {dose()!r} / a_{f} ELSE 1.0 END AS env_{f}" for f in FAM)
    chg = {s: f"c_{s} * env_{s} + {'swing * env_' + s + ' * phase' if s != 'steps' else '0.0'} + d_{s} * env_then" for s in ("steps", "motion", "transitions")}
    moved = "lying_sum + (c_posture * env_posture + d_posture * env_then) * standing_sum + posture_swing * env_posture * phase * (lying_sum + standing_sum)"
    moved = f"least(greatest({moved}, 0.0), lying_sum + standing_sum)"
    new = ", ".join(f"CASE WHEN kept = 1 THEN greatest(0.0, {s}_sum * (1.0 + {c})) ELSE 0.0 END AS {s}_sum" for s, c in chg.items())
    return [
        (f"{name}_1", f"SELECT p.*, {keep}, {refs}, CAST(g.pos - p.start_pos AS INTEGER) AS i FROM {src} g JOIN {plan} p USING (entity)"),
        (
            f"{name}_2",
            f"SELECT *, CAST(i >= 0 AND i < n AS INTEGER) AS inside, CAST(NOT (i >= 0 AND i < n AND i >= hole_at AND i < hole_at + hole) AS INTEGER) AS kept, "
            f"CASE WHEN i >= 0 AND i < n AND i < n1 AND n1 > 1 THEN sin(greatest(2.0, n1 / 6.0) * pi() * i / (n1 - 1)) ELSE 0.0 END AS phase, "
            f"CASE WHEN n2 > 0 THEN {env('i - (n - n2)', 'n2', 'up2', 'down2')} ELSE 0.0 END AS env_then, {envs} FROM {name}_1",
        ),
        (f"{name}_3", f"SELECT *, {area} FROM {name}_2"),
        (f"{name}_4", f"SELECT *, {scaled} FROM {name}_3"),
        (
            f"{name}_full",
            f"SELECT * EXCLUDE ({', '.join(f'{s}_sum' for s in SIG)}, n_raw_samples), {new}, CASE WHEN kept = 1 THEN {moved} ELSE 0.0 END AS lying_sum, "
            f"CASE WHEN kept = 1 THEN lying_sum + standing_sum - {moved} ELSE 0.0 END AS standing_sum, CASE WHEN kept = 1 THEN n_raw_samples ELSE 0.0 END AS n_raw_samples, "
            f"{', '.join(f'{s}_sum AS src_{s}_sum' for s in SIG)} FROM {name}_4",
        ),
        (
            f"{name}_cov",
            f"SELECT *, least(n_raw_samples / x, 1.0) * 100.0 AS coverage_pct FROM (SELECT *, greatest(1.0, least(quantile_cont(nullif(n_raw_samples, 0), 0.5) OVER w, quantile_cont(nullif(n_raw_samples, 0), 0.8) OVER w)) AS x FROM {name}_full WINDOW w AS (PARTITION BY entity, event_id))",
        ),
    ]


KEYS = "entity, event_id"


def series(plan: str, name: str) -> list[tuple[str, str]]:
    """Adjusted series with a fresh split; result CTE is ``<name>``."""
    ev = [c for c in apply(plan, f"{name}_a")]
    lean = ("SELECT entity, event_id, scenario, branch, expected, start, \"end\", heldout_start, bin, pos, inside, kept, coverage_pct, n_raw_samples, "
            + ", ".join(f"{s}_sum" for s in SIG) + ", " + ", ".join(f"ref_{b}_{x}" for b in ("hypo", "instability", "hybrid") for x in ("episode", "start"))
            + (", fraction" if "frac" in name else "") + f" FROM {name}_a_cov")
    return [*ev, (f"{name}_lean", lean), *B.split(f"{name}_lean", name, KEYS)]


def overlap(s0: str, s1: str) -> str:
    return f"(CASE WHEN least({s1}, \"end\") < greatest({s0}, start) THEN 0 ELSE epoch(least({s1}, \"end\")) - epoch(greatest({s0}, start)) + {STEP} END)"


def evaluate(src: str, name: str, ep: str, st: str, score: str, ref_ep: str, ref_st: str, keys: str = KEYS, carry: str = "scenario, expected", reach: int = 0) -> list[tuple[str, str]]:
    def segs(tag: str, cond: str) -> list[tuple[str, str]]:
        inter = overlap("s0", "s1")
        union = f"(epoch(s1) - epoch(s0) + {STEP} + epoch(\"end\") - epoch(start) + {STEP} - {inter})"
        return [
            (f"{name}_{tag}1", f"SELECT {keys}, start, \"end\", bin, pos - row_number() OVER (PARTITION BY {keys} ORDER BY bin) AS isle FROM {src} WHERE {cond}"),
            (f"{name}_{tag}2", f"SELECT {keys}, start, \"end\", min(bin) AS s0, max(bin) AS s1 FROM {name}_{tag}1 GROUP BY {keys}, start, \"end\", isle"),
            (f"{name}_{tag}", f"SELECT {keys}, max({inter} / greatest(1e-9, {union})) AS iou FROM {name}_{tag}2 GROUP BY {keys}"),
        ]

    on = " AND ".join(f"o.{k.strip()} = x.{k.strip()}" for k in keys.split(","))
    near = f"EXISTS (SELECT 1 FROM {src} o WHERE {on} AND abs(o.pos - x.pos) <= {reach} AND o.{ref_st} = 1)"
    return [
        *segs("at", f"{ep} = 1 AND coalesce({ref_ep}, 0) <> 1"),
        *segs("rw", f"{ep} = 1"),
        (f"{name}_nv", f"SELECT {keys}, count(*) AS novel, min(bin) AS first_new FROM {src} x WHERE {st} = 1 AND bin BETWEEN start AND \"end\" AND NOT {near} GROUP BY {keys}"),
        (
            f"{name}_w",
            f"SELECT {keys}, start, \"end\", {carry}, max(CASE WHEN bin BETWEEN start AND \"end\" THEN {score} END) AS score_max, "
            f"sum(CASE WHEN {ep} = 1 AND coalesce({ref_ep}, 0) <> 1 THEN 1 ELSE 0 END) AS natt FROM {src} GROUP BY {keys}, start, \"end\", {carry}",
        ),
        (
            name,
            f"SELECT w.*, CAST(coalesce(novel, 0) > 0 AS INTEGER) AS detected_any_overlap, CAST(coalesce(novel, 0) AS INTEGER) AS novel_start_count, "
            f"CAST(coalesce(a.iou, 0) > 0 AS INTEGER) AS episode_overlap, CAST(coalesce(a.iou, 0) >= 0.2 AS INTEGER) AS detected_iou20, coalesce(a.iou, 0) AS best_iou, "
            f"CAST(coalesce(r.iou, 0) > 0 AS INTEGER) AS episode_overlap_raw, CAST(coalesce(r.iou, 0) >= 0.2 AS INTEGER) AS detected_iou20_raw, coalesce(r.iou, 0) AS best_iou_raw, "
            f"CAST(natt AS INTEGER) AS attributable_interval_count, (epoch(first_new) - epoch(start)) / 3600 AS onset_delay_hours "
            f"FROM {name}_w w LEFT JOIN {name}_at a USING ({keys}) LEFT JOIN {name}_rw r USING ({keys}) LEFT JOIN {name}_nv n USING ({keys})",
        ),
    ]


def drop_eval(src: str, name: str, **kw) -> list[tuple[str, str]]:
    return evaluate(src, name, "behavioral_warning_episode", "behavioral_warning_start", "behavioral_warning_score", "ref_hypo_episode", "ref_hypo_start", **kw)


BACK = ("back", "SELECT entity, sum(behavioral_warning_notification) AS hypo_background_notifs, sum(instability_warning_notification) AS instability_background_notifs, "
                "sum(hybrid_warning_notification) AS hybrid_background_notifs FROM fus WHERE dataset_split = 'futur' GROUP BY entity")
ADJ = [*BRANCH, SPANS, *rotated(), *series("gplan", "adj")]
EVENTS = [*ADJ, *D.hypo("adj", "ahyp", keys=KEYS), *drop_eval("ahyp", "ev0"), BACK,
          ("ev", "SELECT ev0.*, monitored_days, hypo_background_notifs, instability_background_notifs, hybrid_background_notifs FROM ev0 LEFT JOIN spn USING (entity) LEFT JOIN back USING (entity)")]
STRESS = [*BRANCH, SPANS, *placed("sfrac", A.STRESS, A.PLACEMENTS), *series("sfrac", "adj_frac"), *D.hypo("adj_frac", "shyp", keys=KEYS), *drop_eval("shyp", "sev", carry="scenario, expected, fraction")]
HYB = [*BRANCH, SPANS, *slotted(), *series("hplan", "hadj"), *D.hypo("hadj", "hh", keys=KEYS), *D.instability("hh", "hi", keys=KEYS), *D.fusion("hi", "hf", keys=KEYS),
       *evaluate("hf", "e_hypo", "behavioral_warning_episode", "behavioral_warning_start", "behavioral_warning_score", "ref_hypo_episode", "ref_hypo_start", carry="scenario, branch, expected"),
       *evaluate("hf", "e_inst", "instability_warning_episode", "instability_warning_start", "instability_warning_score", "ref_instability_episode", "ref_instability_start"),
       *evaluate("hf", "e_hyb", "hybrid_warning_episode", "hybrid_warning_start", "hybrid_warning_score", "ref_hybrid_episode", "ref_hybrid_start"), BACK,
       ("hev", "SELECT h.entity, h.event_id, h.scenario, h.branch, h.expected, " + ", ".join(f"{t}.{m} AS {n}_{m}" for t, n in (("h", "hypo"), ("i", "instability"), ("y", "hybrid")) for m in ("detected_any_overlap", "episode_overlap", "detected_iou20", "best_iou", "onset_delay_hours"))
        + ", hybrid_background_notifs, monitored_days FROM e_hypo h JOIN e_inst i USING (entity, event_id) JOIN e_hyb y USING (entity, event_id) LEFT JOIN spn USING (entity) LEFT JOIN back USING (entity)")]
METRICS = ("detected_any_overlap:i novel_start_count:i episode_overlap:i detected_iou20:i best_iou episode_overlap_raw:i detected_iou20_raw:i best_iou_raw attributable_interval_count:i onset_delay_hours score_max")
TS = lambda c, a=None: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS " + (a or c)
WIN = TS("start") + ", " + TS('"end"')
AVG = lambda c, cond=None: f"round(avg({c if not cond else f'CASE WHEN {cond} THEN {c} END'}), 6) + 0.0"
GRAD, CTRL = "scenario LIKE 'gradual_%'", "scenario = 'isolated_short_variation'"
REAL = ("SELECT entity, event_id, scenario, expected, " + ", ".join(f"sum(CASE WHEN inside = 1 THEN src_{s}_sum END) AS source_{s}_sum, sum(CASE WHEN inside = 1 THEN {s}_sum END) AS adjusted_{s}_sum" for s in ("steps", "motion", "transitions"))
        + ", max(CASE WHEN inside = 1 AND kept = 1 THEN abs(src_lying_sum + src_standing_sum - lying_sum - standing_sum) END) AS pg FROM adj_a_cov GROUP BY ALL")
REALV = ("real", "SELECT *, " + ", ".join(f"CASE WHEN source_{s}_sum > 0 THEN adjusted_{s}_sum / source_{s}_sum - 1.0 END AS realized_{s}_change" for s in ("steps", "motion", "transitions"))
         + ", CAST(coalesce(pg, 0) <= 1e-8 AS INTEGER) AS posture_conserved, CAST(source_steps_sum > 0 AND (expected = 0 OR (source_motion_sum > 0 AND source_transitions_sum > 0)) AS INTEGER) AS informative_source_window FROM (" + REAL + ")")


def confusion(c: str) -> str:
    t, h = "expected = 1", f"{c} >= 1"
    n = lambda a, b: f"CAST(count(CASE WHEN {a} AND {b} THEN 1 END) AS BIGINT)"
    inner = f"SELECT {n(t, h)} AS tp, {n(f'NOT {t}', h)} AS fp, {n(t, f'NOT {h}')} AS fn, {n(f'NOT {t}', f'NOT {h}')} AS tn FROM ev"
    return (f"SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, "
            f"round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, '{c}' AS measure FROM ({inner})")


def swept(configs: dict[str, HypoConfig]) -> list[tuple[str, str]]:
    """Event table ``cev`` over configurations, each compared with its own untouched run.

    Thresholds come from a configuration table; only window lengths need a chain of their own.
    """
    groups: dict[tuple[float, float], dict[str, HypoConfig]] = {}
    for name, c in configs.items():
        groups.setdefault((c.aggregation_hours, c.persistence_hours), {})[name] = c
    out, parts, backs = [], [], []
    names = dict(fam="x_fam", post="x_post", score="x_score", drift="x_drift", thr="x_thr", nfam="x_nfam", cov="x_cov", wait="x_wait")
    for i, ((agg, persist), cs) in enumerate(groups.items()):
        rows = ", ".join(f"('{k}', {c.family_min_change}, {c.posture_min_change}, {c.score_threshold}::DOUBLE, {c.cusum_drift}::DOUBLE, {c.cusum_threshold}, {c.min_families}, {c.coverage_min_pct}, {max(1, round(c.cooldown_hours / 4))})" for k, c in cs.items())
        out.append((f"g{i}", f"SELECT * FROM (VALUES {rows}) v(config, x_fam, x_post, x_score, x_drift, x_thr, x_nfam, x_cov, x_wait)"))
        for src, tag, keys in (("spl", "k", "entity, config"), ("adj", "q", KEYS + ", config")):
            out.append((f"{tag}{i}_src", f"SELECT * FROM {src}, g{i}"))
            out += D.hypo(f"{tag}{i}_src", f"{tag}{i}", keys=keys, agg=agg, persist=persist, **names)
        out.append((f"r{i}", f"SELECT q.*, c.behavioral_warning_episode AS re, c.behavioral_warning_start AS rs FROM q{i} q LEFT JOIN k{i} c USING (entity, bin, config)"))
        out += evaluate(f"r{i}", f"v{i}", "behavioral_warning_episode", "behavioral_warning_start", "behavioral_warning_score", "re", "rs", keys=KEYS + ", config")
        parts.append(f"SELECT * FROM v{i}")
        backs.append(f"SELECT entity, config, sum(behavioral_warning_notification) AS hypo_background_notifs FROM k{i} WHERE dataset_split = 'futur' GROUP BY entity, config")
    out.append(("cback", " UNION ALL ".join(backs)))
    out.append(("cev", "SELECT e.*, b.hypo_background_notifs, s.monitored_days FROM (" + " UNION ALL ".join(parts) + ") e LEFT JOIN cback b USING (entity, config) LEFT JOIN spn s USING (entity)"))
    return [*ADJ, *out]


def ofat() -> dict[str, HypoConfig]:
    from dataclasses import replace

    return {"reference": HypoConfig()} | {f"{p}__{str(v).replace('.', 'p')}": replace(HypoConfig(), **{p: v}) for p, vs in OFAT.items() for v in vs}


def fused(runs) -> list[tuple[str, str]]:
    """Event table ``fev`` over fusion and instability settings, each compared with its own untouched run."""
    kinds = list(dict.fromkeys(i for i, _ in runs.values()))
    out = [*BRANCH, SPANS, *slotted(), *series("hplan", "hadj"), *D.hypo("spl", "kh"), *D.hypo("hadj", "qh", keys=KEYS)]
    for k, g in enumerate(kinds):
        over = dict(agg=g.aggregation_hours, persist=g.persistence_hours, least=g.restless_motion_min_change, score=g.score_threshold, thr=g.cusum_threshold)
        out += [*D.instability("kh", f"ki{k}", **over), *D.instability("qh", f"qi{k}", keys=KEYS, **over)]
    parts, both = [], ("instability", "hybrid")
    for r, (name, (i, f)) in enumerate(runs.items()):
        k, over = kinds.index(i), dict(mode=f.mode, smin=f.sequence_min_hours, smax=f.sequence_max_hours, cool=f.cooldown_hours)
        out += [*D.fusion(f"ki{k}", f"kf{r}", **over), *D.fusion(f"qi{k}", f"qf{r}", keys=KEYS, **over)]
        refs = ", ".join(f"c.{b}_warning_{x} AS {b}_r{x[0]}" for b in both for x in ("episode", "start"))
        out.append((f"qr{r}", f"SELECT q.*, {refs} FROM qf{r} q LEFT JOIN kf{r} c USING (entity, bin)"))
        for b in both:
            out += evaluate(f"qr{r}", f"e{r}_{b}", f"{b}_warning_episode", f"{b}_warning_start", f"{b}_warning_score", f"{b}_re", f"{b}_rs", carry="scenario, branch, expected")
        out.append((f"kb{r}", f"SELECT entity, sum(hybrid_warning_notification) AS hybrid_background_notifs FROM kf{r} WHERE dataset_split = 'futur' GROUP BY entity"))
        parts.append(f"SELECT '{name}' AS config, y.entity, y.branch, i.detected_any_overlap AS instability_detected_any_overlap, y.detected_any_overlap AS hybrid_detected_any_overlap, y.detected_iou20 AS hybrid_detected_iou20, "
                     f"y.onset_delay_hours AS hybrid_onset_delay_hours, hybrid_background_notifs, monitored_days FROM e{r}_hybrid y JOIN e{r}_instability i USING (entity, event_id) LEFT JOIN kb{r} USING (entity) LEFT JOIN spn USING (entity)")
    return [*out, ("fev", " UNION ALL ".join(parts))]


def sensitivity() -> str:
    kinds = {"hypo_actionable_detection": ("'HYPO'", "hybrid_detected_any_overlap"), "instability_surveillance_detection": ("'INSTABILITE'", "instability_detected_any_overlap"),
             "instability_actionable_detection": ("'INSTABILITE'", "hybrid_detected_any_overlap"), "sequence_actionable_detection": ("'SEQUENCE'", "hybrid_detected_any_overlap"),
             "actionable_detection": ("'HYPO', 'SEQUENCE'", "hybrid_detected_any_overlap"), "benign_control_alert_rate": ("'CONTROLE'", "hybrid_detected_any_overlap"),
             "confound_alert_rate": ("'CONFONDANT'", "hybrid_detected_any_overlap"), "actionable_iou20": ("'HYPO', 'SEQUENCE'", "hybrid_detected_iou20")}
    inner = ("SELECT config, count(*) AS n_events, " + ", ".join(f"avg(CASE WHEN branch IN ({b}) THEN {m} END) AS {k}" for k, (b, m) in kinds.items())
             + ", median(CASE WHEN branch IN ('HYPO', 'SEQUENCE') THEN hybrid_onset_delay_hours END) AS actionable_delay_h_median FROM fev GROUP BY config")
    back = "SELECT config, avg(r) AS background_per_cow_day, count(*) AS n_cows FROM (SELECT config, entity, min(hybrid_background_notifs) / min(monitored_days) AS r FROM fev GROUP BY ALL) GROUP BY config"
    useful = "actionable_detection + 0.15 * instability_surveillance_detection + 0.25 * actionable_iou20 - 1.5 * benign_control_alert_rate - 2.0 * confound_alert_rate - 0.3 * least(1.0, background_per_cow_day)"
    full = "actionable_detection >= 0.6 AND instability_surveillance_detection >= 0.5 AND actionable_iou20 >= 0.2"
    cells = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in (*kinds, "actionable_delay_h_median", "background_per_cow_day"))
    return f"SELECT config, n_events, n_cows, {cells}, round({useful}, 6) + 0.0 AS technical_utility, CAST(coalesce({full}, false) AS INTEGER) AS eligible_full_scope FROM ({inner}) JOIN ({back}) USING (config)"


RATES = {"progressive_new_start_rate": ("detected_any_overlap", GRAD), "progressive_attributable_coverage_rate": ("episode_overlap", GRAD), "progressive_iou20_rate": ("detected_iou20", GRAD),
         "progressive_best_iou_mean": ("best_iou", GRAD), "control_new_start_rate": ("detected_any_overlap", CTRL), "control_attributable_coverage_rate": ("episode_overlap", CTRL), "control_iou20_rate": ("detected_iou20", CTRL)}
CSUM = ("csum0", "SELECT config, count(DISTINCT entity) AS n_cows, count(*) AS n_events, median(CASE WHEN " + GRAD + " THEN onset_delay_hours END) AS dl, "
        + ", ".join(f"avg(CASE WHEN {c} THEN {m} END) AS {k}" for k, (m, c) in RATES.items()) + " FROM cev GROUP BY config")
SWEEP = swept(ofat())
P = "OVER (PARTITION BY entity ORDER BY bin)"
INSIDE = "s.pos - p.start_pos >= 0 AND s.pos - p.start_pos < p.n"
VARIANTS = [*PRED, *D.hypo("spl", "vs", active=("steps",), nfam=1), ("every0", "SELECT * EXCLUDE (if_score, if_anomaly_point), 1 AS if_anomaly_point, CAST(NULL AS DOUBLE) AS if_score FROM scored"), *FX.rules("every0", "every"),
            ("alone0", f"SELECT *, CAST(if_anomaly_point = 1 AND coalesce(lag(if_anomaly_point) {P}, 0) = 0 AS INTEGER) AS c_start FROM fus"), *B.cooldown("alone0", "alone", "c_start", "c_notif", 3, "entity"),
            ("variants", " UNION ALL ".join(f"SELECT entity, bin, dataset_split, '{v}' AS variant, {e} AS episode, {x} AS notification FROM {t}" for v, t, e, x in (
                ("A", "fus", "behavioral_warning_episode", "behavioral_warning_notification"), ("B", "fus", "pred_lameness_episode", "notif_lameness"), ("C", "alone", "if_anomaly_point", "c_notif"),
                ("E", "vs", "behavioral_warning_episode", "behavioral_warning_notification"), ("F", "every", "pred_lameness_episode", "notif_lameness")))),
            ("vrates", "SELECT entity, variant, avg(episode) AS episode_rate, sum(notification) AS notifs FROM variants WHERE dataset_split = 'futur' GROUP BY ALL")]
CURVE = swept({f"{x:.2f}": HypoConfig(score_threshold=x) for x in (0.04, 0.06, 0.08, 0.10, 0.12, 0.14, 0.16, 0.18, 0.20)})
SUMS3 = {k: SUMS[k] for k in ("problem_points", "lameness_notifs", "if_anomaly_points")}
DAYS = [*PRED, ("days0", "SELECT entity, CAST(bin AS DATE) AS day, max(hybrid_warning_episode) AS day_alert, avg(hybrid_warning_episode) AS alert_rate, sum(if_anomaly_point) AS n_anomalies, count(*) AS n_bins, sum(hybrid_warning_notification) AS day_notifs FROM fus GROUP BY ALL"),
        ("days1", "SELECT *, CASE WHEN alert_rate = 0 THEN 0.0 ELSE 0.6 * alert_rate + 0.4 * least(n_anomalies / n_bins, 1.0) END AS severity_raw FROM days0"),
        ("days", "SELECT *, CASE WHEN max(severity_raw) OVER () > 0 THEN severity_raw / max(severity_raw) OVER () ELSE severity_raw END AS severity FROM days1")]
REASON = "printf('Alerte %s: score HYPO=%.2f, score INSTABILITÉ=%.2f. Vérification terrain requise.', hybrid_warning_type, behavioral_warning_score, instability_warning_score) AS reason"
INJ = [B.RAW, ("inj", "SELECT entity, count(*) AS series_bins, (epoch(date_trunc('second', max(t))) - epoch(date_trunc('second', min(t)))) / 86400 AS sd, " + ", ".join(f"avg(CASE WHEN coalesce({s}, 0) > 0 THEN 1.0 ELSE 0.0 END) AS z_{s}, coalesce(stddev_samp({s}), 0) AS s_{s}" for s in SIG) + " FROM raw GROUP BY entity"),
       ("inj2", "SELECT entity, series_bins, least(0.60 * (z_steps + z_motion + z_lying + z_standing) / 4 + 0.25 * (" + " + ".join(f"CASE WHEN s_{s} > 0 THEN 1 ELSE 0 END" for s in ("steps", "motion", "lying", "standing")) + ") / 4.0 + 0.15 * z_transitions, 1.0) AS injectability_score, "
                "CAST(z_steps >= 0.2 AND z_motion >= 0.2 AND z_lying >= 0.2 AND z_standing >= 0.2 AS INTEGER) AS injectability_ok, "
                "least(0.8 * series_bins / greatest(1, max(series_bins) OVER ()) + 0.2 * sd / greatest(1, max(sd) OVER ()), 1.0) AS series_length_score, "
                "CAST(series_bins >= floor(greatest(96, quantile_cont(series_bins, 0.6) OVER ())) AS INTEGER) AS long_series_ok FROM inj")]
RANK = ("SELECT CAST(row_number() OVER (ORDER BY h DESC, b DESC, i DESC, entity) AS INTEGER) AS rank, entity, n_bins, h AS hybrid_warning_notifs, b AS behavioral_warning_notifs, i AS instability_warning_notifs, round(c, 6) AS coverage_mean FROM "
        "(SELECT entity, count(*) AS n_bins, CAST(sum(hybrid_warning_notification) AS BIGINT) AS h, CAST(sum(behavioral_warning_notification) AS BIGINT) AS b, CAST(sum(instability_warning_notification) AS BIGINT) AS i, avg(coverage_pct) AS c FROM fus GROUP BY entity)")

CHECKS: dict[str, str] = {
    "z01_envelopes_and_dose": B.sql("SELECT entity, scenario, CAST(pos AS INTEGER) AS pos, kept, " + ", ".join(f"round(env_{f}, 6) + 0.0 AS env_{f}" for f in FAM) + " FROM s_full WHERE inside = 1", *BRANCH, SPANS, *placed("sp", A.STRESS, (0.5,)), *apply("sp", "s")),
    "z02_z03_adjusted_series": B.sql(f"SELECT {cols('entity:s event_id:s bin ' + ' '.join(f'{s}_sum' for s in SIG))} FROM adj", *ADJ),
    "z02_oscillating_phases": B.sql("SELECT entity, scenario, CAST(pos AS INTEGER) AS pos, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("phase", "env_motion", "env_then", *[f"{s}_sum" for s in SIG])) + " FROM s_full WHERE inside = 1", *BRANCH, SPANS, *slotted(), *apply("hplan", "s")),
    "z02_floor_at_target": B.sql(f"SELECT entity, event_id, {TS('bin')}, round(greatest(lying_sum, 60.0), 6) AS lying_sum FROM adj WHERE inside = 1", *ADJ),
    "z05_contiguous_dropout": B.sql(f"SELECT entity, event_id, {TS('bin')}, n_raw_samples, steps_sum FROM s_full WHERE kept = 0", *BRANCH, SPANS, *placed("sp", A.STRESS, (0.5,)), *apply("sp", "s")),
    "z06_rotated_schedule": B.sql(f"SELECT entity, event_id, scenario, CAST(rotation AS INTEGER) AS rotation, start_pos, n, {WIN} FROM gplan", *SPLIT, SPANS, *rotated()),
    "z06_fractional_placement": B.sql(f"SELECT entity, event_id, scenario, fraction, start_pos, n, {WIN} FROM sfrac", *SPLIT, SPANS, *placed("sfrac", A.STRESS, A.PLACEMENTS)),
    "j21_slide_to_nearest_signal": B.sql(
        f"SELECT entity, scenario, n, CAST(best AS INTEGER) AS start_pos, strftime(first_bin + best * INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS start FROM (SELECT p.*, coalesce((SELECT c.pos FROM live c WHERE c.entity = p.entity AND c.n = p.n AND c.pos >= p.future_pos + 4 "
        "AND c.pos <= p.n_bins - p.n - 4 ORDER BY abs(c.pos - p.start_pos), c.pos DESC LIMIT 1), p.start_pos) AS best FROM hplan p)", *SPLIT, SPANS, *slotted(),
        ("live", "SELECT DISTINCT c.entity, l.n, c.pos FROM spl c, (SELECT DISTINCT n FROM hplan_p) l JOIN spl x ON true WHERE x.entity = c.entity AND x.pos BETWEEN c.pos AND c.pos + l.n - 1 AND x.pos % 20 >= 12 AND x.steps_sum + x.motion_sum + x.lying_sum + x.standing_sum + x.transitions_sum > 0")),
    "z07_role_planning": B.sql("SELECT CASE WHEN row_number() OVER (ORDER BY pool, ls, ln, long_series_ok DESC, injectability_ok DESC, series_length_score DESC, injectability_score DESC, ap DESC, entity) = 1 THEN 'target' ELSE 'hidden' END AS role, entity FROM "
        "(SELECT *, CASE WHEN long_series_ok = 1 AND injectability_ok = 1 THEN 0 WHEN long_series_ok = 1 THEN 1 WHEN ls = 0 AND injectability_ok = 1 THEN 2 WHEN ls = 0 THEN 3 ELSE 4 END AS pool FROM inj2 JOIN (SELECT entity, sum(pred_lameness_start) AS ls, sum(notif_lameness) AS ln, sum(if_anomaly_point) AS ap FROM rul GROUP BY entity) USING (entity)) "
        "QUALIFY row_number() OVER (ORDER BY pool, ls, ln, long_series_ok DESC, injectability_ok DESC, series_length_score DESC, injectability_score DESC, ap DESC, entity) <= 2", *RULES, *INJ),
    "z08_overwritten_scores": B.sql(f"SELECT entity, {TS('bin')}, CAST(i >= 0 AND i < n AS INTEGER) AS inside, " + ", ".join(f"round(CASE WHEN i >= 0 AND i < n THEN CASE WHEN i % 2 = 0 THEN 4.0 ELSE -4.0 END ELSE {c} END, 6) + 0.0 AS {c}" for c in ("steps_sum_rrz", "motion_sum_rrz"))
        + ", CASE WHEN i >= 0 AND i < n THEN 1 ELSE CAST(if_anomaly_point AS INTEGER) END AS if_anomaly_point FROM (SELECT r.*, p.n, r.pos - p.start_pos AS i FROM rul r JOIN gplan p USING (entity) WHERE scenario = 'gradual_marked')", *RULES, *SPLIT, SPANS, *rotated()),
    "a32_realised_changes": B.sql("SELECT entity, event_id, scenario, expected, " + ", ".join(f"round({a}_{s}_sum, 8) + 0.0 AS {a}_{s}_sum" for a in ("source", "adjusted") for s in ("steps", "motion", "transitions")) + ", " + ", ".join(f"round(realized_{s}_change, 8) + 0.0 AS realized_{s}_change" for s in ("steps", "motion", "transitions")) + ", posture_conserved, informative_source_window FROM real", *ADJ, REALV),
    "d10_attributable_evaluation": B.sql(f"SELECT entity, event_id, scenario, expected, {WIN}, {cols(METRICS)} FROM ev", *EVENTS),
    "d12_campaign_with_background": B.sql("SELECT entity, scenario, detected_any_overlap, round(monitored_days, 6) AS monitored_days, " + ", ".join(f"CAST({b}_background_notifs AS BIGINT) AS {b}_background_notifs" for b in ("hypo", "instability", "hybrid")) + " FROM ev", *EVENTS),
    "d12_stress_campaign": B.sql(f"SELECT entity, event_id, scenario, expected, {WIN}, fraction, {cols(METRICS)} FROM sev", *STRESS),
    "d12_hybrid_campaign": B.sql("SELECT entity, scenario, branch, expected, " + ", ".join(f"{b}_{m}" if m.endswith("overlap") else f"round({b}_{m}, 6) + 0.0 AS {b}_{m}" for b in ("hypo", "instability", "hybrid") for m in ("detected_any_overlap", "episode_overlap", "best_iou", "onset_delay_hours")) + " FROM hev", *HYB),
    "a11_a12_hybrid_summary_by_branch": B.sql(
        "SELECT n_events, n_cows, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("hypo_actionable_detection", "instability_surveillance_detection", "instability_actionable_detection", "sequence_actionable_detection", "actionable_detection", "benign_control_alert_rate", "confound_alert_rate", "actionable_iou20", "actionable_delay_h_median", "background_per_cow_day"))
        + ", round(actionable_detection + 0.15 * instability_surveillance_detection + 0.25 * actionable_iou20 - 1.5 * benign_control_alert_rate - 2.0 * confound_alert_rate - 0.3 * least(1.0, background_per_cow_day), 6) AS technical_utility FROM (SELECT count(*) AS n_events, "
        + ", ".join(f"avg(CASE WHEN branch IN ({b}) THEN {m} END) AS {k}" for k, b, m in (
            ("hypo_actionable_detection", "'HYPO'", "hybrid_detected_any_overlap"), ("instability_surveillance_detection", "'INSTABILITE'", "instability_detected_any_overlap"), ("instability_actionable_detection", "'INSTABILITE'", "hybrid_detected_any_overlap"),
            ("sequence_actionable_detection", "'SEQUENCE'", "hybrid_detected_any_overlap"), ("actionable_detection", "'HYPO', 'SEQUENCE'", "hybrid_detected_any_overlap"), ("benign_control_alert_rate", "'CONTROLE'", "hybrid_detected_any_overlap"),
            ("confound_alert_rate", "'CONFONDANT'", "hybrid_detected_any_overlap"), ("actionable_iou20", "'HYPO', 'SEQUENCE'", "hybrid_detected_iou20")))
        + ", median(CASE WHEN branch IN ('HYPO', 'SEQUENCE') THEN hybrid_onset_delay_hours END) AS actionable_delay_h_median FROM hev), (SELECT avg(r) AS background_per_cow_day, count(*) AS n_cows FROM (SELECT entity, min(hybrid_background_notifs) / min(monitored_days) AS r FROM hev GROUP BY entity))", *HYB),
    "a11_hybrid_summary_by_scenario": B.sql(f"SELECT scenario, branch, count(*) AS n_events, {AVG('hybrid_detected_any_overlap')} AS detected, {AVG('hybrid_episode_overlap')} AS coverage, round(median(hybrid_onset_delay_hours), 6) + 0.0 AS delay_median FROM hev GROUP BY ALL", *HYB),
    "a05_detection_summary": B.sql("SELECT scenario, count(DISTINCT event_id) AS n_events, " + ", ".join(f"round_even(avg({m}), 3) + 0.0 AS {k}" for k, m in (("new_warning_start_mean", "detected_any_overlap"), ("warning_coverage_mean", "episode_overlap"), ("detect_iou20_mean", "detected_iou20"), ("best_iou_mean", "best_iou"))) + " FROM ev GROUP BY scenario", *EVENTS),
    "a06_background_rate": B.sql("SELECT round(avg(r), 6) AS background_per_cow_day_mean, round(quantile_cont(r, 0.9), 6) AS background_per_cow_day_p90, count(*) AS n_cow_runs FROM (SELECT avg(hypo_background_notifs) / greatest(min(monitored_days), 1e-9) AS r FROM ev GROUP BY entity)", *EVENTS),
    "a07_leak_rate": B.sql(f"SELECT {AVG('detected_any_overlap', 'expected = 0')} AS leak_any_mean, count(DISTINCT CASE WHEN expected = 0 THEN event_id END) AS n_non_detectable FROM ev", *EVENTS),
    "a10_stress_summaries": B.sql(f"SELECT scenario, expected, count(DISTINCT entity) AS n_cows, count(DISTINCT fraction) AS n_placements, count(DISTINCT event_id) AS n_events, {AVG('episode_overlap')} AS attributable_coverage, {AVG('detected_any_overlap')} AS novel_start_rate, {AVG('detected_iou20')} AS iou20_rate, {AVG('best_iou')} AS best_iou_mean FROM sev GROUP BY ALL", *STRESS),
    "a24_event_f1": B.sql(" UNION ALL ".join(confusion(c) for c in ("episode_overlap", "novel_start_count", "detected_iou20")), *EVENTS),
    "a25_failure_modes": B.sql("SELECT family, mode, CAST(num AS BIGINT) AS numerator, CAST(den AS BIGINT) AS denominator, round(100.0 * num / nullif(den, 0), 1) AS percentage FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS family, '{m}' AS mode, count(CASE WHEN {base} AND {hit} THEN 1 END) AS num, count(CASE WHEN {base} THEN 1 END) AS den FROM {t}" for f, m, t, base, hit in (
            ("HYPO", "gradual_uncovered", "ev", GRAD, "episode_overlap = 0"), ("HYPO", "gradual_poorly_localized", "ev", GRAD, "episode_overlap = 1 AND detected_iou20 = 0"),
            ("HYPO", "covered_without_novel_start", "ev", GRAD + " AND episode_overlap = 1", "novel_start_count = 0"), ("HYPO", "brief_control_alerted", "ev", CTRL, "detected_any_overlap = 1"),
            ("Fusion hiérarchique", "nonlocomotor_hypoactivity_alerted", "hev", "scenario = 'nonlocomotor_hypoactivity'", "hybrid_detected_any_overlap = 1"),
            ("INSTABILITÉ", "pure_instability_in_surveillance", "hev", "branch = 'INSTABILITE'", "instability_detected_any_overlap = 1"),
            ("Fusion hiérarchique", "pure_instability_actionable_episode", "hev", "branch = 'INSTABILITE'", "hybrid_episode_overlap = 1"))) + ")", *EVENTS, *HYB),
    "a31_protocol_checks": B.sql("SELECT * FROM (SELECT unnest(['required_columns', 'non_empty', 'unique_event_ids', 'unique_physical_windows', 'non_overlapping_physical_windows', 'strictly_post_baseline', 'single_primary_seed', 'all_scenarios_present', 'informative_source_windows']) AS \"check\", "
        "unnest([1, 1, 1, 1, CAST(ov = 0 AS INTEGER), CAST(early = 0 AS INTEGER), 1, 1, CAST(blind = 0 AS INTEGER)]) AS passed, unnest(['ok', 'n_events=' || n, 'duplicates=' || n - ni, 'duplicates=' || n - nw, 'overlaps=' || ov, 'violations=' || early, 'n_seeds=1', 'gradual_marked,gradual_mild,gradual_moderate,isolated_short_variation', 'violations=' || blind]) AS detail FROM "
        "(SELECT count(*) AS n, count(DISTINCT event_id) AS ni, count(DISTINCT (entity, start, \"end\")) AS nw, count(CASE WHEN start < heldout_start THEN 1 END) AS early FROM gplan), (SELECT count(*) AS ov FROM gplan a WHERE EXISTS (SELECT 1 FROM gplan b WHERE b.entity = a.entity AND b.start < a.start AND b.\"end\" >= a.start)), (SELECT count(CASE WHEN informative_source_window = 0 THEN 1 END) AS blind FROM real))", *ADJ, REALV),
    "a36_snapshot": B.sql(f"SELECT scenario, ev.expected, count(*) AS n, {AVG('episode_overlap')} AS coverage, {AVG('realized_steps_change')} AS steps_change, {AVG('realized_motion_change')} AS motion_change FROM ev JOIN (SELECT entity, event_id, realized_steps_change, realized_motion_change FROM real) USING (entity, event_id) GROUP BY ALL", *EVENTS, REALV),
    "a38_window_peaks": B.sql("SELECT g.entity, g.event_id, count(*) AS n_win_bins, round(min(steps_sum_rrz), 6) + 0.0 AS steps_min, round(max(lying_sum_rrz), 6) + 0.0 AS lying_max, CAST(max(if_anom_k) AS INTEGER) AS if_anom_k_max, CAST(max(n_families) AS INTEGER) AS n_families_max, CAST(sum(notif_lameness) AS BIGINT) AS notif "
        "FROM gplan g JOIN (SELECT entity, bin, steps_sum_rrz, lying_sum_rrz, if_anom_k, n_families, notif_lameness FROM rul) r ON r.entity = g.entity AND r.bin BETWEEN g.start AND g.\"end\" GROUP BY ALL", *RULES, *SPLIT, SPANS, *rotated()),
    "k03_review_sample": B.sql(f"SELECT entity, event_id, scenario, {TS('start')}, detected_any_overlap, round(best_iou, 6) + 0.0 AS best_iou, 'A_REVOIR' AS manual_status FROM ev QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY detected_any_overlap, best_iou, entity, event_id) <= 3", *EVENTS),
    "w22_window_overlap_checks": B.sql(f"SELECT entity, event_id, {WIN} FROM (SELECT *, lag(\"end\") OVER (PARTITION BY entity ORDER BY start, \"end\") AS pe FROM hplan) WHERE start <= pe", *SPLIT, SPANS, *slotted()),
    "d13_a13_ofat_summary_with_deltas": B.sql("SELECT s.config, s.n_cows, s.n_events, round(s.dl, 6) + 0.0 AS progressive_onset_delay_median_hours, " + ", ".join(f"round(s.{k}, 6) + 0.0 AS {k}, round(s.{k} - r.{k}, 6) + 0.0 AS delta_{k}_vs_reference" for k in RATES) + " FROM csum0 s, csum0 r WHERE r.config = 'reference'", *SWEEP, CSUM),
    "a13_ofat_by_scenario": B.sql(f"SELECT config, scenario, count(DISTINCT entity) AS n_cows, count(*) AS n_events, {AVG('detected_any_overlap')} AS new_start_rate, {AVG('episode_overlap')} AS attributable_coverage_rate, {AVG('best_iou')} AS best_iou_mean FROM cev GROUP BY ALL", *SWEEP),
    "a14_largest_effect_per_parameter": B.sql("SELECT parameter, " + ", ".join(f"round(max(abs(s.{k} - r.{k})), 6) + 0.0 AS max_abs_{k}" for k in ("progressive_new_start_rate", "progressive_attributable_coverage_rate", "control_new_start_rate"))
        + ", round(max(greatest(" + ", ".join(f"abs(s.{k} - r.{k})" for k in ("progressive_new_start_rate", "progressive_attributable_coverage_rate", "control_new_start_rate")) + ")), 6) + 0.0 AS max_abs_any FROM (SELECT *, split_part(config, '__', 1) AS parameter FROM csum0) s, csum0 r WHERE r.config = 'reference' AND s.config <> 'reference' GROUP BY parameter", *SWEEP, CSUM),
    "a08_d08_ablation_variants": B.sql("SELECT variant, count(DISTINCT entity) AS n_cows, count(*) AS n_bins, CAST(sum(episode) AS BIGINT) AS episode_bins, CAST(sum(notification) AS BIGINT) AS notifications FROM variants GROUP BY variant", *VARIANTS),
    "a09_variant_pivot": B.sql("SELECT entity, " + ", ".join(f"round(coalesce(max(CASE WHEN variant = '{v}' THEN episode_rate END), 0), 6) + 0.0 AS \"{v}\"" for v in "ABCEF") + " FROM vrates GROUP BY entity", *VARIANTS),
    "a23_ablation_mean_std": B.sql("SELECT variant, " + ", ".join(f"round(avg({m}), 6) + 0.0 AS {m}_mean, round(stddev_samp({m}), 6) + 0.0 AS {m}_std" for m in ("episode_rate", "notifs")) + " FROM vrates GROUP BY variant", *VARIANTS),
    "j15_variant_pairs": B.sql("SELECT a.variant, b.variant AS variant2, count(*) AS n, round(avg(a.episode_rate - b.episode_rate), 6) + 0.0 AS mean_difference FROM vrates a JOIN vrates b USING (entity) WHERE a.variant < b.variant GROUP BY ALL", *VARIANTS),
    "j16_paired_counts": B.sql("SELECT count(*) AS n_common, " + ", ".join(f"CAST(count(CASE WHEN b.{m} {o} a.{m} THEN 1 END) AS BIGINT) AS {m}_right_{n}" for m in ("episode_rate", "notifs") for n, o in (("gt", ">"), ("eq", "="), ("lt", "<"))) + " FROM vrates a JOIN vrates b USING (entity) WHERE a.variant = 'A' AND b.variant = 'B'", *VARIANTS),
    "j06_before_after": B.sql("SELECT entity, " + ", ".join(f"b.{k} AS before_{k}, a.{k} AS after_{k}, a.{k} - b.{k} AS delta_{k}" for k in SUMS3) + " FROM bef b JOIN aft a USING (entity)", *RULES, *SPLIT, SPANS, *rotated(),
        ("bef", "SELECT entity, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {k}" for k, c in SUMS3.items()) + " FROM rul GROUP BY entity"),
        ("planted", "SELECT s.* REPLACE (" + ", ".join(f"CASE WHEN {INSIDE} THEN CASE WHEN (s.pos - p.start_pos) % 2 = 0 THEN 4.0 ELSE -4.0 END ELSE s.{c} END AS {c}" for c in [f"{x}_rrz" for x in B.FEATURES])
         + f", CASE WHEN {INSIDE} THEN 1 ELSE s.if_anomaly_point END AS if_anomaly_point) FROM scored s JOIN gplan p USING (entity) WHERE p.scenario = 'gradual_marked'"),
        *FX.rules("planted", "rul2"), ("aft", "SELECT entity, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {k}" for k, c in SUMS3.items()) + " FROM rul2 GROUP BY entity")),
    "d11_raw_overlap_with_explanations": B.sql(
        "SELECT entity, event_id, scenario, expected, hit AS detected_any_overlap, CAST(best >= 0.2 AS INTEGER) AS detected_iou20, round(best, 6) + 0.0 AS best_iou, CAST(nb AS INTEGER) AS duration_bins, km AS if_anom_k_max, round(rm, 6) + 0.0 AS anom_rate_k_max, round(cm, 6) + 0.0 AS coherence_boiterie_mean, round(cr, 6) + 0.0 AS cooldown_ratio, "
        "CASE WHEN hit = 1 THEN 'Overlap with at least one predicted behavioral-warning episode.' ELSE coalesce(nullif(concat_ws(' ', CASE WHEN nb < 2 THEN printf('Duration too short for persistence window: %d < K=2.', nb) END, CASE WHEN rm < 0.24 THEN printf('anom_rate_k peak %.3f below threshold 0.240.', rm) END, "
        "CASE WHEN km < 2 THEN printf('if_anom_k peak %.1f below alert_min 2.', km) END, CASE WHEN cm < 0.5 THEN 'Low coherence_boiterie on injected window.' END, CASE WHEN cr >= 0.8 THEN 'Most of the window is under cooldown.' END), ''), 'Signal remained below decision rules or was too fragmented.') END AS why FROM "
        "(SELECT g.entity, g.event_id, g.scenario, g.expected, coalesce(i.iou, 0) AS best, CAST(coalesce(i.iou, 0) > 0 AS INTEGER) AS hit, count(*) AS nb, CAST(max(r.if_anom_k) AS DOUBLE) AS km, max(CASE WHEN r.low THEN 0 ELSE r.rk END) AS rm, avg(r.coherence_boiterie) AS cm, avg(r.in_cooldown) AS cr "
        "FROM gplan g JOIN rul r ON r.entity = g.entity AND r.bin BETWEEN g.start AND g.\"end\" LEFT JOIN oiou i ON i.entity = g.entity AND i.event_id = g.event_id GROUP BY ALL)", *RULES, *SPLIT, SPANS, *rotated(),
        ("osg", "SELECT entity, min(bin) AS s0, max(bin) AS s1 FROM (SELECT entity, bin, pos - row_number() OVER (PARTITION BY entity ORDER BY bin) AS isle FROM rul WHERE pred_lameness_episode = 1) GROUP BY entity, isle"),
        ("oiou", f"SELECT entity, event_id, max({overlap('s0', 's1')} / (epoch(s1) - epoch(s0) + {STEP} + epoch(\"end\") - epoch(start) + {STEP} - {overlap('s0', 's1')})) AS iou FROM gplan JOIN osg USING (entity) GROUP BY ALL")),
    "a27_d14_entity_calibration": B.sql("SELECT f.entity, round(f.baseline_std, 6) + 0.0 AS baseline_std, round(f.factor, 6) + 0.0 AS factor, CAST(r.n AS BIGINT) AS reference_notifs, CAST(c.n AS BIGINT) AS calibrated_notifs FROM fac f "
        "LEFT JOIN (SELECT entity, sum(behavioral_warning_notification) AS n FROM fus WHERE dataset_split = 'futur' GROUP BY entity) r USING (entity) LEFT JOIN (SELECT entity, sum(behavioral_warning_notification) AS n FROM cal WHERE dataset_split = 'futur' GROUP BY entity) c USING (entity)", *BRANCH,
        ("sd", "SELECT entity, stddev_samp(CASE WHEN dataset_split = 'baseline' THEN behavioral_warning_score END) AS baseline_std FROM fus GROUP BY entity"),
        ("fac", "SELECT *, least(greatest(coalesce(baseline_std / nullif(median(baseline_std) OVER (), 0), 1.0), 0.6), 1.8) AS factor FROM sd"),
        ("own", "SELECT spl.*, factor * 0.12 AS x_score FROM spl LEFT JOIN fac USING (entity)"), *D.hypo("own", "cal", score="x_score")),
    "j19_same_event_schedule": B.sql("SELECT count(*) AS n_differences FROM gplan WHERE event_id IS NULL", *SPLIT, SPANS, *rotated()),
    "j19_unequal_schedules": "WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click'), b AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view'), "
    "x AS (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT side, count(*) AS n_rows, CAST(sum(user_id) AS BIGINT) AS users FROM x GROUP BY side",
    "a26_detection_background_curve": B.sql(
        f"SELECT e.config, b.n_cows, CAST(count(CASE WHEN {GRAD} THEN 1 END) AS BIGINT) AS n_gradual_events, round(b.bg, 6) + 0.0 AS background_per_cow_day, {AVG('episode_overlap', GRAD)} AS attributable_coverage, {AVG('CASE WHEN novel_start_count >= 1 THEN 1 ELSE 0 END', GRAD)} AS new_start_rate, "
        f"{AVG('detected_iou20', GRAD)} AS iou20_rate, {AVG('best_iou', GRAD)} AS mean_attributable_iou, round(1.0 - avg(CASE WHEN {CTRL} THEN episode_overlap END), 6) + 0.0 AS brief_control_rejection FROM cev e "
        "JOIN (SELECT config, count(*) AS n_cows, sum(h) / sum(m) AS bg FROM (SELECT config, entity, min(hypo_background_notifs) AS h, min(monitored_days) AS m FROM cev GROUP BY ALL) GROUP BY config) b USING (config) GROUP BY ALL", *CURVE),
    "d13_match_tolerance_sweep": B.sql(" UNION ALL ".join(f"SELECT {float(h)}::DOUBLE AS tolerance_hours, {AVG('detected_any_overlap')} AS new_start_rate, CAST(sum(novel_start_count) AS BIGINT) AS novel_starts FROM t{h}" for h in (1, 4, 8, 24)),
        *ADJ, *D.hypo("adj", "ahyp", keys=KEYS), *[c for h in (1, 4, 8, 24) for c in drop_eval("ahyp", f"t{h}", reach=h // 4)]),
    "d13_instability_configs": B.sql(" UNION ALL ".join(f"SELECT '{k}' AS config, CAST(sum(instability_warning_notification) AS BIGINT) AS notifications, CAST(sum(instability_warning_episode) AS BIGINT) AS episode_bins FROM c{i}" for i, k in enumerate(INSTABILITY)), *SPLIT,
        *[c for i, g in enumerate(INSTABILITY.values()) for c in D.instability("spl", f"c{i}", agg=g.aggregation_hours, persist=g.persistence_hours, least=g.restless_motion_min_change, score=g.score_threshold, thr=g.cusum_threshold)]),
    "d13_fusion_sensitivity": B.sql(sensitivity(), *fused(fusion_runs())),
    "a39_admissibility": B.sql("SELECT entity, round(span_days, 6) AS span_days, CAST(eligible AS INTEGER) AS admissible, CAST(span_days >= 14 AS INTEGER) AS long_enough FROM spn", *SPLIT, SPANS),
    "a21_injectability": B.sql("SELECT entity, series_bins, round(injectability_score, 6) AS injectability_score, injectability_ok, round(series_length_score, 6) AS series_length_score, long_series_ok FROM inj2", *INJ),
    "a20_entity_days_count": B.sql("SELECT count(DISTINCT (entity, CAST(t AS DATE))) AS entity_days FROM raw", B.RAW),
    "a19_detected_episodes": B.sql(f"SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY min(bin)) AS BIGINT) AS island, {TS('min(bin)', 'start')}, {TS('max(bin)', chr(34) + 'end' + chr(34))}, count(*) AS n_bins, round(max(CASE WHEN low THEN 0 ELSE rk END), 6) + 0.0 AS rate_max, CAST(max(n_families) AS INTEGER) AS families_max, round(avg(round_even(conf, 1)), 6) + 0.0 AS confidence_mean "
        "FROM (SELECT *, pos - row_number() OVER (PARTITION BY entity ORDER BY bin) AS isle FROM rul WHERE pred_problem_episode = 1) GROUP BY entity, isle", *RULES),
    "a04_severity_matrix": B.sql("SELECT entity, strftime(day, '%Y-%m-%d') AS day, round(sum(severity), 6) + 0.0 AS severity, round(any_value(t), 6) + 0.0 AS total FROM (SELECT *, sum(severity) OVER (PARTITION BY entity) AS t FROM days) GROUP BY entity, day", *DAYS),
    "a03_herd_days": B.sql("SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS cows, CAST(sum(day_alert) AS BIGINT) AS cows_alert, CAST(sum(day_notifs) AS BIGINT) AS total_notifs, round(sum(day_alert) / count(*) * 100.0, 6) + 0.0 AS pct_alert FROM days GROUP BY day", *DAYS),
    "a02_m07_entity_days": B.sql("SELECT entity, strftime(day, '%Y-%m-%d') AS day, CAST(day_alert AS INTEGER) AS day_alert, round(alert_rate, 6) + 0.0 AS alert_rate, CAST(n_anomalies AS BIGINT) AS n_anomalies, n_bins, CAST(day_notifs AS BIGINT) AS day_notifs, round(severity_raw, 6) + 0.0 AS severity_raw, round(severity, 6) + 0.0 AS severity FROM days", *DAYS),
    "k01_herd_ranking": B.sql(RANK, *BRANCH),
    "k02_top_entities_and_alerts": B.sql("SELECT 'entity' AS kind, entity, CAST(NULL AS VARCHAR) AS bin, rank FROM (" + RANK + f") WHERE rank <= 9 UNION ALL SELECT * FROM (SELECT 'alert', entity, {TS('bin')}, 0 FROM fus WHERE hybrid_warning_start = 1 ORDER BY bin DESC, entity LIMIT 50)", *BRANCH),
    "k05_alert_export": B.sql(f"SELECT entity, {TS('bin')}, hybrid_warning_type, CAST(hybrid_warning_priority AS INTEGER) AS hybrid_warning_priority, {REASON} FROM fus WHERE hybrid_warning_start = 1", *BRANCH),
}
