"""Checks of the two branches and their fusion."""

from __future__ import annotations

from oracle import base as B

HYPO = dict(agg=12.0, persist=6.0, cool=24.0, fam=0.10, post=0.05, score=0.12, drift=0.07, thr=1.2, nfam=3, cov=25.0)
INST = dict(agg=3.0, persist=2.0, cool=12.0, least=0.20, score=0.18, drift=0.06, thr=0.7, nfam=2, cov=25.0)
WEIGHTS = {"steps": 0.30, "motion": 0.30, "transitions": 0.20, "posture": 0.20}


def n(hours: float, floor: int, minutes: int) -> int:
    return max(floor, round(hours * 60 / minutes))


def masks(src: str, name: str, keys: str, missing_only: bool) -> list[tuple[str, str]]:
    if missing_only:
        return [(name, f"SELECT *, dataset_split = 'baseline' AS base, dataset_split = 'futur' AS fut FROM {src}")]
    p = f"OVER (PARTITION BY {keys})"
    return [
        (
            f"{name}_u",
            f"SELECT *, bool_or(dataset_split = 'baseline') {p} AND bool_or(dataset_split = 'futur') {p} AS usable, "
            f"greatest(30, round_even(count(*) {p} * 0.6, 0)) AS cut FROM {src}",
        ),
        (
            name,
            f"SELECT * EXCLUDE (usable, cut), CASE WHEN usable THEN dataset_split = 'baseline' ELSE pos < cut END AS base, "
            f"CASE WHEN usable THEN dataset_split = 'futur' ELSE pos >= cut END AS fut FROM {name}_u",
        ),
    ]


def hypo(src: str = "spl", name: str = "hyp", minutes: int = 240, keys: str = "entity", active=tuple(WEIGHTS), **over) -> list[tuple[str, str]]:
    c = {**HYPO, **over}
    w = n(c["agg"], 4, minutes)
    tot = ", ".join(f"{B.rolling_total(s + '_sum', w, keys)} AS {s}_t" for s in B.SIGNALS)
    ratios = ", ".join(f"r_{s}_t AS warning_ratio_{s}" for s in B.SIGNALS)
    chg = ", ".join(f"{B.clip(f'(1.0 - warning_ratio_{s})', '0.0', '1.0')} AS warning_change_{s}" for s in ("steps", "motion", "transitions"))
    le, sd = B.clip("(warning_ratio_lying - 1.0)", "0.0", "1.0"), B.clip("(1.0 - warning_ratio_standing)", "0.0", "1.0")
    total = sum(WEIGHTS[f] for f in WEIGHTS if f in active)
    act = [f for f in WEIGHTS if f in active]
    score = " + ".join(f"{WEIGHTS[f] / total!r} * coalesce(warning_change_{f}, 0)" for f in act)
    hit = {f: f"CAST(coalesce(warning_change_{f} >= {c['post'] if f == 'posture' else c['fam']}, false) AS INTEGER)" for f in act}
    core = [hit[f] for f in ("steps", "motion") if f in act]
    moves = [f for f in act if f != "posture"]
    mean = (
        f"list_avg(list_filter([{', '.join('warning_ratio_' + f for f in moves)}], lambda x: x IS NOT NULL))" if moves else "CAST(NULL AS DOUBLE)"
    )
    lag = n(6, 2, minutes)
    p = f"PARTITION BY {keys} ORDER BY bin"
    fams = " + ".join(hit.values())
    return [
        *masks(src, f"{name}_m", keys, False),
        (f"{name}_t", f"SELECT *, {tot} FROM {name}_m"),
        *B.reference_ratios(f"{name}_t", f"{name}_r", [f"{s}_t" for s in B.SIGNALS], n(24, 4, minutes), keys, ("lying_t",)),
        (f"{name}_q", f"SELECT * EXCLUDE ({', '.join(f'{s}_t, r_{s}_t' for s in B.SIGNALS)}), {ratios} FROM {name}_r"),
        (f"{name}_g", f"SELECT *, {chg}, list_avg(list_filter([{le}, {sd}], lambda x: x IS NOT NULL)) AS warning_change_posture FROM {name}_q"),
        (f"{name}_h", f"SELECT *, {score} AS sc, {fams} AS behavioral_warning_families, {'greatest(' + ', '.join(core) + ')' if core else '1'} AS core, {mean} AS act FROM {name}_g"),
        (
            f"{name}_k",
            f"SELECT *, coalesce({B.clip(f'(lag(act, {lag}) OVER ({p}) - act)', '0.0', '1.0')}, 0.0) AS pdrop, "
            f"CAST(sc >= {c['score']} AND behavioral_warning_families >= {c['nfam']} AND core = 1 AND coalesce(coverage_pct, 0) >= {c['cov']} AND fut AS INTEGER) AS behavioral_warning_candidate FROM {name}_h",
        ),
        (f"{name}_v", f"SELECT *, CASE WHEN behavioral_warning_candidate = 1 THEN sc + 0.35 * pdrop ELSE 0.0 END AS evidence FROM {name}_k"),
        *B.cusum_cooldown(f"{name}_v", f"{name}_w", "behavioral_warning", c["drift"], c["thr"], n(c["persist"], 2, minutes), 0.45, c.get("wait") or n(c["cool"], 1, minutes), keys),
        (name, f"SELECT * EXCLUDE (base, fut, sc, core, act, pdrop, evidence, csum, prate), {B.clip('sc', '0.0', '1.0')} AS behavioral_warning_score FROM {name}_w"),
    ]


FAMS = {"restless_motion": 0.35, "transition_density": 0.30, "fragmentation": 0.20, "posture_volatility": 0.15}


def instability(src: str = "hyp", name: str = "ins", minutes: int = 240, keys: str = "entity", **over) -> list[tuple[str, str]]:
    c = {**INST, **over}
    w = n(c["agg"], 4, minutes)
    mp = max(4, w // 2)
    p = f"PARTITION BY {keys} ORDER BY bin"
    pe = f"PARTITION BY {keys}"
    post = "(lying_sum + standing_sum)"

    def per(a, b):
        med = f"median(CASE WHEN {b} > 0 THEN {b} END) OVER ({pe})"
        flo = f"CASE WHEN {med} IS NULL THEN 1.0 ELSE greatest(1e-6, 0.05 * {med}) END"
        return f"{a} / (CASE WHEN {b} < {flo} THEN {flo} ELSE {b} END)"

    names = ["steps", "motion", "transitions", *FAMS]
    exc = ", ".join(f"{B.clip(f'(instability_ratio_{f} - 1.0)', '0.0', '1.5')} AS instability_change_{f}" for f in FAMS)
    hits = ", ".join(f"CAST(coalesce(instability_change_{f} >= {c['least']}, false) AS INTEGER) AS h_{f}" for f in FAMS)
    score = " + ".join(f"{wt} * coalesce(instability_change_{f}, 0)" for f, wt in FAMS.items())
    up = {s: B.clip(f"(instability_ratio_{s} - 1.0)", "0.0") for s in ("steps", "motion")}
    return [
        *masks(src, f"{name}_m", keys, True),
        (
            f"{name}_t",
            f"SELECT *, {', '.join(f'{B.rolling_total(s + "_sum", w, keys)} AS {s}_i' for s in ('steps', 'motion', 'transitions'))}, "
            f"{B.rolling_total(post, w, keys)} AS post_t, {B.clip(f'(lying_sum / CASE WHEN {post} > 0 THEN {post} END)', '0.0', '1.0')} AS frac FROM {name}_m",
        ),
        (
            f"{name}_d",
            f"SELECT * EXCLUDE (post_t, frac), {per('motion_i', 'steps_i')} AS restless_motion_i, {per('transitions_i', 'steps_i')} AS transition_density_i, "
            f"{per('transitions_i', 'post_t')} AS fragmentation_i, abs(frac - lag(frac) OVER ({p})) AS swing FROM {name}_t",
        ),
        (
            f"{name}_e",
            f"SELECT * EXCLUDE (swing), CASE WHEN count(swing) {B.frame(keys, w)} >= {mp} THEN avg(swing) {B.frame(keys, w)} END AS posture_volatility_i FROM {name}_d",
        ),
        *B.reference_ratios(f"{name}_e", f"{name}_r", [f"{x}_i" for x in names], n(24, 4, minutes), keys),
        (f"{name}_q", f"SELECT * EXCLUDE ({', '.join(f'{x}_i, r_{x}_i' for x in names)}), {', '.join(f'r_{x}_i AS instability_ratio_{x}' for x in names)} FROM {name}_r"),
        (f"{name}_x", f"SELECT *, {exc} FROM {name}_q"),
        (f"{name}_h", f"SELECT *, {hits}, {score} AS sc, {up['steps']} AS us, {up['motion']} AS um FROM {name}_x"),
        (
            f"{name}_k",
            f"SELECT *, h_restless_motion + h_transition_density + h_fragmentation + h_posture_volatility AS instability_warning_families, "
            f"CAST(coalesce(us >= 0.15 AND um >= 0.15 AND abs(um - us) <= 0.20 AND h_transition_density = 0 AND h_fragmentation = 0, false) AS INTEGER) AS instability_coordinated_activity FROM {name}_h",
        ),
        (
            f"{name}_n",
            f"SELECT *, CAST(sc >= {c['score']} AND instability_warning_families >= {c['nfam']} AND h_restless_motion = 1 "
            f"AND (h_transition_density = 1 OR h_fragmentation = 1 OR h_posture_volatility = 1) AND instability_coordinated_activity = 0 "
            f"AND coalesce(coverage_pct, 0) >= {c['cov']} AND fut AS INTEGER) AS instability_warning_candidate FROM {name}_k",
        ),
        (f"{name}_v", f"SELECT *, CASE WHEN instability_warning_candidate = 1 THEN sc ELSE 0.0 END AS evidence FROM {name}_n"),
        *B.cusum_cooldown(f"{name}_v", f"{name}_w", "instability_warning", c["drift"], c["thr"], n(c["persist"], 2, minutes), 0.50, n(c["cool"], 1, minutes), keys),
        (name, f"SELECT * EXCLUDE (base, fut, sc, us, um, evidence, csum, prate, {', '.join('h_' + f for f in FAMS)}), {B.clip('sc', '0.0', '1.0')} AS instability_warning_score FROM {name}_w"),
    ]


def fusion(src: str = "ins", name: str = "fus", mode: str = "HIERARCHICAL", minutes: int = 240, keys: str = "entity", smin: float = 0.0, smax: float = 72.0, cool: float = 12.0) -> list[tuple[str, str]]:
    lo = n(smin, 0, minutes)
    hi = n(smax, lo + 1, minutes)
    p = f"PARTITION BY {keys} ORDER BY bin"
    h, i, hs, is_ = "behavioral_warning_episode", "instability_warning_episode", "behavioral_warning_start", "instability_warning_start"
    ep, st = {
        "HYPO_ONLY": (h, hs),
        "INSTABILITY_ONLY": (i, is_),
        "OR": (f"greatest({h}, {i})", f"greatest({hs}, {is_})"),
        "SEQUENTIAL": ("hybrid_warning_sequence_start", "hybrid_warning_sequence_start"),
        "HIERARCHICAL": (h, f"greatest({hs}, mix_start, hybrid_warning_sequence_start)"),
    }[mode]
    return [
        (
            f"{name}_p",
            f"SELECT *, {h} * {i} AS mix, coalesce(max({is_}) OVER ({p} ROWS BETWEEN {hi} PRECEDING AND {max(1, lo)} PRECEDING), 0) AS prior FROM {src}",
        ),
        (
            f"{name}_s",
            f"SELECT *, {hs} * prior AS hybrid_warning_sequence_start, CAST(mix = 1 AND coalesce(lag(mix) OVER ({p}), 0) = 0 AS INTEGER) AS mix_start FROM {name}_p",
        ),
        (
            f"{name}_e",
            f"SELECT *, {ep} AS hybrid_warning_episode, {st} AS hybrid_warning_start, CAST({i} = 1 AND {h} = 0 AS INTEGER) AS hybrid_warning_surveillance, "
            f"greatest(behavioral_warning_score, instability_warning_score) AS hybrid_warning_score, "
            f"CASE WHEN hybrid_warning_sequence_start = 1 THEN 'SEQUENCE' WHEN mix = 1 THEN 'MIXTE' WHEN {h} = 1 THEN 'HYPO' WHEN {i} = 1 THEN 'INSTABILITE' ELSE 'AUCUN' END AS hybrid_warning_type, "
            f"CASE WHEN hybrid_warning_sequence_start = 1 OR mix = 1 THEN 3 WHEN {h} = 1 THEN 2 WHEN {i} = 1 THEN 1 ELSE 0 END AS hybrid_warning_priority FROM {name}_s",
        ),
        *B.cooldown(f"{name}_e", f"{name}_n", "hybrid_warning_start", "hybrid_warning_notification", n(cool, 1, minutes), keys),
        (name, f"SELECT * EXCLUDE (mix, prior, mix_start) FROM {name}_n"),
    ]
