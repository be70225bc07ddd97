"""Checks of the core queries."""

from __future__ import annotations

from oracle import base as B
from oracle import detectors as D
from oracle import features as FX

S = B.SIGNALS
GRID = [B.RAW, *B.grid()]
SPLIT = [*GRID, *B.split()]
FEAT = [*GRID, *FX.logs(), *FX.rolling_z()]
PRED0 = [*FEAT, *B.split("rrz")]
SCORED = [*PRED0, *FX.distance_score()]
RULES = [*SCORED, *FX.rules()]
PRED = [*RULES, *D.hypo("rul"), *D.instability(), *D.fusion()]
BRANCH = [*SPLIT, *D.hypo(), *D.instability(), *D.fusion()]
LEVELS = (0.02, 0.04, 0.06, 0.08, 0.10)
SWEPT = [
    ("cont_1", FX.distance_score()[0][1]),
    ("cont_2", f"SELECT *, quantile_cont(CASE WHEN dataset_split = 'baseline' THEN raw_score END, {list(LEVELS)}) OVER (PARTITION BY entity) AS offs FROM cont_1"),
    ("cont", "SELECT s.* EXCLUDE (raw_score, offs), v.config, raw_score - offs[v.i] AS if_score, CAST(coalesce(raw_score - offs[v.i] < 0, false) AS INTEGER) AS if_anomaly_point FROM cont_2 s CROSS JOIN (VALUES "
     + ", ".join(f"('contamination_{x:.2f}', {i})" for i, x in enumerate(LEVELS, 1)) + ") v(config, i)"),
]
INTS = ("n", "families", "candidate", "episode", "start", "notification", "surveillance", "priority", "activity", "anom", "k", "spike",
        "coherent", "coherence", "problem", "lameness", "notif", "cooldown", "hit", "fam", "point", "rank", "dow", "hour", "train")


def col(c: str, kind: str = "") -> str:
    """Select item with the rounding and text form the queries use."""
    if c == "bin":
        return B.ts("bin") + " AS bin"
    if kind == "i":
        return f"CAST({c} AS INTEGER) AS {c}"
    if kind == "l":
        return f"CAST({c} AS BIGINT) AS {c}"
    if kind == "s":
        return c
    return f"round({c}, 6) + 0.0 AS {c}"


def cols(spec: str) -> str:
    """``"entity:s bin x y:i"`` -> select list."""
    return ", ".join(col(*x.split(":")) for x in spec.split())


H = lambda m: f"CAST(floor({m} * 60) AS BIGINT)"
NORMAL = f"""SELECT entity, strftime(t, '%Y-%m-%d %H:%M:%S') AS t, seq, round(CASE WHEN steps - 20 < 0 THEN 0 ELSE steps - 20 END, 6) + 0.0 AS steps,
 motion + 0.0 AS motion, round({H('lying')} / 60, 6) + 0.0 AS lying, standing + 0.0 AS standing, transitions + 1.0 AS transitions FROM raw"""

HYPO_COLS = ("entity:s bin coverage_pct dataset_split:s " + " ".join(f"warning_ratio_{s}" for s in S)
             + " " + " ".join(f"warning_change_{f}" for f in ("steps", "motion", "transitions", "posture"))
             + " behavioral_warning_cusum behavioral_warning_score " + " ".join(f"behavioral_warning_{x}:i" for x in ("families", "candidate", "episode", "start", "notification")))
NAMES = ["steps", "motion", "transitions", *D.FAMS]
INST_COLS = ("entity:s bin " + " ".join(f"instability_ratio_{x}" for x in NAMES) + " " + " ".join(f"instability_change_{x}" for x in D.FAMS)
             + " instability_coordinated_activity:i instability_warning_cusum instability_warning_score "
             + " ".join(f"instability_warning_{x}:i" for x in ("families", "candidate", "episode", "start", "notification")))
FUSE_COLS = "entity:s bin hybrid_warning_score hybrid_warning_type:s " + " ".join(
    f"hybrid_warning_{x}:i" for x in ("episode", "surveillance", "sequence_start", "start", "notification", "priority"))
RULE_COLS = "entity:s bin alert_level:s " + " ".join(f"{x}:i" for x in (
    "if_anom_k", "n_families", "flag_coherent_episode", "coherence_boiterie", "pred_problem_episode", "pred_problem_start",
    "pred_lameness_episode", "pred_lameness_start", "notif_lameness", "in_cooldown"))
CONF = "round_even(conf, 1) + 0.0 AS lame_confidence"


def fused(mode: str, **kw) -> str:
    return B.sql(f"SELECT {cols(FUSE_COLS)} FROM fus", *SPLIT, *D.hypo(), *D.instability(), *D.fusion(mode=mode, **kw))


SUMS = {"if_anomaly_points": "if_anomaly_point", "problem_points": "pred_problem_episode", "lameness_points": "pred_lameness_episode",
        "problem_starts": "pred_problem_start", "lameness_starts": "pred_lameness_start", "lameness_notifs": "notif_lameness",
        "critique_points": "CASE WHEN alert_level = 'critique' THEN 1 ELSE 0 END", "behavioral_warning_points": "behavioral_warning_episode",
        "behavioral_warning_notifs": "behavioral_warning_notification", "instability_warning_notifs": "instability_warning_notification",
        "hybrid_warning_notifs": "hybrid_warning_notification"}
SUMMARY = ("SELECT entity, count(*) AS n_bins, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {m}" for m, c in SUMS.items())
           + ", round(avg(coverage_pct), 6) AS coverage_mean, round(min(coverage_pct), 6) AS coverage_min FROM fus GROUP BY entity")
MASK = [*SPLIT, *D.masks("spl", "mk", "entity", False)]
P = "OVER (PARTITION BY entity ORDER BY bin)"

CHECKS: dict[str, str] = {
    "src01_csv_scan_normalise": B.sql(NORMAL, B.RAW),
    "src02_semicolon_dimension": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "src03_label_sheet": "SELECT CAST(doc_id AS VARCHAR) AS entity, quality, toxic FROM labels",
    "src04_uploaded_table_first": B.sql(NORMAL, B.RAW),
    "src05_json_documents": B.sql(
        "SELECT entity, n, steps, p AS placement, f AS fraction FROM (SELECT entity, count(*) AS n, round(sum(coalesce(steps, 0)), 2) AS steps FROM raw GROUP BY entity) "
        "CROSS JOIN (VALUES ('a', 0.18::DOUBLE), ('b', 0.82::DOUBLE)) v(p, f)", B.RAW),
    "src06_input_shape": B.sql("SELECT 'raw' AS shape, count(*) AS n FROM raw UNION ALL SELECT 'predictions', count(*) FROM grid", *GRID),
    "snk01_partitioned_results": B.sql("SELECT entity, count(*) AS n_bins, CAST(sum(hybrid_warning_episode) AS BIGINT) AS episode_bins FROM fus GROUP BY entity", *BRANCH),
    "snk02_json_summary": B.sql("SELECT entity, count(*) AS n_bins, CAST(sum(hybrid_warning_notification) AS BIGINT) AS hybrid_warning_notifs, round(avg(coverage_pct), 6) AS coverage_mean FROM fus GROUP BY entity", *BRANCH),
    "snk03_append_partial_outputs": B.sql("SELECT CASE WHEN hybrid_warning_notification = 1 THEN 'firing' ELSE 'quiet' END AS run_id, count(*) AS n FROM fus GROUP BY 1", *BRANCH),
    "snk04_resume_by_config_hash": """SELECT DISTINCT o_orderpriority, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y,
 sha256('{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","y":' || year(o_orderdate) || '}') AS run_id FROM orders WHERE o_orderstatus <> 'F'""",
    "snk05_latest_complete_run": """WITH r AS (SELECT l_tax AS grp, l_orderkey AS run_id, max(l_shipdate) AS c, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_returnflag END) AS have
 FROM lineitem GROUP BY ALL HAVING have = 2) SELECT grp, strftime(c, '%Y-%m-%d %H:%M:%S') AS completed_at, run_id FROM r QUALIFY row_number() OVER (PARTITION BY grp ORDER BY c DESC, run_id DESC) = 1""",
    "snk06_fingerprint": B.sql("SELECT 'readings' AS \"table\", 'same' AS status, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM raw UNION ALL "
                               "SELECT 'steps', 'changed', count(*), count(DISTINCT entity) FROM raw WHERE motion IS NOT NULL", B.RAW),
    "p03_parse_time": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events WHERE event_type <> 'error'",
    "p04_entity_id_text": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS entity FROM customer",
    "p05_duration_minutes": f"SELECT event_id, round(CASE WHEN event_type IN ('click', 'view') THEN {H('value')} / 60 WHEN event_type <> 'error' THEN value END, 6) + 0.0 AS minutes FROM events",
    "p06_numeric_coercion": "SELECT event_id, v AS value, coalesce(v, 0.0) AS value_or_zero FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS v FROM events)",
    "p07_derived_transitions": "SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS entity, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS transitions FROM lineitem",
    "p08_clamp_negative": "SELECT CAST(c_custkey AS VARCHAR) AS entity, round(greatest(c_acctbal, 0), 6) AS steps FROM customer",
    "p09_signal_availability": B.sql("SELECT entity, 'steps,motion,lying,transitions' AS signals, " + ", ".join(f"round(sum({s}), 6) AS {s}" for s in ("steps", "motion", "lying", "transitions")) + " FROM raw GROUP BY entity", B.RAW),
    "p10_entity_filter": B.sql("SELECT entity, strftime(t, '%Y-%m-%d %H:%M:%S') AS t, seq, round(steps, 6) AS steps FROM raw WHERE entity = '0'", B.RAW),
    "p11_first_entities": B.sql("SELECT entity, count(*) AS n FROM raw WHERE entity IN (SELECT DISTINCT entity FROM raw ORDER BY entity LIMIT 5) GROUP BY entity", B.RAW),
    "p12_day_range": B.sql("SELECT entity, strftime(t, '%Y-%m-%d %H:%M:%S') AS t, seq FROM raw WHERE t >= '2024-01-10' AND t < '2024-01-13'", B.RAW),
    "p13_detection_filter": B.sql(f"SELECT {cols('entity:s bin hybrid_warning_episode:i if_anomaly_point:i')} FROM fus WHERE hybrid_warning_episode = 1 AND if_anomaly_point = 1", *PRED),
    "p14_filterable_table": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, dataset_split, round(coverage_pct, 6) + 0.0 AS coverage_pct, strftime(bin, '%Y-%m-%d') AS day, "
        + cols(FUSE_COLS).split("AS bin, ")[1] + ", " + ", ".join(col(f"behavioral_warning_{x}", k) for x, k in (("score", ""), ("cusum", ""), ("families", "i"), ("candidate", "i"), ("episode", "i"), ("start", "i"), ("notification", "i")))
        + ", " + ", ".join(col(f"instability_warning_{x}", k) for x, k in (("score", ""), ("cusum", ""), ("families", "i"), ("candidate", "i"), ("episode", "i"), ("start", "i"), ("notification", "i")))
        + ", CAST(instability_coordinated_activity AS INTEGER) AS instability_coordinated_activity, 'HIERARCHICAL' AS hybrid_warning_fusion_mode, 'alerte comportementale a verifier, non diagnostique' AS hybrid_warning_scope, "
        "'alerte comportementale a verifier, non diagnostique' AS behavioral_warning_scope, 'instabilite comportementale a verifier, non diagnostique' AS instability_warning_scope, "
        "round(if_score, 6) + 0.0 AS if_score, round(q05, 6) + 0.0 AS if_score_q05, round(pct, 6) + 0.0 AS if_score_pct, CAST(if_anomaly_point AS INTEGER) AS if_anomaly_point FROM fus", *PRED),
    "p15_feature_selection": B.sql("SELECT DISTINCT entity, 40 AS n_features, 'motion_sum_rrz' AS first_motion FROM raw", B.RAW),
    "p16_coverage_gating": B.sql(f"SELECT {cols('entity:s bin coverage_pct if_anomaly_point:i if_anom_k:i n_families:i in_cooldown:i')}, CAST(spike AS INTEGER) AS mi_spike, {CONF} FROM rul", *RULES),
    "p17_point_validity": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, round(CASE WHEN coverage_pct >= 60 THEN steps_sum END, 6) + 0.0 AS score, CASE WHEN coverage_pct >= 60 THEN -1 ELSE 1 END AS if_pred FROM grid", *GRID),
    "p18_tolerant_config_match": "SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_returnflag FROM lineitem WHERE abs(l_discount - 0.05) < 2e-9 AND abs(l_tax - 0.02) < 2e-9 AND l_returnflag = 'R'",
    "p19_config_floors": "SELECT DISTINCT greatest(l_discount, 0.05) AS contamination, greatest(l_linenumber, 6) AS persist_hours, greatest(l_linenumber - 2, 2) AS alert_min FROM lineitem",
    "p20_key_standardisation": "SELECT round(l_tax, 6) AS rate, l_returnflag AS mode, count(*) AS n, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 7.0 END) AS persist FROM lineitem GROUP BY ALL",
    "t02_regular_grid": B.sql(f"SELECT {cols('entity:s bin n_raw_samples ' + ' '.join(f'{s}_{a}' for s in S for a in ('sum', 'mean')))} FROM grid", *GRID),
    "t02_regular_grid_15min": B.sql(f"SELECT {cols('entity:s bin n_raw_samples steps_sum motion_mean')} FROM grid", B.RAW, *B.grid(15)),
    "t04_coverage": B.sql(f"SELECT {cols('entity:s bin n_raw_samples expected_raw_per_bin coverage_pct')} FROM grid", *GRID),
    "t05_no_signal_fallback": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, 0.0::DOUBLE AS coverage_pct, strftime(bin, '%Y-%m-%d') AS day FROM grid", *GRID),
    "t06_gapped_series": B.sql("SELECT c.entity, strftime(c.bin, '%Y-%m-%d %H:%M:%S') AS bin, round(f.transitions, 6) + 0.0 AS transitions FROM grid_cal c LEFT JOIN "
                               "(SELECT entity, time_bucket(INTERVAL 60 MINUTES, t) AS bin, arg_min(transitions, seq) AS transitions FROM raw GROUP BY ALL) f USING (entity, bin)", B.RAW, *B.grid(60)),
    "t07_sampling_cadence": B.sql("SELECT entity, round(coalesce(median(CASE WHEN dt > 0 THEN dt END) / 60e6, 15.0), 6) AS cadence_minutes FROM "
                                  "(SELECT entity, epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY entity ORDER BY t) AS dt FROM raw) GROUP BY entity", B.RAW),
    "t08_calendar": B.sql(f"SELECT entity, {B.ts('bin')} AS bin, * EXCLUDE (entity, bin) FROM (SELECT entity, bin, dow, hour, round(sin_hour, 6) + 0.0 AS sin_hour, round(cos_hour, 6) + 0.0 AS cos_hour, "
                          f"round(sin_dow, 6) + 0.0 AS sin_dow, round(cos_dow, 6) + 0.0 AS cos_dow, day FROM (SELECT entity, bin, {FX.CALENDAR} FROM grid))", *GRID),
    "t09_slot_of_day": B.sql("SELECT CAST(hour(bin) * 60 + minute(bin) AS INTEGER) AS slot, count(*) AS n FROM grid GROUP BY 1", B.RAW, *B.grid(30)),
    "t12_chronological_split": B.sql(f"SELECT {cols('entity:s bin train_candidate:i dataset_split:s')} FROM spl", *SPLIT),
    "t12_split_without_ratio": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, CASE WHEN train_candidate = 1 THEN 'all' ELSE 'excluded' END AS dataset_split FROM spl", *GRID, *B.split(cov=100.0)),
    "t13_split_fallback": B.sql("SELECT entity, CAST(least(greatest(30, round_even(count(*) * 0.6, 0)), count(*)) AS BIGINT) AS n_base, CAST(count(*) - greatest(30, round_even(count(*) * 0.6, 0)) AS BIGINT) AS n_future FROM grid GROUP BY entity", *GRID),
    "t14_heldout_start": B.sql("SELECT entity, strftime(min(bin), '%Y-%m-%d %H:%M:%S') AS heldout_start FROM spl WHERE dataset_split = 'futur' GROUP BY entity", *SPLIT),
    "t15_t16_spans_and_eligibility": B.sql(
        "SELECT entity, CAST(count(*) AS INTEGER) AS n_bins, strftime(min(CASE WHEN pos >= fp THEN bin END), '%Y-%m-%d %H:%M:%S') AS heldout_start, "
        "round((epoch(max(bin)) - epoch(min(bin))) / 86400, 6) AS span_days, round((epoch(max(bin)) - epoch(min(CASE WHEN pos >= fp THEN bin END)) + 14400) / 86400, 6) AS monitored_days, "
        + ", ".join(f"round(coalesce(sum(CASE WHEN pos >= fp THEN {s}_sum END), 0), 6) AS future_{s}" for s in ("steps", "motion", "transitions"))
        + ", CAST((epoch(max(bin)) - epoch(min(bin))) / 86400 >= 14 AND " + " AND ".join(f"coalesce(sum(CASE WHEN pos >= fp THEN {s}_sum END), 0) > 0" for s in ("steps", "motion", "transitions"))
        + " AS INTEGER) AS eligible FROM (SELECT *, min(CASE WHEN dataset_split = 'futur' THEN pos END) OVER (PARTITION BY entity) AS fp FROM spl) GROUP BY entity", *SPLIT),
    "m01_log_level": B.sql(f"SELECT {cols('entity:s bin motion_sum_log motion_mean_log')} FROM lg", *GRID, *FX.logs()),
    "m02_reference_ratios": B.sql(
        f"SELECT {cols('entity:s bin t_steps t_lying')}, round(r_t_steps, 6) + 0.0 AS ratio_steps, round(r_t_lying, 6) + 0.0 AS ratio_lying FROM rr", *MASK,
        ("tot", f"SELECT *, {B.rolling_total('steps_sum', 4)} AS t_steps, {B.rolling_total('lying_sum', 4)} AS t_lying FROM mk"),
        *B.reference_ratios("tot", "rr", ["t_steps", "t_lying"], 6, "entity", ("t_lying",))),
    "m04_row_mean_min_max": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, round(list_avg(list_filter([steps_mean, motion_mean, lying_mean], lambda x: x IS NOT NULL)), 6) AS mean, "
                                  "round(least(steps_mean, motion_mean, lying_mean), 6) AS low, round(greatest(steps_mean, motion_mean, lying_mean), 6) AS high FROM grid", *GRID),
    "m05_weighted_score_active_families": B.sql(f"SELECT {cols('entity:s bin behavioral_warning_score behavioral_warning_families:i behavioral_warning_notification:i')} FROM hyp", *SPLIT, *D.hypo(active=("steps", "posture"), nfam=2)),
    "m10_stable_seed": "SELECT c_custkey, CAST('0x' || substr(sha256(c_name || '|schedule|42'), 1, 8) AS BIGINT) AS seed FROM customer",
    "m12_reason_sentences": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, printf('Alerte %s: score HYPO=%.2f, score INSTABILITÉ=%.2f. Vérification terrain requise.', hybrid_warning_type, behavioral_warning_score, instability_warning_score) AS reason FROM fus WHERE hybrid_warning_start = 1", *BRANCH),
    "m13_feature_labels": "SELECT event_type, count(*) AS n, event_type || '_sum_rrz' AS \"column\", event_type || '_sum_rrz - écart robuste glissant' AS label, event_type || '_sum_rrz (rrz)' AS short_label FROM events GROUP BY event_type",
    "m15_guidance_lookup": B.sql("SELECT alert_level AS level, alert_level, count(*) AS n, CASE alert_level WHEN 'suspect' THEN 'Watch.' WHEN 'critique' THEN 'Call now.' END AS summary, "
    "CASE alert_level WHEN 'suspect' THEN 'guide_a' WHEN 'critique' THEN 'b' END AS refs, CAST(CASE alert_level WHEN 'suspect' THEN 1 WHEN 'critique' THEN 2 END AS INTEGER) AS n_actions, "
    "CASE alert_level WHEN 'suspect' THEN 'Watch. Action: Observe gait.' WHEN 'critique' THEN 'Call now. Action: Isolate.' WHEN 'normal' THEN 'Pas d''indice significatif; poursuivre la surveillance de routine. Action: Continuer le suivi quotidien et l''hygiène des sols/litière.' "
    "ELSE 'Niveau non documente. Action: Vérifier le dossier clinique et réévaluer le cas.' END AS guidance FROM rul GROUP BY ALL", *RULES),
    "p02_mandatory_columns": "SELECT v AS verdict, (SELECT count(*) FROM events) AS n FROM (VALUES ('accepted'), ('columns not found: [''t'']'), ('columns not found: [''entity'', ''t'']')) x(v)",
    "t01_interval_bins": B.sql("SELECT i AS interval, CAST(m AS INTEGER) AS minutes, count(DISTINCT (entity, time_bucket(to_minutes(m), t))) AS n_bins FROM raw CROSS JOIN (VALUES ('15T', 15), ('30T', 30), ('1H', 60), ('2H', 120), ('4H', 240)) v(i, m) GROUP BY ALL", B.RAW),
    "m12_rule_reasons": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, concat_ws(' | ', printf('Persistance IF: %d/2 anomalies', CAST(if_anom_k AS BIGINT)), printf('Taux anomalies=%.1f%%', CASE WHEN low THEN 0.0 ELSE rk END * 100), "
    "CASE WHEN f_activity + f_rest + f_transitions > 0 THEN 'Familles: ' || concat_ws(', ', CASE WHEN f_activity = 1 THEN 'activité' END, CASE WHEN f_rest = 1 THEN 'repos' END, CASE WHEN f_transitions = 1 THEN 'transitions' END) END, "
    "CASE WHEN sk > 0 AND NOT low THEN printf('MI spike persistant=%d', CAST(sk AS BIGINT)) END, CASE WHEN coherence_boiterie = 1 THEN 'Cohérence multivariée=OK' END, CASE WHEN in_cooldown = 1 THEN 'En cooldown' END, CASE WHEN alert_level = 'critique' THEN 'Niveau critique' END) AS reason FROM rul", *RULES),
    "d13_contamination_sweep": B.sql("SELECT config, CAST(sum(if_anomaly_point) AS BIGINT) AS anomalies, CAST(sum(pred_lameness_episode) AS BIGINT) AS episode_bins, CAST(sum(notif_lameness) AS BIGINT) AS notifications, "
    "round(sum(notif_lameness) / count(DISTINCT (entity, CAST(bin AS DATE))), 6) + 0.0 AS notifications_per_entity_day, "
    "CAST(rank() OVER (ORDER BY sum(notif_lameness) DESC, config) AS INTEGER) AS rank FROM rul GROUP BY config", *PRED0, *SWEPT, *FX.rules("cont", keys="entity, config")),
    "m14_level_priority": B.sql("SELECT alert_level AS level, CASE alert_level WHEN 'critique' THEN 3 WHEN 'probable' THEN 2 WHEN 'suspect' THEN 1 ELSE 0 END AS priority, count(*) AS n FROM rul GROUP BY ALL", *RULES),
    "w01_w02_differences": B.sql(f"SELECT {cols('entity:s bin ' + ' '.join(f'{c}_{x}' for c in ('steps_sum', 'lying_mean') for x in ('d1', 'd1_per_hour', 'mm7', 'vs_mm7')))} FROM dif", *GRID, *FX.differences("grid", cols=("steps_sum", "lying_mean"))),
    "w03_rolling_robust_z": B.sql(f"SELECT {cols('entity:s bin ' + ' '.join(f'{s}_sum_rrz' for s in S) + ' lying_mean_rrz')} FROM rrz", *FEAT),
    "w04_global_robust_z": B.sql(f"SELECT {cols('entity:s bin ' + ' '.join(f'{s}_sum_rz' for s in S) + ' lying_mean_rz')} FROM rz", *GRID, *FX.logs(), *FX.global_z()),
    "w05_rolling_total": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, " + ", ".join(f"round({B.rolling_total(s + '_sum', 12)}, 6) + 0.0 AS {s}_12h" for s in S) + " FROM grid", B.RAW, *B.grid(60)),
    "w07_baseline_expectation": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, round(e_steps_sum, 6) + 0.0 AS expected_steps, round(e_lying_mean, 6) + 0.0 AS expected_lying FROM rr_med", *MASK, *B.reference_ratios("mk", "rr", ["steps_sum", "lying_mean"], 6, "entity")[:1]),
    "w09_w10_densities_and_volatility": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, " + ", ".join(f"round({f}_i, 6) + 0.0 AS {f}" for f in D.FAMS) + " FROM ins_e", *SPLIT, *D.instability("spl")),
    "w11_family_presence": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, " + ", ".join(f"CAST(f_{x} AS INTEGER) AS fam_{x}, CASE WHEN low THEN 0 ELSE h_{x} END AS hit_{x}" for x in ("activity", "rest", "transitions", "other")) + ", CASE WHEN low THEN 0 ELSE CAST(nfk AS INTEGER) END AS n_families_k FROM rul", *RULES),
    "w12_anomaly_and_spike_counts": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, CAST(if_anom_k AS INTEGER) AS if_anom_k, round(CASE WHEN low THEN 0 ELSE rk END, 6) + 0.0 AS anom_rate_k, CAST(spike AS INTEGER) AS mi_spike, CAST(CASE WHEN low THEN 0 ELSE sk END AS INTEGER) AS mi_spike_k FROM rul", *RULES),
    "w15_cusum": B.sql(  # the recursion itself, one bin after the other
        "SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, round(s, 6) + 0.0 AS cusum FROM walk", *GRID,
        ("walk", "SELECT entity, bin, pos, greatest(0.0, steps_sum / 100 - 0.35) AS s FROM grid WHERE pos = 0 UNION ALL "
                 "SELECT g.entity, g.bin, g.pos, greatest(0.0, w.s + g.steps_sum / 100 - 0.35) FROM walk w JOIN grid g ON g.entity = w.entity AND g.pos = w.pos + 1")).replace("walk AS MATERIALIZED", "walk AS"),
    "w16_cooldown": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, start, fired FROM cd", *GRID,
                          ("cs", f"SELECT *, CAST(steps_sum > 30 AND NOT coalesce(lag(steps_sum > 30) {P}, false) AS INTEGER) AS start FROM grid"), *B.cooldown("cs", "cd", "start", "fired", 6, "entity")),
    "w17_prior_event": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, CAST(EXISTS (SELECT 1 FROM grid o WHERE o.entity = g.entity AND o.steps_sum > 100 AND g.pos - o.pos BETWEEN 6 AND 18) AS INTEGER) AS prior, "
                             "CAST(EXISTS (SELECT 1 FROM grid o WHERE o.entity = g.entity AND o.steps_sum > 100 AND g.pos - o.pos BETWEEN 1 AND 3) AS INTEGER) AS just_before FROM grid g", *GRID),
    "w18_percent_rank": B.sql("SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, round(CASE WHEN x IS NOT NULL THEN 100.0 * (rank() OVER (PARTITION BY entity ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY entity, x) - 1) / 2.0) / count(x) OVER (PARTITION BY entity) END, 6) AS pct "
                              "FROM (SELECT entity, bin, round(steps_mean, 0) AS x FROM grid)", *GRID),
    "w19_score_quantile": B.sql("SELECT entity, round(CASE WHEN count(*) > 10 AND count(lying_mean) > 5 THEN quantile_cont(lying_mean, 0.05) END, 6) AS q05 FROM grid GROUP BY entity", *GRID),
    "w20_segments": B.sql("SELECT entity, strftime(min(bin), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(bin), '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n_bins FROM "
                          "(SELECT entity, bin, pos - row_number() OVER (PARTITION BY entity ORDER BY bin) AS isle FROM hyp WHERE behavioral_warning_episode = 1) GROUP BY entity, isle", *SPLIT, *D.hypo()),
    "w24_display_smoothing": B.sql(f"SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, round(avg(steps_sum) OVER (PARTITION BY entity ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) + 0.0 AS centred, round({B.rolling_total('steps_sum', 48, least=12)}, 6) + 0.0 AS total_48 FROM grid", B.RAW, *B.grid(60)),
    "w25_first_row_per_group": B.sql("SELECT entity, strftime(t, '%Y-%m-%d %H:%M:%S') AS t, seq, round(steps, 6) AS steps FROM raw QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seq) = 1", B.RAW),
    "w26_dedup_keep_first_last": "SELECT o_custkey, o_orderstatus, o_orderkey, round(o_totalprice, 6) AS o_totalprice, 'first' AS kept FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1 UNION ALL "
                                 "SELECT o_custkey, o_orderstatus, o_orderkey, round(o_totalprice, 6), 'last' FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1",
    "d01_interval_features": B.sql(
        "SELECT entity, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, round(coverage_pct, 7) AS coverage_pct, CAST(isodow(bin) - 1 AS INTEGER) AS dow, CAST(hour(bin) AS INTEGER) AS hour, "
        + ", ".join(f"round({c}_{x}, 7) + 0.0 AS {c}_{x}" for c in B.FEATURES for x in ("rz", "rrz", "d1_per_hour", "mm7", "vs_mm7")) + " FROM dif",
        *FEAT, *FX.global_z("rrz"), *FX.differences("rz")),
    "d02_hypo_branch": B.sql(f"SELECT {cols(HYPO_COLS)} FROM hyp", *SPLIT, *D.hypo()),
    "d03_instability_branch": B.sql(f"SELECT {cols(INST_COLS)} FROM ins", *SPLIT, *D.instability("spl")),
    "d04_fusion_hierarchical": fused("HIERARCHICAL"),
    "d04_fusion_hypo_only": fused("HYPO_ONLY"),
    "d04_fusion_instability_only": fused("INSTABILITY_ONLY"),
    "d04_fusion_or": fused("OR"),
    "d04_fusion_sequential": fused("SEQUENTIAL", smin=24.0, smax=72.0),
    "d05_comparator_rules": B.sql(f"SELECT {cols(RULE_COLS)}, {CONF} FROM rul", *RULES),
    "d07_rules_on_existing_predictions": B.sql(f"SELECT {cols(RULE_COLS)}, {CONF} FROM rul", *SCORED, *FX.rules(mixed=False)),
    "d06_herd_summary": B.sql(SUMMARY, *PRED),
    "d09_channel_ablation": B.sql(
        " UNION ALL ".join(f"SELECT entity, '{f}' AS family, CAST(sum(behavioral_warning_notification) AS BIGINT) AS notifications, CAST(sum(behavioral_warning_episode) AS BIGINT) AS episode_bins FROM a_{f} GROUP BY entity" for f in D.WEIGHTS),
        *SPLIT, *[c for f in D.WEIGHTS for c in D.hypo("spl", f"a_{f}", active=(f,), nfam=1)]),
}
