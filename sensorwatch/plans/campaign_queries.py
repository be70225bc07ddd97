"""Registered queries: adjustments, evaluation, campaigns, sweeps and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorwatch.config import HypoConfig, RulesConfig
from sensorwatch.functions import series as S
from sensorwatch.operators import adjust as A
from sensorwatch.operators import campaign as C
from sensorwatch.operators import evaluate as E
from sensorwatch.operators import fusion as FU
from sensorwatch.operators import hypo as H
from sensorwatch.operators import lanes as LN
from sensorwatch.operators import report as RP
from sensorwatch.operators import rules as R
from sensorwatch.operators import sweep as SW
from sensorwatch.plans import tables as T
from sensorwatch.plans.output import tidy
from sensorwatch.plans.registry import query, shared
from sensorwatch.sources import sinks as SK
from sensorwatch.sources.readings import stored
from sensorwatch.sources.tables import event_readings, table

EV = ["entity", "event_id", "scenario", "expected", "start", "end"]
METRICS = ["detected_any_overlap", "novel_start_count", "episode_overlap", "detected_iou20", "best_iou", "episode_overlap_raw",
           "detected_iou20_raw", "best_iou_raw", "attributable_interval_count", "onset_delay_hours", "score_max"]


@query("z01_envelopes_and_dose")
def _(spark, d):
    plan = A.fractional_plan(T.spans(spark, d), A.STRESS, T.INTERVAL, (0.5,))
    rows = A.apply_plan(T.clean_run(spark, d), plan, T.INTERVAL).where("inside = 1")
    return tidy(rows, "entity", "scenario", "pos", "kept", *[f"env_{f}" for f in A.FAMILIES])


@query("z02_z03_adjusted_series")
def _(spark, d):
    return tidy(T.gradual_adjusted(spark, d), "entity", "event_id", "bin", *[f"{s}_sum" for s in ("steps", "motion", "lying", "standing", "transitions")])


@query("z02_oscillating_phases")
def _(spark, d):
    plan = A.slotted_plan(T.spans(spark, d), A.HYBRID, T.INTERVAL)
    rows = A.apply_plan(T.clean_run(spark, d), plan, T.INTERVAL).where("inside = 1")
    return tidy(rows, "entity", "scenario", "pos", "phase", "env_motion", "env_then", *[f"{s}_sum" for s in ("steps", "motion", "lying", "standing", "transitions")])


@query("z02_floor_at_target")
def _(spark, d):
    return tidy(A.floor_at(T.gradual_adjusted(spark, d), "lying_sum", 60.0).where("inside = 1"), "entity", "event_id", "bin", "lying_sum")


@query("z05_contiguous_dropout")
def _(spark, d):
    plan = A.fractional_plan(T.spans(spark, d), A.STRESS, T.INTERVAL, (0.5,)).where("hole > 0")
    rows = A.apply_plan(T.clean_run(spark, d), plan, T.INTERVAL)
    return tidy(rows.where("kept = 0"), "entity", "event_id", "bin", "n_raw_samples", "steps_sum")


@query("z06_rotated_schedule")
def _(spark, d):
    return tidy(T.gradual_plan(spark, d), "entity", "event_id", "scenario", "rotation", "start_pos", "n", "start", "end")


@query("z06_fractional_placement")
def _(spark, d):
    return tidy(A.fractional_plan(T.spans(spark, d), A.STRESS, T.INTERVAL), "entity", "event_id", "scenario", "fraction", "start_pos", "n", "start", "end")


@query("j21_slide_to_nearest_signal")
def _(spark, d):
    grid = T.interval_table(spark, d).withColumns({f"{s}_sum": F.when(F.col("pos") % 20 < 12, F.lit(0.0)).otherwise(F.col(f"{s}_sum")) for s in ("steps", "motion", "lying", "standing", "transitions")})
    plan = A.slotted_plan(T.spans(spark, d), A.HYBRID, T.INTERVAL)
    return tidy(A.slide_to_signal(plan, grid, T.INTERVAL), "entity", "scenario", "n", "start_pos", "start")


@query("z07_role_planning")
def _(spark, d):
    s = RP.entity_summary(T.predictions(spark, d)).join(C.injectability(event_readings(spark, d)), "entity")
    return C.pick_roles(s)


@query("z08_overwritten_scores")
def _(spark, d):
    plan = T.gradual_plan(spark, d).where("scenario = 'gradual_marked'")
    p = T.predictions(spark, d).select("entity", "bin", "pos", "steps_sum_rrz", "motion_sum_rrz", "if_anomaly_point")
    rows = p.join(plan.select("entity", "start_pos", "n"), "entity").withColumn("inside", F.col("pos").between(F.col("start_pos"), F.col("start_pos") + F.col("n") - 1).cast("int"))
    return tidy(A.overwrite_scores(rows), "entity", "bin", "inside", "steps_sum_rrz", "motion_sum_rrz", "if_anomaly_point")


@query("a32_realised_changes")
def _(spark, d):
    return tidy(A.realised_changes(T.gradual_adjusted(spark, d)), digits=8)


@query("d10_attributable_evaluation")
def _(spark, d):
    return tidy(T.gradual_events(spark, d), *EV, *METRICS)


@query("d12_campaign_with_background")
def _(spark, d):
    return tidy(T.gradual_events(spark, d), "entity", "scenario", "detected_any_overlap", "monitored_days", "hypo_background_notifs", "instability_background_notifs", "hybrid_background_notifs")


@shared("stress_events")
def stress_events(spark, d):
    """Equal-dose scenarios at three placements, drop branch."""
    plan = A.fractional_plan(T.spans(spark, d), A.STRESS, T.INTERVAL)
    carry = [*T.EVENT_COLS[2:], "fraction"]
    rows = T.adjusted_series(spark, d, plan, len(A.STRESS) * len(A.PLACEMENTS), carry)
    return T.with_background(spark, d, T.drop_events(rows, carry=carry))


@query("d12_stress_campaign")
def _(spark, d):
    return tidy(stress_events(spark, d), *EV, "fraction", *METRICS)


@shared("hybrid_adjusted")
def hybrid_adjusted(spark, d):
    return T.adjusted_series(spark, d, A.slotted_plan(T.spans(spark, d), A.HYBRID, T.INTERVAL), len(A.HYBRID), T.EVENT_COLS[2:])


@shared("hybrid_events")
def hybrid_events(spark, d):
    """Twelve scenarios per entity, all three alert streams evaluated against the untouched run."""
    rows = hybrid_adjusted(spark, d)
    size = rows.count()
    rows = S.spread(rows.select(*T.series_columns(), *T.REFS), size)
    pred = FU.hybrid_warning(rows, T.INTERVAL, keys=A.EVENT, notify=False, only=[c for own in T.ALERTS.values() for c in own])
    streams = {f"{short}_": (f"{long}_episode", f"{long}_start", f"{long}_score", f"ref_{short}_episode", f"ref_{short}_start") for long, short in T.ALERT_FLAGS.items()}
    return T.with_background(spark, d, E.attributable_streams(S.spread(pred, size, A.EVENT), T.INTERVAL, streams, carry=T.EVENT_COLS[2:]))


@query("d12_hybrid_campaign")
def _(spark, d):
    cols = [f"{s}_{m}" for s in ("hypo", "instability", "hybrid") for m in ("detected_any_overlap", "episode_overlap", "best_iou", "onset_delay_hours")]
    return tidy(hybrid_events(spark, d), "entity", "scenario", "branch", "expected", *cols)


@query("a11_a12_hybrid_summary_by_branch")
def _(spark, d):
    return tidy(C.branch_metrics(hybrid_events(spark, d)))


@query("a11_hybrid_summary_by_scenario")
def _(spark, d):
    return tidy(hybrid_events(spark, d).groupBy("scenario", "branch").agg(
        F.count(F.lit(1)).alias("n_events"), C.mean_if("hybrid_detected_any_overlap").alias("detected"),
        C.mean_if("hybrid_episode_overlap").alias("coverage"), F.percentile("hybrid_onset_delay_hours", F.lit(0.5)).alias("delay_median")))


@query("a05_detection_summary")
def _(spark, d):
    return tidy(C.detection_summary(C.keep_first_events(T.gradual_events(spark, d), ["event_id"])))


@query("a06_background_rate")
def _(spark, d):
    return tidy(C.background_rate(T.gradual_events(spark, d)))


@query("a07_leak_rate")
def _(spark, d):
    return tidy(C.leak_rate(T.gradual_events(spark, d)))


@query("a10_stress_summaries")
def _(spark, d):
    return tidy(stress_events(spark, d).groupBy("scenario", "expected").agg(
        F.countDistinct("entity").alias("n_cows"), F.countDistinct("fraction").alias("n_placements"), F.countDistinct("event_id").alias("n_events"),
        C.mean_if("episode_overlap").alias("attributable_coverage"), C.mean_if("detected_any_overlap").alias("novel_start_rate"),
        C.mean_if("detected_iou20").alias("iou20_rate"), C.mean_if("best_iou").alias("best_iou_mean")))


@query("a24_event_f1")
def _(spark, d):
    ev = T.gradual_events(spark, d)
    frames = [C.confusion(ev, F.col("expected") == 1, F.col(c) >= 1).withColumn("measure", F.lit(c)) for c in ("episode_overlap", "novel_start_count", "detected_iou20")]
    return tidy(SK.union_ragged(frames))


@query("a25_failure_modes")
def _(spark, d):
    return tidy(C.failure_modes(T.gradual_events(spark, d), hybrid_events(spark, d)))


@query("a31_protocol_checks")
def _(spark, d):
    ev = T.gradual_events(spark, d).join(A.realised_changes(T.gradual_adjusted(spark, d)).select("entity", "event_id", "informative_source_window"), ["entity", "event_id"])
    ev = ev.withColumns({"seed": F.lit(42), "event_after_heldout": F.col("start") >= F.col("heldout_start")})
    return C.protocol_checks(ev, list(A.GRADUAL))


@query("a36_snapshot")
def _(spark, d):
    ev = T.gradual_events(spark, d).join(A.realised_changes(T.gradual_adjusted(spark, d)).select("entity", "event_id", "realized_steps_change", "realized_motion_change"), ["entity", "event_id"])
    return tidy(ev.groupBy("scenario", "expected").agg(F.count(F.lit(1)).alias("n"), C.mean_if("episode_overlap").alias("coverage"),
                                                     F.avg("realized_steps_change").alias("steps_change"), F.avg("realized_motion_change").alias("motion_change")))


@query("a38_window_peaks")
def _(spark, d):
    from sensorwatch.operators.intervals import rows_in_windows

    win = T.gradual_plan(spark, d).select("entity", "event_id", "start", "end")
    p = T.predictions(spark, d).select("entity", "bin", "steps_sum_rrz", "lying_sum_rrz", "if_anom_k", "n_families", "notif_lameness")
    rows = rows_in_windows(p, win, "bin")
    return tidy(rows.groupBy("entity", "event_id").agg(
        F.count(F.lit(1)).alias("n_win_bins"), F.min("steps_sum_rrz").alias("steps_min"), F.max("lying_sum_rrz").alias("lying_max"),
        F.max("if_anom_k").alias("if_anom_k_max"), F.max("n_families").alias("n_families_max"), F.sum("notif_lameness").alias("notif")))


@query("k03_review_sample")
def _(spark, d):
    return tidy(C.review_sample(T.gradual_events(spark, d)), "entity", "event_id", "scenario", "start", "detected_any_overlap", "best_iou", "manual_status")


@query("w22_window_overlap_checks")
def _(spark, d):
    plan = A.slotted_plan(T.spans(spark, d), A.HYBRID, T.INTERVAL)
    return tidy(C.overlaps_previous(plan), "entity", "event_id", "start", "end")


@query("d11_raw_overlap_with_explanations")
def _(spark, d):
    win = T.gradual_plan(spark, d).select("entity", "event_id", "scenario", "expected", "start", "end")
    rows = T.predictions(spark, d).join(win, "entity")
    return tidy(E.explained_matches(rows, T.INTERVAL, 2, 2, 0.24, carry=("scenario", "expected")))


LANE_ROWS = 200_000  # rows times settings of a task


def config_events(spark, d, configs):
    """Every setting of the drop branch evaluated on the campaign, each against its own untouched run."""
    names, grid, rows = list(configs), T.interval_table(spark, d), T.gradual_adjusted(spark, d)
    most = max(1, LANE_ROWS // len(names))
    grid = S.spread(grid, grid.count(), most=most)
    clean = stored(LN.drop_lanes(grid, T.INTERVAL, configs, notify=True).select("entity", "bin", "dataset_split", "episodes", "starts", "notifications"), "clean_lanes")
    size = rows.count()
    rows = S.spread(rows.select(*T.series_columns(carry=("scenario", "expected"))), size, most=most)
    adjusted = LN.drop_lanes(rows, T.INTERVAL, configs, A.EVENT)
    ev = LN.evaluated(adjusted, LN.reference_lanes(clean, T.INTERVAL), T.INTERVAL, names, carry=("scenario", "expected"), size=size)
    base = LN.notified(clean, names, where=F.col("dataset_split") == "futur").withColumnRenamed("notifications", "hypo_background_notifs")
    return ev.join(base, ["entity", "config"], "left").join(T.spans(spark, d).select("entity", "monitored_days"), "entity", "left")


@shared("ofat_events")
def ofat_events(spark, d):
    """Twenty-one settings x four scenarios per entity."""
    configs = SW.ofat_configs()
    SW.assert_one_factor(configs)
    return config_events(spark, d, {name: c for name, (_, _, c) in configs.items()})


def _params():
    return {n: p for n, (p, _, _) in SW.ofat_configs().items()}


@query("d13_a13_ofat_summary_with_deltas")
def _(spark, d):
    s = C.config_summary(ofat_events(spark, d))
    metrics = [c for c in s.columns if c.startswith(("progressive", "control")) and "delay" not in c]
    return tidy(C.with_reference_deltas(s, metrics))


@query("a13_ofat_by_scenario")
def _(spark, d):
    return tidy(ofat_events(spark, d).groupBy("config", "scenario").agg(
        F.countDistinct("entity").alias("n_cows"), F.count(F.lit(1)).alias("n_events"), C.mean_if("detected_any_overlap").alias("new_start_rate"),
        C.mean_if("episode_overlap").alias("attributable_coverage_rate"), C.mean_if("best_iou").alias("best_iou_mean")))


@query("a14_largest_effect_per_parameter")
def _(spark, d):
    s = C.config_summary(ofat_events(spark, d))
    metrics = ["progressive_new_start_rate", "progressive_attributable_coverage_rate", "control_new_start_rate"]
    names = F.create_map(*[F.lit(x) for kv in _params().items() for x in kv])
    deltas = C.with_reference_deltas(s, metrics).withColumn("parameter", names[F.col("config")])
    return tidy(C.largest_effects(deltas.where("config <> 'reference'"), metrics))


@query("j19_same_event_schedule")
def _(spark, d):
    ev = ofat_events(spark, d)
    sig = lambda c: ev.where(F.col("config") == c).select("entity", "event_id", "scenario")
    diff = SK.same_rows(sig("reference"), sig("min_families__2"))
    return diff.groupBy().agg(F.count(F.lit(1)).alias("n_differences"))


@query("j19_unequal_schedules")
def _(spark, d):
    """Two schedules that differ: days with clicks and days with views of each user, repeats counted."""
    ev = table(spark, d, "events")
    days = lambda kind: ev.where(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("day"))
    return SK.same_rows(days("click"), days("view")).groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("user_id").alias("users"))


@query("a26_detection_background_curve")
def _(spark, d):
    configs = {f"{x:.2f}": HypoConfig(score_threshold=x) for x in (0.04, 0.06, 0.08, 0.10, 0.12, 0.14, 0.16, 0.18, 0.20)}
    ev = config_events(spark, d, configs)
    return tidy(C.curve_row(ev))


@shared("fusion_events")
def fusion_events(spark, d):
    """Fusion variants and instability variants, all streams evaluated against the untouched run of the same setting."""
    runs = SW.fusion_runs()
    names, streams = list(runs), {f"{s}_": tuple(f"{s}_{x}" for x in LN.LANES) for s in ("instability", "hybrid")}
    lanes = [c for s in streams.values() for c in s]
    grid, rows = T.interval_table(spark, d), hybrid_adjusted(spark, d)
    most = max(1, LANE_ROWS // len(names))
    clean = stored(LN.fusion_lanes(S.spread(grid, grid.count(), most=most), T.INTERVAL, runs, notify=True).select("entity", "bin", "dataset_split", *lanes, "hybrid_notifications"), "clean_lanes")
    carry = ["scenario", "branch", "expected"]
    size = rows.count()
    rows = S.spread(rows.select(*T.series_columns(carry=carry)), size, most=most)
    adjusted = LN.fusion_lanes(rows, T.INTERVAL, runs, keys=A.EVENT).select(*A.EVENT, *carry, "bin", "start", "end", *lanes)
    ref = None
    for p, own in streams.items():
        one = LN.reference_lanes(clean, T.INTERVAL, own[:2]).withColumnsRenamed({c: f"{p}{c}" for c in ("ref_episodes", "near_starts")})
        ref = one if ref is None else ref.join(one, ["entity", "bin"])
    frames = LN.evaluated(adjusted, ref, T.INTERVAL, names, carry=carry, lanes=streams, size=size)
    base = LN.notified(clean, names, "hybrid_notifications", where=F.col("dataset_split") == "futur").withColumnRenamed("notifications", "hybrid_background_notifs")
    return frames.join(base, ["entity", "config"], "left").join(T.spans(spark, d).select("entity", "monitored_days"), "entity", "left")


@query("d13_fusion_sensitivity")
def _(spark, d):
    """Detection, background and utility of every fusion and instability variant, and whether it covers the full scope."""
    m = C.branch_metrics(fusion_events(spark, d), ["config"])
    full = (F.col("actionable_detection") >= 0.60) & (F.col("instability_surveillance_detection") >= 0.50) & (F.col("actionable_iou20") >= 0.20)
    return tidy(m.withColumn("eligible_full_scope", F.coalesce(full.cast("int"), F.lit(0))))


@query("d13_match_tolerance_sweep")
def _(spark, d):
    rows = T.gradual_adjusted(spark, d)
    rows = S.spread(rows.select(*T.series_columns(carry=("scenario",)), "ref_hypo_episode", "ref_hypo_start"), rows.count())
    pred = H.hypo_branch(rows, T.INTERVAL, keys=A.EVENT)
    frames = []
    for h in (1.0, 4.0, 8.0, 24.0):
        ev = E.attributable(pred, T.INTERVAL, "behavioral_warning_episode", "behavioral_warning_start", "behavioral_warning_score", "ref_hypo_episode", "ref_hypo_start", carry=("scenario",), tolerance_hours=h)
        frames.append(ev.agg(F.lit(h).alias("tolerance_hours"), C.mean_if("detected_any_overlap").alias("new_start_rate"), F.sum("novel_start_count").alias("novel_starts")))
    return tidy(SK.union_ragged(frames))


@query("d13_instability_configs")
def _(spark, d):
    from sensorwatch.operators.instability import instability_branch

    frames = []
    for name, cfg in SW.INSTABILITY.items():
        run = instability_branch(T.interval_table(spark, d), T.INTERVAL, cfg)
        frames.append(run.groupBy(F.lit(name).alias("config")).agg(F.sum("instability_warning_notification").alias("notifications"), F.sum("instability_warning_episode").alias("episode_bins")))
    return SK.union_ragged(frames)


@query("a27_d14_entity_calibration")
def _(spark, d):
    p = T.branch_predictions(spark, d)
    stds = p.groupBy("entity").agg(F.stddev_samp(F.when(F.col("dataset_split") == "baseline", F.col("behavioral_warning_score"))).alias("baseline_std"))
    factors = SW.calibration_factors(stds)
    cal = SW.entity_thresholds(T.interval_table(spark, d), T.INTERVAL, factors)
    rate = cal.where("dataset_split = 'futur'").groupBy("entity").agg(F.sum("behavioral_warning_notification").alias("calibrated_notifs"))
    ref = p.where("dataset_split = 'futur'").groupBy("entity").agg(F.sum("behavioral_warning_notification").alias("reference_notifs"))
    return tidy(factors.join(ref, "entity", "left").join(rate, "entity", "left"))


@query("a08_d08_ablation_variants")
def _(spark, d):
    return tidy(variants(spark, d).groupBy("variant").agg(
        F.countDistinct("entity").alias("n_cows"), F.count(F.lit(1)).alias("n_bins"), F.sum("episode").alias("episode_bins"), F.sum("notification").alias("notifications")))


@shared("variants")
def variants(spark, d):
    """A drop branch, B score + rules, C score alone, E steps only, F rules without a score: one long table."""
    p = T.predictions(spark, d)
    keep = lambda df, v, ep, nt: df.select("entity", "bin", "dataset_split", F.lit(v).alias("variant"), F.col(ep).alias("episode"), F.col(nt).alias("notification"))
    alone = S.add_cooldown(p.withColumn("c_start", S.rising("if_anomaly_point")), "c_start", 3, "c_notif")
    steps = H.hypo_branch(T.interval_table(spark, d), T.INTERVAL, HypoConfig(active_families=("steps",), min_families=1))
    features = T.feature_table(spark, d)
    rows = features.select("dataset_split", *R.inputs(features.columns)).withColumn("if_anomaly_point", F.lit(1))
    every = R.apply_rules(S.spread(rows, features.count()), T.INTERVAL, RulesConfig())
    return SK.union_ragged([
        keep(p, "A", "behavioral_warning_episode", "behavioral_warning_notification"),
        keep(p, "B", "pred_lameness_episode", "notif_lameness"),
        keep(alone, "C", "if_anomaly_point", "c_notif"),
        keep(steps, "E", "behavioral_warning_episode", "behavioral_warning_notification"),
        keep(every, "F", "pred_lameness_episode", "notif_lameness"),
    ])


@shared("variant_rates")
def variant_rates(spark, d):
    v = variants(spark, d).where("dataset_split = 'futur'")
    return v.groupBy("entity", "variant").agg(F.avg("episode").alias("episode_rate"), F.sum("notification").alias("notifs"))


@query("a09_variant_pivot")
def _(spark, d):
    return tidy(variant_rates(spark, d).groupBy("entity").pivot("variant", ["A", "B", "C", "E", "F"]).agg(F.first("episode_rate")).fillna(0.0))


@query("a23_ablation_mean_std")
def _(spark, d):
    return tidy(variant_rates(spark, d).groupBy("variant").agg(*[c.alias(f"{m}_{k}") for m in ("episode_rate", "notifs") for k, c in (("mean", F.avg(m)), ("std", F.stddev_samp(m)))]))


@query("j15_variant_pairs")
def _(spark, d):
    r = variant_rates(spark, d)
    b = r.select("entity", F.col("variant").alias("variant2"), F.col("episode_rate").alias("rate2"))
    pairs = r.join(b, "entity").where("variant < variant2")
    return tidy(pairs.groupBy("variant", "variant2").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("episode_rate") - F.col("rate2")).alias("mean_difference")))


@query("j16_paired_counts")
def _(spark, d):
    return C.paired_counts(variant_rates(spark, d), "variant", "A", "B", ["entity"], ["episode_rate", "notifs"])


@query("j06_before_after")
def _(spark, d):
    """Before/after audit of planned windows: rules re-applied on overwritten predictions."""
    p = T.predictions(spark, d).drop("hybrid_warning_sequence_start")
    before = RP.entity_summary(p)
    plan = T.gradual_plan(spark, d).where("scenario = 'gradual_marked'").select("entity", "start_pos", "n")
    rows = T.robust_distance_score(T.feature_table(spark, d)).join(plan, "entity").withColumn("inside", F.col("pos").between(F.col("start_pos"), F.col("start_pos") + F.col("n") - 1).cast("int"))
    after = RP.entity_summary(R.apply_rules(A.overwrite_scores(rows), T.INTERVAL))
    cols = ["problem_points", "lameness_notifs", "if_anomaly_points"]
    joined = before.select("entity", *[F.col(c).alias(f"before_{c}") for c in cols]).join(after.select("entity", *[F.col(c).alias(f"after_{c}") for c in cols]), "entity")
    return joined.withColumns({f"delta_{c}": F.col(f"after_{c}") - F.col(f"before_{c}") for c in cols})


@query("k01_herd_ranking")
def _(spark, d):
    return tidy(RP.rank_entities(RP.entity_summary(T.branch_predictions(spark, d))), "rank", "entity", "n_bins", "hybrid_warning_notifs", "behavioral_warning_notifs", "instability_warning_notifs", "coverage_mean")


@query("k02_top_entities_and_alerts")
def _(spark, d):
    r = RP.rank_entities(RP.entity_summary(T.branch_predictions(spark, d))).where("rank <= 9")
    alerts = T.branch_predictions(spark, d).where("hybrid_warning_start = 1").orderBy(F.desc("bin"), "entity").limit(50)
    top = r.select(F.lit("entity").alias("kind"), "entity", F.lit(None).cast("timestamp").alias("bin"), "rank")
    return tidy(top.unionByName(alerts.select(F.lit("alert").alias("kind"), "entity", "bin", F.lit(0).alias("rank"))))


@query("k05_alert_export")
def _(spark, d):
    return tidy(RP.with_reasons(T.branch_predictions(spark, d)), "entity", "bin", "hybrid_warning_type", "hybrid_warning_priority", "reason")


@query("a02_m07_entity_days")
def _(spark, d):
    return tidy(RP.entity_days(T.predictions(spark, d)))


@query("a03_herd_days")
def _(spark, d):
    return tidy(RP.herd_days(RP.entity_days(T.predictions(spark, d))))


@query("a04_severity_matrix")
def _(spark, d):
    return tidy(RP.severity_rows(RP.entity_days(T.predictions(spark, d))))


@query("a19_detected_episodes")
def _(spark, d):
    p = S.add_islands(T.predictions(spark, d), "pred_problem_episode", "island").where("island is not null")
    return tidy(p.groupBy("entity", "island").agg(F.min("bin").alias("start"), F.max("bin").alias("end"), F.count(F.lit(1)).alias("n_bins"),
                                                   F.max("anom_rate_k").alias("rate_max"), F.max("n_families").alias("families_max"), F.avg("lame_confidence").alias("confidence_mean")))


@query("a20_entity_days_count")
def _(spark, d):
    e = event_readings(spark, d)
    return e.agg(F.greatest(F.lit(1), F.countDistinct("entity", F.to_date("t"))).alias("entity_days"))


@query("a21_injectability")
def _(spark, d):
    return tidy(C.injectability(event_readings(spark, d)))


@query("a39_admissibility")
def _(spark, d):
    s = T.spans(spark, d)
    return tidy(s.select("entity", "span_days", F.col("eligible").cast("int").alias("admissible"), (F.col("span_days") >= 14).cast("int").alias("long_enough")))
