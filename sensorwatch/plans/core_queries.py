"""Registered queries: sources, normalisation, grid, scalar math, windows, detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sensorwatch.config import INTERVALS, SIGNALS, FusionConfig, HypoConfig, RulesConfig, WatchConfig, interval_minutes
from sensorwatch.functions import scalars as SC
from sensorwatch.functions import series as S
from sensorwatch.operators import baseline as BL
from sensorwatch.operators import features as FE
from sensorwatch.operators import fusion as FU
from sensorwatch.operators import grid as G
from sensorwatch.operators import hypo as H
from sensorwatch.operators import instability as I
from sensorwatch.operators import models as M
from sensorwatch.operators import report as RP
from sensorwatch.operators import rules as R
from sensorwatch.operators import sweep as SW
from sensorwatch.pipeline import run_herd
from sensorwatch.plans import tables as T
from sensorwatch.plans.output import tidy
from sensorwatch.plans.registry import query
from sensorwatch.sources import readings as RD
from sensorwatch.sources import sinks as SK
from sensorwatch.sources.tables import event_readings, table


def hms(minutes):
    """Minutes as ``H:MM:SS`` text (whole seconds)."""
    s = F.floor(minutes * 60).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def messy_export(spark, d):
    """The event log as an exporter would hand it over: odd names, text times, durations as H:MM:SS."""
    r = event_readings(spark, d)
    return r.select(
        F.concat("entity", F.lit(".0")).alias("Cow ID"),
        F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("seq").cast("string").alias("seq"),
        (F.col("steps") - 20.0).cast("string").alias("Step Count"),
        F.coalesce(F.col("motion").cast("string"), F.lit("n/a")).alias("MI"),
        hms(F.col("lying")).alias("Lying Time"),
        F.col("standing").cast("string").alias("Standing (s)"),
        F.nullif("transitions", F.lit(0.0)).cast("string").alias("Up"),
        F.lit("1").alias("Down"),
    )


NORMAL = ("entity", "t", "seq", "steps", "motion", "lying", "standing", "transitions")


def _normalised(df):
    df = df.withColumns({"entity": RD.clean_id(F.col("entity")), "seq": F.col("seq").cast("long")})
    return tidy(df, *NORMAL)


@query("src01_csv_scan_normalise")
def _(spark, d):
    path = RD.scratch(spark, "export")
    SK.write_csv(messy_export(spark, d), path)
    return _normalised(RD.load_readings(spark, path))


@query("src02_semicolon_dimension")
def _(spark, d):
    path = RD.scratch(spark, "dimension")
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation.select("n_nationkey", "n_name", "r_name").write.option("header", True).option("sep", ";").csv(path)
    return RD.read_delimited(spark, path, ";").select(F.col("n_nationkey").cast("int"), "n_name", "r_name")


@query("src03_label_sheet")
def _(spark, d):
    path = RD.scratch(spark, "labels")
    SK.write_csv(table(spark, d, "labels"), path)
    sheet = RD.read_delimited(spark, path)
    typed = sheet.select(RD.clean_id(F.col("doc_id")).alias("entity"), *[F.col(c).try_cast("int").alias(c) for c in ("quality", "toxic")])
    valid = typed.where(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1))
    return RD.keep_first(valid.withColumn("_o", F.col("entity")), ["entity"], "_o").drop("_o")


@query("src04_uploaded_table_first")
def _(spark, d):
    path = RD.scratch(spark, "upload") + ".parquet"
    messy_export(spark, d).write.parquet(path)
    return _normalised(RD.load_readings(spark, "unused.csv", uploaded=path))


@query("src05_json_documents")
def _(spark, d):
    path = RD.scratch(spark, "protocols")
    per = event_readings(spark, d).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("steps", F.lit(0.0))).alias("steps"))
    doc = F.struct("entity", F.struct(F.col("n"), F.round("steps", 2).alias("steps")).alias("meta"),
                   F.array(F.struct(F.lit("a").alias("id"), F.lit(0.18).alias("at")), F.struct(F.lit("b").alias("id"), F.lit(0.82).alias("at"))).alias("placements"))
    per.select(F.to_json(doc).alias("value")).write.text(path)
    docs = RD.read_documents(spark, path, one_per_line=True)
    return tidy(docs.select("entity", F.col("meta.n").alias("n"), F.col("meta.steps").alias("steps"), F.explode("placements").alias("p"))
                .select("entity", "n", "steps", F.col("p.id").alias("placement"), F.col("p.at").alias("fraction")))


@query("src06_input_shape")
def _(spark, d):
    raw, pred = event_readings(spark, d), T.predictions(spark, d)
    parts = [df.groupBy().agg(F.lit(RD.shape_of(df)).alias("shape"), F.count(F.lit(1)).alias("n")) for df in (raw, pred)]
    return SK.union_ragged(parts)


@query("snk01_partitioned_results")
def _(spark, d):
    path = SK.write_results(T.branch_predictions(spark, d).select("entity", "bin", "hybrid_warning_episode"), RD.scratch(spark, "results"))
    back = spark.read.parquet(path)
    return back.groupBy(F.col("entity").cast("string").alias("entity")).agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("hybrid_warning_episode").alias("episode_bins"))


@query("snk02_json_summary")
def _(spark, d):
    path = SK.write_json(RP.entity_summary(T.branch_predictions(spark, d)), RD.scratch(spark, "summary"))
    schema = "entity string, n_bins bigint, hybrid_warning_notifs bigint, coverage_mean double"
    return tidy(spark.read.schema(schema).json(path))


@query("snk03_append_partial_outputs")
def _(spark, d):
    path = RD.scratch(spark, "runs")
    p = T.branch_predictions(spark, d).select("entity", "bin", "hybrid_warning_notification")
    for run, flag in (("quiet", 0), ("firing", 1)):
        SK.append_run(p.where(F.col("hybrid_warning_notification") == flag), path, run)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("snk04_resume_by_config_hash")
def _(spark, d):
    runs = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("y")).distinct()
    planned = runs.withColumn("run_id", SK.config_hash("o_orderpriority", "o_orderstatus", "y"))
    finished = planned.where("o_orderstatus = 'F'")
    return SK.pending(planned, finished)


@query("snk05_latest_complete_run")
def _(spark, d):
    li = table(spark, d, "lineitem")
    manifest = li.select(F.col("l_tax").alias("grp"), F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("completed_at"),
                         F.col("l_returnflag").alias("artefact"))
    return tidy(SK.latest_complete(manifest, ["A", "N"], ["grp"]))


@query("snk06_fingerprint")
def _(spark, d):
    r = event_readings(spark, d)
    sealed = SK.fingerprint(r, "readings").unionByName(SK.fingerprint(r.where("steps is not null"), "steps"))
    now = SK.fingerprint(r.repartition(7, "seq"), "readings").unionByName(SK.fingerprint(r.where("motion is not null"), "steps"))
    return SK.compare_fingerprints(sealed, now).join(now.select("table", "n_rows", "n_entities"), "table")


@query("p03_parse_time")
def _(spark, d):
    ev = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t"))
    return tidy(ev.withColumn("t", F.try_to_timestamp("t")).where("t is not null"))


@query("p04_entity_id_text")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", RD.clean_id(F.concat(F.lit(" "), F.col("c_custkey").cast("double").cast("string"))).alias("entity"))


@query("p05_duration_minutes")
def _(spark, d):
    ev = table(spark, d, "events")
    sec = F.floor(F.col("value") * 60).cast("long")
    text = (F.when(F.col("event_type") == "click", hms(F.col("value")))
            .when(F.col("event_type") == "view", F.format_string("%d:%02d", F.floor(sec / 60), sec % 60))
            .when(F.col("event_type") == "error", F.lit("??:xx")).otherwise(F.col("value").cast("string")))
    return tidy(ev.select("event_id", RD.duration_minutes(text).alias("minutes")))


@query("p06_numeric_coercion")
def _(spark, d):
    p = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    bad = F.when(F.col("event_type") == "view", F.concat("k", F.lit("x"))).otherwise(F.col("k"))
    return p.select("event_id", RD.number(bad).alias("value"), F.coalesce(RD.number(bad), F.lit(0.0)).alias("value_or_zero"))


@query("p07_derived_transitions")
def _(spark, d):
    raw = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("ID"), F.col("l_shipdate").alias("Time"), "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("Transitions Up"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("Transitions Down"))
    return RD.normalise(raw).select("l_orderkey", "l_linenumber", "entity", "transitions")


@query("p08_clamp_negative")
def _(spark, d):
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("ID"), F.lit("2024-01-01 00:00:00").alias("T"), F.col("c_acctbal").alias("Steps"))
    return tidy(RD.normalise(raw), "entity", "steps")


@query("p09_signal_availability")
def _(spark, d):
    r = event_readings(spark, d).drop("standing")
    names = RD.available_signals(r)
    return tidy(r.groupBy("entity").agg(F.lit(",".join(names)).alias("signals"), *[F.sum(s).alias(s) for s in names]))


@query("p10_entity_filter")
def _(spark, d):
    return tidy(event_readings(spark, d).where(F.col("entity") == "0"), "entity", "t", "seq", "steps")


@query("p11_first_entities")
def _(spark, d):
    return tidy(RD.first_entities(event_readings(spark, d), 5).groupBy("entity").agg(F.count(F.lit(1)).alias("n")))


@query("p12_day_range")
def _(spark, d):
    return tidy(RD.between_days(event_readings(spark, d), "2024-01-10", "2024-01-12"), "entity", "t", "seq")


@query("p13_detection_filter")
def _(spark, d):
    p = RP.filter_detections(T.predictions(spark, d), episode=True, anomaly=True)
    return tidy(p, "entity", "bin", "hybrid_warning_episode", "if_anomaly_point")


@query("p14_filterable_table")
def _(spark, d):
    return tidy(RP.detection_table(T.predictions(spark, d)))


@query("p15_feature_selection")
def _(spark, d):
    f = T.feature_table(spark, d)
    cols = RP.model_features(f.columns)
    return f.groupBy("entity").agg(F.lit(len(cols)).alias("n_features"), F.lit(RP.first_rolling_z(f.columns, "motion")).alias("first_motion"))


@query("p16_coverage_gating")
def _(spark, d):
    return tidy(T.predictions(spark, d), "entity", "bin", "coverage_pct", "if_anomaly_point", "if_anom_k", "n_families", "mi_spike", "in_cooldown", "lame_confidence")


@query("p17_point_validity")
def _(spark, d):
    df = T.feature_table(spark, d)
    ok = F.coalesce(F.col("coverage_pct"), F.lit(0.0)) >= 60.0
    return tidy(df.select("entity", "bin", F.when(ok, F.col("steps_sum")).alias("score"), F.when(ok, F.lit(-1)).otherwise(1).alias("if_pred")))


@query("p18_tolerant_config_match")
def _(spark, d):
    return tidy(RP.match_config(table(spark, d, "lineitem"), {"l_discount": 0.05 + 1e-12, "l_tax": 0.02, "l_returnflag": "R"})
                .select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag"))


@query("p19_config_floors")
def _(spark, d):
    grid = table(spark, d, "lineitem").select(
        F.col("l_discount").alias("contamination"), F.col("l_linenumber").alias("persist_hours"), (F.col("l_linenumber") - 2).alias("alert_min"))
    return tidy(RP.config_floors(grid))


@query("p20_key_standardisation")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_tax").cast("string").alias("rate"), F.col("l_returnflag").alias("mode"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("persist"))
    std = RP.standardise_keys(li, ["rate", "mode"], {"persist": 7.0})
    return std.groupBy("rate", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum("persist").alias("persist"))


GRID = ["entity", "bin", "n_raw_samples"] + [f"{s}_{a}" for s in SIGNALS for a in ("sum", "mean")]


@query("t02_regular_grid")
def _(spark, d):
    return tidy(G.regular_grid(event_readings(spark, d), T.INTERVAL), *GRID)


@query("t02_regular_grid_15min")
def _(spark, d):
    return tidy(G.regular_grid(event_readings(spark, d), "15T"), "entity", "bin", "n_raw_samples", "steps_sum", "motion_mean")


@query("t04_coverage")
def _(spark, d):
    return tidy(T.interval_table(spark, d), "entity", "bin", "n_raw_samples", "expected_raw_per_bin", "coverage_pct")


@query("t05_no_signal_fallback")
def _(spark, d):
    r = event_readings(spark, d).select("entity", "t")
    return tidy(G.add_calendar(G.add_coverage(G.regular_grid(r, T.INTERVAL))), "entity", "bin", "coverage_pct", "day")


@query("t06_gapped_series")
def _(spark, d):
    r = event_readings(spark, d).withColumn("t", G.bin_start(F.col("t"), "1H"))
    return tidy(G.gapped_series(r, "transitions", "1H", "seq"))


@query("t07_sampling_cadence")
def _(spark, d):
    return tidy(G.sampling_cadence(event_readings(spark, d)))


@query("t08_calendar")
def _(spark, d):
    return tidy(G.add_calendar(G.regular_grid(event_readings(spark, d), T.INTERVAL)), "entity", "bin", "dow", "hour", "sin_hour", "cos_hour", "sin_dow", "cos_dow", "day")


@query("t09_slot_of_day")
def _(spark, d):
    g = G.regular_grid(event_readings(spark, d), "30T")
    return g.groupBy(G.slot_of_day().alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("t12_chronological_split")
def _(spark, d):
    return tidy(T.interval_table(spark, d), "entity", "bin", "train_candidate", "dataset_split")


@query("t12_split_without_ratio")
def _(spark, d):
    g = G.add_coverage(G.regular_grid(event_readings(spark, d), T.INTERVAL))
    return tidy(BL.add_split(g, ratio=None, coverage_min_pct=100.0), "entity", "bin", "dataset_split")


@query("t13_split_fallback")
def _(spark, d):
    g = T.interval_table(spark, d).withColumn("dataset_split", F.lit("all"))
    g = BL.add_reference_masks(g, only_if_missing=False)
    return g.groupBy("entity").agg(F.sum(F.col("_base").cast("int")).alias("n_base"), F.sum(F.col("_future").cast("int")).alias("n_future"))


@query("t14_heldout_start")
def _(spark, d):
    return tidy(BL.heldout_start(T.interval_table(spark, d)))


@query("t15_t16_spans_and_eligibility")
def _(spark, d):
    return tidy(T.spans(spark, d), "entity", "n_bins", "heldout_start", "span_days", "monitored_days", "future_steps", "future_motion", "future_transitions", "eligible")


@query("m01_log_level")
def _(spark, d):
    return tidy(FE.add_log_levels(G.regular_grid(event_readings(spark, d), T.INTERVAL)), "entity", "bin", "motion_sum_log", "motion_mean_log")


@query("m02_reference_ratios")
def _(spark, d):
    g = BL.add_reference_masks(T.interval_table(spark, d), only_if_missing=False)
    g = g.withColumns({f"t_{s}": S.rolling_total(F.col(f"{s}_sum"), 4) for s in ("steps", "lying")})
    g = BL.add_reference_ratios(g, ["t_steps", "t_lying"], 6, high=["t_lying"])
    return tidy(g, "entity", "bin", "t_steps", "t_lying", "_ratio_t_steps", "_ratio_t_lying").withColumnsRenamed(
        {"_ratio_t_steps": "ratio_steps", "_ratio_t_lying": "ratio_lying"})


@query("m04_row_mean_min_max")
def _(spark, d):
    r = T.interval_table(spark, d)
    cols = [F.col(f"{s}_mean") for s in ("steps", "motion", "lying")]
    return tidy(r.select("entity", "bin", SC.row_mean(*cols).alias("mean"), F.least(*cols).alias("low"), F.greatest(*cols).alias("high")))


@query("m05_weighted_score_active_families")
def _(spark, d):
    cfg = HypoConfig(active_families=("steps", "posture"), min_families=2)
    return tidy(H.hypo_branch(T.interval_table(spark, d), T.INTERVAL, cfg), "entity", "bin", "behavioral_warning_score", "behavioral_warning_families", "behavioral_warning_notification")


@query("m10_stable_seed")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", SC.stable_seed(F.concat_ws("|", "c_name", F.lit("schedule"), F.lit("42"))).alias("seed"))


@query("m12_reason_sentences")
def _(spark, d):
    return RP.with_reasons(T.branch_predictions(spark, d)).select("entity", F.date_format("bin", "yyyy-MM-dd HH:mm:ss").alias("bin"), "reason")


@query("m12_rule_reasons")
def _(spark, d):
    p = T.predictions(spark, d)
    return p.select("entity", F.date_format("bin", "yyyy-MM-dd HH:mm:ss").alias("bin"), RP.reason(p).alias("reason"))


@query("d13_contamination_sweep")
def _(spark, d):
    df = T.feature_table(spark, d).withColumn("_raw", T.raw_distance())
    return tidy(SW.contamination_summary(SW.contamination_sweep(df, "_raw", T.INTERVAL)))


@query("p02_mandatory_columns")
def _(spark, d):
    """Readings with their mandatory columns pass; without one of them the table is refused by name."""
    r = event_readings(spark, d)

    def verdict(df):
        try:
            return RD.require_columns(df, "entity", "t").select(F.lit("accepted").alias("verdict"))
        except ValueError as error:
            return df.select(F.lit(str(error).split(";")[0]).alias("verdict"))

    cases = [verdict(r), verdict(r.drop("t")), verdict(r.drop("entity", "t"))]
    return reduce(lambda a, b: a.union(b), cases).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("t01_interval_bins")
def _(spark, d):
    """Bins that hold readings at every accepted interval."""
    r = event_readings(spark, d)
    bins_ = [r.select(F.lit(i).alias("interval"), F.lit(interval_minutes(i)).alias("minutes"), "entity", G.bin_start(F.col("t"), i).alias("bin")) for i in INTERVALS]
    return reduce(lambda a, b: a.union(b), bins_).groupBy("interval", "minutes").agg(F.count_distinct("entity", "bin").alias("n_bins"))


@query("m13_feature_labels")
def _(spark, d):
    ev = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return RP.with_labels(ev.withColumn("column", F.concat(F.col("event_type"), F.lit("_sum_rrz"))), "column")


@query("m14_level_priority")
def _(spark, d):
    p = T.predictions(spark, d)
    return p.select(F.upper(F.concat(F.lit(" "), "alert_level")).alias("level")).groupBy(RP.level_name("level").alias("level"), RP.level_priority("level").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("m15_guidance_lookup")
def _(spark, d):
    path = RD.scratch(spark, "guidance")
    kb = """{"levels": {"suspect": {"summary": "Watch.", "actions_0_24h": ["Observe gait.", " "], "references": ["guide_a", "gone"]},
      "critique": {"summary": "Call now.", "actions_0_2h": ["Isolate."], "actions_24_48h": ["Trim."], "references": ["b"]}},
      "sources": [{"name": "Guide A"}, {"id": "b", "name": "B"}]}"""
    spark.range(1).select(F.lit(kb).alias("value")).write.text(path)
    level = "struct<summary:string,actions_0_2h:array<string>,actions_0_24h:array<string>,actions_24_48h:array<string>,references:array<string>>"
    doc = spark.read.schema(f"levels map<string,{level}>, sources array<struct<id:string,name:string>>").option("multiLine", True).json(path)
    counts = T.predictions(spark, d).groupBy("alert_level").agg(F.count(F.lit(1)).alias("n"))
    return RP.attach_guidance(counts, "alert_level", doc)


@query("w01_w02_differences")
def _(spark, d):
    g = G.regular_grid(event_readings(spark, d), T.INTERVAL)
    g = FE.add_differences(g, ["steps_sum", "lying_mean"], T.INTERVAL)
    return tidy(g, "entity", "bin", *[f"{c}_{x}" for c in ("steps_sum", "lying_mean") for x in ("d1", "d1_per_hour", "mm7", "vs_mm7")])


@query("w03_rolling_robust_z")
def _(spark, d):
    return tidy(T.feature_table(spark, d), "entity", "bin", *[f"{s}_sum_rrz" for s in SIGNALS], "lying_mean_rrz")


@query("w04_global_robust_z")
def _(spark, d):
    return tidy(T.feature_table(spark, d), "entity", "bin", *[f"{s}_sum_rz" for s in SIGNALS], "lying_mean_rz")


@query("w05_rolling_total")
def _(spark, d):
    g = G.regular_grid(event_readings(spark, d), "1H")
    return tidy(g.select("entity", "bin", *[S.rolling_total(F.col(f"{s}_sum"), 12).alias(f"{s}_12h") for s in SIGNALS]))


@query("w07_baseline_expectation")
def _(spark, d):
    g = BL.add_reference_masks(T.interval_table(spark, d), only_if_missing=False)
    return tidy(BL.add_expected(g, ["steps_sum", "lying_mean"]), "entity", "bin", "_exp_steps_sum", "_exp_lying_mean").withColumnsRenamed(
        {"_exp_steps_sum": "expected_steps", "_exp_lying_mean": "expected_lying"})


@query("w09_w10_densities_and_volatility")
def _(spark, d):
    g = I.add_densities(T.interval_table(spark, d), 4)
    names = list(I.FAMILY_WEIGHTS)
    return tidy(g.withColumnsRenamed({f"_i_{x}": x for x in names}), "entity", "bin", *names)


@query("w11_family_presence")
def _(spark, d):
    return tidy(T.predictions(spark, d), "entity", "bin", *[f"fam_{x}" for x in R.FAMILIES], *[f"hit_{x}" for x in R.FAMILIES], "n_families_k")


@query("w12_anomaly_and_spike_counts")
def _(spark, d):
    return tidy(T.predictions(spark, d), "entity", "bin", "if_anom_k", "anom_rate_k", "mi_spike", "mi_spike_k")


@query("w15_cusum")
def _(spark, d):
    g = T.interval_table(spark, d).withColumn("e", F.col("steps_sum") / 100.0)
    return tidy(S.add_cusum(g, "e", 0.35, "cusum"), "entity", "bin", "cusum")


@query("w16_cooldown")
def _(spark, d):
    g = T.interval_table(spark, d).withColumn("on", (F.col("steps_sum") > 30).cast("int"))
    g = g.withColumn("start", S.rising("on"))
    return tidy(S.add_cooldown(g, "start", 6, "fired"), "entity", "bin", "start", "fired")


@query("w17_prior_event")
def _(spark, d):
    g = T.interval_table(spark, d).withColumn("on", (F.col("steps_sum") > 100).cast("int"))
    g = S.add_prior_event(g, "on", 6, 18, "prior")
    return tidy(S.add_prior_event(g, "on", 0, 3, "just_before"), "entity", "bin", "prior", "just_before")


@query("w18_percent_rank")
def _(spark, d):
    g = T.interval_table(spark, d).withColumn("x", F.round(F.col("steps_mean"), 0))
    return tidy(R.add_percent_rank(g, "x", "pct"), "entity", "bin", "pct")


@query("w19_score_quantile")
def _(spark, d):
    g = T.interval_table(spark, d).withColumn("q05", R.score_quantile("lying_mean"))
    return tidy(g.groupBy("entity").agg(F.min("q05").alias("q05")))


@query("w20_segments")
def _(spark, d):
    from sensorwatch.operators.evaluate import segments

    return tidy(segments(T.branch_predictions(spark, d), "behavioral_warning_episode"), "entity", "start", "end", "n_bins")


@query("w24_display_smoothing")
def _(spark, d):
    g = G.regular_grid(event_readings(spark, d), "1H")
    w = S.ordered().rowsBetween(-3, 3)
    return tidy(g.select("entity", "bin", F.avg("steps_sum").over(w).alias("centred"), S.rolling_total(F.col("steps_sum"), 48, least=12).alias("total_48")))


@query("w25_first_row_per_group")
def _(spark, d):
    return tidy(RD.keep_first(event_readings(spark, d).select("entity", "t", "seq", "steps"), ["entity"], "seq"))


@query("w26_dedup_keep_first_last")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    a = RD.keep_first(o, ["o_custkey", "o_orderstatus"], "o_orderkey").withColumn("kept", F.lit("first"))
    return tidy(a.unionByName(RD.keep_last(o, ["o_custkey", "o_orderstatus"], "o_orderkey").withColumn("kept", F.lit("last"))))


@query("d01_interval_features")
def _(spark, d):
    return tidy(T.feature_table(spark, d), "entity", "bin", "coverage_pct", "dow", "hour",
                *[f"{c}_{x}" for c in FE.base_columns(T.feature_table(spark, d)) for x in ("rz", "rrz", "d1_per_hour", "mm7", "vs_mm7")], digits=7)


HYPO_COLS = (["entity", "bin", "coverage_pct", "dataset_split"] + [f"warning_ratio_{s}" for s in SIGNALS]
             + [f"warning_change_{f}" for f in ("steps", "motion", "transitions", "posture")]
             + [f"behavioral_warning_{x}" for x in ("families", "candidate", "cusum", "episode", "start", "notification", "score")])
INST_COLS = (["entity", "bin"] + [f"instability_ratio_{x}" for x in (*I.MOVEMENTS, *I.FAMILY_WEIGHTS)] + [f"instability_change_{x}" for x in I.FAMILY_WEIGHTS]
             + ["instability_coordinated_activity"] + [f"instability_warning_{x}" for x in ("families", "candidate", "cusum", "episode", "start", "notification", "score")])
FUSE_COLS = ["entity", "bin"] + [f"hybrid_warning_{x}" for x in ("score", "episode", "surveillance", "sequence_start", "start", "notification", "type", "priority")]
RULE_COLS = ["entity", "bin", "if_anom_k", "n_families", "flag_coherent_episode", "coherence_boiterie", "pred_problem_episode", "pred_problem_start",
             "pred_lameness_episode", "pred_lameness_start", "notif_lameness", "in_cooldown", "alert_level", "lame_confidence"]


@query("d02_hypo_branch")
def hypo_query(spark, d):
    return tidy(H.hypo_branch(T.interval_table.uncached(spark, d), T.INTERVAL), *HYPO_COLS)


@query("d03_instability_branch")
def _(spark, d):
    return tidy(I.instability_branch(T.interval_table.uncached(spark, d), T.INTERVAL), *INST_COLS)


def _fusion(mode, **cfg):
    def run(spark, d):
        return tidy(FU.fuse(T.branch_predictions(spark, d).drop("hybrid_warning_sequence_start"), T.INTERVAL, FusionConfig(mode, **cfg)), *FUSE_COLS)

    return run


query("d04_fusion_hierarchical")(_fusion("HIERARCHICAL"))
query("d04_fusion_hypo_only")(_fusion("HYPO_ONLY"))
query("d04_fusion_instability_only")(_fusion("INSTABILITY_ONLY"))
query("d04_fusion_or")(_fusion("OR"))
query("d04_fusion_sequential")(_fusion("SEQUENTIAL", sequence_min_hours=24.0, sequence_max_hours=72.0))


@query("d05_comparator_rules")
def _(spark, d):
    return tidy(T.predictions(spark, d), *RULE_COLS)


@query("d07_rules_on_existing_predictions")
def _(spark, d):
    df = R.apply_rules(T.robust_distance_score(T.feature_table(spark, d)), T.INTERVAL, RulesConfig(mix_mode="IF-ONLY"))
    return tidy(df, *RULE_COLS)


@query("d06_herd_summary")
def _(spark, d):
    return tidy(RP.entity_summary(T.predictions(spark, d)))


@query("d06_pipeline_with_forest")
def _(spark, d):
    """The whole run as published, forest of 800 trees included: features, split, forest, rules, branches, fusion, summary."""
    summary, _ = run_herd(event_readings(spark, d), WatchConfig(interval=T.INTERVAL))
    return tidy(summary)


@query("d08_local_outliers_with_rules")
def _(spark, d):
    cols = [c for c in T.feature_table(spark, d).columns if c.endswith("_sum_rrz")]
    lof = M.local_outliers(M.robust_scale(T.feature_table(spark, d), cols), [f"{c}_scaled" for c in cols])
    out = R.apply_rules(lof, T.INTERVAL)
    return tidy(out.groupBy("entity").agg(F.sum("if_anomaly_point").alias("anomalies"), F.sum("pred_lameness_episode").alias("episode_bins"), F.sum("notif_lameness").alias("notifications")))


@query("d09_channel_ablation")
def _(spark, d):
    run = SW.channel_ablation(T.interval_table(spark, d), T.INTERVAL)
    return run.groupBy("entity", F.col("config").alias("family")).agg(
        F.sum("behavioral_warning_notification").alias("notifications"), F.sum("behavioral_warning_episode").alias("episode_bins"))
