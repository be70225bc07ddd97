"""Registered queries: joins, set operations, aggregations and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorwatch.functions import series as S
from sensorwatch.operators import campaign as C
from sensorwatch.operators import cohort as CO
from sensorwatch.operators import evaluate as E
from sensorwatch.operators import grid as G
from sensorwatch.operators import intervals as IV
from sensorwatch.operators import models as M
from sensorwatch.operators import stats as ST
from sensorwatch.plans import tables as T
from sensorwatch.plans.output import tidy
from sensorwatch.plans.registry import query
from sensorwatch.sources import readings as RD
from sensorwatch.sources import sinks as SK
from sensorwatch.sources.tables import event_readings, table


def labelled(spark, d):
    """Document length as a score for the quality label."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, d, "labels"), "doc_id")


def nation_units(spark, d):
    """One row per nation: region, mean balances by segment, and a binary label. Regions are the strata."""
    cust = table(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).agg(F.round(F.avg("c_acctbal"), 4))
    supp = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("s"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.join(cust, F.col("n_nationkey") == F.col("c_nationkey")).join(supp, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.select("r_name", "n_name", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", (F.coalesce("s", F.lit(0.0)) > 4500).cast("int").alias("label"))


@query("x01_auc_global")
def _(spark, d):
    return tidy(ST.auc(labelled(spark, d), "quality", "score"))


@query("x01_auc_by_stratum")
def _(spark, d):
    return tidy(ST.auc(labelled(spark, d), "quality", "score", ["lang"]))


@query("x02_average_precision")
def _(spark, d):
    return tidy(ST.average_precision(labelled(spark, d), "quality", "score", ["lang"]))


@query("x03_clustered_bootstrap")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").cast("long").alias("hit"), F.lit(1).cast("long").alias("one"))
    return tidy(ST.bootstrap_ci(li, "hit", "one", 10_000, 42, "l_suppkey"))


@query("x07_paired_mean_difference")
def _(spark, d):
    """Mean paired difference of two segments over the nations that have both, and its interval when nations are drawn anew."""
    u = nation_units(spark, d).select("n_name", (F.col("BUILDING") - F.col("MACHINERY")).alias("diff"), F.lit(1).cast("long").alias("one")).where("diff is not null")
    return tidy(ST.bootstrap_ci(u, "diff", "one", 10_000, 42, "n_name"))


@query("x04_isotonic_out_of_fold")
def _(spark, d):
    return tidy(M.isotonic_out_of_fold(labelled(spark, d).select("doc_id", "source", "score", "quality"), "score", "quality", "source"))


@query("x05_brier_and_ece")
def _(spark, d):
    p = labelled(spark, d).withColumn("p", F.col("score") / (F.col("score") + 1000.0))
    return tidy(ST.calibration_error(p, "quality", "p", 10, ["lang"]))


@query("x06_x07_wilcoxon_rank_biserial")
def _(spark, d):
    u = nation_units(spark, d).withColumn("diff", F.col("BUILDING") - F.col("MACHINERY"))
    return tidy(ST.wilcoxon(u, "diff", ["r_name"], ["n_name"]).drop("method"))


def customer_units(spark, d):
    """One row per customer: nation, balance above 4500, and whether the market segment is BUILDING."""
    c = table(spark, d, "customer")
    return c.select("c_nationkey", "c_custkey", F.round(F.col("c_acctbal") - 4500, 2).alias("diff"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"))


@query("x06_wilcoxon_large_groups")
def _(spark, d):
    return tidy(ST.wilcoxon(customer_units(spark, d), "diff", ["c_nationkey"], ["c_custkey"], exact_up_to=1000).drop("p_floor", "rank_biserial"))


@query("x09_permutation_auc_large_groups")
def _(spark, d):
    return tidy(ST.permutation_auc(customer_units(spark, d), "label", "diff", ["c_nationkey"], ["c_custkey"], exact_up_to=1000).drop("n_permutations"))


@query("x12_spearman_p_value")
def _(spark, d):
    r = ST.spearman(table(spark, d, "customer"), "c_custkey", "c_acctbal", ["c_nationkey"])
    return tidy(ST.student_p(r, "t", F.col("n") - 2).withColumn("reject", F.when(F.abs("rho") < 1 - 1e-9, (F.col("p_value") < 0.05).cast("int"))), "c_nationkey", "n", "rho", "reject")


@query("x08_sign_flip")
def _(spark, d):
    u = nation_units(spark, d).withColumn("diff", F.col("BUILDING") - F.col("MACHINERY"))
    return tidy(ST.sign_flip(u, "diff", ["r_name"], ["n_name"]).drop("method"))


@query("x09_permutation_auc")
def _(spark, d):
    r = ST.permutation_auc(nation_units(spark, d), "label", "BUILDING", ["r_name"], ["n_name"])
    return tidy(r.drop("method").withColumn("n_permutations", F.col("n_permutations").cast("long")))


@query("x10_max_stat_multiplicity")
def _(spark, d):
    u = nation_units(spark, d)
    segs = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    long = u.select("r_name", "n_name", "label", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.col(s).alias("score")) for s in segs])).alias("x")).select("r_name", "n_name", "label", "x.*")
    return tidy(ST.max_stat(long, "label", "score", "segment", "BUILDING", ["r_name"], ["n_name"]))


@query("x11_mann_whitney")
def _(spark, d):
    return tidy(ST.mann_whitney(labelled(spark, d), "quality", "score", ["lang"]))


@query("x12_spearman")
def _(spark, d):
    return tidy(ST.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query("x13_fisher_exact")
def _(spark, d):
    t = labelled(spark, d).groupBy("lang").agg(*[F.sum(((F.col("quality") == q) & (F.col("toxic") == x)).cast("int")).cast("int").alias(k) for k, q, x in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 0, 0))])
    return tidy(ST.fisher_exact(t, ["lang"]))


@query("x14_leave_one_positive_out")
def _(spark, d):
    return tidy(ST.leave_one_out_auc(labelled(spark, d), "quality", "score", ["lang"]))


@query("x15_holm")
def _(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg((F.avg("l_discount") / (F.max("l_linenumber") * 3)).alias("p"))
    return tidy(ST.holm(p, "p", ["l_returnflag"], "l_linenumber"))


def hourly(spark, d):
    r = event_readings(spark, d).withColumn("t", G.bin_start(F.col("t"), "1H"))
    return G.gapped_series(r, "transitions", "1H", "seq")


@query("x16_autocorrelation")
def _(spark, d):
    return tidy(ST.autocorrelation(hourly(spark, d), "transitions", 192))


@query("x16_correlation_time")
def _(spark, d):
    acf = ST.autocorrelation(T.interval_table(spark, d).withColumn("x", S.rolling_total(F.col("steps_sum"), 3, least=3)), "x", 192)
    return tidy(ST.correlation_time(acf, 192))


@query("x18_local_outlier_factor")
def _(spark, d):
    df = T.interval_table(spark, d)
    cols = [f"{s}_sum" for s in ("steps", "motion", "lying", "standing", "transitions")]
    return tidy(M.local_outliers(M.robust_scale(df, cols), [f"{c}_scaled" for c in cols], neighbours=20), "entity", "bin", "if_score", "if_anomaly_point")


@query("x17_isolation_forest")
def _(spark, d):
    df = T.interval_table(spark, d)
    cols = [f"{s}_sum" for s in ("steps", "motion", "lying", "standing", "transitions")]
    return tidy(M.isolation_scores(df, cols), "entity", "bin", "if_score", "if_anomaly_point")


@query("x19_robust_scaling")
def _(spark, d):
    return tidy(M.robust_scale(T.interval_table(spark, d), ["steps_sum", "lying_sum"]), "entity", "bin", "steps_sum_scaled", "lying_sum_scaled")


@query("x20_tolerant_table_diff")
def _(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    b = a.where("not (o_orderstatus = 'P' and o_orderpriority like '1%')").withColumns({
        "o_totalprice": F.when(F.col("o_orderpriority").startswith("2"), F.col("o_totalprice") + 10.0).otherwise(F.col("o_totalprice") + 1e-9),
        "o_orderpriority": F.when((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("3"), "X").otherwise(F.col("o_orderpriority"))})
    return ST.tolerant_diff(a, b, ["o_orderkey"], rtol=1e-7).select("o_orderkey", "column")


@query("j01_left_with_exclusions")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    out = CO.with_labels(docs, table(spark, d, "labels"), "doc_id", "quality", "score_absent")
    return out.withColumns({c: F.col(c).cast("double") for c in ("quality", "toxic")})


@query("j02_dimension_map")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return tidy(table(spark, d, "customer").join(n, "c_nationkey", "left").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance")))


@query("j03_one_to_one_reconciliation")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("items"), F.count(F.lit(1)).alias("n_items"))
    return tidy(CO.one_to_one(o, s, ["o_orderkey"]))


def _configs(spark, d, flag, scale):
    """One evaluated grid per version: configurations are (tax, discount) pairs."""
    li = table(spark, d, "lineitem").where(F.col("l_linestatus") == flag)
    li = li.where("l_discount > 0.02") if flag == "O" else li.where("l_discount < 0.09")
    g = li.groupBy("l_tax", "l_discount").agg(F.avg("l_quantity").alias("score"))
    return g.select("l_tax", "l_discount", (F.col("score") > 25.5).cast("int").alias("ok"), (F.col("score") * scale).alias("score"))


def _flags_as_double(df):
    return df.withColumns({c: F.col(c).cast("double") for c in df.columns if c.startswith(("ok_", "agree_"))})


@query("j04_d16_two_version_comparison")
def _(spark, d):
    frames = {"v4": _configs(spark, d, "O", 1.0), "v5": _configs(spark, d, "F", 1.0)}
    return tidy(_flags_as_double(C.compare_versions(frames, ["l_tax", "l_discount"], "ok", "score")))


@query("j05_d16_three_version_comparison")
def _(spark, d):
    frames = {"v4": _configs(spark, d, "O", 1.0), "v5": _configs(spark, d, "F", 1.0), "v6": _configs(spark, d, "F", 2.0).where("l_tax > 0.03")}
    return tidy(_flags_as_double(C.compare_versions(frames, ["l_tax", "l_discount"], "ok", "score")))


@query("j07_metric_assembly")
def _(spark, d):
    e = event_readings(spark, d)
    return tidy(e.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.coalesce(s, F.lit(0.0)) > 0).cast("double")).alias(f"{s}_nonzero") for s in ("steps", "motion")],
                                        *[F.stddev_samp(s).alias(f"{s}_std") for s in ("steps", "motion")], ((F.unix_timestamp(F.max("t")) - F.unix_timestamp(F.min("t"))) / 86400.0).alias("span_days")))


@query("j08_reference_lookup_last_wins")
def _(spark, d):
    e = event_readings(spark, d).select("entity", G.bin_start(F.col("t"), T.INTERVAL).alias("bin"), "seq",
                                        (F.coalesce("steps", F.lit(0.0)) > 50).cast("int").alias("ep"), (F.coalesce("motion", F.lit(0.0)) > 50).cast("int").alias("st"))
    p = T.branch_predictions(spark, d).select("entity", "bin", "behavioral_warning_episode")
    r = E.with_reference(p, e, "ep", "st")
    att = ((F.col("behavioral_warning_episode") == 1) & (F.coalesce("ref_episode", F.lit(0)) != 1)).cast("int")
    return r.groupBy("entity").agg(F.sum(att).alias("attributable"), F.sum(F.coalesce("ref_episode", F.lit(0))).alias("ref_bins"), F.sum(F.coalesce("ref_start", F.lit(0))).alias("ref_starts"))


@query("j09_readings_in_windows")
def _(spark, d):
    win = T.gradual_plan(spark, d).select("entity", "event_id", "start", "end")
    rows = IV.rows_in_windows(event_readings(spark, d), win)
    return tidy(rows.groupBy("entity", "event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("steps").alias("steps")))


@query("j10_no_neighbour_within_tolerance")
def _(spark, d):
    e = event_readings(spark, d)
    return tidy(IV.without_neighbour(e.where("lying is not null").select("entity", "t", "seq"), e.where("standing is not null").select("entity", "t"), "t", 1.0))


@query("j11_interval_overlap_best_iou")
def _(spark, d):
    p = T.branch_predictions(spark, d)
    a = E.segments(p, "behavioral_warning_episode").select("entity", "start", "end")
    b = E.segments(p, "instability_warning_episode").select("entity", F.col("start").alias("start2"), F.col("end").alias("end2"))
    pairs = IV.overlapping(a, b)
    best = pairs.groupBy("entity", "start", "end").agg(F.max(E.iou(F.col("start"), F.col("end"), F.col("start2"), F.col("end2"), 14400)).alias("best_iou"))
    return tidy(a.join(best, ["entity", "start", "end"], "left").withColumn("best_iou", F.coalesce("best_iou", F.lit(0.0))))


@query("m11_overlap_seconds_and_iou")
def _(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a0, a1 = F.col("o_orderdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 60 DAYS")
    b0, b1 = F.col("l_shipdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 10 DAYS")
    return tidy(li.select("l_orderkey", "l_linenumber", E.overlap_seconds(a0, a1, b0, b1, 86400).alias("overlap"), E.iou(a0, a1, b0, b1, 86400).alias("iou")))


@query("j12_semi_and_anti")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    kinds = {"focus": "left_semi", "dropped": "left_anti"}
    return SK.union_ragged([c.join(o, "c_custkey", how).select("c_custkey", F.lit(k).alias("kind")) for k, how in kinds.items()])


@query("j13_notifications_outside_windows")
def _(spark, d):
    p = T.branch_predictions(spark, d).where("hybrid_warning_notification = 1").select("entity", "bin")
    out = IV.rows_in_windows(p, T.gradual_plan(spark, d).select("entity", "start", "end"), "bin", how="left_anti")
    return out.groupBy("entity").agg(F.count(F.lit(1)).alias("outside"), F.countDistinct(F.to_date("bin")).alias("days"))


@query("j14_config_grid")
def _(spark, d):
    """Every bin under every (coverage, level) setting; settings are exploded, not joined."""
    df = T.interval_table(spark, d).withColumn("cov", F.explode(F.array(*[F.lit(x) for x in (25.0, 50.0, 75.0)]))).withColumn("level", F.explode(F.array(*[F.lit(x) for x in (20.0, 60.0)])))
    return df.groupBy("cov", "level").agg(F.sum(((F.col("coverage_pct") >= F.col("cov")) & (F.col("steps_sum") >= F.col("level"))).cast("int")).alias("n"))


@query("j17_pareto_frontier")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 1).alias("gain"), F.round(F.avg("l_discount"), 3).alias("cost1"), F.round(F.avg("l_tax"), 3).alias("cost2"))
    return C.pareto(g, "gain", ["cost1", "cost2"])


@query("j18_a28_completed_contingency")
def _(spark, d):
    return ST.contingency(labelled(spark, d), "lang", "quality", ["en", "de", "fr", "es", "xx"]).select("lang", F.col("0").alias("n0"), F.col("1").alias("n1"))


@query("j20_attach_reason_by_event")
def _(spark, d):
    ev = T.gradual_plan(spark, d).select("event_id", "scenario")
    why = T.gradual_events(spark, d).groupBy("event_id").agg(F.max(F.when(F.col("episode_overlap") == 0, "missed").otherwise("covered")).alias("reason"))
    return ev.join(why, "event_id", "left")


@query("a15_distribution_stats")
def _(spark, d):
    return tidy(table(spark, d, "lineitem").groupBy("l_returnflag").agg(*C.distribution(None, ["l_quantity", "l_discount"])))


@query("a16_m08_m09_grid_summary_with_verdict")
def _(spark, d):
    return tidy(grid_summary(spark, d))


def grid_summary(spark, d):
    """Runs per configuration summarised overall and per scenario, with verdict and selection score.

    A run is an order line: tax and line number are the configuration, the return flag its scenario.
    """
    li = table(spark, d, "lineitem").select(F.col("l_tax").alias("mix_rate_thr"), F.col("l_linenumber").alias("persist_hours"), "l_returnflag",
                                            (F.col("l_quantity") / 50.0).alias("iou20"), (F.col("l_discount") * 2).alias("recall_any"), F.col("l_discount").alias("leak"), (F.col("l_tax") * 3).alias("false_notif"))
    sc = lambda x: F.col("l_returnflag") == x
    g = li.groupBy("mix_rate_thr", "persist_hours").agg(
        F.count(F.lit(1)).alias("n_runs"), *C.distribution(li, ["recall_any", "false_notif"]), *C.distribution(li, ["iou20"], where=sc("A"), prefix="strong_"),
        *C.distribution(li, ["recall_any"], where=sc("N"), prefix="borderline_"), *C.distribution(li, ["leak"], where=sc("R"), prefix="hidden_"))
    g = g.withColumns({"borderline_any_mean": F.col("borderline_recall_any_mean"), "hidden_leak_any_p90": F.col("hidden_leak_p90"), "hidden_leak_any_mean": F.col("hidden_leak_mean")})
    g = C.gate_verdict(g, {"strong_iou20_p10": (">=", 0.10), "borderline_any_mean": (">=", 0.10), "hidden_leak_any_p90": ("<=", 0.095), "false_notif_p90": ("<=", 0.20)})
    return g.withColumn("selection_score", C.selection_score())


@query("a17_reference_choice")
def _(spark, d):
    g = grid_summary(spark, d)
    bal = (F.col("strong_iou20_p10") >= 0.10) & (F.col("borderline_any_mean") >= 0.10) & (F.col("false_notif_p90") <= 0.20)
    safe = F.col("false_notif_p90") <= 0.30
    order = [F.col("false_notif_p90"), F.col("hidden_leak_any_p90"), -F.col("borderline_any_mean"), -F.col("strong_iou20_mean"), F.col("mix_rate_thr"), F.col("persist_hours").cast("double")]
    user = (F.abs(F.col("mix_rate_thr") - 0.08) < 1e-9) & (F.col("persist_hours") == 1)
    pick = C.choose_reference(g, user, bal, safe, order, [-F.col("mix_rate_thr"), -F.col("persist_hours").cast("double")])
    return tidy(pick, "mix_rate_thr", "persist_hours", "ref_source")


@query("a18_scenario_report")
def _(spark, d):
    ev = T.gradual_events(spark, d)
    return tidy(ev.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_events"), F.sum("expected").alias("n_expected_detected"), C.mean_if("detected_any_overlap").alias("detected_any_overlap_mean"),
                                           C.mean_if("detected_iou20").alias("detected_iou20_mean"), C.mean_if("best_iou").alias("best_iou_mean")))


@query("a22_collapsed_configs")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_tax", "l_linenumber", (F.col("l_quantity") >= 50).cast("int").alias("ok"), F.col("l_extendedprice").alias("score"),
                                            F.concat(F.lit("flag "), "l_returnflag").alias("why"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    li = li.withColumn("ok", F.when(F.col("l_linenumber") < 4, F.col("ok")).otherwise(0))
    return tidy(C.collapse_configs(li, ["l_tax", "l_linenumber"], "ok", "score", "why", "seq"))


@query("a29_value_counts_and_mode")
def _(spark, d):
    ev = table(spark, d, "events")
    counts = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(RD.modal_value(ev, "user_id", "event_type").withColumnRenamed("event_type", "modal"), "user_id")


@query("a30_component_validation")
def _(spark, d):
    conv = table(spark, d, "conversations").select("conv_id", (F.length("text") > 200).cast("int").alias("long_turn"), (F.col("role") == "user").cast("int").alias("asks"), (F.col("turn") > 1).cast("int").alias("late"))
    return CO.validate_components(conv, "conv_id", ["long_turn", "asks", "late"])


@query("a33_timing_statistics")
def _(spark, d):
    runs = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_extendedprice") / 1000).alias("seconds"), (F.col("l_linenumber") * 1000).alias("rows"))
    return tidy(CO.timing_stats(runs, ["l_linenumber"], "seconds", "rows"))


@query("a34_source_agreement")
def _(spark, d):
    li = table(spark, d, "lineitem")
    pairs = li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("whole", F.round("l_quantity", -1))
    return tidy(CO.agreement(pairs, [("price", "l_extendedprice", "p_retailprice"), ("quantity", "l_quantity", "whole")]))


@query("a35_claim_check")
def _(spark, d):
    li = table(spark, d, "lineitem")
    stats = li.agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("std"), F.percentile("l_quantity", F.lit(0.5)).alias("median"))
    values = stats.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("mean", "std", "median")])).alias("v")).select("v.*")
    claims = values.select("name", (F.floor("value") + 0.5).alias("claimed"), F.lit(0.3).alias("tolerance"))
    return tidy(CO.check_claims(values, claims))


@query("a37_d15_cohort_features")
def _(spark, d):
    raw = event_readings(spark, d)
    adm = CO.admission(raw, "2024-01-29 00:00:00", 12, coverage=1.0)
    feats = CO.window_features(T.branch_predictions(spark, d), "2024-01-29 00:00:00", 6)
    return tidy(adm.join(feats, "entity", "left"), "entity", "baseline_days", "primary_coverage", "exclusion_reason", "pre7_hybrid_notifs", "pre7_hybrid_frac_time", "pre7_hybrid_score_max",
                "pre7_instability_surveillance_frac", "pre7_hypo_notifs", "pre7_instability_notifs", "future_hybrid_notif_per_cow_day")


@query("d15_cohort_concordance")
def _(spark, d):
    """Does the week before the score time separate entities whose later readings are more irregular?"""
    feats = CO.window_features(T.branch_predictions(spark, d), "2024-01-24 00:00:00", 6)
    raw = event_readings(spark, d).where("t >= timestamp'2024-01-24 00:00:00'").groupBy("entity").agg((F.sum(F.coalesce("motion", F.lit(0.0))) > F.sum(F.coalesce("steps", F.lit(0.0)))).cast("int").alias("label"))
    j = feats.join(raw, "entity")
    names = ("pre7_hybrid_notifs", "pre7_hybrid_frac_time", "pre7_hybrid_score_max", "pre7_instability_surveillance_frac")
    long = j.select("entity", "label", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(n).cast("double"), 9).alias("score")) for n in names])).alias("x")).select("entity", "label", "x.*")
    a = ST.auc(long, "label", "score", ["metric"])
    mw = ST.mann_whitney(long, "label", "score", ["metric"]).select("metric", "u", "mean_pos", "mean_neg")
    return tidy(a.join(mw, "metric"))


@query("u01_union_ragged")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return tidy(SK.union_ragged([a, b]))


@query("u02_except_urgent")
def _(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(spark, d, "customer").select("c_custkey").exceptAll(urgent.distinct())


@query("u02_except")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").select("o_custkey").distinct())


@query("u03_intersect")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("k04_best_config_runs_events")
def _(spark, d):
    g = grid_summary(spark, d)
    best = g.orderBy(F.desc("robust_pass"), F.desc("selection_score"), "mix_rate_thr", "persist_hours").limit(1).select(F.col("mix_rate_thr").alias("l_tax"), F.col("persist_hours").alias("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_tax", "l_linenumber").join(best, ["l_tax", "l_linenumber"], "left_semi")


@query("w21_cumulative_share")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.sum("l_quantity").alias("weight"))
    return tidy(CO.cumulative_share(g, "weight", "l_linenumber", ["l_returnflag"]))


@query("w23_position_of_time")
def _(spark, d):
    grid = T.interval_table(spark, d)
    times = event_readings(spark, d).groupBy("entity").agg(F.max(F.when(F.col("steps") > 200, F.col("t"))).alias("at"))
    return CO.position_of_time(grid, times).withColumn("pos", F.col("pos").cast("double"))
