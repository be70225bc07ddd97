"""Reports over evaluated events: detection, background, sweeps, verdicts, reference choice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorwatch.functions.scalars import attach, safe_div
from sensorwatch.operators.stats import running
from sensorwatch.sources.readings import keep_first

RATES = ("detected_any_overlap", "episode_overlap", "detected_iou20", "best_iou")
# Acceptance thresholds of a robust grid, and its selection weights.
GATES = {
    "strong_iou20_p10": (">=", 0.25),
    "borderline_any_mean": (">=", 0.20),
    "hidden_leak_any_p90": ("<=", 0.20),
    "false_notif_p90": ("<=", 0.30),
}
SELECTION = {
    "strong_iou20_mean": 0.60,
    "borderline_any_mean": 0.20,
    "recall_any_mean": 0.10,
    "hidden_leak_any_mean": -0.25,
    "false_notif_mean": -0.30,
    "false_notif_std": -0.10,
}


def mean_if(col, cond: Column | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.avg((c if cond is None else F.when(cond, c)).cast("double"))


def detection_summary(events: DataFrame, by: Sequence[str] = ("scenario",), digits: int = 3) -> DataFrame:
    g = events.groupBy(*by).agg(
        F.countDistinct("event_id").alias("n_events"),
        mean_if("detected_any_overlap").alias("new_warning_start_mean"),
        mean_if("episode_overlap").alias("warning_coverage_mean"),
        mean_if("detected_iou20").alias("detect_iou20_mean"),
        mean_if("best_iou").alias("best_iou_mean"),
    )
    return g.withColumns({c: F.bround(F.col(c), digits) for c in g.columns if c.endswith("_mean")})


def background_rate(events: DataFrame, notifs: str = "hypo_background_notifs") -> DataFrame:
    """Notifications per monitored day: mean within an entity, then mean and p90 over entities."""
    per = events.groupBy("entity").agg(F.avg(notifs).alias("n"), F.min("monitored_days").alias("d"))
    rate = F.col("n") / F.greatest(F.col("d"), F.lit(1e-9))
    return per.agg(
        F.avg(rate).alias("background_per_cow_day_mean"),
        F.percentile(rate, F.lit(0.9)).alias("background_per_cow_day_p90"),
        F.count(F.lit(1)).alias("n_cow_runs"),
    )


def leak_rate(events: DataFrame) -> DataFrame:
    no = F.col("expected") == 0
    return events.agg(
        mean_if("detected_any_overlap", no).alias("leak_any_mean"),
        F.countDistinct(F.when(no, F.col("event_id"))).alias("n_non_detectable"),
    )


def curve_row(events: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """Detection against background per configuration (background summed once per entity)."""
    grad = F.col("scenario").startswith("gradual_")
    ctrl = F.col("scenario") == "isolated_short_variation"
    per = events.groupBy(*by, "entity").agg(
        F.min("hypo_background_notifs").alias("b"),
        F.min("monitored_days").alias("d"),
        F.count(F.when(grad, 1)).alias("g"),
        *[F.sum(F.when(grad, (F.col(c) >= 1).cast("int"))).alias(f"g_{c}") for c in ("episode_overlap", "novel_start_count", "detected_iou20")],
        F.sum(F.when(grad, F.col("best_iou"))).alias("g_iou"),
        F.count(F.when(ctrl, 1)).alias("c"),
        F.sum(F.when(ctrl, (F.col("episode_overlap") >= 1).cast("int"))).alias("c_hit"),
    )
    over = lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cows"),
        F.sum("g").alias("n_gradual_events"),
        (F.sum("b") / F.nullif(F.sum("d"), F.lit(0.0))).alias("background_per_cow_day"),
        over("g_episode_overlap", "g").alias("attributable_coverage"),
        over("g_novel_start_count", "g").alias("new_start_rate"),
        over("g_detected_iou20", "g").alias("iou20_rate"),
        over("g_iou", "g").alias("mean_attributable_iou"),
        (1.0 - over("c_hit", "c")).alias("brief_control_rejection"),
    )


def config_summary(events: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """Rates of progressive and control scenarios per configuration."""
    prog, ctrl = F.col("scenario").startswith("gradual_"), F.col("scenario") == "isolated_short_variation"
    return events.groupBy(*by).agg(
        F.countDistinct("entity").alias("n_cows"),
        F.count(F.lit(1)).alias("n_events"),
        mean_if("detected_any_overlap", prog).alias("progressive_new_start_rate"),
        mean_if("episode_overlap", prog).alias("progressive_attributable_coverage_rate"),
        mean_if("detected_iou20", prog).alias("progressive_iou20_rate"),
        mean_if("best_iou", prog).alias("progressive_best_iou_mean"),
        F.percentile(F.when(prog, F.col("onset_delay_hours")), F.lit(0.5)).alias("progressive_onset_delay_median_hours"),
        mean_if("detected_any_overlap", ctrl).alias("control_new_start_rate"),
        mean_if("episode_overlap", ctrl).alias("control_attributable_coverage_rate"),
        mean_if("detected_iou20", ctrl).alias("control_iou20_rate"),
    )


def with_reference_deltas(summary: DataFrame, metrics: Sequence[str], key: str = "config", name: str = "reference") -> DataFrame:
    """Difference of every configuration to the reference row (which is one row)."""
    ref = summary.where(F.col(key) == name).select(*[F.col(m).alias(f"_{m}") for m in metrics])
    out = attach(summary, ref)
    return out.withColumns({f"delta_{m}_vs_reference": F.col(m) - F.col(f"_{m}") for m in metrics}).drop(*[f"_{m}" for m in metrics])


def largest_effects(deltas: DataFrame, metrics: Sequence[str], by: str = "parameter") -> DataFrame:
    """Largest absolute change per parameter."""
    g = deltas.groupBy(by).agg(*[F.max(F.abs(f"delta_{m}_vs_reference")).alias(f"max_abs_{m}") for m in metrics])
    return g.withColumn("max_abs_any", F.greatest(*[F.col(f"max_abs_{m}") for m in metrics]))


def distribution(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), where: Column | None = None, prefix: str = "") -> list[Column]:
    """Mean, population std, p10 and p90 columns of each metric (optionally of a subset of rows)."""
    out = []
    for m in metrics:
        x = F.col(m).cast("double") if where is None else F.when(where, F.col(m).cast("double"))
        stats = {"mean": F.avg(x), "std": F.stddev_pop(x), "p10": F.percentile(x, F.lit(0.1)), "p90": F.percentile(x, F.lit(0.9))}
        out += [c.alias(f"{prefix}{m}_{k}") for k, c in stats.items()]
    return out


def gate_verdict(df: DataFrame, gates: dict = GATES) -> DataFrame:
    """1 when every gate holds, else 0 with the failed gates spelled out."""
    ok, why = [], []
    for name, (op, level) in gates.items():
        x = F.col(name)
        good = F.coalesce(x >= level if op == ">=" else x <= level, F.lit(False))
        miss = "<" if op == ">=" else ">"
        ok.append(good)
        why.append(
            F.when(~good, F.when(x.isNull(), F.lit(f"{name} is NaN")).otherwise(F.format_string(f"{name} %.3f {miss} {level:.3f}", x)))
        )
    text = F.concat_ws(" | ", *why)
    return df.withColumns(
        {
            "robust_pass": reduce(lambda a, b: a & b, ok).cast("int"),
            "go_reason": F.when(text == "", "OK").otherwise(text),
        }
    )


def selection_score(weights: dict = SELECTION) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()])


def utility(df: DataFrame) -> DataFrame:
    """Technical utility of a fusion: detections minus heavily weighted unwanted alerts."""
    z = lambda c: F.col(c)
    return df.withColumn(
        "technical_utility",
        z("actionable_detection") + 0.15 * z("instability_surveillance_detection") + 0.25 * z("actionable_iou20")
        - 1.50 * z("benign_control_alert_rate") - 2.00 * z("confound_alert_rate")
        - 0.30 * F.least(F.lit(1.0), z("background_per_cow_day")),
    )


def branch_metrics(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Detection by target branch in one pass; background once per entity."""
    b = lambda *names: F.col("branch").isin(*names)
    per = events.groupBy(*by, "entity").agg((F.min("hybrid_background_notifs") / F.min("monitored_days")).alias("_rate"))
    back = per.groupBy(*by).agg(F.avg("_rate").alias("background_per_cow_day"), F.count(F.lit(1)).alias("n_cows"))
    act = b("HYPO", "SEQUENCE")
    main = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        mean_if("hybrid_detected_any_overlap", b("HYPO")).alias("hypo_actionable_detection"),
        mean_if("instability_detected_any_overlap", b("INSTABILITE")).alias("instability_surveillance_detection"),
        mean_if("hybrid_detected_any_overlap", b("INSTABILITE")).alias("instability_actionable_detection"),
        mean_if("hybrid_detected_any_overlap", b("SEQUENCE")).alias("sequence_actionable_detection"),
        mean_if("hybrid_detected_any_overlap", act).alias("actionable_detection"),
        mean_if("hybrid_detected_any_overlap", b("CONTROLE")).alias("benign_control_alert_rate"),
        mean_if("hybrid_detected_any_overlap", b("CONFONDANT")).alias("confound_alert_rate"),
        mean_if("hybrid_detected_iou20", act).alias("actionable_iou20"),
        F.percentile(F.when(act, F.col("hybrid_onset_delay_hours")), F.lit(0.5)).alias("actionable_delay_h_median"),
    )
    joined = main.join(back, list(by)) if by else attach(main, back)
    return utility(joined)


def choose_reference(summary: DataFrame, user: Column | None, balanced: Column, safe: Column, order: Sequence[Column], fallback: Sequence[Column]) -> DataFrame:
    """One reference configuration: the user's if balanced, else balanced, else safe, else conservative.

    Each tier keeps its own best row through a ``min_by``, so no sort of the grid is needed.
    """
    user_ok = F.coalesce(user & balanced, F.lit(False)) if user is not None else F.lit(False)
    tier = F.when(user_ok, 0).when(F.coalesce(balanced, F.lit(False)), 1).when(F.coalesce(safe, F.lit(False)), 2).otherwise(3)
    df = summary.withColumn("_tier", tier)
    rank = F.when(F.col("_tier") < 3, F.array(*order)).otherwise(F.array(*fallback))
    best = df.agg(F.min_by(F.struct(*summary.columns, "_tier"), F.struct("_tier", rank)).alias("r")).select("r.*")
    names = F.when(F.col("_tier") == 0, "user_cfg").when(F.col("_tier") == 1, "auto_balanced").when(F.col("_tier") == 2, "auto_quality_safe").otherwise("auto_conservative")
    return best.withColumn("ref_source", names).drop("_tier")


def protocol_checks(events: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """Nine named checks of an event table as rows (check, passed, detail).

    Row-level facts (repeats, overlaps) are counted per group first, so the
    table is reduced to one row before anything is compared.
    """
    need = ("event_id", "entity", "scenario", "seed", "start", "end", "heldout_start", "event_after_heldout")
    missing = [c for c in need if c not in events.columns]
    if missing:
        return events.limit(0).agg(F.lit("required_columns").alias("check"), F.lit(0).alias("passed"), F.lit(f"missing={missing}").alias("detail"))
    ids = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("dup_ids"))
    before = Window.partitionBy("entity").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    win = events.groupBy("entity", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    win = win.withColumn("late", F.max("end").over(before)).agg(
        F.sum(F.col("n") - 1).alias("dup_windows"),
        F.sum((F.coalesce(F.col("start") <= F.col("late"), F.lit(False))).cast("int") + F.col("n") - 1).alias("overlaps"),
    )
    one = events.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(1 - F.col("event_after_heldout").cast("int")).alias("early"),
        F.countDistinct("seed").alias("seeds"),
        F.array_sort(F.collect_set("scenario")).alias("scenarios"),  # at most the catalogue's names
        F.sum(1 - F.col("informative_source_window").cast("int")).alias("blind"),
    )
    row = attach(attach(one, ids), win)
    text = lambda label, c: F.concat(F.lit(f"{label}="), F.coalesce(F.col(c), F.lit(0)).cast("string"))
    some = F.col("n") > 0
    checks = [
        ("required_columns", F.lit(True), F.lit("ok")),
        ("non_empty", some, text("n_events", "n")),
        ("unique_event_ids", some & (F.col("dup_ids") == 0), text("duplicates", "dup_ids")),
        ("unique_physical_windows", some & (F.col("dup_windows") == 0), text("duplicates", "dup_windows")),
        ("non_overlapping_physical_windows", some & (F.col("overlaps") == 0), text("overlaps", "overlaps")),
        ("strictly_post_baseline", some & (F.col("early") == 0), text("violations", "early")),
        ("single_primary_seed", F.col("seeds") == 1, text("n_seeds", "seeds")),
        ("all_scenarios_present", F.col("scenarios") == F.array(*[F.lit(s) for s in sorted(scenarios)]), F.array_join("scenarios", ",")),
        ("informative_source_windows", some & (F.col("blind") == 0), text("violations", "blind")),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(ok, F.lit(False)).cast("int").alias("passed"), d.alias("detail")) for k, ok, d in checks])
    return row.select(F.explode(rows).alias("r")).select("r.*")


def assert_protocol(checks: DataFrame) -> DataFrame:
    failed = [r["check"] for r in checks.where("passed = 0").select("check").collect()]  # nine rows at most
    if failed:
        raise RuntimeError(f"campaign checks failed: {failed}")
    return checks


def overlaps_previous(events: DataFrame) -> DataFrame:
    """Windows starting before the previous one of the same entity has ended."""
    w = Window.partitionBy("entity").orderBy("start", "end")
    return events.withColumn("_prev", F.lag("end").over(w)).where(F.col("start") <= F.col("_prev")).drop("_prev")


def review_sample(events: DataFrame, per: int = 3) -> DataFrame:
    """First ``per`` events of each scenario, least detected first.

    Rows are thinned inside hash salts before the final ranking, so a scenario
    holding most events is still ranked in parallel; the result is the exact top.
    """
    order = ["detected_any_overlap", "best_iou", "entity", "event_id"]
    salted = events.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    first = Window.partitionBy("scenario", "_salt").orderBy(*order)
    thin = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per)
    final = Window.partitionBy("scenario").orderBy(*order)
    out = thin.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= per).drop("_r", "_salt")
    return out.withColumns({"manual_status": F.lit("A_REVOIR"), "manual_comment": F.lit("")})


def failure_modes(primary: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Numerator, denominator and share of each way an alert can be wrong."""
    g, brief = F.col("scenario").startswith("gradual_"), F.col("scenario") == "isolated_short_variation"
    cov = g & (F.col("episode_overlap") == 1)
    inst, non = F.col("branch") == "INSTABILITE", F.col("scenario") == "nonlocomotor_hypoactivity"
    first = {
        ("HYPO", "gradual_uncovered"): (g, F.col("episode_overlap") == 0),
        ("HYPO", "gradual_poorly_localized"): (g, (F.col("episode_overlap") == 1) & (F.col("detected_iou20") == 0)),
        ("HYPO", "covered_without_novel_start"): (cov, F.col("novel_start_count") == 0),
        ("HYPO", "brief_control_alerted"): (brief, F.col("detected_any_overlap") == 1),
    }
    second = {
        ("Fusion hiérarchique", "nonlocomotor_hypoactivity_alerted"): (non, F.col("hybrid_detected_any_overlap") == 1),
        ("INSTABILITÉ", "pure_instability_in_surveillance"): (inst, F.col("instability_detected_any_overlap") == 1),
        ("Fusion hiérarchique", "pure_instability_actionable_episode"): (inst, F.col("hybrid_episode_overlap") == 1),
    }

    def table(df: DataFrame, modes: dict) -> DataFrame:
        rows = [
            F.struct(
                F.lit(fam).alias("family"), F.lit(mode).alias("mode"),
                F.sum((base & hit).cast("int")).alias("numerator"), F.sum(base.cast("int")).alias("denominator"),
            )
            for (fam, mode), (base, hit) in modes.items()
        ]
        return df.agg(*[r.alias(f"r{i}") for i, r in enumerate(rows)]).select(
            F.explode(F.array(*[F.col(f"r{i}") for i in range(len(rows))])).alias("r")
        ).select("r.*")

    out = table(primary, first).unionByName(table(hybrid, second))
    return out.withColumn("percentage", F.round(100.0 * F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0)), 1))


def confusion(df: DataFrame, truth: Column, hit: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall and F1."""
    n = {"tp": truth & hit, "fp": ~truth & hit, "fn": truth & ~hit, "tn": ~truth & ~hit}
    g = df.groupBy(*by).agg(*[F.sum(F.coalesce(c.cast("int"), F.lit(0))).alias(k) for k, c in n.items()])
    d = lambda a, b: F.coalesce(safe_div(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0))
    g = g.withColumns({"precision": d("tp", "fp"), "recall": d("tp", "fn")})
    both = F.col("precision") + F.col("recall")
    return g.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def collapse_configs(df: DataFrame, keys: Sequence[str], ok: str, score: str, why: str, order: str) -> DataFrame:
    """One row per configuration: any pass, best score, first two distinct reasons.

    Reasons are reduced to their first appearance before being listed, so the
    list holds distinct texts only.
    """
    texts = df.where(F.col(why).isNotNull()).groupBy(*keys, why).agg(F.min(order).alias("_first"))
    ranked = texts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_first", why))).where("_r <= 2")
    two = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", why))).alias("_w"))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_variants"), F.max(F.coalesce(ok, F.lit(0))).alias(ok), F.max(score).alias(score))
    out = g.join(two, list(keys), "left")
    text = F.array_join(F.transform("_w", lambda x: x[why]), " | ")
    return out.withColumn(why, F.when(F.col(ok) == 1, "OK").otherwise(F.coalesce(text, F.lit("")))).drop("_w")


def compare_versions(frames: dict[str, DataFrame], keys: Sequence[str], ok: str, score: str) -> DataFrame:
    """Chained full outer join of versions: presence, agreement and score deltas.

    Works for two or three versions; every frame is already one row per key.
    """
    tags = list(frames)
    out = None
    for tag, df in frames.items():
        part = df.select(*keys, F.lit(1).alias(f"in_{tag}"), F.col(ok).alias(f"{ok}_{tag}"), F.col(score).alias(f"{score}_{tag}"))
        out = part if out is None else out.join(part, list(keys), "full_outer")
    out = out.withColumns({f"in_{t}": F.coalesce(f"in_{t}", F.lit(0)) for t in tags})
    both = {}
    for i, a in enumerate(tags):
        for b in tags[i + 1 :]:
            both[f"agree_{a}_{b}"] = (F.col(f"{ok}_{a}") == F.col(f"{ok}_{b}")).cast("int")
            both[f"delta_{a}_{b}"] = F.col(f"{score}_{b}") - F.col(f"{score}_{a}")
    if len(tags) > 2:
        both["agree_all"] = reduce(lambda a, b: a & b, [F.col(f"{ok}_{tags[0]}") == F.col(f"{ok}_{t}") for t in tags[1:]]).cast("int")
    else:
        a, b = tags
        both["presence"] = F.when((F.col(f"in_{a}") == 1) & (F.col(f"in_{b}") == 1), "both").when(F.col(f"in_{a}") == 1, "left_only").otherwise("right_only")
    return out.withColumns(both)


def pareto(df: DataFrame, up: str, down: Sequence[str]) -> DataFrame:
    """Rows no other row beats: higher ``up`` and lower ``down`` (two columns) preferred.

    Only distinct points are looked at, and never in pairs. The levels of the
    first cost are numbered, and every point is filed under the power-of-two
    blocks that hold its level, as many as the number of levels needs. "All levels up to mine" is then a
    handful of whole blocks, and within a block a running minimum over falling
    gain finds the best rival. A point is beaten when that rival is not itself.
    """
    a, b = down
    points = df.select(up, a, b).distinct()
    level = running(points.select(a).distinct().withColumn("_one", F.lit(1).cast("long")), a, ["_one"]).select(a, (F.col("upto__one") - 1).alias("_r"))
    depth = level.count().bit_length()
    points = points.join(level, a).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    shift = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_k"))).cast("long")
    filed = points.select(up, a, b, "_k", shift(F.col("_r")).alias("_block"), F.struct(b, (-F.col(up)).alias("g"), a).alias("_mine"))
    upto = shift(F.col("_r") + 1)
    asked = points.where(upto % 2 == 1).select(up, a, b, "_k", (upto - 1).alias("_block"))
    rows = filed.unionByName(asked.withColumn("_mine", F.lit(None).cast(filed.schema["_mine"].dataType)))
    best = F.min("_mine").over(Window.partitionBy("_k", "_block").orderBy(F.desc(up)).rangeBetween(Window.unboundedPreceding, 0))
    answers = rows.withColumn("_best", best).where("_mine is null")
    rival = answers.groupBy(up, a, b).agg(F.min("_best").alias("_best"))
    keep = rival.where(F.col("_best") == F.struct(F.col(b), (-F.col(up)).alias("g"), F.col(a))).select(up, a, b)
    return df.join(keep, [up, a, b], "left_semi")


def paired_counts(df: DataFrame, variant: str, left: str, right: str, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wins, ties and losses of ``right`` over ``left`` on their common keys."""
    l = df.where(F.col(variant) == left).select(*keys, *[F.col(m).alias(f"l_{m}") for m in metrics])  # noqa: E741
    r = df.where(F.col(variant) == right).select(*keys, *[F.col(m).alias(f"r_{m}") for m in metrics])
    counts = [F.count(F.lit(1)).alias("n_common")]
    for m in metrics:
        x, y = F.col(f"r_{m}"), F.col(f"l_{m}")
        counts += [F.sum(c.cast("int")).alias(f"{m}_right_{k}") for k, c in (("gt", x > y), ("eq", x == y), ("lt", x < y))]
    return l.join(r, list(keys)).agg(*counts)


def injectability(raw: DataFrame) -> DataFrame:
    """Per entity: how lively and how long its series is, for choosing where to adjust."""
    core, all_ = ("steps", "motion", "lying", "standing"), ("steps", "motion", "lying", "standing", "transitions")
    g = raw.groupBy("entity").agg(
        F.count(F.lit(1)).alias("series_bins"),
        ((F.unix_timestamp(F.max("t")) - F.unix_timestamp(F.min("t"))) / 86400.0).alias("span_days"),
        *[F.avg((F.coalesce(s, F.lit(0.0)) > 0).cast("double")).alias(f"nz_{s}") for s in all_],
        *[F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias(f"sd_{s}") for s in all_],
    )
    top = g.agg(F.max("series_bins").alias("_b"), F.max("span_days").alias("_s"), F.percentile("series_bins", F.lit(0.6)).alias("_p60"))
    g = attach(g, top)
    mean = lambda cols: reduce(lambda x, y: x + y, cols) / len(cols)
    alive = mean([F.col(f"nz_{s}") for s in core])
    moving = mean([(F.col(f"sd_{s}") > 0).cast("double") for s in core])
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return g.select(
        "entity", "series_bins",
        unit(0.60 * alive + 0.25 * moving + 0.15 * unit(F.col("nz_transitions"))).alias("injectability_score"),
        reduce(lambda a, b: a & b, [F.col(f"nz_{s}") >= 0.20 for s in core]).cast("int").alias("injectability_ok"),
        unit(
            0.80 * unit(F.col("series_bins") / F.greatest(F.lit(1.0), F.col("_b")))
            + 0.20 * unit(F.col("span_days") / F.greatest(F.lit(1.0), F.col("_s")))
        ).alias("series_length_score"),
        (F.col("series_bins") >= F.floor(F.greatest(F.lit(96.0), F.col("_p60")))).cast("int").alias("long_series_ok"),
    )


def pick_roles(summary: DataFrame) -> DataFrame:
    """Target and hidden entity from ordered pools (long and lively first, then long, then quiet, then any)."""
    quiet = F.col("lameness_starts") == 0
    pool = (
        F.when((F.col("long_series_ok") == 1) & (F.col("injectability_ok") == 1), 0).when(F.col("long_series_ok") == 1, 1)
        .when(quiet & (F.col("injectability_ok") == 1), 2).when(quiet, 3).otherwise(4)
    )
    order = F.struct(
        pool.alias("pool"), "lameness_starts", "lameness_notifs", (-F.col("long_series_ok")).alias("a"), (-F.col("injectability_ok")).alias("b"),
        (-F.col("series_length_score")).alias("c"), (-F.col("injectability_score")).alias("d"), (-F.col("if_anomaly_points")).alias("e"), "entity",
    )
    two = summary.withColumn("_o", order).orderBy("_o").limit(2)
    return two.withColumn("role", F.when(F.row_number().over(Window.orderBy("_o")) == 1, "target").otherwise("hidden")).select("role", "entity")


def keep_first_events(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keep_first(events, list(keys), "event_id")
