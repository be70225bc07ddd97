"""Report tables over predictions: summaries, filters, labels, sentences, guidance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorwatch.functions.scalars import attach
from sensorwatch.operators.stats import running

# Summary metric -> summed column.
SUMMARY = {
    "if_anomaly_points": "if_anomaly_point",
    "problem_points": "pred_problem_episode",
    "lameness_points": "pred_lameness_episode",
    "problem_starts": "pred_problem_start",
    "lameness_starts": "pred_lameness_start",
    "lameness_notifs": "notif_lameness",
    "critique_points": "is_critique",
    "behavioral_warning_points": "behavioral_warning_episode",
    "behavioral_warning_notifs": "behavioral_warning_notification",
    "instability_warning_notifs": "instability_warning_notification",
    "hybrid_warning_notifs": "hybrid_warning_notification",
}
# Columns of the detection table, in order.
DETECTION_COLUMNS = (
    ["bin", "day", "dataset_split", "coverage_pct"]
    + [f"hybrid_warning_{x}" for x in ("priority", "type", "score", "episode", "start", "notification", "surveillance", "sequence_start", "fusion_mode", "scope")]
    + [f"behavioral_warning_{x}" for x in ("score", "cusum", "families", "candidate", "episode", "start", "notification", "scope")]
    + [f"instability_warning_{x}" for x in ("score", "cusum", "families", "candidate", "episode", "start", "notification")]
    + ["instability_coordinated_activity", "instability_warning_scope", "if_score", "if_score_q05", "if_score_pct", "if_anomaly_point"]
)
# Texts shown to readers.
SIGNAL_LABELS = {
    "motion": "Activité - Motion Index",
    "steps": "Activité - Pas",
    "lying": "Repos - Temps couché",
    "standing": "Repos - Temps debout",
    "transitions": "Transitions",
}
SUFFIX_LABELS = {"rrz": "écart robuste glissant", "rz": "écart robuste global", "sum": "somme", "mean": "moyenne"}
LEVELS = {"normal": 0, "suspect": 1, "probable": 2, "critique": 3}
FLOORS = {"contamination": 0.05, "persist_hours": 6, "alert_min": 2}
ACTION_LISTS = ("actions_0_2h", "actions_0_24h", "actions_24h", "actions_24_48h")


def entity_summary(pred: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """One row per entity; metrics whose column is absent are 0."""
    total = lambda c: F.sum(c).cast("long") if c in pred.columns else F.lit(0).cast("long")
    cover = {f"coverage_{k}": f("coverage_pct") if "coverage_pct" in pred.columns else F.lit(None).cast("double") for k, f in (("mean", F.avg), ("min", F.min))}
    return pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bins"),
        *[total(c).alias(m) for m, c in SUMMARY.items()],
        *[c.alias(k) for k, c in cover.items()],
    )


def rank_entities(summary: DataFrame) -> DataFrame:
    """Most notified first (entity name settles ties). The entities are ranked range by range,
    so neither all of them nor the many quiet ones meet in one task."""
    k = ["hybrid_warning_notifs", "behavioral_warning_notifs", "instability_warning_notifs"]
    order = F.struct(*[(-F.col(c)).alias(c) for c in k], "entity")
    ranked = running(summary.withColumns({"_order": order, "_one": F.lit(1).cast("long")}), "_order", ["_one"])
    return ranked.withColumn("rank", F.col("upto__one").cast("int")).drop("_order", "_one", "upto__one", "all__one")


def entity_days(pred: DataFrame) -> DataFrame:
    """Per entity and day: alert state, rate, anomalies, notifications and graded severity."""
    g = pred.groupBy("entity", F.to_date("bin").alias("day")).agg(
        F.max("hybrid_warning_episode").alias("day_alert"),
        F.avg("hybrid_warning_episode").alias("alert_rate"),
        F.sum("if_anomaly_point").alias("n_anomalies"),
        F.count(F.lit(1)).alias("n_bins"),
        F.sum("hybrid_warning_notification").alias("day_notifs"),
    )
    raw = F.when(F.col("alert_rate") == 0, F.lit(0.0)).otherwise(
        0.6 * F.col("alert_rate") + 0.4 * F.least(F.col("n_anomalies") / F.col("n_bins"), F.lit(1.0))
    )
    g = g.withColumn("severity_raw", raw)
    worst = g.agg(F.max("severity_raw").alias("_worst"))
    return attach(g, worst).withColumn(
        "severity", F.when(F.col("_worst") > 0, F.col("severity_raw") / F.col("_worst")).otherwise(F.col("severity_raw"))
    ).drop("_worst")


def herd_days(days: DataFrame) -> DataFrame:
    return days.groupBy("day").agg(
        F.count(F.lit(1)).alias("cows"), F.sum("day_alert").alias("cows_alert"), F.sum("day_notifs").alias("total_notifs")
    ).withColumn("pct_alert", F.col("cows_alert") / F.col("cows") * 100.0)


def severity_matrix(days: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Entities x the days the caller lists; ``total`` is the entity's over all its days."""
    rows = severity_rows(days).withColumn("_d", F.date_format("day", "yyyy-MM-dd"))
    return rows.groupBy("entity", "total").pivot("_d", list(labels)).agg(F.sum("severity")).fillna(0.0)


def severity_rows(days: DataFrame) -> DataFrame:
    """Severity per entity and day, whatever the days, with the entity's total to order rows by."""
    return days.groupBy("entity", "day").agg(F.sum("severity").alias("severity")).withColumn("total", F.sum("severity").over(Window.partitionBy("entity")))


def filter_detections(df: DataFrame, episode=False, notification=False, candidate=False, anomaly=False) -> DataFrame:
    asked = {
        "hybrid_warning_episode" if "hybrid_warning_episode" in df.columns else "behavioral_warning_episode": episode,
        "hybrid_warning_notification": notification,
        "behavioral_warning_candidate": candidate,
        "if_anomaly_point": anomaly,
    }
    for col, on in asked.items():
        if on and col in df.columns:
            df = df.where(F.col(col) == 1)
    return df


def detection_table(df: DataFrame) -> DataFrame:
    return df.select("entity", *[c for c in DETECTION_COLUMNS if c in df.columns]).orderBy(F.desc("bin"), "entity")


def model_features(columns: Sequence[str]) -> list[str]:
    picked = [c for c in columns if c.endswith(("_rrz", "_d1_per_hour", "_vs_mm7"))]
    return picked + [c for c in ("sin_hour", "cos_hour", "sin_dow", "cos_dow") if c in columns]


def first_rolling_z(columns: Sequence[str], key: str) -> str | None:
    return next((c for c in columns if c.endswith("_rrz") and key.lower() in c.lower()), None)


def match_config(df: DataFrame, wanted: dict) -> DataFrame:
    """Rows equal to a configuration: numbers within 1e-9 (absolute plus relative), text exactly."""
    for col, value in wanted.items():
        if isinstance(value, (int, float)):
            df = df.where(F.abs(F.col(col) - F.lit(float(value))) <= 1e-9 + 1e-9 * abs(value))
        else:
            df = df.where(F.col(col).cast("string") == str(value))
    return df


def config_floors(grid: DataFrame) -> DataFrame:
    """Raise settings to their least allowed value and drop the duplicates this makes."""
    return grid.withColumns({c: F.greatest(F.col(c), F.lit(v)) for c, v in FLOORS.items() if c in grid.columns}).distinct()


def standardise_keys(df: DataFrame, keys: Sequence[str], missing: dict | None = None) -> DataFrame:
    """Key columns comparable across versions: numbers rounded to 6 places when over 95 % are numeric, else text.

    ``missing`` fills configuration columns from run metadata. The decision is
    one aggregate row per table.
    """
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (missing or {}).items() if c in df.columns})
    num = {k: F.col(k).cast("string").try_cast("double") for k in keys}
    shares = df.agg(*[F.avg(num[k].isNotNull().cast("double")).alias(k) for k in keys]).first()
    return df.withColumns({k: F.round(num[k], 6) if (shares[k] or 0) > 0.95 else F.col(k).cast("string") for k in keys})


def reason(df: DataFrame) -> Column:
    """Why a row alerts, in one sentence; parts whose columns are absent are left out."""
    have = set(df.columns)
    on = lambda c, text: F.when(F.col(c) == 1, F.lit(text)) if c in have else None
    parts = []
    if {"if_anom_k", "K"} <= have:
        parts.append(F.when(F.col("K") > 0, F.format_string("Persistance IF: %d/%d anomalies", "if_anom_k", "K")))
    if "anom_rate_k" in have:
        parts.append(F.format_string("Taux anomalies=%.1f%%", F.col("anom_rate_k") * 100))
    fams = [on(f"fam_{f}", t) for f, t in (("activity", "activité"), ("rest", "repos"), ("transitions", "transitions"))]
    fams = [f for f in fams if f is not None]
    if fams:
        names = F.concat_ws(", ", *fams)
        parts.append(F.when(names != "", F.concat(F.lit("Familles: "), names)))
    if "mi_spike_k" in have:
        parts.append(F.when(F.col("mi_spike_k") > 0, F.format_string("MI spike persistant=%d", "mi_spike_k")))
    parts += [on("coherence_boiterie", "Cohérence multivariée=OK"), on("in_cooldown", "En cooldown"), on("is_critique", "Niveau critique")]
    text = F.concat_ws(" | ", *[p for p in parts if p is not None])
    return F.when(text == "", "Signal faible / contexte normal").otherwise(text)


def hybrid_reason() -> Column:
    return F.format_string(
        "Alerte %s: score HYPO=%.2f, score INSTABILITÉ=%.2f. Vérification terrain requise.",
        "hybrid_warning_type", F.coalesce("behavioral_warning_score", F.lit(0.0)), F.coalesce("instability_warning_score", F.lit(0.0)),
    )


def with_reasons(pred: DataFrame) -> DataFrame:
    """Alert starts, newest first, each with its sentence."""
    return pred.where("hybrid_warning_start = 1").withColumn("reason", hybrid_reason()).orderBy(F.desc("bin"), "entity")


def feature_label(col: Column) -> Column:
    """Readable name of a feature column."""
    base = reduce(lambda acc, kv: acc.when(F.contains(col, F.lit(kv[0])), kv[1]), SIGNAL_LABELS.items(), F.when(F.lit(False), "")).otherwise(col)
    logged = F.when(F.contains(col, F.lit("_log")), F.lit(" (log)")).otherwise("")
    tail = reduce(lambda acc, kv: acc.when(F.endswith(col, F.lit("_" + kv[0])), " - " + kv[1]), SUFFIX_LABELS.items(), F.when(F.lit(False), "")).otherwise("")
    return F.concat(base, logged, tail)


def compact_label(col: Column, most: int = 38) -> Column:
    text = feature_label(col)
    for old in ("Activité - ", "Repos - "):
        text = F.replace(text, F.lit(old), F.lit(""))
    text = F.replace(text, F.lit("Transitions - "), F.lit("Transitions "))
    for key, label in SUFFIX_LABELS.items():
        text = F.replace(text, F.lit(" - " + label), F.lit(f" ({key})"))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def with_labels(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({"label": feature_label(F.col(column)), "short_label": compact_label(F.col(column))})


def level_name(col: str) -> Column:
    x = F.lower(F.trim(F.col(col).cast("string")))
    return F.when(x.isin("critique", "critical"), "critique").when(x.isin("probable", "suspect"), x).otherwise("normal")


def level_priority(col: str) -> Column:
    return reduce(lambda acc, kv: acc.when(level_name(col) == kv[0], kv[1]), LEVELS.items(), F.when(F.lit(False), 0))


def guidance_levels(kb: DataFrame) -> DataFrame:
    """Knowledge-base document -> one row per level: summary, ordered actions, known references, short text.

    ``kb`` is a table with ``levels MAP<STRING, STRUCT>`` and ``sources ARRAY<STRUCT<id, name>>``.
    Sources without an id get one from their name; references to unknown sources are dropped.
    """
    slug = lambda s: F.regexp_replace(F.regexp_replace(F.lower(F.trim(s["name"])), "[^a-z0-9]+", "_"), "^_|_$", "")
    ids = F.transform("sources", lambda s: F.coalesce(s["id"], slug(s)))
    rows = kb.select(ids.alias("ids"), F.explode("levels").alias("level", "p"))
    fields = set(rows.schema["p"].dataType.names)
    lists = [F.coalesce(F.col(f"p.{a}"), F.array().cast("array<string>")) for a in ACTION_LISTS if a in fields]
    actions = F.filter(F.flatten(F.array(*lists)), lambda a: F.trim(a) != "")
    refs = F.filter(F.coalesce("p.references", F.array().cast("array<string>")), lambda r: F.array_contains("ids", r))
    out = rows.select(level_name("level").alias("level"), F.col("p.summary").alias("summary"), actions.alias("actions"), F.array_join(refs, ",").alias("refs"))
    short = F.when(F.size("actions") > 0, F.concat("summary", F.lit(" Action: "), F.get("actions", F.lit(0)))).otherwise(F.col("summary"))
    return out.withColumns({"n_actions": F.size("actions"), "guidance": short}).drop("actions")


def attach_guidance(df: DataFrame, level_col: str, kb: DataFrame) -> DataFrame:
    """Guidance of each row's level; levels the document does not know get the default text."""
    table = guidance_levels(kb)
    out = df.withColumn("level", level_name(level_col)).join(F.broadcast(table), "level", "left")  # at most four levels
    default = F.when(
        F.col("level") == "normal",
        "Pas d'indice significatif; poursuivre la surveillance de routine. Action: Continuer le suivi quotidien et l'hygiène des sols/litière.",
    ).otherwise("Niveau non documente. Action: Vérifier le dossier clinique et réévaluer le cas.")
    return out.withColumn("guidance", F.coalesce("guidance", default))
