"""Shared intermediate tables of the registered queries (interval 4H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorwatch.config import SIGNALS, RulesConfig
from sensorwatch.functions import series as S
from sensorwatch.operators import adjust as A
from sensorwatch.operators import baseline as BL
from sensorwatch.operators import evaluate as E
from sensorwatch.operators import features as FE
from sensorwatch.operators import fusion as FU
from sensorwatch.operators import grid as G
from sensorwatch.operators import hypo as H
from sensorwatch.operators import rules as R
from sensorwatch.plans.registry import shared
from sensorwatch.sources.tables import event_readings

INTERVAL = "4H"
ALERT_FLAGS = {"behavioral_warning": "hypo", "instability_warning": "instability", "hybrid_warning": "hybrid"}


@shared("interval")
def interval_table(spark, d):
    """Grid, coverage and split: all the two branches need."""
    return BL.add_split(G.add_coverage(G.regular_grid(event_readings(spark, d), INTERVAL)))


@shared("features")
def feature_table(spark, d):
    return BL.add_split(FE.interval_features(event_readings(spark, d), INTERVAL))


def raw_distance():
    """Mean capped rolling z of the sums, negative; NULL for badly covered bins."""
    z = sum((F.least(F.abs(f"{s}_sum_rrz"), F.lit(6.0)) for s in ("motion", "lying", "standing", "transitions")),
            F.least(F.abs("steps_sum_rrz"), F.lit(6.0)))
    return F.when(F.col("coverage_pct") >= 25.0, 0.0 - z / 5.0)


def robust_distance_score(df, keys=S.ENTITY):
    """A deterministic outlier score from rolling z values, thresholded like the forest's.

    Stands in for the forest where a query is checked against SQL.
    """
    df = df.withColumn("_raw", raw_distance())
    cut = F.percentile(F.when(F.col("dataset_split") == "baseline", F.col("_raw")), F.lit(0.06)).over(S.whole(keys))
    return df.withColumn("if_score", F.col("_raw") - cut).withColumn(
        "if_anomaly_point", F.coalesce((F.col("if_score") < 0).cast("int"), F.lit(0))
    ).drop("_raw")


@shared("predictions")
def predictions(spark, d):
    """Rules, both branches and fusion for every entity."""
    df, cfg = feature_table(spark, d), RulesConfig()
    needed = [*R.inputs(df.columns, cfg), *H.BRANCH_INPUTS, *[f"{s}_sum_rrz" for s in SIGNALS]]
    return S.beside(S.spread(df, df.count()), needed, lambda own: FU.hybrid_warning(R.apply_rules(robust_distance_score(own), INTERVAL, cfg), INTERVAL))


@shared("branch_predictions")
def branch_predictions(spark, d):
    """Both branches and fusion on the interval table (no comparator)."""
    df = interval_table(spark, d)
    return FU.hybrid_warning(S.spread(df, df.count()), INTERVAL)


@shared("spans")
def spans(spark, d):
    return A.entity_spans(interval_table(spark, d), INTERVAL)


KEEP = ["entity", "bin", "pos", "n_raw_samples"] + [f"{s}_sum" for s in ("steps", "motion", "lying", "standing", "transitions")]
EVENT_COLS = ["entity", "event_id", "scenario", "branch", "expected", "n", "start_pos", "start", "end", "heldout_start"]


def clean_run(spark, d):
    """Untouched predictions reduced to what an adjusted run is compared with."""
    p = branch_predictions(spark, d)
    refs = {f"ref_{short}_{x}": F.col(f"{long}_{x}") for long, short in ALERT_FLAGS.items() for x in ("episode", "start")}
    return p.withColumns(refs).select(*KEEP, *refs)


REFS = [f"ref_{short}_{x}" for short in ALERT_FLAGS.values() for x in ("episode", "start")]


def adjusted_series(spark, d, plan, most, carry=None):
    """Every series once per event planned for it, ``most`` an entity; dealt to tasks before it is repeated.

    With ``carry``, only what branches and evaluation read, the untouched run's flags and these columns of the plan.
    """
    clean, size = clean_run(spark, d), interval_table(spark, d).count() * most
    plan = S.spread(A.with_areas(plan, clean), size).hint("merge")  # sent around, it would leave the tasks to packed bytes
    df = A.apply_plan(S.spread(clean, size), plan, INTERVAL)
    if carry is not None:
        df = df.select(*[c for c in df.columns if c in {*A.EVENT, *KEEP, "start", "end", *carry, *REFS}])
    return BL.coverage_and_split(df.drop("expected_raw_per_bin", "coverage_pct", "pos"), A.EVENT)


@shared("gradual_plan")
def gradual_plan(spark, d):
    return A.rotated_plan(spans(spark, d), A.GRADUAL, INTERVAL)


@shared("gradual_adjusted")
def gradual_adjusted(spark, d):
    return adjusted_series(spark, d, gradual_plan(spark, d), len(A.GRADUAL))


def with_background(spark, d, events):
    """Notifications of the untouched run after the reference period, per entity."""
    p = branch_predictions(spark, d).where("dataset_split = 'futur'")
    base = p.groupBy("entity").agg(*[F.sum(f"{long}_notification").alias(f"{short}_background_notifs") for long, short in ALERT_FLAGS.items()])
    days = spans(spark, d).select("entity", "monitored_days")
    return events.join(days, "entity", "left").join(base, "entity", "left")


def series_columns(keys=A.EVENT, carry=EVENT_COLS[2:]):
    """What branches and evaluation read of adjusted series."""
    return list(dict.fromkeys([*keys, *H.BRANCH_INPUTS, "start", "end", *carry]))


ALERTS = {long: [f"{long}_{x}" for x in ("episode", "start", "score")] for long in ALERT_FLAGS}


def drop_events(rows, carry=EVENT_COLS[2:], keys=A.EVENT):
    """Attributable evaluation of the drop branch."""
    pred = H.hypo_branch(rows.select(*series_columns(keys, carry), "ref_hypo_episode", "ref_hypo_start"), INTERVAL, keys=keys, notify=False, only=ALERTS["behavioral_warning"])
    return E.attributable(
        pred, INTERVAL, "behavioral_warning_episode", "behavioral_warning_start", "behavioral_warning_score",
        "ref_hypo_episode", "ref_hypo_start", keys=keys, carry=carry,
    )


@shared("gradual_events")
def gradual_events(spark, d):
    """The campaign's event table: four scenarios per eligible entity, drop branch."""
    rows = gradual_adjusted(spark, d)
    return with_background(spark, d, drop_events(S.spread(rows, rows.count())))
