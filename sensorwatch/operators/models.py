"""Outlier and calibration models fitted per entity, spread over tasks by Spark."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorwatch.functions import series as S
from sensorwatch.operators.forest import Forest, raw_scores
from sensorwatch.operators.neighbours import nearest_rows
from sensorwatch.operators.stats import running

# Fixed values of the models.
SCALE_RANGE = (0.10, 0.90)
CONTAMINATION = 0.06


def robust_scale(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = S.ENTITY) -> DataFrame:
    """``<col>_scaled``: (x - median) / (p90 - p10), both taken on the entity's training rows."""
    w, train = S.whole(keys), F.col("train_point") == 1
    low, high = SCALE_RANGE
    q = {f"_q_{c}": F.percentile(F.when(train, F.coalesce(c, F.lit(0.0))), F.array(F.lit(low), F.lit(0.5), F.lit(high))).over(w) for c in cols}
    df = df.withColumns(q)
    out = {}
    for c in cols:
        width = F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]
        out[f"{c}_scaled"] = (F.coalesce(c, F.lit(0.0)) - F.col(f"_q_{c}")[1]) / F.when(width > 0, width).otherwise(F.lit(1.0))
    return df.withColumns(out).drop(*q)


def flag_scores(df: DataFrame, raw: str, contamination: float, coverage_min_pct: float, keys: Sequence[str] = S.ENTITY) -> DataFrame:
    """Score relative to the training quantile; below 0 is an anomaly; badly covered bins get no score."""
    cut = F.percentile(F.when(F.col("train_point") == 1, F.col(raw)), F.lit(contamination)).over(S.whole(keys))
    ok = F.coalesce(F.col("coverage_pct"), F.lit(0.0)) >= coverage_min_pct
    df = df.withColumn("if_score", F.when(ok, F.col(raw) - cut))
    hit = F.coalesce((F.col("if_score") < 0).cast("int"), F.lit(0))
    return df.withColumns({"if_anomaly_point": hit, "if_pred": F.when(hit == 1, -1).otherwise(1)}).drop(raw)


def isolation_scores(
    df: DataFrame, cols: Sequence[str], n_trees: int = 800, contamination: float = CONTAMINATION, max_samples: int = 256,
    feature_share: float = 0.8, seed: int = 42, coverage_min_pct: float = 25.0,
) -> DataFrame:
    """Isolation forest per entity with the columns of ``flag_scores``; an entity without training rows has no score."""
    cfg = Forest(n_trees=n_trees, max_samples=max_samples, feature_share=feature_share, seed=seed)
    return flag_scores(raw_scores(df, cols, cfg), "_raw", contamination, coverage_min_pct)


def renamed(df: DataFrame) -> DataFrame:
    """The same table under other names, so both sides of a cogroup can come from one source."""
    return df.toDF(*[f"t_{c}" for c in df.columns])


def nearest(query: DataFrame, train: DataFrame, cols: Sequence[str], k: int, rows_per_task: int, skip_self: bool) -> DataFrame:
    """The ``k`` nearest training rows of every query row within its entity.

    A task holds one entity's training rows (bounded by its grid) and one block of query rows; the
    neighbours come from a tree of balls (``neighbours``), equal distances by position, and only ``k``
    per row leave it. A missing feature counts as 0, as in ``robust_scale``.
    """
    feats = list(cols)
    known = [F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0)).alias(c) for c in feats]
    q = query.select("entity", "pos", F.floor(F.col("pos") / rows_per_task).cast("int").alias("part"), *known)
    parts = q.select("entity", "part").distinct()
    t = renamed(train.select("entity", "pos", *known).join(parts, "entity"))

    def find(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"entity": [], "pos": [], "near": [], "dist": []})
        own = a["pos"].to_numpy()
        row, near, dist = nearest_rows(a[feats].to_numpy(float), own if skip_self else None, b[[f"t_{c}" for c in feats]].to_numpy(float), b["t_pos"].to_numpy(), k)
        return pd.DataFrame({"entity": key[0], "pos": own[row], "near": near, "dist": dist})

    grouped = q.groupBy("entity", "part").cogroup(t.groupBy("t_entity", "t_part"))
    return grouped.applyInPandas(find, "entity string, pos int, near int, dist double")


def local_outliers(
    df: DataFrame, cols: Sequence[str], neighbours: int = 20, contamination: float = CONTAMINATION,
    coverage_min_pct: float = 25.0, rows_per_task: int = 16_384,
) -> DataFrame:
    """Local outlier factor against the entity's training rows (novelty form).

    Densities of training rows leave the row itself out; the score is minus the
    ratio of the neighbours' density to the row's own.
    """
    train = df.where("train_point = 1")
    inner = nearest(train, train, cols, neighbours, rows_per_task, True)
    reach = inner.groupBy("entity", "pos").agg(F.max("dist").alias("kdist"))
    lrd = _density(inner, reach)
    outer = nearest(df, train, cols, neighbours, rows_per_task, False)
    mine = _density(outer, reach)
    around = outer.join(lrd.select("entity", F.col("pos").alias("near"), F.col("lrd").alias("_nl")), ["entity", "near"])
    mean = around.groupBy("entity", "pos").agg(F.avg("_nl").alias("_around"))
    ratio = mean.join(mine, ["entity", "pos"]).select("entity", "pos", (-F.col("_around") / F.col("lrd")).alias("_raw"))
    out = df.join(ratio, ["entity", "pos"], "left")
    seen = lof_of_training(inner, lrd)
    out = out.join(seen, ["entity", "pos"], "left").withColumn("_fit", F.coalesce("_own", "_raw"))
    cut = F.percentile(F.when(F.col("train_point") == 1, F.col("_fit")), F.lit(contamination)).over(S.whole())
    ok = F.coalesce(F.col("coverage_pct"), F.lit(0.0)) >= coverage_min_pct
    out = out.withColumn("if_score", F.when(ok, F.col("_raw") - cut))
    hit = F.coalesce((F.col("if_score") < 0).cast("int"), F.lit(0))
    return out.withColumns({"if_anomaly_point": hit, "if_pred": F.when(hit == 1, -1).otherwise(1)}).drop("_raw", "_own", "_fit")


def _density(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """Local reachability density: inverse mean of max(distance, neighbour's k-distance)."""
    j = pairs.join(reach.select("entity", F.col("pos").alias("near"), "kdist"), ["entity", "near"])
    return j.groupBy("entity", "pos").agg((1.0 / (F.avg(F.greatest("dist", "kdist")) + 1e-10)).alias("lrd"))


def lof_of_training(inner: DataFrame, lrd: DataFrame) -> DataFrame:
    around = inner.join(lrd.select("entity", F.col("pos").alias("near"), F.col("lrd").alias("_nl")), ["entity", "near"])
    mean = around.groupBy("entity", "pos").agg(F.avg("_nl").alias("_around"))
    return mean.join(lrd, ["entity", "pos"]).select("entity", "pos", (-F.col("_around") / F.col("lrd")).alias("_own"))


def assign_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Whole groups to folds, dealt out from the largest group down (name settles ties)."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_o", F.struct((-F.col("_n")).alias("n"), F.col(group).cast("string").alias("g")))
    dealt = running(sizes.withColumn("_one", F.lit(1).cast("long")), "_o", ["_one"])
    return df.join(dealt.select(group, ((F.col("upto__one") - 1) % folds).cast("int").alias("fold")), group)


def isotonic_out_of_fold(df: DataFrame, score: str, label: str, group: str, folds: int = 5) -> DataFrame:
    """Calibrated probability of every row from a model that never saw its group.

    Rows are reduced to (fold, score) totals before fitting, so the fit's input
    is the number of distinct scores.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    df = assign_folds(df, group, folds)
    cells = df.groupBy("fold", score).agg(F.avg(F.col(label).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    vec = VectorAssembler(inputCols=[score], outputCol="_x")
    out = []
    for f in range(folds):
        rest = cells.where(F.col("fold") != f).groupBy(score).agg((F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).alias("_y"), F.sum("_w").alias("_w"))
        if rest.agg(F.count_distinct("_y")).first()[0] < 2:
            out.append(df.where(F.col("fold") == f).withColumn("probability", F.lit(None).cast("double")))  # nothing to learn from
            continue
        model = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="probability").fit(vec.transform(rest))
        out.append(model.transform(vec.transform(df.where(F.col("fold") == f))).drop("_x"))
    return reduce(lambda a, b: a.unionByName(b), out)

