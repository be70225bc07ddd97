"""Small-sample and ranking statistics as DataFrame operations.

Scores are first reduced to their distinct values with class counts; running
totals over those values are taken range by range (see ``running``), so neither
a frequent value nor a large group ends up in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import comb, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sensorwatch.functions.scalars import attach, stable_seed
from sensorwatch.operators.exact import placed_blocks, placed_sum_chances, sign_flip_p, student_tail, subset_sum_chances
from sensorwatch.sources.readings import stored


def running(df: DataFrame, order: str, sums: Sequence[str], keys: Sequence[str] = (), desc: bool = False) -> DataFrame:
    """Add ``upto_<s>`` (running total, own row included) and ``all_<s>`` per key.

    Rows are range-partitioned on (keys, order) and kept, so their ranges are
    fixed; each range's total is added up first and the ranges only need the
    sum of those before them.
    """
    sort = F.desc(order) if desc else F.asc(order)
    placed = stored(df, "running")  # the range partitioner samples its input, which would compute it twice
    placed = fixed(placed.repartitionByRange(*[F.asc(k) for k in keys], sort).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_range",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    local = Window.partitionBy(*keys, "_range").orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"_l_{s}": F.sum(s).over(local) for s in sums}).join(offsets, [*keys, "_range"])
    out = out.withColumns({f"upto_{s}": F.col(f"_l_{s}") + F.col(f"_b_{s}") for s in sums})
    return out.drop("_range", *[f"_{x}_{s}" for x in "lb" for s in sums])


def fixed(df: DataFrame) -> DataFrame:
    """Materialise rows in the shared checkpoint folder, so a lost task cannot place them anew."""
    return stored(df, "fixed")


def by_value(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with their number of positives and negatives (missing rows left out)."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*keys, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve: chance that a positive outranks a negative, ties half. NULL for one class."""
    r = running(by_value(df, label, score, keys), score, ["pos", "neg"], keys)
    wins = F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2.0)
    g = r.groupBy(*keys).agg(F.sum(wins).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return g.withColumn("auc", F.col("_u") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))).drop("_u")


def average_precision(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean precision over the positives, taking equal scores together."""
    r = running(by_value(df, label, score, keys), score, ["pos", "neg"], keys, desc=True)
    part = F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg"))
    return r.groupBy(*keys).agg(F.sum(part).alias("average_precision"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def calibration_error(df: DataFrame, label: str, prob: str, n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Brier score and expected calibration error over equal-width bins."""
    edges = [i / n_bins for i in range(1, n_bins)]
    slot = sum(((F.col(prob) >= e).cast("int") for e in edges), F.lit(0))
    cells = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).groupBy(*keys, slot.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(label).alias("_y"), F.avg(prob).alias("_p"),
        F.sum((F.col(prob) - F.col(label)) * (F.col(prob) - F.col(label))).alias("_s"),
    )
    g = cells.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_s").alias("_s"), F.sum(F.col("_n") * F.abs(F.col("_y") - F.col("_p"))).alias("_e")
    )
    return g.select(*keys, "n", (F.col("_s") / F.col("n")).alias("brier"), (F.col("_e") / F.col("n")).alias("ece"))


def average_ranks(df: DataFrame, col: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average-tie ranks, found on the distinct values."""
    values = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    r = running(values, col, ["_n"], keys).select(*keys, col, (F.col("upto__n") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(r, [*keys, col], "left")


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation on complete pairs, with its t statistic (``student_p`` gives its p value)."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = average_ranks(average_ranks(d, a, "_ra", keys), b, "_rb", keys)
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"))
    rest = 1 - F.col("rho") * F.col("rho")
    return g.withColumn("t", F.when(rest > 0, F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(rest, F.lit(0.0)))))


def student_p(df: DataFrame, t: str, freedom: Column, out: str = "p_value") -> DataFrame:
    """Two-sided p value of a t statistic: the regularised incomplete beta function by its continued fraction."""

    def tail(ts: pd.Series, fs: pd.Series) -> pd.Series:
        return pd.Series([student_tail(a, b) for a, b in zip(ts, fs, strict=True)], dtype="float64")

    p = F.pandas_udf(tail, DoubleType())(F.col(t).cast("double"), freedom.cast("double"))
    return df.withColumn(out, F.nanvl(p, F.lit(None).cast("double")))


def normal_tail(z: Column) -> Column:
    """Two-sided normal p value (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mann_whitney(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """U of the positives, group means, and the tie-corrected normal p value (two-sided, continuity-corrected)."""
    v = by_value(df, label, score, keys)
    r = running(v, score, ["pos", "neg"], keys)
    t = F.col("pos") + F.col("neg")
    g = r.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        (F.sum(F.col(score) * F.col("pos")) / F.sum("pos")).alias("mean_pos"),
        (F.sum(F.col(score) * F.col("neg")) / F.sum("neg")).alias("mean_neg"),
        F.sum(t.cast("double") * t * t - t).alias("_ties"),
    )
    n1, n2 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - n1 * n2 / 2.0) - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0))
    return g.withColumn("p_normal", normal_tail(z)).drop("_ties")


EXACT = "exact"
NORMAL = "normal"


def _sized(df: DataFrame, keys: Sequence[str], exact_up_to: int) -> DataFrame:
    """Adds ``n`` units and ``method``: groups up to ``exact_up_to`` units are counted out, larger ones approximated."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return df.join(n.withColumn("method", F.when(F.col("n") <= exact_up_to, EXACT).otherwise(NORMAL)), list(keys))


def _key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def sign_flip(df: DataFrame, diff: str, keys: Sequence[str], order: Sequence[str], exact_up_to: int = 40) -> DataFrame:
    """Sign-flip test of mean difference 0, one- and two-sided; ``method`` tells exact from normal groups."""
    d = _sized(df.where(F.col(diff).isNotNull()), keys, exact_up_to)

    def count(pdf):
        one, two = sign_flip_p(pdf.sort_values(list(order))[diff].to_numpy(float))
        return pd.DataFrame([[*pdf.iloc[0][list(keys)], one, two]], columns=[*keys, "p_one_sided", "p_two_sided"])

    exact = d.where(F.col("method") == EXACT).groupBy(*keys).applyInPandas(count, f"{_key_ddl(d, keys)}, p_one_sided double, p_two_sided double")
    g = d.groupBy(*keys, "n", "method").agg(F.avg(diff).alias("mean_difference"), F.sqrt(F.sum(F.col(diff) * F.col(diff))).alias("_sd"))
    z = F.try_divide(F.col("mean_difference") * F.col("n"), F.col("_sd"))
    two = F.coalesce(normal_tail(z), F.lit(1.0))
    one = F.when(z >= 0, two / 2).otherwise(1 - two / 2)
    g = g.join(exact, list(keys), "left")
    return g.select(*keys, "n", "mean_difference", F.coalesce("p_one_sided", one).alias("p_one_sided"), F.coalesce("p_two_sided", two).alias("p_two_sided"), "method")


def wilcoxon(df: DataFrame, diff: str, keys: Sequence[str], order: Sequence[str], exact_up_to: int = 200) -> DataFrame:
    """Signed-rank test on non-zero differences (``bootstrap_ci`` gives the mean difference of all units and its interval).

    With the informative count, the lowest reachable p value, the rank-biserial
    effect, and ``method``: exact by counting rank sums, or normal for larger groups.
    """
    d = df.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("_abs", F.round(F.abs(diff), 12))
    d = _sized(average_ranks(d, "_abs", "_rank", keys), keys, exact_up_to)
    g = d.groupBy(*keys, "method").agg(
        F.count(F.lit(1)).cast("int").alias("n_informative"),
        F.sum((F.col(diff) > 0).cast("int")).cast("int").alias("n_positive"),
        F.sum(F.when(F.col(diff) > 0, F.col("_rank")).otherwise(F.lit(0.0))).alias("w_plus"),
        F.sum("_rank").alias("_total"), F.sum(F.col("_rank") * F.col("_rank")).alias("_sq"),
    )

    def count(pdf):
        ranks = np.round(pdf["_rank"].to_numpy() * 2).astype(np.int64)  # average ranks are halves
        observed = ranks[(pdf[diff] > 0).to_numpy()].sum()
        chances = subset_sum_chances(ranks)
        far = np.abs(2 * np.arange(len(chances)) - ranks.sum()) >= abs(2 * observed - ranks.sum())
        return pd.DataFrame([[*pdf.iloc[0][list(keys)], min(float(chances[far].sum()), 1.0)]], columns=[*keys, "_exact"])

    exact = d.where(F.col("method") == EXACT).groupBy(*keys).applyInPandas(count, f"{_key_ddl(d, keys)}, _exact double")
    z = (F.col("w_plus") - F.col("_total") / 2) / F.nullif(F.sqrt(F.col("_sq")) / 2, F.lit(0.0))
    return g.join(exact, list(keys), "left").select(
        *keys, "n_informative", "n_positive", "w_plus",
        F.coalesce("_exact", normal_tail(z)).alias("p_value"),
        F.least(F.lit(1.0), 2.0 / F.pow(F.lit(2.0), F.col("n_informative"))).alias("p_floor"),
        ((2 * F.col("w_plus") - F.col("_total")) / F.col("_total")).alias("rank_biserial"),
        "method",
    )


def permutation_auc(df: DataFrame, label: str, score: str, keys: Sequence[str], order: Sequence[str], exact_up_to: int = 100) -> DataFrame:
    """Permutation test of AUC over all placements of the positives, counted by rank sums; every group has a row.

    Groups of one class have NULL statistics; ``method`` tells exact groups from normal ones.
    """
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    d = _sized(average_ranks(d, score, "_rank", keys), keys, exact_up_to)
    n, p = F.col("n").cast("double"), F.col("n_pos").cast("double")
    q = n - p
    g = d.groupBy(*keys, "n", "method").agg(
        F.sum(label).cast("int").alias("n_pos"), F.sum(F.when(F.col(label) == 1, F.col("_rank")).otherwise(F.lit(0.0))).alias("_obs"),
        F.sum(F.col("_rank") * F.col("_rank")).alias("_sq"),
    )
    g = g.withColumn("auc", (F.col("_obs") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0.0)))

    def count(pdf):
        ranks = np.round(pdf["_rank"].to_numpy() * 2).astype(np.int64)
        y = pdf[label].to_numpy(int)
        k, size = int(y.sum()), len(y)
        if not 0 < k < size:
            return pd.DataFrame([[*pdf.iloc[0][list(keys)], None, None, float(comb(size, k))]], columns=[*keys, "_one", "_two", "_all"])
        chances = placed_sum_chances(ranks, k)
        middle, observed, sums = k * (size + 1), ranks[y == 1].sum(), np.arange(len(chances))
        one, two = chances[sums >= observed].sum(), chances[np.abs(sums - middle) >= abs(observed - middle)].sum()
        return pd.DataFrame([[*pdf.iloc[0][list(keys)], min(float(one), 1.0), min(float(two), 1.0), float(comb(size, k))]], columns=[*keys, "_one", "_two", "_all"])

    exact = d.where(F.col("method") == EXACT).groupBy(*keys).applyInPandas(count, f"{_key_ddl(d, keys)}, _one double, _two double, _all double")
    variance = p * q / F.nullif(n * (n - 1), F.lit(0.0)) * (F.col("_sq") - n * (n + 1) * (n + 1) / 4)
    z = F.try_divide(F.col("_obs") - p * (n + 1) / 2, F.sqrt(variance))
    two = normal_tail(z)
    one = F.when(z >= 0, two / 2).otherwise(1 - two / 2)
    return g.join(exact, list(keys), "left").select(
        *keys, "n", "n_pos", "auc", F.coalesce("_one", one).alias("p_one_sided"), F.coalesce("_two", two).alias("p_two_sided"),
        F.col("_all").alias("n_permutations"), "method",
    )


def max_stat(df: DataFrame, label: str, score: str, family: str, primary: str, keys: Sequence[str], order: Sequence[str], most: int = 50_000_000, cells: int = 1 << 22) -> DataFrame:
    """Multiplicity over a family of scores: the primary AUC against the best permuted AUC of any score.

    ``df`` is long: one row per unit and score name (column ``family``). Units that lack a
    score or the label are left out. All placements of the labels are tried up to
    ``most``; beyond that as many seeded random ones (``method`` "sampled"). Every
    group has a row, with NULL statistics where one class is empty. A group's ranks are one
    row; its placements are numbered and dealt to tasks in blocks of ``cells`` label cells,
    which unrank their own numbers, so a task holds one block whatever the group.
    """
    units = Window.partitionBy(*keys, *order)
    names = F.size(F.collect_set(family).over(Window.partitionBy(*keys)))
    whole = F.count(F.when(F.col(label).isNotNull() & F.col(score).isNotNull(), 1)).over(units) == names
    d = df.withColumn("_whole", whole & (F.count(F.lit(1)).over(units) == names)).where("_whole").drop("_whole")
    d = average_ranks(d, score, "_rank", [*keys, family])
    by_unit = d.groupBy(*keys, *order).agg(F.max(label).cast("int").alias("_y"), F.sort_array(F.collect_list(F.struct(F.col(family).alias("name"), F.col("_rank").alias("rank")))).alias("_v"))
    group = by_unit.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "_y", "_v"))).alias("_u"))
    group = group.select(
        *keys, F.transform("_u", lambda u: u["_y"]).alias("_y"), F.flatten(F.transform("_u", lambda u: u["_v"]["rank"])).alias("_ranks"),
        F.array_position(F.element_at("_u", 1)["_v"]["name"], primary).cast("int").alias("_primary"),
    )
    n, k = F.size("_y"), F.aggregate("_y", F.lit(0), lambda x, y: x + y)
    size = F.greatest(F.lit(1), F.floor(F.lit(cells) / n)).cast("long")
    all_of_them = F.exp(F.least(F.lit(log(most) + 1.0), log_factorial(n) - log_factorial(k) - log_factorial(n - k))) * (1 + 1e-9)
    blocks = F.floor(F.least(F.lit(float(most)), all_of_them) / size).cast("long")  # the last one may be empty
    tasks = group.withColumns({"_size": size, "_block": F.explode(F.sequence(F.lit(0).cast("long"), blocks))}).repartition(*keys, "_block")

    def count(frames):
        for pdf in frames:
            out = [[*[r[c] for c in keys], *placed_blocks(r["_y"], r["_ranks"], r["_primary"], r["_block"], r["_size"], most)] for r in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=[*keys, "_observed", "_one", "_two", "n_permutations", "_all"])

    parts = tasks.mapInPandas(count, f"{_key_ddl(df, keys)}, _observed double, _one long, _two long, n_permutations long, _all boolean")
    total = F.sum("n_permutations")
    share = lambda c: F.when(F.max("_observed").isNotNull(), F.sum(c) / total)
    out = parts.groupBy(*keys).agg(
        F.max("_observed").alias("observed_auc"), share("_one").alias("p_one_sided"), share("_two").alias("p_two_sided"), total.alias("n_permutations"),
        F.when(F.min("_all"), EXACT).otherwise("sampled").alias("method"),
    )
    values = df.groupBy(*keys, family).agg(F.sum(F.xxhash64(*order, F.round(F.col(score), 12)).cast("decimal(38,0)")).alias("_h"))
    tests = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tests"), F.countDistinct("_h").alias("n_unique_score_vectors"))
    return out.join(tests, list(keys))


def leave_one_out_auc(df: DataFrame, label: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Range of AUC when one positive is left out: each positive's own wins are taken off the total.

    No copy of the data per left-out unit is made.
    """
    r = running(by_value(df, label, score, keys), score, ["pos", "neg"], keys)
    own = F.col("upto_neg") - F.col("neg") / 2.0
    r = r.withColumn("_own", own).where("pos > 0")
    g = r.groupBy(*keys).agg(
        F.sum(F.col("pos") * F.col("_own")).alias("_u"), F.min("_own").alias("_lo"), F.max("_own").alias("_hi"),
        F.first("all_pos").alias("_p"), F.first("all_neg").alias("_n"),
    )
    left = F.nullif((F.col("_p").cast("double") - 1) * F.col("_n"), F.lit(0.0))
    return g.select(*keys, ((F.col("_u") - F.col("_hi")) / left).alias("auc_min"), ((F.col("_u") - F.col("_lo")) / left).alias("auc_max"))


def log_factorial(n: Column) -> Column:
    """ln n!: a table below 20, Stirling's series from there (error below 1e-13)."""
    m = F.greatest(n, F.lit(20)).cast("double")
    series = m * F.ln(m) - m + 0.5 * F.ln(m * 6.283185307179586) + 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * F.pow(m, F.lit(5.0)))
    small = F.array(*[F.lit(sum(log(i) for i in range(2, k + 1))) for k in range(20)])
    return F.when(n < 20, F.element_at(small, (F.least(n, F.lit(19)) + 1).cast("int"))).otherwise(series)


def fisher_exact(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-sided Fisher test of 2x2 tables with columns a, b, c, d.

    A table costs one cheap row per possible cell.
    """
    a, b, c, d = (F.col(x).cast("long") for x in "abcd")
    t = tables.withColumns({"_r": a + b, "_k": a + c, "_n": a + b + c + d})
    lo, hi = F.greatest(F.lit(0), F.col("_r") + F.col("_k") - F.col("_n")), F.least("_r", "_k")
    t = t.withColumn("x", F.explode(F.sequence(lo, hi)))
    r, k, n, x = (F.col(q) for q in ("_r", "_k", "_n", "x"))
    lf = log_factorial
    log_p = lf(r) + lf(n - r) + lf(k) + lf(n - k) - lf(n) - lf(x) - lf(r - x) - lf(k - x) - lf(n - r - k + x)
    t = t.withColumn("_p", F.exp(log_p))
    seen = F.max(F.when(x == F.col("a"), F.col("_p"))).over(Window.partitionBy(*keys))
    t = t.withColumn("_o", seen)
    return t.groupBy(*keys, *"abcd").agg(
        F.least(F.lit(1.0), F.sum(F.when(F.col("_p") <= F.col("_o") * (1 + 1e-7), F.col("_p")).otherwise(F.lit(0.0)))).alias("p_value")
    )


def contingency(df: DataFrame, by: str, label: str, spine: Sequence[str]) -> DataFrame:
    """Counts of label 0/1 per group, groups without rows kept as zeros."""
    frame = df.sparkSession.createDataFrame([(s,) for s in spine], f"`{by}` string")
    counts = df.groupBy(by).pivot(label, [0, 1]).count()
    return frame.join(counts, by, "left").fillna(0)


def holm(df: DataFrame, p: str, keys: Sequence[str], order: str) -> DataFrame:
    """Holm step-down within each family of tests."""
    w = Window.partitionBy(*keys).orderBy(p, order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = df.withColumn("_step", (m - F.row_number().over(w) + 1) * F.col(p))
    upto = F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("p_holm", F.least(F.lit(1.0), upto)).drop("_step")


SENT_UNITS = 500_000  # entities whose sums are sent to every task: a number and a few sums each, some 20 MB


def bootstrap_metric(units: DataFrame, sums: dict[str, str], metric: Callable[[dict[str, Column]], Column], n_boot: int, seed: int, unit: str = "entity") -> DataFrame:
    """95 % interval of any metric of entity sums when whole entities are drawn with replacement.

    ``sums`` names the columns to add up per entity, ``metric`` turns their totals
    into the statistic (a rate, an F1, a mean paired difference). Entities are
    numbered; replicate r draws for slot i the entity number hash(seed, r, i) mod n.
    A task makes whole runs of a replicate's slots, so its draws add up where they meet the sums
    and one row a (task, replicate) is shuffled; only a table of more than ``SENT_UNITS`` entities that
    Spark finds too large to send around makes the draws move to it. The draws themselves are never sent
    around: a left join forbids it, for Spark takes the few rows they are made from for their size.
    """
    one = {k: F.sum(v).alias(f"_s_{k}") for k, v in sums.items()}
    total = {k: F.sum(F.col(f"_s_{k}")) for k in sums}
    by_unit = units.groupBy(unit).agg(*one.values(), F.lit(1).cast("long").alias("_one"))
    numbered = running(by_unit, unit, ["_one"]).select((F.col("upto__one") - 1).alias("_i"), F.col("all__one").alias("_n"), *[f"_s_{k}" for k in sums])
    numbered = stored(numbered, "units")
    run = 4096  # slots of a run
    spark = units.sparkSession
    reps = attach(spark.range(0, n_boot, 1, max(1, min(n_boot, spark.sparkContext.defaultParallelism * 4))), numbered.agg(F.max("_n").alias("_n"))).where("_n > 0")
    runs = reps.select(F.col("id").alias("_rep"), "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(run).cast("long"))).alias("_from"))
    draws = runs.select("_rep", "_n", F.explode(F.sequence("_from", F.least(F.col("_from") + run, F.col("_n")) - 1)).alias("_slot"))
    pick = stable_seed(F.concat_ws("|", F.lit(str(seed)), F.col("_rep").cast("string"), F.col("_slot").cast("string"))) % F.col("_n")
    sums_of = numbered.drop("_n")
    sums_of = F.broadcast(sums_of) if sums_of.count() <= SENT_UNITS else sums_of
    boot = draws.select("_rep", pick.alias("_i")).join(sums_of, "_i", "left").groupBy("_rep").agg(metric(total).alias("_m"))
    ci = boot.agg(F.percentile("_m", F.lit(0.025)).alias("ci_low"), F.percentile("_m", F.lit(0.975)).alias("ci_high"), F.count("_m").alias("n_boot"))
    point = numbered.agg(metric(total).alias("value"), F.count(F.lit(1)).alias("n_groups"))
    return attach(point, ci)


def bootstrap_ci(units: DataFrame, num: str, den: str, n_boot: int, seed: int, unit: str = "entity") -> DataFrame:
    """``bootstrap_metric`` of sum(num) / sum(den)."""
    return bootstrap_metric(units, {"num": num, "den": den}, lambda t: t["num"] / F.nullif(t["den"].cast("double"), F.lit(0.0)), n_boot, seed, unit)


def autocorrelation(series: DataFrame, value: str, max_lag: int, least_pairs: int = 30, keys: Sequence[str] = ("entity",), block: int = 4096) -> DataFrame:
    """Pairwise-complete autocorrelation by lag on a regular grid with gaps as NULL.

    A series is cut into blocks; the first ``max_lag`` rows of a block are also the tail of the block
    before it. Each block gives its sums of products and pair counts per lag, which add up, so a lag
    costs two dot products a block and no column of the plan.
    """
    block = max(block, max_lag)
    w = Window.partitionBy(*keys)
    x = series.select(*keys, (F.col(value) - F.avg(value).over(w)).cast("double").alias("_x"), (F.row_number().over(w.orderBy("bin")) - 1).cast("long").alias("_i"))
    own = F.floor(F.col("_i") / block)
    tail = (F.col("_i") % block < max_lag) & (own > 0)
    parts = x.withColumn("_b", F.explode(F.when(tail, F.array(own, own - 1)).otherwise(F.array(own))))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        seen = pdf["_x"].notna().to_numpy(float)
        values = pdf["_x"].fillna(0.0).to_numpy(float)
        n = int((pdf["_i"].to_numpy() // block == pdf["_b"].iloc[0]).sum())
        reach = [min(n, max(len(values) - k, 0)) for k in range(max_lag + 1)]
        out = pd.DataFrame({"lag": np.arange(max_lag + 1, dtype=np.int32)})
        out["_s"] = [float(values[:m] @ values[k : k + m]) for k, m in enumerate(reach)]
        out["_n"] = [int(seen[:m] @ seen[k : k + m]) for k, m in enumerate(reach)]
        for i, c in enumerate(keys):
            out.insert(i, c, [pdf[c].iloc[0]] * len(out))
        return out

    parts = parts.groupBy(*keys, "_b").applyInPandas(sums, f"{_key_ddl(series, keys)}, lag int, _s double, _n long")
    g = parts.groupBy(*keys, "lag").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    mean = F.when(F.col("_n") >= F.when(F.col("lag") == 0, 1).otherwise(least_pairs), F.try_divide("_s", "_n"))
    g = g.withColumn("_c", mean)
    g = g.withColumns({"n_obs": F.max(F.when(F.col("lag") == 0, F.col("_n"))).over(w), "_var": F.max(F.when(F.col("lag") == 0, F.col("_c"))).over(w)})
    return g.where("lag > 0").select(*keys, "n_obs", "lag", F.when(F.col("_var") > 0, F.col("_c") / F.nullif("_var", F.lit(0.0))).alias("rho"))


def correlation_time(acf: DataFrame, max_lag: int, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """First lag below 1/e, integrated time over the initial positive run, effective sample size."""
    below = F.min(F.when(F.col("rho") < 0.36787944117144233, F.col("lag")))
    stop = F.min(F.when(F.col("rho").isNull() | (F.col("rho") <= 0), F.col("lag"))).over(Window.partitionBy(*keys))
    g = acf.withColumn("_stop", stop).groupBy(*keys, "n_obs").agg(
        F.coalesce(below, F.lit(max_lag)).cast("double").alias("tau_e"),
        F.greatest(F.lit(1.0), 1.0 + 2.0 * F.coalesce(F.sum(F.when(F.coalesce(F.col("lag") < F.col("_stop"), F.lit(True)), F.col("rho"))), F.lit(0.0))).alias("tau_int"),
    )
    return g.withColumn("n_eff", F.col("n_obs") / F.col("tau_int"))


def tolerant_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], atol: float = 1e-8, rtol: float = 1e-5, ignore: Sequence[str] = ()) -> DataFrame:
    """Cell-level differences of two keyed tables: numbers within tolerance and NULL = NULL are equal."""
    cols = [c for c in a.columns if c in b.columns and c not in (*keys, *ignore)]
    types = dict(a.dtypes)
    num = {c for c in cols if types[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or types[c].startswith("decimal")}
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*cols))  # repeated keys pair up in sorted order
    left = a.withColumn("_nth", nth).select(*keys, "_nth", F.lit(1).alias("_l"), *[F.col(c).alias(f"l_{c}") for c in cols])
    right = b.withColumn("_nth", nth).select(*keys, "_nth", F.lit(1).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in cols])
    j = left.join(right, [*keys, "_nth"], "full_outer")

    def differs(c: str) -> Column:
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        if c in num:
            close = F.abs(x - y) <= atol + rtol * F.abs(y)
            return ~F.coalesce(close, x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    text = lambda c: F.col(c).cast("string")
    cells = [F.when(both & differs(c), F.struct(F.lit(c).alias("column"), text(f"l_{c}").alias("left"), text(f"r_{c}").alias("right"))) for c in cols]
    row = F.when(~both, F.struct(F.lit("<row>").alias("column"), text("_l").alias("left"), text("_r").alias("right")))
    found = F.filter(F.array(row, *cells), lambda x: x.isNotNull())
    return j.select(*keys, F.explode(found).alias("_d")).select(*keys, "_d.*")
