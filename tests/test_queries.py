"""Registered queries against DuckDB on the smallest data, and the driver contract."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["src01_csv_scan_normalise", "t02_regular_grid", "t12_chronological_split", "w03_rolling_robust_z", "w16_cooldown", "st02_scorer_with_holes", "x06_wilcoxon_large_groups", "a04_severity_matrix", "d02_hypo_branch", "d03_instability_branch",
          "d04_fusion_hierarchical", "d05_comparator_rules", "d10_attributable_evaluation", "x01_auc_by_stratum", "x09_permutation_auc", "j10_no_neighbour_within_tolerance", "x20_tolerant_table_diff",
          "x07_paired_mean_difference", "x18_local_outlier_factor", "j17_pareto_frontier", "x10_max_stat_multiplicity", "x16_autocorrelation", "x16_correlation_time"]


def rows(frame):
    def text(v):
        if v is None or v != v:
            return "~"
        return f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_entry_and_one_exchange(spark):
    assert entry.entry(spark).count() > 0
    from sensorwatch.operators.fusion import hybrid_warning
    from sensorwatch.plans import tables as T

    plan = hybrid_warning(T.interval_table(spark, DATA), "4H")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
