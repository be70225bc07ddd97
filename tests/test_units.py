"""Single operators against known answers and plain loops."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorwatch.config import FusionConfig, HypoConfig, bins, interval_minutes
from sensorwatch.functions import series as S
from sensorwatch.operators import adjust as A
from sensorwatch.operators import campaign as C
from sensorwatch.operators import features as FE
from sensorwatch.operators import fusion as FU
from sensorwatch.operators import grid as G
from sensorwatch.operators import hypo as H
from sensorwatch.operators import intervals as IV
from sensorwatch.operators import models as M
from sensorwatch.operators import stats as ST
from sensorwatch.operators import sweep as SW
from sensorwatch.operators.neighbours import nearest_rows
from sensorwatch.sources import readings as RD
from sensorwatch.sources import sinks as SK

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, names="x double", minutes=15, entity="a"):
    rows = [(entity, T0 + dt.timedelta(minutes=minutes * i), i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"entity string, bin timestamp, pos int, {names}")


def column(df, c):
    return [r[c] for r in df.orderBy("bin").collect()]


def test_intervals():
    assert [interval_minutes(x) for x in ("15T", "30min", "1H", "4h")] == [15, 30, 60, 240]
    assert bins(6, "4H", 2) == 2 and bins(12, "15T", 4) == 48
    with pytest.raises(ValueError):
        interval_minutes("2D")


def test_durations_and_normalisation(spark):
    df = spark.createDataFrame([("1:30:00",), ("2:00:30",), ("15:30",), ("x",), (None,)], "d string")
    assert [r[0] for r in df.select(RD.duration_minutes(F.col("d"))).collect()] == [90.0, 120.5, 15.5, None, None]
    raw = spark.createDataFrame([("7", "2024-01-01 00:00:00", "-3", "1", "2"), ("7", "bad", "1", "1", "1")], "`Cow ID` string, Time string, Step string, Up string, Down string")
    out = RD.normalise(raw).collect()
    assert len(out) == 1 and out[0]["steps"] == 0.0 and out[0]["transitions"] == 3.0
    with pytest.raises(ValueError):
        RD.normalise(spark.createDataFrame([(1,)], "Time int"))


def test_grid_keeps_empty_bins(spark):
    rows = [("a", T0, 1.0), ("a", T0 + dt.timedelta(minutes=50), 2.0), ("a", T0 + dt.timedelta(minutes=52), 4.0)]
    g = G.regular_grid(spark.createDataFrame(rows, "entity string, t timestamp, steps double"), "15T").orderBy("bin").collect()
    assert [(r["steps_sum"], r["steps_mean"], r["n_raw_samples"]) for r in g] == [(1.0, 1.0, 1.0), (0.0, None, 0.0), (0.0, None, 0.0), (6.0, 3.0, 2.0)]


def test_cadence_against_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for e in "ab":
        t, gaps = T0, []
        for _ in range(60):
            g = rng.choice([0, 10, 900, 900, 3600 * 5])
            t += dt.timedelta(seconds=g, microseconds=rng.randint(0, 9))
            rows.append((e, t))
        ts = sorted(x for k, x in rows if k == e)
        gaps = sorted((b - a).total_seconds() / 60 for a, b in zip(ts, ts[1:]) if b > a)
        want[e] = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2
    got = {r["entity"]: r["cadence_minutes"] for r in G.sampling_cadence(spark.createDataFrame(rows, "entity string, t timestamp")).collect()}
    assert all(abs(got[e] - want[e]) < 1e-6 for e in want)


def test_robust_z(spark):
    flat = FE.add_global_z(series(spark, [5.0] * 20), ["x"])
    assert column(flat, "x_rz") == [0.0] * 20
    peak = column(FE.add_global_z(series(spark, [0.0] * 19 + [100.0]), ["x"]), "x_rz")
    assert peak[-1] > 2
    two = column(FE.add_global_z(series(spark, [0.0] * 10 + [1.0] * 10), ["x"]), "x_rz")
    assert two[0] * two[-1] < 0
    roll = column(FE.add_rolling_z(series(spark, [1.0, None, 3.0, 2.0, 9.0, 4.0, 4.0, None, 30.0, 2.0]), ["x"], 24), "x_rrz")
    assert all(math.isfinite(v) for v in roll)


def test_cusum_cooldown_prior_against_loops(spark):
    rng = random.Random(1)
    for wait in (1, 3, 7):
        xs = [(rng.random(), int(rng.random() < 0.35)) for _ in range(150)]
        df = S.add_cusum(series(spark, xs, "e double, st int"), "e", 0.5, "c")
        df = S.add_prior_event(S.add_cooldown(df, "st", wait, "fire"), "st", 2, 6, "prior")
        rows = df.orderBy("bin").collect()
        state, last = 0.0, -(10**9)
        for i, (e, st) in enumerate(xs):
            state = max(0.0, state + e - 0.5)
            fire = int(st == 1 and i - last > wait)
            last = i if fire else last
            assert abs(rows[i]["c"] - state) < 1e-9 and rows[i]["fire"] == fire
            assert rows[i]["prior"] == int(any(xs[j][1] for j in range(max(0, i - 6), i - 1)))


def test_cooldowns_of_many_keys_across_batches(spark):
    """Starts without pause, keys cut anywhere by Arrow batches, null starts, waits by row, two items in one pass."""
    rng = random.Random(5)
    rows = [(f"k{k}", T0 + dt.timedelta(hours=i), i, rng.choice([0, 1, 1, None]), int(rng.random() < 0.2), k % 4) for k in range(9) for i in range(rng.randrange(1, 90))]
    df = spark.createDataFrame(rows, "entity string, bin timestamp, pos int, a int, b int, w int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r["entity"], r["pos"]): r for r in S.add_cooldowns(df, [("a", F.col("w"), "x"), ("b", 6, "y")], last=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    last: dict = {}
    for e, _, i, a, b, w in rows:
        for name, start, wait in (("x", a, w), ("y", b, 6)):
            before = last.get((e, name))
            fire = int(start == 1 and (before is None or i - before > wait))
            assert got[e, i][name] == fire and got[e, i][f"_last_{name}"] == before
            if fire:
                last[e, name] = i


def hypo_table(spark):
    rows = []
    for i in range(192):
        late = i >= 120
        rows.append(("a", T0 + dt.timedelta(minutes=15 * i), "futur" if i >= 115 else "baseline", 100.0, *((5.0, 5.0, 5.0, 50.0, 50.0) if late else (100.0, 100.0, 100.0, 20.0, 80.0))))
    return spark.createDataFrame(rows, "entity string, bin timestamp, dataset_split string, coverage_pct double, steps_sum double, motion_sum double, transitions_sum double, lying_sum double, standing_sum double")


def test_hypo_alerts_only_after_reference(spark):
    out = H.hypo_branch(hypo_table(spark), "15T").orderBy("bin").collect()
    assert sum(r["behavioral_warning_notification"] for r in out) == 1
    assert not any(r["behavioral_warning_episode"] for r in out[:115])
    for r in out:
        assert r["behavioral_warning_notification"] <= r["behavioral_warning_start"] <= r["behavioral_warning_episode"]


def test_posture_only_ignores_other_channels(spark):
    cfg = HypoConfig(active_families=("posture",), min_families=1)
    df = hypo_table(spark)
    a = column(H.hypo_branch(df, "15T", cfg), "behavioral_warning_score")
    b = column(H.hypo_branch(df.withColumn("steps_sum", F.lit(0.0)), "15T", cfg), "behavioral_warning_score")
    assert a == b


def test_or_fusion_of_preset_episodes(spark):
    h, i = [0, 1, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 1, 1, 0]
    rows = [(x, y, int(x and not (k and h[k - 1])), int(y and not (k and i[k - 1])), 0.1, 0.2) for k, (x, y) in enumerate(zip(h, i))]
    df = series(spark, rows, "behavioral_warning_episode int, instability_warning_episode int, behavioral_warning_start int, instability_warning_start int, behavioral_warning_score double, instability_warning_score double")
    out = FU.fuse(df, "15T", FusionConfig("OR"))
    assert column(out, "hybrid_warning_episode") == [0, 1, 1, 0, 0, 1, 1, 0]
    lone = FU.fuse(df, "15T", FusionConfig("HIERARCHICAL")).orderBy("bin").collect()
    assert [r["hybrid_warning_priority"] for r in lone] == [0, 2, 2, 0, 0, 1, 1, 0]
    assert [r["hybrid_warning_surveillance"] for r in lone] == [0, 0, 0, 0, 0, 1, 1, 0]
    with pytest.raises(ValueError):
        FusionConfig("NONE")


def test_envelope_shapes(spark):
    def smooth(n, up, down):
        x = [k / (up - 1) for k in range(up)] + [1.0] * (n - up - down) + [1 - k / (down - 1) for k in range(down)]
        return [v * v * (3 - 2 * v) for v in x]

    up, down = A.ramps(48, "gradual")
    assert (up, down) == (17, 7)
    args = [F.lit(v) for v in (48, up, down, 1, 1.0)]
    got = [r[0] for r in spark.range(48).select(A.envelope(F.col("id"), *args)).collect()]
    assert max(abs(a - b) for a, b in zip(got, smooth(48, up, down))) < 1e-12
    assert A.ramps(2, "gradual") == (1, 1) and A.ramps(60, "flat") == (0, 0) and A.ramps(1, "mirrored") == (1, 1)


def test_pareto_against_pairs(spark):
    rng = random.Random(5)
    pts = [(i, rng.randint(0, 6) / 2, rng.randint(0, 6) / 2, rng.randint(0, 6) / 2) for i in range(150)]
    df = spark.createDataFrame(pts, "id int, up double, c1 double, c2 double")
    got = {r["id"] for r in C.pareto(df, "up", ["c1", "c2"]).collect()}
    beats = lambda b, a: b[1] >= a[1] and b[2] <= a[2] and b[3] <= a[3] and b[1:] != a[1:]
    assert got == {a[0] for a in pts if not any(beats(b, a) for b in pts)}


def test_window_joins_against_pairs(spark):
    rng = random.Random(2)
    pts = [("a", T0 + dt.timedelta(minutes=rng.randint(0, 9000)), i) for i in range(120)]
    oth = [("a", T0 + dt.timedelta(minutes=rng.randint(0, 9000))) for _ in range(40)]
    p, o = spark.createDataFrame(pts, "entity string, t timestamp, id int"), spark.createDataFrame(oth, "entity string, t timestamp")
    got = {r["id"] for r in IV.without_neighbour(p, o, "t", 1.0).collect()}
    assert got == {i for _, t, i in pts if not any(abs((t - u).total_seconds()) <= 3600 for _, u in oth)}
    win = [("a", t, t + dt.timedelta(hours=30), i) for i, (_, t) in enumerate(oth[:9])]
    w = spark.createDataFrame(win, "entity string, start timestamp, end timestamp, w int")
    pairs = {(r["id"], r["w"]) for r in IV.rows_in_windows(p, w).collect()}
    assert pairs == {(i, k) for _, t, i in pts for _, s, e, k in win if s <= t <= e}


def test_exact_statistics_known_answers(spark):
    rows = [("g", f"u{i}", y, float(s)) for i, (y, s) in enumerate(zip([1, 1, 1, 0, 0, 0], [7, 7, 6, 3, 7, 3]))]
    df = spark.createDataFrame(rows, "g string, u string, y int, s double")
    r = ST.permutation_auc(df, "y", "s", ["g"], ["u"]).first()
    assert abs(r["auc"] - 7 / 9) < 1e-12 and r["n_permutations"] == 20
    assert abs(r["p_one_sided"] - 0.20) < 1e-12 and abs(r["p_two_sided"] - 0.40) < 1e-12
    assert abs(ST.auc(df, "y", "s").first()["auc"] - 7 / 9) < 1e-12
    d = spark.createDataFrame([("g", i, float(i + 1)) for i in range(11)], "g string, u int, d double")
    assert abs(ST.sign_flip(d, "d", ["g"], ["u"]).first()["p_one_sided"] - 1 / 2**11) < 1e-12
    assert abs(ST.wilcoxon(d, "d", ["g"], ["u"]).first()["p_value"] - 2 / 2**11) < 1e-12
    h = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03)], "f string, k int, p double")
    assert [round(x["p_holm"], 6) for x in ST.holm(h, "p", ["f"], "k").orderBy("k").collect()] == [0.03, 0.06, 0.06]
    t = spark.createDataFrame([("x", 3, 1, 1, 3)], "k string, a int, b int, c int, d int")
    assert abs(ST.fisher_exact(t, ["k"]).first()["p_value"] - 0.485714) < 1e-5


def test_max_stat_tries_every_placement(spark):
    from itertools import combinations

    import numpy as np

    from sensorwatch.operators.exact import unranked

    rows = unranked(np.arange(35), 7, 3)
    assert sorted(tuple(np.flatnonzero(r)) for r in rows) == sorted(combinations(range(7), 3))
    rng = np.random.default_rng(5)
    cells = [("g", f"u{i}", int(i < 5), f, float(v)) for i in range(11) for f, v in zip("abc", rng.integers(0, 6, 3) + 2 * (i < 5), strict=True)] + [("h", "u", 1, "a", 1.0), ("g", "short", 1, "a", 9.0)]
    df = spark.createDataFrame(cells, "g string, u string, y int, f string, s double")
    own = {f: [c[4] for c in cells if c[3] == f and c[1] not in ("u", "short")] for f in "abc"}
    ranks = {f: np.array([sum(w < v for w in x) + (sum(w == v for w in x) + 1) / 2 for v in x]) for f, x in own.items()}
    auc = lambda chosen, f: (ranks[f][list(chosen)].sum() - 15) / 30
    seen = auc(range(5), "a")
    best = [(max(auc(c, f) for f in "abc"), max(abs(auc(c, f) - 0.5) for f in "abc")) for c in combinations(range(11), 5)]
    for size in (60, 1 << 22):  # many blocks, one block
        got = {r.g: r for r in ST.max_stat(df, "y", "s", "f", "a", ["g"], ["u"], cells=size).collect()}
        r = got["g"]
        assert r.n_permutations == 462 and r.method == "exact" and abs(r.observed_auc - seen) < 1e-12 and r.n_tests == 3
        assert abs(r.p_one_sided - sum(a >= seen - 1e-12 for a, _ in best) / 462) < 1e-12 and abs(r.p_two_sided - sum(b >= abs(seen - 0.5) - 1e-12 for _, b in best) / 462) < 1e-12
        assert got["h"].p_one_sided is None and got["h"].n_permutations == 1
    few = {r.g: r for r in ST.max_stat(df, "y", "s", "f", "a", ["g"], ["u"], most=200).collect()}["g"]
    assert few.method == "sampled" and few.n_permutations == 200
    large = spark.createDataFrame([("g", i, int(i % 2 == 0), "a", float(i * i % 23)) for i in range(25)], "g string, u int, y int, f string, s double")
    want = ST.permutation_auc(large, "y", "s", ["g"], ["u"]).first()
    got = ST.max_stat(large, "y", "s", "f", "a", ["g"], ["u"]).first()
    assert got.n_permutations == 5_200_300 and got.method == "exact" and abs(got.p_one_sided - want.p_one_sided) < 1e-9 and abs(got.p_two_sided - want.p_two_sided) < 1e-9


def test_autocorrelation_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=300).cumsum()]
    df = spark.createDataFrame([("e", i, v) for i, v in enumerate(x)] + [("f", 0, 1.0), ("n", 0, None)], "entity string, bin int, v double")
    c = np.array([np.nan if v is None else v for v in x])
    c = c - np.nanmean(c)
    for block in (20, 64, 4096):
        got = {(r.entity, r.lag): r for r in ST.autocorrelation(df, "v", 20, block=block).collect()}
        for k in range(1, 21):
            assert abs(got["e", k].rho - np.nanmean(c[:-k] * c[k:]) / np.nanmean(c * c)) < 1e-12
            assert got["f", k].rho is None and got["n", k].n_obs == 0


def test_running_totals_with_one_value_holding_most_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") % 97).cast("double").alias("v"), F.lit(1).alias("n"))
    got = {r["v"]: r["upto_n"] for r in ST.running(df.groupBy("v").agg(F.sum("n").alias("n")), "v", ["n"]).collect()}
    values = sorted(r["v"] for r in df.select("v").collect())
    assert all(got[v] == sum(1 for x in values if x <= v) for v in set(values))


def test_forest_and_lof_find_planted_outliers(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        odd = i in (250, 260, 270)
        rows.append(("a", i, 1 if i < 180 else 0, 100.0, 50.0 if odd else rng.gauss(0, 1), -40.0 if odd else rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "entity string, pos int, train_point int, coverage_pct double, x double, y double").withColumn("bin", F.col("pos"))
    out = M.isolation_scores(df, ["x", "y"], n_trees=100)
    low = [r["pos"] for r in out.orderBy("if_score").limit(3).collect()]
    assert set(low) == {250, 260, 270}
    share = out.where("train_point = 1").agg(F.avg("if_anomaly_point")).first()[0]
    assert 0.03 <= share <= 0.09
    lof = M.local_outliers(df, ["x", "y"], 10)
    assert {r["pos"] for r in lof.orderBy("if_score").limit(3).collect()} == {250, 260, 270}


@pytest.mark.parametrize("n,dim,kind", [(1, 2, "plain"), (2, 2, "plain"), (700, 5, "plain"), (700, 2, "ties"), (900, 1, "ties"), (500, 3, "copies")])
def test_ball_tree_neighbours_equal_all_pairs(n, dim, kind):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(n, dim))
    if kind == "ties":
        points = np.round(points)
    if kind == "copies":
        points[rng.random(n) < 0.4] = 0
    pos = rng.permutation(2 * n)[:n]

    def all_pairs(query, own, k):
        order = np.argsort(pos)
        out = []
        for i, q in enumerate(query):
            gap = np.sqrt(((points[order] - q) ** 2).sum(axis=1))
            rest = [(g, p) for g, p in zip(gap.tolist(), pos[order].tolist(), strict=True) if own is None or p != own[i]]
            out += [(i, p) for _, p in sorted(rest)[:k]]
        return out

    query = np.vstack([points, rng.normal(size=(50, dim)).round(1)])
    for k in (1, 20):
        for asked, own in ((query, None), (points, pos)):
            row, near, gap = nearest_rows(asked, own, points, pos, k)
            assert list(zip(row.tolist(), near.tolist(), strict=True)) == all_pairs(asked, own, k)
            at = {p: v for p, v in zip(pos.tolist(), points, strict=True)}
            assert np.allclose(gap, [np.linalg.norm(asked[i] - at[j]) for i, j in zip(row, near, strict=True)])


def test_sweep_configs_change_one_factor():
    configs = SW.ofat_configs()
    assert len(configs) == 21
    SW.assert_one_factor(configs)
    with pytest.raises(ValueError):
        SW.assert_one_factor({"reference": configs["reference"], "x": ("min_families", "lower", HypoConfig(min_families=2, cusum_drift=0.1))})


def test_protocol_failures_are_named(spark):
    day = dt.timedelta(days=1)
    rows = [(f"e{i}", "a", s, 1, T0 + day * i, T0 + day * i + dt.timedelta(hours=30), T0, True, True) for i, s in enumerate(A.GRADUAL)]
    ev = spark.createDataFrame(rows, "event_id string, entity string, scenario string, seed int, start timestamp, end timestamp, heldout_start timestamp, event_after_heldout boolean, informative_source_window boolean")
    checks = {r["check"]: r["passed"] for r in C.protocol_checks(ev, list(A.GRADUAL)).collect()}
    assert len(checks) == 9 and checks["non_overlapping_physical_windows"] == 0 and sum(checks.values()) == 8
    with pytest.raises(RuntimeError):
        C.assert_protocol(C.protocol_checks(ev, list(A.GRADUAL)))


def test_sinks_resume_and_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "run_id int, v string")
    assert [r["run_id"] for r in SK.pending(a, a.where("run_id = 1")).collect()] == [2]
    path = RD.scratch(spark, "t")
    SK.append_run(a, path, "one")
    SK.append_run(a, path, "two")
    assert spark.read.parquet(path).count() == 4
    assert SK.run_hash({"a": 1, "b": 2}) == SK.run_hash({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        RD.shape_of(spark.range(1))
    assert SK.same_rows(a, a).count() == 0


def test_lanes_equal_single_settings(spark):
    """Every lane of a sweep and of a fusion run is what the branch gives alone, notifications included."""
    from sensorwatch.config import InstabilityConfig
    from sensorwatch.operators import lanes as LN

    rng = random.Random(11)
    cells = "entity string, bin timestamp, dataset_split string, coverage_pct double, steps_sum double, motion_sum double, transitions_sum double, lying_sum double, standing_sum double"
    rows = []
    for e in ("a", "b"):
        for i in range(160):
            low = 0.3 if i > 110 and (i // 12) % 2 else 1.0
            rows.append((e, T0 + dt.timedelta(hours=4 * i), "futur" if i >= 90 else "baseline", rng.choice([100.0, 100.0, 60.0, 20.0]), *(round(rng.uniform(50, 90) * low, 2) for _ in range(3)), round(rng.uniform(60, 90) / low, 2), round(rng.uniform(60, 90) * low, 2)))
    df = spark.createDataFrame(rows, cells)
    configs = {n: c for n, (_, _, c) in list(SW.ofat_configs().items())[::4]}
    got = {(r["entity"], r["bin"]): r for r in LN.drop_lanes(df, "4H", configs, notify=True).collect()}
    fired = 0
    for k, c in enumerate(configs.values()):
        for r in H.hypo_branch(df, "4H", c).collect():
            own = got[r["entity"], r["bin"]]
            assert (own["episodes"][k], own["starts"][k], own["notifications"][k]) == tuple(r[f"behavioral_warning_{x}"] for x in ("episode", "start", "notification"))
            assert own["scores"][k] == pytest.approx(r["behavioral_warning_score"], abs=1e-12)
            fired += r["behavioral_warning_notification"]
    assert fired
    runs = {"a": (InstabilityConfig(), FusionConfig("OR")), "b": (InstabilityConfig(persistence_hours=8.0), FusionConfig("HIERARCHICAL", cooldown_hours=24))}
    got = {(r["entity"], r["bin"]): r for r in LN.fusion_lanes(df, "4H", runs, notify=True).collect()}
    for k, (i, f) in enumerate(runs.values()):
        for r in FU.hybrid_warning(df, "4H", HypoConfig(), i, f).collect():
            own = got[r["entity"], r["bin"]]
            assert [own[f"hybrid_{x}s"][k] for x in ("episode", "start", "notification")] == [r[f"hybrid_warning_{x}"] for x in ("episode", "start", "notification")]
            assert own["instability_episodes"][k] == r["instability_warning_episode"]


def test_scorer_continues_and_forgets(spark, tmp_path):
    """Any cut of a run gives the same scores; an entity silent for longer than the limit loses its state and starts anew."""
    import numpy as np

    from sensorwatch.streaming import alerts as AL

    rng = np.random.default_rng(2)
    rules, n = AL.Rules(HypoConfig(), "4H"), 120
    values = rng.uniform(40, 90, (n, 5)) * np.where((np.arange(n) % 40 > 20)[:, None], [0.4, 0.4, 0.4, 1.6, 0.4], 1.0)
    rest = (np.full(n, 5.0), np.ones(n), np.full((n, 5), 390.0), np.full(10, 1.0), 5.0)
    whole = rules.advance(AL.Recent(), values, *(x[:n] for x in rest[:3]), *rest[3:])
    assert whole["notification"].sum() > 0 and whole["cusum"].max() > 1
    for cuts in ((1, 2, 3, 50), (7, 8, 60, 61), tuple(range(1, n))):
        s, parts = AL.Recent(), []
        for low, high in zip((0, *cuts), (*cuts, n), strict=True):
            s = AL.Recent.of(s.row()) if s.last is not None else s
            parts.append(rules.advance(s, values[low:high], *(x[low:high] for x in rest[:3]), *rest[3:]))
            s.last = s.heard = AL._time(0)
        for k, x in whole.items():
            assert np.allclose(np.concatenate([p[k] for p in parts]), x, atol=1e-9), k

    AL.use_typed_state(spark)
    cells = "entity string, bin timestamp, n_raw_samples double, live int, " + ", ".join(f"{x}_sum double" for x in AL.SIGNALS)
    day = lambda e, k: (e, T0 + dt.timedelta(days=k), 1.0, 1, 1.0, 1.0, 1.0, 1.0, 1.0)
    for rows in ([day("a", 0), day("b", 0)], [day("a", 1)], [day("c", 30)], [day("c", 31), day("b", 40), day("a", 40), day("a", 40)]):
        spark.createDataFrame(rows, cells).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    profile = "entity string, slot int, expected_raw_per_bin double, live_from timestamp, " + ", ".join([f"exp_{x} double" for x in AL.SIGNALS] + [f"floor_{k}_{x} double" for k in ("exp", "lag") for x in AL.SIGNALS])
    feed = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scored = AL.score_stream(feed, spark.createDataFrame([], profile), "24H", late="2 days", forget="5 days")
    q = scored.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = sorted((r["entity"], (r["bin"] - T0).days, r["late"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [x for x in got if x[0] == "b"] == [("b", k, 0) for k in (*range(6), 40)]
    assert [x for x in got if x[0] == "a"] == [("a", k, 0) for k in (*range(7), 40)] + [("a", 40, 1)]


def test_idle_columns_travel_as_one_struct(spark):
    """Windows of the rules and branches see few columns, and every column comes back in its place."""
    from sensorwatch.functions import series as S

    df = spark.createDataFrame([("a", i, float(i), "x", None, i % 2) for i in range(6)], "entity string, bin int, v double, n1 string, n2 int, n3 int")
    widths = []

    def step(own):
        widths.append(len(own.columns))
        inner = S.beside(own.withColumn("more", F.lit(1)), ["entity", "bin"], lambda x: x.withColumn("k", F.row_number().over(S.ordered())))
        return inner.withColumn("v", F.col("v") * 2)

    out = S.beside(df, ["entity", "bin", "v"], step)
    assert out.columns == ["entity", "bin", "v", "n1", "n2", "n3", "more", "k"] and widths == [4]
    assert [tuple(r) for r in out.orderBy("bin").collect()] == [("a", i, 2.0 * i, "x", None, i % 2, 1, i + 1) for i in range(6)]


def test_tasks_grow_with_rows(spark):
    """A key's rows stay together and the number of tasks follows the rows, whatever they shuffle to."""
    from sensorwatch.functions import series as S

    df = spark.range(3000).select((F.col("id") % 300).cast("string").alias("entity"), "id")
    few, many = S.spread(df, 600_000), S.spread(df, 6_000_000)
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (10, 100)
    homes = many.groupBy("entity", F.spark_partition_id().alias("p")).count()
    assert homes.count() == 300


def test_streams_are_evaluated_side_by_side(spark):
    """Several streams in one pass give what each gives alone; runs are bounded without a sort of their own."""
    import datetime

    from sensorwatch.operators import evaluate as E

    t0 = datetime.datetime(2024, 1, 1)
    at = lambda i: t0 + datetime.timedelta(hours=4 * i)
    ep, ref = [0, 1, 1, 0, 1, 1, 1, 0], [0, 0, 0, 0, 0, 0, 1, 0]
    rising = lambda x: [int(v and not (i and x[i - 1])) for i, v in enumerate(x)]
    rows = [("a", e, at(i), at(2), at(5), ep[i], rising(ep)[i], 0.5, ref[i], rising(ref)[i], 1 - ep[i], ep[i], 0.1 * i) for e in ("e1", "e2") for i in range(8)]
    df = spark.createDataFrame(rows, "entity string, event_id string, bin timestamp, start timestamp, end timestamp, ep int, st int, sc double, r_ep int, r_st int, ep2 int, st2 int, sc2 double")
    streams = {"x_": ("ep", "st", "sc", "r_ep", "r_st"), "y_": ("ep2", "st2", "sc2", "r_ep", "r_st")}
    both = E.attributable_streams(df, "4H", streams)
    for p, s in streams.items():
        one = E.attributable(df, "4H", *s)
        names = [c for c in one.columns if c not in ("entity", "event_id")]
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, both.select("entity", "event_id", *[f"{p}{c}" for c in names]).collect()))
    r = both.where("event_id = 'e1'").first()
    assert r["x_best_iou"] == pytest.approx(2 / 4) and r["x_best_iou_raw"] == pytest.approx(2 / 5) and r["x_attributable_interval_count"] == 4
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 3


def test_bootstrap_never_sends_its_draws_around(spark, capsys):
    units = spark.range(3000).select(F.col("id").alias("entity"), (F.col("id") % 7).alias("hit"), F.lit(1).cast("long").alias("one"))
    ci = ST.bootstrap_ci(units, "hit", "one", 5, 1)
    ci.explain()  # 15,000 draws come from 5 rows, which Spark takes for their size
    assert "BuildLeft" not in capsys.readouterr().out
    row = ci.first()
    assert row["n_groups"] == 3000 and row["n_boot"] == 5 and row["ci_low"] <= row["ci_high"] and abs(row["value"] - 2.999) < 0.01


def test_fusion_runs_share_their_windows(spark, capsys):
    """Runs of two aggregation lengths and every mode are what the branches give alone, and add no sorts of their own."""
    from sensorwatch.config import InstabilityConfig
    from sensorwatch.operators import lanes as LN

    rng = random.Random(5)
    cells = "entity string, bin timestamp, dataset_split string, coverage_pct double, steps_sum double, motion_sum double, transitions_sum double, lying_sum double, standing_sum double"
    rows = []
    for i in range(200):
        low, wild = 0.3 if i > 120 and (i // 12) % 2 else 1.0, 3.0 if i > 110 and (i // 9) % 2 else 1.0
        rows.append(("a", T0 + dt.timedelta(hours=4 * i), "futur" if i >= 100 else "baseline", rng.choice([100.0, 60.0, 20.0]), round(rng.uniform(50, 90) * low, 2), *(round(rng.uniform(50, 90) * low * wild, 2) for _ in range(2)), round(rng.uniform(60, 90) / low, 2), round(rng.uniform(60, 90) * low, 2)))
    df = spark.createDataFrame(rows, cells)
    slow = InstabilityConfig(aggregation_hours=36.0)
    runs = SW.fusion_runs() | {"slow": (slow, FusionConfig("HIERARCHICAL")), "slow_sequence": (slow, FusionConfig("SEQUENTIAL", sequence_min_hours=8.0))}
    got = {r["bin"]: r for r in LN.fusion_lanes(df, "4H", runs, notify=True).collect()}
    fired = set()
    for k, (name, (i, f)) in enumerate(runs.items()):
        for r in FU.hybrid_warning(df, "4H", HypoConfig(), i, f).collect():
            own = got[r["bin"]]
            assert [own[f"hybrid_{x}s"][k] for x in ("episode", "start", "notification")] == [r[f"hybrid_warning_{x}"] for x in ("episode", "start", "notification")], name
            assert [own[f"instability_{x}s"][k] for x in ("episode", "start")] == [r[f"instability_warning_{x}"] for x in ("episode", "start")], name
            assert own["hybrid_scores"][k] == pytest.approx(r["hybrid_warning_score"], abs=1e-12)
            fired |= {name} if r["hybrid_warning_start"] else set()
    assert len(fired) > 5
    windows = lambda settings: (LN.fusion_lanes(df, "4H", settings).explain(), capsys.readouterr().out.count("Window ["))[1]
    capsys.readouterr()
    assert windows(SW.fusion_runs()) <= windows({"one": next(iter(runs.values()))}) + 1


def test_lanes_meet_the_untouched_run_in_tasks_by_rows(spark, capsys):
    """A known size deals the join by rows, whatever the tables' bytes; results are those without it."""
    from sensorwatch.operators import lanes as LN

    at = lambda i: T0 + dt.timedelta(hours=4 * i)
    runs = {"a": {4, 5, 6, 11}, "b": {5, 7, 8}}  # bins in an episode of lane 0; lane 1 has one bin more at its end
    lane = lambda e, i: [int(i in runs[e]), int(i in runs[e] or i - 1 in runs[e])]
    start = lambda e, i: [int(x == 1 and (i == 0 or y == 0)) for x, y in zip(lane(e, i), lane(e, i - 1), strict=True)]
    rows = [(e, f"{e}1", i, at(i), at(3), at(8), lane(e, i), start(e, i), [i / 20, i / 10]) for e in runs for i in range(14)]
    df = spark.createDataFrame(rows, "entity string, event_id string, pos int, bin timestamp, start timestamp, end timestamp, episodes array<int>, starts array<int>, scores array<double>")
    clean = spark.createDataFrame([("a", at(i), [int(i == 6)] * 2, [int(i == 6)] * 2) for i in range(14)], "entity string, bin timestamp, episodes array<int>, starts array<int>")
    measured = lambda size: LN.evaluated(df, LN.reference_lanes(clean, "4H"), "4H", ["x", "y"], size=size)
    got = {(r["event_id"], r["config"]): r.asDict() for r in measured(len(rows)).collect()}
    assert got == {(r["event_id"], r["config"]): r.asDict() for r in measured(None).collect()} and len(got) == 4
    assert [got[k]["attributable_interval_count"] for k in (("a1", "x"), ("a1", "y"), ("b1", "x"), ("b1", "y"))] == [3, 5, 3, 5]
    measured(6_000_000).explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and len(re.findall(r"hashpartitioning\(entity#\d+, bin#\d+, 100\), REPARTITION_BY_NUM", plan)) == 2
