"""Checks of joins, set operations, aggregations and statistics."""

from __future__ import annotations

import re

from oracle import base as B
from oracle import features as FX
from oracle import forest as FO
from oracle.campaign import ADJ, EVENTS, SPANS, TS, rotated
from oracle.core import BRANCH, GRID, PRED0, SPLIT

LAB = ("lab", "SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS score, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
SEGS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
UNITS = ("units", "SELECT r_name, n_name, " + ", ".join(f"round(avg(CASE WHEN c_mktsegment = '{s}' THEN c_acctbal END), 4) AS {s}" for s in SEGS)
         + ", CAST(coalesce(any_value(s), 0) > 4500 AS INTEGER) AS label FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey "
         "LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY r_name, n_name")
DIFF = ("dif", "SELECT r_name, n_name, BUILDING - MACHINERY AS diff, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS i, count(*) OVER (PARTITION BY r_name) AS n FROM units WHERE BUILDING - MACHINERY IS NOT NULL")
MASKS = ("masks", "SELECT r_name, n, unnest(generate_series(0::BIGINT, (1::BIGINT << CAST(n AS BIGINT)) - 1)) AS mask FROM (SELECT DISTINCT r_name, n FROM {src})")


def masks(src: str) -> tuple[str, str]:
    return MASKS[0], MASKS[1].format(src=src)


def auc(src: str, label: str, score: str, keys: str = "") -> str:
    """Pair counting over all positive-negative pairs."""
    g = f"{keys}, " if keys else ""
    on = f"p.{keys} = q.{keys}" if keys else "true"
    by = f" GROUP BY {keys}" if keys else ""
    return (f"SELECT {'c.' + keys + ', ' if keys else ''}n_pos, n_neg, round(w / nullif(n_pos * n_neg, 0), 6) + 0.0 AS auc FROM (SELECT {g}CAST(sum({label}) AS BIGINT) AS n_pos, CAST(sum(1 - {label}) AS BIGINT) AS n_neg FROM {src} WHERE {label} IS NOT NULL AND {score} IS NOT NULL{by}) c "
            f"LEFT JOIN (SELECT {'p.' + keys + ', ' if keys else ''}sum(CASE WHEN p.{score} > q.{score} THEN 1.0 WHEN p.{score} = q.{score} THEN 0.5 ELSE 0 END) AS w FROM {src} p JOIN {src} q ON {on} AND p.{label} = 1 AND q.{label} = 0{' GROUP BY p.' + keys if keys else ''}) x ON {'x.' + keys + ' = c.' + keys if keys else 'true'}")


RANKS = ("rnk", "SELECT *, rank() OVER (PARTITION BY r_name, segment ORDER BY score) + (count(*) OVER (PARTITION BY r_name, segment, score) - 1) / 2.0 AS rk, row_number() OVER (PARTITION BY r_name, segment ORDER BY n_name) - 1 AS i, "
                 "count(*) OVER (PARTITION BY r_name, segment) AS n, sum(label) OVER (PARTITION BY r_name, segment) AS np FROM long")
LONG = ("long", " UNION ALL ".join(f"SELECT r_name, n_name, label, '{s}' AS segment, {s} AS score FROM units WHERE {s} IS NOT NULL" for s in SEGS))
COMPLETE = ("long", " UNION ALL ".join(f"SELECT r_name, n_name, label, '{s}' AS segment, {s} AS score FROM units WHERE {' AND '.join(f'{x} IS NOT NULL' for x in SEGS)}" for s in SEGS))
PERM = ("perm", "SELECT r.r_name, r.segment, m.mask, any_value(r.n) AS n, any_value(r.np) AS np, (sum(CASE WHEN (m.mask >> r.i) & 1 = 1 THEN r.rk ELSE 0 END) - any_value(r.np) * (any_value(r.np) + 1) / 2.0) / nullif(any_value(r.np) * (any_value(r.n) - any_value(r.np)), 0) AS pa, "
                "(sum(CASE WHEN r.label = 1 THEN r.rk ELSE 0 END) - any_value(r.np) * (any_value(r.np) + 1) / 2.0) / nullif(any_value(r.np) * (any_value(r.n) - any_value(r.np)), 0) AS oa FROM rnk r JOIN masks m ON m.r_name = r.r_name AND m.n = r.n AND bit_count(m.mask) = r.np GROUP BY ALL")
GRIDRUN = ("SELECT l_tax AS mix_rate_thr, l_linenumber AS persist_hours, l_returnflag, l_quantity / 50.0 AS iou20, l_discount * 2 AS recall_any, l_discount AS leak, l_tax * 3 AS false_notif FROM lineitem")


def dist(m: str, prefix: str = "", flag: str = "") -> str:
    x = f"CASE WHEN l_returnflag = '{flag}' THEN {m} END" if flag else m
    return f"avg({x}) AS {prefix}{m}_mean, stddev_pop({x}) AS {prefix}{m}_std, quantile_cont({x}, 0.1) AS {prefix}{m}_p10, quantile_cont({x}, 0.9) AS {prefix}{m}_p90"


GSUM = [("gr", GRIDRUN), ("gs0", f"SELECT mix_rate_thr, persist_hours, count(*) AS n_runs, {dist('recall_any')}, {dist('false_notif')}, {dist('iou20', 'strong_', 'A')}, {dist('recall_any', 'borderline_', 'N')}, {dist('leak', 'hidden_', 'R')} FROM gr GROUP BY ALL"),
        ("gs1", "SELECT *, borderline_recall_any_mean AS borderline_any_mean, hidden_leak_p90 AS hidden_leak_any_p90, hidden_leak_mean AS hidden_leak_any_mean FROM gs0"),
        ("gs", "SELECT *, CAST(strong_iou20_p10 >= 0.10 AND borderline_any_mean >= 0.10 AND hidden_leak_any_p90 <= 0.095 AND false_notif_p90 <= 0.20 AS INTEGER) AS robust_pass, "
               "coalesce(nullif(concat_ws(' | ', CASE WHEN strong_iou20_p10 < 0.10 THEN printf('strong_iou20_p10 %.3f < 0.100', strong_iou20_p10) END, CASE WHEN borderline_any_mean < 0.10 THEN printf('borderline_any_mean %.3f < 0.100', borderline_any_mean) END, "
               "CASE WHEN hidden_leak_any_p90 > 0.095 THEN printf('hidden_leak_any_p90 %.3f > 0.095', hidden_leak_any_p90) END, CASE WHEN false_notif_p90 > 0.20 THEN printf('false_notif_p90 %.3f > 0.200', false_notif_p90) END), ''), 'OK') AS go_reason, "
               "0.6 * strong_iou20_mean + 0.2 * borderline_any_mean + 0.1 * recall_any_mean - 0.25 * hidden_leak_any_mean - 0.3 * false_notif_mean - 0.1 * false_notif_std AS selection_score FROM gs1")]
GCOLS = [f"{p}{m}_{k}" for p, m in (("", "recall_any"), ("", "false_notif"), ("strong_", "iou20"), ("borderline_", "recall_any"), ("hidden_", "leak")) for k in ("mean", "std", "p10", "p90")] + ["borderline_any_mean", "hidden_leak_any_p90", "hidden_leak_any_mean", "selection_score"]


def version(flag: str, scale: float, extra: str = "") -> str:
    w = "l_discount > 0.02" if flag == "O" else "l_discount < 0.09"
    return f"SELECT l_tax, l_discount, CAST(avg(l_quantity) > 25.5 AS INTEGER) AS ok, avg(l_quantity) * {scale} AS score FROM lineitem WHERE l_linestatus = '{flag}' AND {w}{extra} GROUP BY ALL"


V = [("va", version("O", 1.0)), ("vb", version("F", 1.0)), ("vc", version("F", 2.0, " AND l_tax > 0.03"))]
R6 = lambda c, a=None: f"round({c}, 6) + 0.0 AS {a or c}"
SEG = lambda flag: f"SELECT entity, min(bin) AS s, max(bin) AS e FROM (SELECT entity, bin, pos - row_number() OVER (PARTITION BY entity ORDER BY bin) AS isle FROM fus WHERE {flag} = 1) GROUP BY entity, isle"
HOURLY = [B.RAW, *B.grid(60), ("hr", "SELECT c.entity, c.bin, f.transitions AS x FROM grid_cal c LEFT JOIN (SELECT entity, time_bucket(INTERVAL 60 MINUTES, t) AS bin, arg_min(transitions, seq) AS transitions FROM raw GROUP BY ALL) f USING (entity, bin)")]


def acf(src: str, lag: int) -> list[tuple[str, str]]:
    return [
        ("ac0", f"SELECT entity, x - avg(x) OVER (PARTITION BY entity) AS xc, row_number() OVER (PARTITION BY entity ORDER BY bin) AS i FROM {src}"),
        ("ac1", "SELECT entity, count(xc) AS n_obs, avg(xc * xc) AS v FROM ac0 GROUP BY entity"),
        ("ac2", f"SELECT a.entity, k.k AS lag, CASE WHEN count(a.xc * b.xc) >= 30 THEN avg(a.xc * b.xc) END AS c FROM ac0 a CROSS JOIN (SELECT unnest(range(1, {lag + 1})) AS k) k LEFT JOIN ac0 b ON b.entity = a.entity AND b.i = a.i + k.k GROUP BY ALL"),
        ("acf", "SELECT ac1.entity, n_obs, CAST(lag AS INTEGER) AS lag, CASE WHEN v > 0 THEN c / v END AS rho FROM ac1 JOIN ac2 USING (entity)"),
    ]


ERF = ("(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x))")
LOFC = [f"{s}_sum" for s in B.SIGNALS]
SCALED = ("scl", "SELECT *, " + ", ".join(f"({c} - m_{c}) / CASE WHEN w_{c} > 0 THEN w_{c} ELSE 1.0 END AS {c}_scaled" for c in LOFC) + " FROM (SELECT *, dataset_split = 'baseline' AS tr, " + ", ".join(
    f"quantile_cont(CASE WHEN dataset_split = 'baseline' THEN {c} END, 0.5) OVER (PARTITION BY entity) AS m_{c}, quantile_cont(CASE WHEN dataset_split = 'baseline' THEN {c} END, 0.9) OVER (PARTITION BY entity) - quantile_cont(CASE WHEN dataset_split = 'baseline' THEN {c} END, 0.1) OVER (PARTITION BY entity) AS w_{c}" for c in LOFC) + " FROM spl)")
DIST = "sqrt(" + " + ".join(f"power(a.{c}_scaled - b.{c}_scaled, 2)" for c in LOFC) + ")"


def local_outliers(dist: str) -> list[tuple[str, str]]:
    """Local outlier factor of the scaled rows ``scl`` against training rows, as ``fin`` (raw, cut)."""
    return [("inn", f"SELECT * FROM (SELECT a.entity, a.pos, b.pos AS near, {dist} AS d, row_number() OVER (PARTITION BY a.entity, a.pos ORDER BY {dist}, b.pos) AS k FROM scl a JOIN scl b ON a.entity = b.entity AND a.tr AND b.tr AND a.pos <> b.pos) WHERE k <= 20"),
        ("kd", "SELECT entity, pos, max(d) AS kd FROM inn GROUP BY ALL"),
        ("lrd", "SELECT i.entity, i.pos, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM inn i JOIN kd ON kd.entity = i.entity AND kd.pos = i.near GROUP BY ALL"),
        ("outr", f"SELECT * FROM (SELECT a.entity, a.pos, b.pos AS near, {dist} AS d, row_number() OVER (PARTITION BY a.entity, a.pos ORDER BY {dist}, b.pos) AS k FROM scl a JOIN scl b ON a.entity = b.entity AND b.tr) WHERE k <= 20"),
        ("mine", "SELECT i.entity, i.pos, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS mine, avg(lrd) AS around FROM outr i JOIN kd ON kd.entity = i.entity AND kd.pos = i.near JOIN lrd ON lrd.entity = i.entity AND lrd.pos = i.near GROUP BY ALL"),
        ("own", "SELECT i.entity, i.pos, 0.0 - avg(n.lrd) / any_value(m.lrd) AS own FROM inn i JOIN lrd n ON n.entity = i.entity AND n.pos = i.near JOIN lrd m ON m.entity = i.entity AND m.pos = i.pos GROUP BY ALL"),
        ("fin", "SELECT s.*, 0.0 - around / mine AS raw, quantile_cont(CASE WHEN s.tr THEN own END, 0.06) OVER (PARTITION BY s.entity) AS cut FROM scl s JOIN mine USING (entity, pos) LEFT JOIN own USING (entity, pos)")
    ]


RRZ = [c + "_rrz" for c in LOFC]
SCALED_RRZ = (SCALED[0], re.sub("|".join(LOFC), lambda m: m[0] + "_rrz", SCALED[1]))
DIST_RRZ = re.sub("|".join(LOFC), lambda m: m[0] + "_rrz", DIST)
LOF_SCORED = ("scored", "SELECT *, CASE WHEN coverage_pct >= 25 THEN raw - cut END AS if_score, CAST(coalesce(coverage_pct >= 25 AND raw - cut < 0, false) AS INTEGER) AS if_anomaly_point FROM fin")

CUST = ("cu", "SELECT c_nationkey, c_custkey, round(c_acctbal - 4500, 2) AS diff, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS label, c_acctbal FROM customer")


def counted(ranks: str, limit: str, placed: bool) -> str:
    """Null distribution of rank sums by adding one unit at a time: (g, s, c) with c the chance of sum s."""
    pick = ", k + take AS k" if placed else ""
    return (f"dp(g, i, k, s, c) AS (SELECT DISTINCT g, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM ({ranks}) UNION ALL "
            f"SELECT d.g, d.i + 1, d.k + {'v.take' if placed else '0'}, d.s + v.take * r.r, sum(d.c) / 2 FROM dp d JOIN ({ranks}) r ON r.g = d.g AND r.i = d.i + 1 CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) v(take) "
            f"{limit} GROUP BY 1, 2, 3, 4)")


W_RANKS = ("SELECT c_nationkey AS g, CAST(2 * rank() OVER (PARTITION BY c_nationkey ORDER BY abs(diff)) + count(*) OVER (PARTITION BY c_nationkey, abs(diff)) - 1 AS BIGINT) AS r, "
           "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, diff FROM cu WHERE diff <> 0")
P_RANKS = ("SELECT c_nationkey AS g, CAST(2 * rank() OVER (PARTITION BY c_nationkey ORDER BY diff) + count(*) OVER (PARTITION BY c_nationkey, diff) - 1 AS BIGINT) AS r, "
           "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, label, sum(label) OVER (PARTITION BY c_nationkey) AS np FROM cu")
ISOTONIC = (
    "WITH lab AS (SELECT d.doc_id, d.source, CAST(d.n_chars AS DOUBLE) AS score, l.quality FROM documents d JOIN labels l USING (doc_id)), "
    "fo AS (SELECT source, CAST((row_number() OVER (ORDER BY count(*) DESC, source) - 1) % 5 AS INTEGER) AS fold FROM lab GROUP BY source), "
    "x AS MATERIALIZED (SELECT lab.*, fold FROM lab JOIN fo USING (source)), "
    "t AS (SELECT f.fold, x.score, sum(quality) AS y, count(*) AS w FROM (SELECT DISTINCT fold FROM fo) f JOIN x ON x.fold <> f.fold GROUP BY 1, 2), "
    "p AS MATERIALIZED (SELECT *, row_number() OVER v AS i, sum(y) OVER v AS cy, sum(w) OVER v AS cw FROM t WINDOW v AS (PARTITION BY fold ORDER BY score)), "
    "m AS (SELECT a.fold, a.i AS j, b.i, min((b.cy - a.cy + a.y) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.fold, a.i ORDER BY b.i DESC) AS lo FROM p a JOIN p b ON a.fold = b.fold AND a.i <= b.i), "
    "g AS MATERIALIZED (SELECT p.fold, p.score, max(lo) AS v FROM m JOIN p USING (fold, i) GROUP BY 1, 2), "
    "n AS (SELECT x.doc_id, x.source, x.score, x.quality, x.fold, max(g.score) FILTER (WHERE g.score <= x.score) AS s0, min(g.score) FILTER (WHERE g.score >= x.score) AS s1 FROM x JOIN g USING (fold) GROUP BY ALL) "
    "SELECT n.doc_id, n.source, n.score, n.quality, n.fold, round(CASE WHEN s0 IS NULL THEN b.v WHEN s1 IS NULL OR s0 = s1 THEN a.v ELSE a.v + (b.v - a.v) * (n.score - s0) / (s1 - s0) END, 6) + 0.0 AS probability "
    "FROM n LEFT JOIN g a ON a.fold = n.fold AND a.score = s0 LEFT JOIN g b ON b.fold = n.fold AND b.score = s1"
)
LARGE = {
    "d08_local_outliers_with_rules": B.sql("SELECT entity, CAST(sum(if_anomaly_point) AS BIGINT) AS anomalies, CAST(sum(pred_lameness_episode) AS BIGINT) AS episode_bins, CAST(sum(notif_lameness) AS BIGINT) AS notifications FROM rul GROUP BY entity",
        *PRED0, SCALED_RRZ, *local_outliers(DIST_RRZ), LOF_SCORED, *FX.rules()),
    "x04_isotonic_out_of_fold": ISOTONIC,
    "x06_wilcoxon_large_groups": f"WITH RECURSIVE cu AS ({CUST[1]}), rk AS MATERIALIZED ({W_RANKS}), {counted('SELECT g, i, r FROM rk', '', False)}, "
    "o AS (SELECT g, count(*) AS n, sum(CAST(diff > 0 AS INTEGER)) AS np, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w, sum(r) AS t FROM rk GROUP BY g) "
    "SELECT o.g AS c_nationkey, CAST(o.n AS INTEGER) AS n_informative, CAST(o.np AS INTEGER) AS n_positive, round(o.w / 2.0, 6) + 0.0 AS w_plus, "
    "round(least(1.0, sum(CASE WHEN abs(2 * d.s - o.t) >= abs(2 * o.w - o.t) THEN d.c ELSE 0 END)), 6) + 0.0 AS p_value, 'exact' AS method FROM o JOIN dp d ON d.g = o.g AND d.i = o.n GROUP BY o.g, o.n, o.np, o.w, o.t",
    "x09_permutation_auc_large_groups": f"WITH RECURSIVE cu AS ({CUST[1]}), rk AS MATERIALIZED ({P_RANKS}), {counted('SELECT g, i, r, np FROM rk', 'WHERE d.k + v.take <= r.np', True)}, "
    "o AS (SELECT g, count(*) AS n, any_value(np) AS np, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS w FROM rk GROUP BY g), "
    "f AS (SELECT o.*, d.s, d.c, sum(d.c) OVER (PARTITION BY o.g) AS al FROM o JOIN dp d ON d.g = o.g AND d.i = o.n AND d.k = o.np) "
    "SELECT g AS c_nationkey, CAST(n AS INTEGER) AS n, CAST(np AS INTEGER) AS n_pos, round((w / 2.0 - np * (np + 1) / 2.0) / (np * (n - np)), 6) + 0.0 AS auc, "
    "CASE WHEN np > 0 AND np < n THEN round(sum(CASE WHEN s >= w THEN c ELSE 0 END) / any_value(al), 6) + 0.0 END AS p_one_sided, CASE WHEN np > 0 AND np < n THEN round(least(1.0, sum(CASE WHEN abs(s - np * (n + 1)) >= abs(w - np * (n + 1)) THEN c ELSE 0 END) / any_value(al)), 6) + 0.0 END AS p_two_sided, "
    "'exact' AS method FROM f GROUP BY g, n, np, w",
    # |t| beyond the 5 % point: the rejection is checked against tabled quantiles by series around the normal one
    "x12_spearman_p_value": f"WITH cu AS ({CUST[1]}), r AS (SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0 AS b FROM cu), "
    "g AS (SELECT c_nationkey, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1), "
    "q AS (SELECT *, n - 2 AS f, 1.959963984540054 AS z FROM g) "
    "SELECT c_nationkey, n, round(rho, 6) + 0.0 AS rho, CASE WHEN abs(rho) < 1 - 1e-9 THEN CAST(abs(rho) * sqrt(f / (1 - rho * rho)) > z + (pow(z, 3) + z) / (4 * f) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * f * f) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * f * f * f) AS INTEGER) END AS reject FROM q",
}

CHECKS: dict[str, str] = {
    "x01_auc_global": B.sql(auc("lab", "quality", "score"), LAB),
    "x01_auc_by_stratum": B.sql(auc("lab", "quality", "score", "lang"), LAB),
    "x02_average_precision": B.sql("SELECT lang, round(sum(p / nullif(tot, 0) * tp / (tp + fp)), 6) + 0.0 AS average_precision, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg FROM (SELECT lang, p, q, sum(p) OVER (PARTITION BY lang) AS tot, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM "
        "(SELECT lang, score, sum(quality) AS p, sum(1 - quality) AS q FROM lab GROUP BY ALL) WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY lang", LAB),
    "x03_clustered_bootstrap": B.sql("SELECT round((SELECT sum(a) / sum(b) FROM s), 6) AS value, (SELECT count(*) FROM s) AS n_groups, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, count(*) AS n_boot FROM "
        "(SELECT rep, sum(p.a) / sum(p.b) AS m FROM s CROSS JOIN (SELECT unnest(range(10000)) AS rep) JOIN s p ON p.i = CAST('0x' || substr(sha256('42|' || rep || '|' || s.i), 1, 8) AS BIGINT) % (SELECT count(*) FROM s) GROUP BY rep)",
        ("s", "SELECT row_number() OVER (ORDER BY l_suppkey) - 1 AS i, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS a, count(*) AS b FROM lineitem GROUP BY l_suppkey")),
    "x07_paired_mean_difference": B.sql("SELECT round((SELECT sum(a) / sum(b) FROM s), 6) AS value, (SELECT count(*) FROM s) AS n_groups, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, count(*) AS n_boot FROM "
        "(SELECT rep, sum(p.a) / sum(p.b) AS m FROM s CROSS JOIN (SELECT unnest(range(10000)) AS rep) JOIN s p ON p.i = CAST('0x' || substr(sha256('42|' || rep || '|' || s.i), 1, 8) AS BIGINT) % (SELECT count(*) FROM s) GROUP BY rep)",
        UNITS, DIFF, ("s", "SELECT row_number() OVER (ORDER BY n_name) - 1 AS i, diff AS a, 1 AS b FROM dif")),
    "x05_brier_and_ece": B.sql("SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS brier, round(sum(n * abs(y - pm)) / sum(n), 6) AS ece FROM (SELECT lang, least(floor(p * 10), 9) AS b, count(*) AS n, avg(quality) AS y, avg(p) AS pm, sum((p - quality) * (p - quality)) AS s FROM (SELECT *, score / (score + 1000.0) AS p FROM lab) GROUP BY ALL) GROUP BY lang", LAB),
    "x06_x07_wilcoxon_rank_biserial": B.sql("SELECT r_name, CAST(n AS INTEGER) AS n_informative, CAST(npos AS INTEGER) AS n_positive, round(wp, 6) AS w_plus, round(avg(CASE WHEN abs(w - tot / 2) >= abs(wp - tot / 2) - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p_value, round(least(1.0, 2.0 / power(2, n)), 6) AS p_floor, round((2 * wp - tot) / tot, 6) + 0.0 AS rank_biserial FROM "
        "(SELECT k.r_name, m.mask, any_value(k.n) AS n, sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) AS npos, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS wp, sum(rk) AS tot, sum(CASE WHEN (m.mask >> k.i) & 1 = 1 THEN rk ELSE 0 END) AS w FROM sr k JOIN masks m USING (r_name) GROUP BY k.r_name, m.mask) GROUP BY ALL", UNITS, DIFF,
        ("sr", "SELECT r_name, diff, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS i, count(*) OVER (PARTITION BY r_name) AS n, rank() OVER (PARTITION BY r_name ORDER BY round(abs(diff), 12)) + (count(*) OVER (PARTITION BY r_name, round(abs(diff), 12)) - 1) / 2.0 AS rk FROM dif WHERE diff <> 0"), masks("sr")),
    "x08_sign_flip": B.sql("SELECT r_name, CAST(n AS INTEGER) AS n, round(o, 6) + 0.0 AS mean_difference, round(avg(CASE WHEN f >= o - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p_one_sided, round(avg(CASE WHEN abs(f) >= abs(o) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p_two_sided FROM "
        "(SELECT k.r_name, m.mask, any_value(k.n) AS n, avg(diff) AS o, avg(CASE WHEN (m.mask >> k.i) & 1 = 1 THEN diff ELSE 0.0 - diff END) AS f FROM dif k JOIN masks m USING (r_name) GROUP BY k.r_name, m.mask) GROUP BY r_name, n, round(o, 6)", UNITS, DIFF, masks("dif")),
    "x09_permutation_auc": B.sql("SELECT r_name, CAST(n AS INTEGER) AS n, CAST(np AS INTEGER) AS n_pos, round(any_value(oa), 6) AS auc, round(avg(CASE WHEN pa >= oa - 1e-12 THEN 1.0 WHEN pa IS NOT NULL THEN 0.0 END), 6) AS p_one_sided, round(avg(CASE WHEN abs(pa - 0.5) >= abs(oa - 0.5) - 1e-12 THEN 1.0 WHEN pa IS NOT NULL THEN 0.0 END), 6) AS p_two_sided, count(*) AS n_permutations FROM perm WHERE segment = 'BUILDING' GROUP BY r_name, n, np", UNITS, LONG, RANKS, masks("rnk"), PERM),
    "x10_max_stat_multiplicity": B.sql("SELECT b.r_name, round(any_value(o.oa), 6) AS observed_auc, round(avg(CASE WHEN m1 >= o.oa - 1e-12 THEN 1.0 WHEN m1 IS NOT NULL THEN 0.0 END), 6) AS p_one_sided, round(avg(CASE WHEN m2 >= abs(o.oa - 0.5) - 1e-12 THEN 1.0 WHEN m2 IS NOT NULL THEN 0.0 END), 6) AS p_two_sided, count(*) AS n_permutations, 'exact' AS method, any_value(t.nt) AS n_tests, any_value(t.nu) AS n_unique_score_vectors FROM "
        "(SELECT r_name, mask, max(pa) AS m1, max(abs(pa - 0.5)) AS m2 FROM perm GROUP BY ALL) b JOIN (SELECT r_name, any_value(oa) AS oa FROM perm WHERE segment = 'BUILDING' GROUP BY r_name) o USING (r_name) "
        "JOIN (SELECT r_name, count(*) AS nt, count(DISTINCT v) AS nu FROM (SELECT r_name, segment, list(score ORDER BY n_name) AS v FROM long GROUP BY ALL) GROUP BY r_name) t USING (r_name) GROUP BY b.r_name", UNITS, COMPLETE, RANKS, masks("rnk"), PERM),
    "x11_mann_whitney": B.sql("SELECT lang, round(u, 6) AS u, n_pos, n_neg, round(mp, 6) AS mean_pos, round(mn, 6) AS mean_neg, round(" + ERF + ", 6) AS p_normal FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM (SELECT *, greatest(abs(u - n_pos * n_neg / 2.0) - 0.5, 0) / sqrt(n_pos * n_neg / 12.0 * (n_pos + n_neg + 1 - ties / ((n_pos + n_neg) * (n_pos + n_neg - 1)))) / sqrt(2.0) AS x FROM "
        "(SELECT lang, CAST(sum(quality) AS BIGINT) AS n_pos, CAST(sum(1 - quality) AS BIGINT) AS n_neg, avg(CASE WHEN quality = 1 THEN score END) AS mp, avg(CASE WHEN quality = 0 THEN score END) AS mn, sum(CASE WHEN quality = 1 THEN rk ELSE 0 END) - sum(quality) * (sum(quality) + 1) / 2.0 AS u, sum(c * c - 1.0) AS ties FROM "
        "(SELECT *, count(*) OVER (PARTITION BY lang, score) AS c, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM lab) GROUP BY lang)))", LAB),
    "x12_spearman": "SELECT l_returnflag, n, round(rho, 6) AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 6) AS t FROM (SELECT l_returnflag, count(*) AS n, corr(a, b) AS rho FROM (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, "
        "rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) GROUP BY l_returnflag)",
    "x13_fisher_exact": B.sql("SELECT lang, a, b, c, d, round(least(1.0, sum(CASE WHEN p <= o * (1 + 1e-7) THEN p ELSE 0 END)), 6) AS p_value FROM (SELECT *, max(CASE WHEN x = a THEN p END) OVER (PARTITION BY lang) AS o FROM (SELECT *, exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1)) AS p FROM "
        "(SELECT *, unnest(generate_series(greatest(0, r + k - n), least(r, k))) AS x FROM (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS n FROM (SELECT lang, CAST(count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS INTEGER) AS a, CAST(count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS INTEGER) AS b, CAST(count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS INTEGER) AS c, CAST(count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END) AS INTEGER) AS d FROM lab GROUP BY lang))))) GROUP BY lang, a, b, c, d", LAB),
    "x14_leave_one_positive_out": B.sql("SELECT lang, round(min(a), 6) AS auc_min, round(max(a), 6) AS auc_max FROM (SELECT h.lang, h.doc_id, (SELECT avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) FROM lab p JOIN lab q ON p.lang = q.lang WHERE p.lang = h.lang AND p.doc_id <> h.doc_id AND p.quality = 1 AND q.quality = 0) AS a FROM lab h WHERE h.quality = 1) GROUP BY lang", LAB),
    "x15_holm": "SELECT l_returnflag, l_linenumber, round(p, 6) AS p, round(least(1.0, max(st) OVER (PARTITION BY l_returnflag ORDER BY p, l_linenumber ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM (SELECT *, (count(*) OVER (PARTITION BY l_returnflag) - row_number() OVER (PARTITION BY l_returnflag ORDER BY p, l_linenumber) + 1) * p AS st FROM (SELECT l_returnflag, l_linenumber, avg(l_discount) / (max(l_linenumber) * 3) AS p FROM lineitem GROUP BY l_returnflag, l_linenumber))",
    "x16_autocorrelation": B.sql("SELECT entity, n_obs, lag, round(rho, 6) + 0.0 AS rho FROM acf", *HOURLY, *acf("hr", 192)),
    "x16_correlation_time": B.sql("SELECT entity, n_obs, coalesce(te, 192.0)::DOUBLE AS tau_e, round(ti, 6) AS tau_int, round(n_obs / ti, 6) AS n_eff FROM (SELECT entity, n_obs, min(CASE WHEN rho < exp(-1) THEN lag END) AS te, greatest(1.0, 1.0 + 2.0 * coalesce(sum(CASE WHEN lag < coalesce(st, 999) THEN rho END), 0)) AS ti FROM "
        "(SELECT *, min(CASE WHEN rho IS NULL OR rho <= 0 THEN lag END) OVER (PARTITION BY entity) AS st FROM acf) GROUP BY ALL)", *GRID, ("rl", f"SELECT entity, bin, {B.rolling_total('steps_sum', 3, least=3)} AS x FROM grid"), *acf("rl", 192)),
    "x17_isolation_forest": B.sql(f"SELECT entity, {TS('bin')}, round(if_score, 6) + 0.0 AS if_score, if_anomaly_point FROM forest", *SPLIT,
        ("bins", "SELECT entity, bin, pos, coverage_pct, CAST(dataset_split = 'baseline' AS INTEGER) AS train_point, " + ", ".join(f"{x}_sum" for x in B.SIGNALS) + " FROM spl"),
        *FO.scores("bins", "forest", [f"{x}_sum" for x in ("steps", "motion", "lying", "standing", "transitions")])),
    "x18_local_outlier_factor": B.sql(f"SELECT entity, {TS('bin')}, round(CASE WHEN coverage_pct >= 25 THEN raw - cut END, 6) + 0.0 AS if_score, CAST(coalesce(coverage_pct >= 25 AND raw - cut < 0, false) AS INTEGER) AS if_anomaly_point FROM fin", *SPLIT, SCALED, *local_outliers(DIST)),
    "x19_robust_scaling": B.sql(f"SELECT entity, {TS('bin')}, {R6('steps_sum_scaled')}, {R6('lying_sum_scaled')} FROM scl", *SPLIT, SCALED),
    "x20_tolerant_table_diff": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '1%' THEN '<row>' WHEN o_orderpriority LIKE '2%' THEN 'o_totalprice' ELSE 'o_orderpriority' END AS \"column\" FROM orders WHERE (o_orderstatus = 'P' AND o_orderpriority LIKE '1%') OR (o_orderpriority LIKE '2%' AND 10 > 1e-8 + 1e-7 * (o_totalprice + 10)) OR (o_orderstatus = 'F' AND o_orderpriority LIKE '3%')",
    "j01_left_with_exclusions": "SELECT d.doc_id, lang, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic, CASE WHEN quality IS NULL THEN 'score_absent' END AS exclusion_reason FROM documents d LEFT JOIN labels l USING (doc_id)",
    "j02_dimension_map": "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 6) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "j03_one_to_one_reconciliation": "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, round(round(sum(l_extendedprice), 2), 6) AS items, count(*) AS n_items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice",
    "j04_d16_two_version_comparison": B.sql(f"SELECT l_tax, l_discount, CASE WHEN a.ok IS NULL THEN 0 ELSE 1 END AS in_v4, CAST(a.ok AS DOUBLE) AS ok_v4, {R6('a.score', 'score_v4')}, CASE WHEN b.ok IS NULL THEN 0 ELSE 1 END AS in_v5, CAST(b.ok AS DOUBLE) AS ok_v5, {R6('b.score', 'score_v5')}, CAST(CAST(a.ok = b.ok AS INTEGER) AS DOUBLE) AS agree_v4_v5, {R6('b.score - a.score', 'delta_v4_v5')}, "
        "CASE WHEN a.ok IS NULL THEN 'right_only' WHEN b.ok IS NULL THEN 'left_only' ELSE 'both' END AS presence FROM va a FULL JOIN vb b USING (l_tax, l_discount)", *V),
    "j05_d16_three_version_comparison": B.sql("SELECT l_tax, l_discount, " + ", ".join(f"CASE WHEN {t}.ok IS NULL THEN 0 ELSE 1 END AS in_{n}, CAST({t}.ok AS DOUBLE) AS ok_{n}, {R6(t + '.score', 'score_' + n)}" for t, n in (("va", "v4"), ("vb", "v5"), ("vc", "v6")))
        + ", " + ", ".join(f"CAST(CAST({x}.ok = {y}.ok AS INTEGER) AS DOUBLE) AS agree_{m}_{n}, {R6(f'{y}.score - {x}.score', f'delta_{m}_{n}')}" for x, y, m, n in (("va", "vb", "v4", "v5"), ("va", "vc", "v4", "v6"), ("vb", "vc", "v5", "v6")))
        + ", CAST(CAST(va.ok = vb.ok AND va.ok = vc.ok AS INTEGER) AS DOUBLE) AS agree_all FROM va FULL JOIN vb USING (l_tax, l_discount) FULL JOIN vc USING (l_tax, l_discount)", *V),
    "j07_metric_assembly": B.sql("SELECT entity, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN coalesce({s}, 0) > 0 THEN 1.0 ELSE 0.0 END), 6) AS {s}_nonzero, round(stddev_samp({s}), 6) AS {s}_std" for s in ("steps", "motion")) + ", round((epoch(date_trunc('second', max(t))) - epoch(date_trunc('second', min(t)))) / 86400, 6) AS span_days FROM raw GROUP BY entity", B.RAW),
    "j08_reference_lookup_last_wins": B.sql("SELECT p.entity, CAST(count(CASE WHEN behavioral_warning_episode = 1 AND coalesce(ep, 0) <> 1 THEN 1 END) AS BIGINT) AS attributable, CAST(sum(coalesce(ep, 0)) AS BIGINT) AS ref_bins, CAST(sum(coalesce(st, 0)) AS BIGINT) AS ref_starts FROM fus p LEFT JOIN "
        "(SELECT entity, time_bucket(INTERVAL 4 HOUR, t) AS bin, CAST(arg_max(coalesce(steps, 0) > 50, seq) AS INTEGER) AS ep, CAST(arg_max(coalesce(motion, 0) > 50, seq) AS INTEGER) AS st FROM raw GROUP BY ALL) r USING (entity, bin) GROUP BY p.entity", *BRANCH),
    "j09_readings_in_windows": B.sql("SELECT g.entity, g.event_id, count(*) AS n, round(sum(steps), 6) AS steps FROM gplan g JOIN raw r ON r.entity = g.entity AND r.t BETWEEN g.start AND g.\"end\" GROUP BY ALL", *SPLIT, SPANS, *rotated()),
    "j10_no_neighbour_within_tolerance": B.sql(f"SELECT entity, {TS('t')}, seq FROM raw p WHERE lying IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw o WHERE o.entity = p.entity AND o.standing IS NOT NULL AND abs(epoch_us(o.t) - epoch_us(p.t)) <= 3600000000)", B.RAW),
    "j11_interval_overlap_best_iou": B.sql(f"SELECT a.entity, {TS('a.s', 'start')}, {TS('a.e', chr(34) + 'end' + chr(34))}, round(coalesce(max(i / (epoch(a.e) - epoch(a.s) + epoch(b.e) - epoch(b.s) + 28800 - i)), 0), 6) + 0.0 AS best_iou FROM sa a LEFT JOIN (SELECT x.entity, x.s AS xs, y.s, y.e, epoch(least(x.e, y.e)) - epoch(greatest(x.s, y.s)) + 14400 AS i FROM sa x JOIN sb y ON x.entity = y.entity AND x.s <= y.e AND y.s <= x.e) b ON b.entity = a.entity AND b.xs = a.s GROUP BY a.entity, a.s, a.e",
        *BRANCH, ("sa", SEG("behavioral_warning_episode")), ("sb", SEG("instability_warning_episode"))),
    "m11_overlap_seconds_and_iou": "SELECT l_orderkey, l_linenumber, CAST(i AS DOUBLE) AS overlap, round(CASE WHEN i > 0 THEN i / (61 * 86400 + 11 * 86400 - i) ELSE 0 END, 6) + 0.0 AS iou FROM (SELECT l_orderkey, l_linenumber, CASE WHEN least(o_orderdate + INTERVAL 60 DAY, l_shipdate + INTERVAL 10 DAY) < greatest(o_orderdate, l_shipdate) THEN 0 ELSE epoch(least(o_orderdate + INTERVAL 60 DAY, l_shipdate + INTERVAL 10 DAY)) - epoch(greatest(o_orderdate, l_shipdate)) + 86400 END AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "j12_semi_and_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'focus' ELSE 'dropped' END AS kind FROM customer",
    "j13_notifications_outside_windows": B.sql("SELECT p.entity, count(*) AS outside, count(DISTINCT CAST(bin AS DATE)) AS days FROM fus p WHERE hybrid_warning_notification = 1 AND NOT EXISTS (SELECT 1 FROM gplan g WHERE g.entity = p.entity AND p.bin BETWEEN g.start AND g.\"end\") GROUP BY p.entity", *BRANCH, SPANS, *rotated()),
    "j14_config_grid": B.sql("SELECT cov, level, CAST(count(CASE WHEN coverage_pct >= cov AND steps_sum >= level THEN 1 END) AS BIGINT) AS n FROM grid CROSS JOIN (VALUES (25.0::DOUBLE), (50.0::DOUBLE), (75.0::DOUBLE)) a(cov) CROSS JOIN (VALUES (20.0::DOUBLE), (60.0::DOUBLE)) b(level) GROUP BY ALL", *GRID),
    "j17_pareto_frontier": B.sql("SELECT * FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.gain >= a.gain AND b.cost1 <= a.cost1 AND b.cost2 <= a.cost2 AND (b.gain > a.gain OR b.cost1 < a.cost1 OR b.cost2 < a.cost2))",
        ("g", "SELECT l_suppkey, round(avg(l_quantity), 1) AS gain, round(avg(l_discount), 3) AS cost1, round(avg(l_tax), 3) AS cost2 FROM lineitem GROUP BY l_suppkey")),
    "j18_a28_completed_contingency": B.sql("SELECT s.lang, count(CASE WHEN quality = 0 THEN 1 END) AS n0, count(CASE WHEN quality = 1 THEN 1 END) AS n1 FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('xx')) s(lang) LEFT JOIN lab USING (lang) GROUP BY s.lang", LAB),
    "j20_attach_reason_by_event": B.sql("SELECT event_id, scenario, CASE WHEN episode_overlap = 0 THEN 'missed' ELSE 'covered' END AS reason FROM ev", *EVENTS),
    "a15_distribution_stats": "SELECT l_returnflag, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std, round(quantile_cont({m}, 0.1), 6) AS {m}_p10, round(quantile_cont({m}, 0.9), 6) AS {m}_p90" for m in ("l_quantity", "l_discount")) + " FROM lineitem GROUP BY l_returnflag",
    "a16_m08_m09_grid_summary_with_verdict": B.sql("SELECT mix_rate_thr, persist_hours, n_runs, robust_pass, go_reason, " + ", ".join(R6(c) for c in GCOLS) + " FROM gs", *GSUM),
    "a17_reference_choice": B.sql("SELECT mix_rate_thr, persist_hours, CASE tier WHEN 0 THEN 'user_cfg' WHEN 1 THEN 'auto_balanced' WHEN 2 THEN 'auto_quality_safe' ELSE 'auto_conservative' END AS ref_source FROM (SELECT *, CASE WHEN bal AND abs(mix_rate_thr - 0.08) < 1e-9 AND persist_hours = 1 THEN 0 WHEN bal THEN 1 WHEN false_notif_p90 <= 0.30 THEN 2 ELSE 3 END AS tier FROM "
        "(SELECT *, strong_iou20_p10 >= 0.10 AND borderline_any_mean >= 0.10 AND false_notif_p90 <= 0.20 AS bal FROM gs)) ORDER BY tier, CASE WHEN tier < 3 THEN false_notif_p90 ELSE -mix_rate_thr END, CASE WHEN tier < 3 THEN hidden_leak_any_p90 ELSE -persist_hours END, -borderline_any_mean, -strong_iou20_mean, mix_rate_thr, persist_hours LIMIT 1", *GSUM),
    "a18_scenario_report": B.sql("SELECT scenario, count(*) AS n_events, CAST(sum(expected) AS BIGINT) AS n_expected_detected, round(avg(detected_any_overlap), 6) AS detected_any_overlap_mean, round(avg(detected_iou20), 6) AS detected_iou20_mean, round(avg(best_iou), 6) + 0.0 AS best_iou_mean FROM ev GROUP BY scenario", *EVENTS),
    "a22_collapsed_configs": B.sql("SELECT c.l_tax, c.l_linenumber, n_variants, c.ok, round(c.score, 6) AS score, CASE WHEN c.ok = 1 THEN 'OK' ELSE w.why END AS why FROM (SELECT l_tax, l_linenumber, count(*) AS n_variants, max(ok) AS ok, max(score) AS score FROM cfg GROUP BY ALL) c JOIN "
        "(SELECT l_tax, l_linenumber, string_agg(why, ' | ' ORDER BY f, why) AS why FROM (SELECT *, row_number() OVER (PARTITION BY l_tax, l_linenumber ORDER BY f, why) AS r FROM (SELECT l_tax, l_linenumber, why, min(seq) AS f FROM cfg GROUP BY ALL)) WHERE r <= 2 GROUP BY ALL) w USING (l_tax, l_linenumber)",
        ("cfg", "SELECT l_tax, l_linenumber, CASE WHEN l_linenumber < 4 THEN CAST(l_quantity >= 50 AS INTEGER) ELSE 0 END AS ok, l_extendedprice AS score, 'flag ' || l_returnflag AS why, l_orderkey * 10 + l_linenumber AS seq FROM lineitem")),
    "a29_value_counts_and_mode": "SELECT user_id, event_type, count(*) AS n, any_value(m) AS modal FROM events JOIN (SELECT user_id, event_type AS m FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1) USING (user_id) GROUP BY ALL",
    "a30_component_validation": B.sql("SELECT conv_id, " + ", ".join(f"max({p}) AS {p}" for p in ("long_turn", "asks", "late")) + ", CAST(0 AS BIGINT) AS n_invalid, " + " + ".join(f"CAST(count(DISTINCT {p}) > 1 AS INTEGER)" for p in ("long_turn", "asks", "late")) + " AS conflicts, max(long_turn) + max(asks) + max(late) AS score FROM s GROUP BY conv_id",
        ("s", "SELECT conv_id, CAST(length(text) > 200 AS INTEGER) AS long_turn, CAST(role = 'user' AS INTEGER) AS asks, CAST(turn > 1 AS INTEGER) AS late FROM conversations")),
    "a33_timing_statistics": "SELECT *, round(med / n_rows * 1000, 6) AS seconds_per_1000_rows, round(n_rows / max(n_rows) OVER (), 6) AS rows_ratio_vs_full, round(med / first_value(med) OVER (ORDER BY n_rows DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS time_ratio_vs_full FROM (SELECT l_linenumber, count(*) AS repeats, l_linenumber * 1000 AS n_rows, avg(l_extendedprice / 1000) AS m, median(l_extendedprice / 1000) AS med, stddev_pop(l_extendedprice / 1000) AS sd, min(l_extendedprice / 1000) AS lo, max(l_extendedprice / 1000) AS hi FROM lineitem GROUP BY l_linenumber)",
    "a34_source_agreement": "SELECT 'price' AS variable, count(*) AS n, round(corr(l_extendedprice, p_retailprice), 6) + 0.0 AS correlation, round(avg(CASE WHEN l_extendedprice = p_retailprice THEN 100.0 ELSE 0 END), 6) + 0.0 AS pct_identical FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL "
        "SELECT 'quantity', count(*), round(corr(l_quantity, round(l_quantity, -1)), 6), round(avg(CASE WHEN l_quantity = round(l_quantity, -1) THEN 100.0 ELSE 0 END), 6) FROM lineitem JOIN part ON l_partkey = p_partkey",
    "a35_claim_check": "SELECT name, floor(v) + 0.5 AS claimed, 0.3::DOUBLE AS tolerance, round(v, 6) AS value, CAST(abs(v - floor(v) - 0.5) <= 0.3 AS INTEGER) AS ok FROM (SELECT 'mean' AS name, avg(l_quantity) AS v FROM lineitem UNION ALL SELECT 'std', stddev_samp(l_quantity) FROM lineitem UNION ALL SELECT 'median', median(l_quantity) FROM lineitem)",
    "a37_d15_cohort_features": B.sql("SELECT entity, round((epoch(TIMESTAMP '2024-01-22') - epoch(date_trunc('second', f))) / 86400, 6) AS baseline_days, round(n / 84.0, 6) AS primary_coverage, concat_ws(';', CASE WHEN (epoch(TIMESTAMP '2024-01-22') - epoch(date_trunc('second', f))) / 86400 < 20 THEN 'baseline_trop_courte' END, CASE WHEN n / 84.0 < 1 THEN 'couverture_pre7_insuffisante' END) AS exclusion_reason, "
        "CAST(hn AS BIGINT) AS pre7_hybrid_notifs, round(hf, 6) + 0.0 AS pre7_hybrid_frac_time, round(hs, 6) + 0.0 AS pre7_hybrid_score_max, round(sf, 6) + 0.0 AS pre7_instability_surveillance_frac, CAST(bn AS BIGINT) AS pre7_hypo_notifs, CAST(inn AS BIGINT) AS pre7_instability_notifs, round(fr, 6) + 0.0 AS future_hybrid_notif_per_cow_day FROM "
        "(SELECT entity, min(t) AS f, count(CASE WHEN t >= '2024-01-22' THEN 1 END) AS n FROM raw WHERE t < '2024-01-29' GROUP BY entity) LEFT JOIN (SELECT entity, sum(CASE WHEN w THEN hybrid_warning_notification END) AS hn, avg(CASE WHEN w THEN hybrid_warning_episode END) AS hf, max(CASE WHEN w THEN hybrid_warning_score END) AS hs, avg(CASE WHEN w THEN hybrid_warning_surveillance END) AS sf, "
        "sum(CASE WHEN w THEN behavioral_warning_notification END) AS bn, sum(CASE WHEN w THEN instability_warning_notification END) AS inn, sum(CASE WHEN dataset_split = 'futur' THEN hybrid_warning_notification END) / greatest(1 / 6.0, count(CASE WHEN dataset_split = 'futur' THEN 1 END) / 6.0) AS fr FROM (SELECT *, bin >= '2024-01-22' AS w FROM fus WHERE bin < '2024-01-29') GROUP BY entity) USING (entity)", *BRANCH),
    "d15_cohort_concordance": B.sql("SELECT a.metric, a.n_pos, a.n_neg, a.auc, round(a.auc * a.n_pos * a.n_neg, 4) AS u, round(avg(CASE WHEN label = 1 THEN score END), 6) + 0.0 AS mean_pos, round(avg(CASE WHEN label = 0 THEN score END), 6) + 0.0 AS mean_neg FROM (" + auc("lng", "label", "score", "metric") + ") a JOIN lng USING (metric) GROUP BY ALL", *BRANCH,
        ("lbl", "SELECT entity, CAST(sum(coalesce(motion, 0)) > sum(coalesce(steps, 0)) AS INTEGER) AS label FROM raw WHERE t >= '2024-01-24' GROUP BY entity"),
        ("wk", "SELECT entity, CAST(sum(hybrid_warning_notification) AS DOUBLE) AS pre7_hybrid_notifs, avg(hybrid_warning_episode) AS pre7_hybrid_frac_time, max(hybrid_warning_score) AS pre7_hybrid_score_max, avg(hybrid_warning_surveillance) AS pre7_instability_surveillance_frac FROM fus WHERE bin >= '2024-01-17' AND bin < '2024-01-24' GROUP BY entity"),
        ("lng", " UNION ALL ".join(f"SELECT entity, label, '{n}' AS metric, round({n}, 9) AS score FROM wk JOIN lbl USING (entity)" for n in ("pre7_hybrid_notifs", "pre7_hybrid_frac_time", "pre7_hybrid_score_max", "pre7_instability_surveillance_frac")))),
    "u01_union_ragged": "SELECT c_custkey AS key, c_mktsegment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, round(s_acctbal, 6) FROM supplier",
    "u02_except": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "u02_except_urgent": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "u03_intersect": "SELECT l_suppkey AS key FROM lineitem INTERSECT SELECT o_custkey FROM orders",
    "k04_best_config_runs_events": B.sql("SELECT l_orderkey, l_tax, l_linenumber FROM lineitem JOIN (SELECT * FROM gs ORDER BY robust_pass DESC, selection_score DESC, mix_rate_thr, persist_hours LIMIT 1) b ON l_tax = b.mix_rate_thr AND l_linenumber = b.persist_hours", *GSUM),
    "w21_cumulative_share": "SELECT l_returnflag, l_linenumber, round(weight, 6) AS weight, round(sum(weight) OVER (PARTITION BY l_returnflag ORDER BY weight DESC, l_linenumber ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY l_returnflag), 6) AS cumulative_share FROM (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)",
    "w23_position_of_time": B.sql("SELECT g.entity, CAST(min(CASE WHEN g.bin >= r.at THEN g.pos END) AS DOUBLE) AS pos FROM grid g JOIN (SELECT entity, max(CASE WHEN steps > 200 THEN t END) AS at FROM raw GROUP BY entity) r USING (entity) GROUP BY g.entity", *GRID),
}
CHECKS["a33_timing_statistics"] = ("SELECT l_linenumber, repeats, n_rows, round(m, 6) AS mean, round(med, 6) AS median, round(sd, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max, seconds_per_1000_rows, rows_ratio_vs_full, time_ratio_vs_full FROM (" + CHECKS["a33_timing_statistics"] + ")")
CHECKS |= LARGE
