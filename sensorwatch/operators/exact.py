"""Exact null distributions of small-sample tests, by counting sums instead of sign patterns.

Each function handles one group of units that a grouped map hands it.
"""

from __future__ import annotations

from math import comb, exp, isnan, lgamma, log

import numpy as np


def subset_sum_chances(values: np.ndarray) -> np.ndarray:
    """Chance of every sum when each non-negative integer is taken with chance one half."""
    chances = np.zeros(int(values.sum()) + 1)
    chances[0] = 1.0
    top = 0
    for v in values.astype(np.int64):
        new = chances[: top + v + 1] * 0.5
        new[v:] += chances[: top + 1] * 0.5
        chances[: top + v + 1] = new
        top += v
    return chances


def placed_sum_chances(values: np.ndarray, k: int) -> np.ndarray:
    """Chance of every sum when ``k`` of the integers are chosen at random."""
    n, total = len(values), int(np.sort(values)[::-1][:k].sum())
    table = np.zeros((k + 1, total + 1))
    table[0, 0] = 1.0
    p = k / n if n else 0.0
    for v in values.astype(np.int64):  # weights p and 1 - p keep the row of k choices from underflow
        new = table * (1 - p)
        if v <= total:
            new[1:, v:] += table[:-1, : total + 1 - v] * p
        table = new
    return table[k] / table[k].sum()


def half_sums(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(1)
    for v in values:
        sums = np.concatenate([sums - v, sums + v])
    return np.sort(sums)


def sign_flip_p(values: np.ndarray) -> tuple[float, float]:
    """One- and two-sided p of the mean under all sign patterns, the two halves of the units met in sorted order."""
    n = len(values)
    left, right = half_sums(values[: n // 2]), half_sums(values[n // 2 :])
    observed, slack = float(values.sum()), 1e-12 * n
    at_least = lambda x: int((len(right) - np.searchsorted(right, x - slack - left, "left")).sum())
    upper = at_least(observed)
    far = abs(observed)
    two = at_least(far) + int(np.searchsorted(right, -far + slack - left, "right").sum()) if far > slack else 2**n
    return upper / 2**n, min(two / 2**n, 1.0)


def unranked(numbers: np.ndarray, n: int, k: int) -> np.ndarray:
    """(numbers, n) 0/1 rows: the choice of ``k`` of ``n`` units with each number from 0 to C(n, k) - 1 (combinatorial number system)."""
    choices = np.array([[comb(i, j) for j in range(k + 1)] for i in range(n)], np.int64)
    rest, left = numbers.astype(np.int64), np.full(len(numbers), k)
    rows = np.zeros((len(numbers), n), np.int8)
    for i in range(n - 1, -1, -1):
        take = (left > 0) & (rest >= choices[i, left])
        rest = np.where(take, rest - choices[i, left], rest)
        left = left - take
        rows[:, i] = take
    return rows


def placed_blocks(labels: list[int], ranks: list[float], primary: int | None, block: int, size: int, most: int, seed: int = 42) -> tuple:
    """Of one block of label placements: observed AUC of the primary score, placements whose best AUC (one- and two-sided)
    of any score reaches it, placements tried, and whether all of the group's are (otherwise ``most`` seeded random ones).

    ``ranks`` holds each unit's ranks by score, unit after unit; ``primary`` counts from 1."""
    y = np.array(labels, int)
    n, k = len(y), int(y.sum())
    whole = comb(n, k) <= most
    low, high = block * size, min((block + 1) * size, comb(n, k) if whole else most)
    count = max(high - low, 0)
    if not 0 < k < n or not primary:
        return None, 0, 0, count, whole
    r = np.array(ranks, float).reshape(n, -1)
    base, pairs = k * (k + 1) / 2, k * (n - k)
    observed = float((y @ r[:, primary - 1] - base) / pairs)
    if not count:
        return observed, 0, 0, 0, whole
    if whole:
        rows = unranked(np.arange(low, high), n, k)
    else:
        rows = np.zeros((count, n), np.int8)
        np.put_along_axis(rows, np.random.default_rng([seed, block]).random((count, n)).argpartition(k, axis=1)[:, :k], 1, axis=1)
    auc = (rows @ r - base) / pairs
    one, two = auc.max(axis=1), np.abs(auc - 0.5).max(axis=1)
    return observed, int((one >= observed - 1e-12).sum()), int((two >= abs(observed - 0.5) - 1e-12).sum()), count, whole


def student_tail(t: float, freedom: float) -> float:
    """Two-sided tail of Student's t; NaN where it is undefined."""
    if t is None or freedom is None or isnan(t) or isnan(freedom) or freedom <= 0:
        return float("nan")
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    if x >= 1:
        return 1.0
    swap = x >= (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    scale = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if x > 0 else 0.0
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    part = scale * value / a
    return 1 - part if swap else part
