"""Exact nearest neighbours of vectors by a tree of balls, for one entity inside a task."""

from __future__ import annotations

import numpy as np

LEAF = 64  # vectors of a ball


def balls(points: np.ndarray, leaf: int = LEAF) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Row numbers, centre and radius of each ball: rows halved at the median of their widest dimension."""
    stack, members = [np.arange(len(points))], []
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            members.append(rows)
            continue
        own = points[rows]
        widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argpartition(own[:, widest], len(rows) // 2)
        stack += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    centre = np.array([points[r].mean(axis=0) for r in members])
    radius = np.array([np.sqrt(((points[r] - c) ** 2).sum(axis=1)).max() for r, c in zip(members, centre, strict=True)])
    return members, centre, radius


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        out += (x[:, d, None] - y[None, :, d]) ** 2
    return np.sqrt(out)


def nearest_distinct(query: np.ndarray, points: np.ndarray, k: int, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(distances, rows) of the ``k`` first points of each query, equal distances by row number.

    Queries are filed in balls as well. The balls of points next to a query ball, as many as hold some
    times ``k`` points, give each query a distance within which its neighbours lie; then the balls that the triangle
    inequality leaves possible for some query are looked through, up to ``block`` points at a time.
    """
    k = min(k, len(points))
    out_dist, out_row = np.empty((len(query), k)), np.empty((len(query), k), np.int64)
    members, centre, radius = balls(points)
    held = np.array([len(m) for m in members])
    for rows, m, _ in zip(*balls(query), strict=True):
        x = query[rows]
        order = np.argsort(_gaps(m[None, :], centre)[0], kind="stable")
        few = order[: int(np.searchsorted(np.cumsum(held[order]), min(8 * k, len(points)))) + 1]
        worst = np.partition(_gaps(x, points[np.concatenate([members[j] for j in few])]), k - 1, axis=1)[:, k - 1]
        away = _gaps(x, centre)
        reach = away - radius - 1e-9 * (1.0 + away + radius) <= worst[:, None]  # with the rounding of the bound
        possible = np.concatenate([members[j] for j in np.flatnonzero(reach.any(axis=0))])
        at, place, dist = [], [], []
        for low in range(0, len(possible), block):
            part = possible[low : low + block]
            gap = _gaps(x, points[part])
            i, j = np.nonzero(gap <= worst[:, None])
            at.append(i)
            place.append(part[j])
            dist.append(gap[i, j])
        i, j, gap = np.concatenate(at), np.concatenate(place), np.concatenate(dist)
        o = np.lexsort((j, gap, i))
        i, j, gap = i[o], j[o], gap[o]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out_dist[rows], out_row[rows] = gap[keep].reshape(len(rows), k), j[keep].reshape(len(rows), k)
    return out_dist, out_row


def nearest_rows(query: np.ndarray, own: np.ndarray | None, points: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, position, distance) of the ``k`` nearest points of each query by (distance, position).

    ``own`` gives the position a query has among the points, which is left out. Equal points are one
    entry with their first ``k`` + 1 positions, equal queries are asked once.
    """
    order = np.argsort(pos, kind="stable")
    points, pos = points[order] + 0.0, pos[order]  # the sum turns minus zero into zero
    want = k + (own is not None)
    _, first, same = np.unique(points, axis=0, return_index=True, return_inverse=True)
    by_first = np.argsort(first)  # entries numbered by their first position, which settles ties
    number = np.empty_like(by_first)
    number[by_first] = np.arange(len(by_first))
    entry = number[same.ravel()]
    grouped = np.argsort(entry, kind="stable")
    count = np.bincount(entry)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])

    asked, which = np.unique(query + 0.0, axis=0, return_inverse=True)
    dist, near = nearest_distinct(asked, points[first[by_first]], want)
    rows, places, gaps = [], [], []
    held = np.minimum(count, want)
    for low in range(0, len(asked), 4096):
        near_part, dist_part = near[low : low + 4096], dist[low : low + 4096]
        times = held[near_part].ravel()
        row = np.repeat(np.repeat(np.arange(low, low + len(near_part)), near_part.shape[1]), times)
        step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        place = pos[grouped[np.repeat(start[near_part.ravel()], times) + step]]
        gap = np.repeat(dist_part.ravel(), times)
        o = np.lexsort((place, gap, row))
        row, place, gap = row[o], place[o], gap[o]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < want
        rows.append(row[keep])
        places.append(place[keep])
        gaps.append(gap[keep])
    row, place, gap = np.concatenate(rows), np.concatenate(places), np.concatenate(gaps)
    # answers of equal queries are copied to each of them; a query's own position then goes
    which = which.ravel()
    size = np.bincount(row, minlength=len(asked))
    begin = np.cumsum(size) - size
    times = size[which]
    out = np.repeat(np.arange(len(query)), times)
    at = np.repeat(begin[which], times) + np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
    if own is not None:
        other = place[at] != own[out]
        out, at = out[other], at[other]
    keep = np.arange(len(out)) - np.searchsorted(out, out) < k
    return out[keep], place[at[keep]], gap[at[keep]]
