"""Small numpy routines that run inside tasks."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle


def newton_groups(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, starts: np.ndarray, ridge: float, steps: int,
                  tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intercept, slope, status) of consecutive groups of rows, all groups stepping together."""
    sizes = np.diff(np.append(starts, len(x)))
    total = lambda v, s=starts: np.add.reduceat(v, s)
    p, n = total(pos), total(neg)
    a, b = np.zeros(len(starts)), np.zeros(len(starts))
    status = np.where((p > 0) & (n > 0), "not converged", "one class").astype(object)
    for _ in range(steps):
        open_ = np.flatnonzero(status == "not converged")
        if not len(open_):
            break
        rows = np.repeat(status == "not converged", sizes)
        X, P, N = x[rows], pos[rows], pos[rows] + neg[rows]
        at = np.cumsum(sizes[open_]) - sizes[open_]
        mu = 1.0 / (1.0 + np.exp(-np.clip(np.repeat(a[open_], sizes[open_]) + np.repeat(b[open_], sizes[open_]) * X, -50.0, 50.0)))
        w, g = N * mu * (1 - mu), P - N * mu
        h00, h01, h11 = (np.add.reduceat(v, at) for v in (w, w * X, w * X * X))
        g0, g1 = np.add.reduceat(g, at), np.add.reduceat(g * X, at) - ridge * b[open_]
        h11 = h11 + ridge
        det = h00 * h11 - h01 * h01
        fine = det != 0
        safe = np.where(fine, det, 1.0)
        da, db = np.where(fine, (h11 * g0 - h01 * g1) / safe, 0.0), np.where(fine, (h00 * g1 - h01 * g0) / safe, 0.0)
        a[open_] += da
        b[open_] += db
        near = np.maximum(np.abs(da), np.abs(db)) < tolerance * np.maximum(1.0, np.maximum(np.abs(a[open_]), np.abs(b[open_])))
        status[open_[fine & near]] = "converged"
        status[open_[~fine]] = "singular"
    return a, b, status


def pool_violators(low: np.ndarray, high: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pools (low, high, sum, weight) of consecutive pools in order, neighbours merged until their means rise."""
    out: list[list[float]] = []
    for a, b, s, w in zip(low.tolist(), high.tolist(), total.tolist(), n.tolist()):
        while out and out[-1][2] * w >= s * out[-1][3]:
            a, _, t, v = out.pop()
            s, w = s + t, w + v
        out.append([a, b, s, w])
    return tuple(np.array(c, float) for c in zip(*out)) if out else (np.zeros(0),) * 4


def tree_leaves(x: np.ndarray, tree: list[tuple[int, float, int, int]]) -> np.ndarray:
    """Leaf number of each row under a tree of (dimension, cut, left, right); children below 0 are leaves."""
    out = np.zeros(len(x), np.int64)
    stack = [(0, np.arange(len(x)))] if tree else []
    while stack:
        node, rows = stack.pop()
        if node < 0:
            out[rows] = -node - 1
        elif len(rows):
            d, cut, left, right = tree[node]
            under = x[rows, d] <= cut
            stack += [(left, rows[under]), (right, rows[~under])]
    return out


def cells(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of rows in compact cells of at most ``size`` rows: halves along the widest dimension; equal rows as they come."""
    out, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        v = x[rows]
        d = int(np.argmax(v.max(0) - v.min(0)))
        order = np.argpartition(v[:, d], len(rows) // 2)
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def box_gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least distance between boxes, pairwise by broadcasting; the last axis holds the dimensions."""
    return np.sqrt((np.maximum(np.maximum(lows - high, low - highs), 0.0) ** 2).sum(-1))


def nearest_rows(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int,
                 cell: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, distance, row) of the k rows nearest to each query within its bound, ties by earlier row; rows of the query's
    own id and rows and queries that are not finite take no part.

    Queries and rows are cut into small cells. The rows nearest to a cell of queries bound their k-th distances, and only
    cells of rows that may hold something as near are looked at."""
    at, dist, near = [], [], []
    fine = np.flatnonzero(np.isfinite(x).all(1))
    groups = [fine[g] for g in cells(x[fine], cell)]
    lows, highs = (np.array([f(x[g], axis=0) for g in groups]).reshape(-1, x.shape[1]) for f in (np.min, np.max))
    sizes = np.array([len(g) for g in groups], np.int64)
    asked = np.flatnonzero(np.isfinite(q).all(1))

    def distances(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
        d = np.zeros((len(rows), len(found)))
        for j in range(x.shape[1]):
            d += (q[rows, j][:, None] - x[found, j][None, :]) ** 2
        d = np.sqrt(d)
        d[own[rows][:, None] == ids[found][None, :]] = np.inf
        return d

    def last(d: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1]) if d.shape[1] >= k else most

    for part in cells(q[asked], cell) if groups else []:
        rows = asked[part]
        low, high = q[rows].min(0), q[rows].max(0)
        gap = box_gaps(low, high, lows, highs)
        order = np.lexsort((((lows + highs - low - high) ** 2).sum(1), gap))
        first = order[:1 + int(np.searchsorted(np.cumsum(sizes[order]), 4 * k))]
        limit = last(distances(rows, np.concatenate([groups[g] for g in first])), bound[rows])
        # a little slack against rounding of the gaps
        reach = float(limit.max()) * (1 + 1e-9) + 1e-300
        found = np.sort(np.concatenate([groups[g] for g in order[gap[order] <= reach]] or [fine[:0]]))
        for i in range(0, len(found), 1 << 16):  # pieces bounded by memory
            d = distances(rows, found[i:i + (1 << 16)])
            limit = last(d, limit)
            a, b = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            at.append(rows[a])
            dist.append(d[a, b])
            near.append(found[i + b])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    a, d, b = np.concatenate(at), np.concatenate(dist), np.concatenate(near)
    order = np.lexsort((b, d, a))
    a, d, b = a[order], d[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < k], d[rank < k], b[rank < k]


# the helpers travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
