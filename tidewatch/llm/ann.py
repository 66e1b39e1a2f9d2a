"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test.

Vectors are projected to ``DIMS`` dimensions by Gaussian (2-stable) directions: the squared projected
distance of two vectors over their squared distance is chi-square distributed. The top of the kd-tree
over the projected space is fitted on a bounded sample and cuts the space into cells, one group of rows
each; a cell's rows build the rest of the tree. A query reads the leaves of a cell in the order of their
projected distance and verifies the vectors in them by true distance, until at projected distance r and
current last answer d the test P(chi-square <= r^2 / d^2) >= ``SURE`` holds: a vector as near as d would
have been met with that probability. A first round asks the ``HOME`` nearest cells; its answers' d sorts
out, by the same test, which other cells a query still visits in the second round. Every row is indexed.

Defined cases: null ids, null vectors, zero vectors and vectors with null or non-finite components take
no part, nor do vectors of another length; fewer than k candidates give all of them; ties go to the
smaller id; an empty table gives an empty table; other columns are not looked at."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import vectors
from tidewatch.llm.base import sampled
from tidewatch.plans.lineage import stored

DIMS, SURE, HOME = 8, 0.98, 2
CELL, LEAF, SAMPLE = 8192, 32, 20_000  # distinct vectors in a cell, in a leaf, and in the sample that places the cells
ANSWER = "rep long, vec_id long, score double"


def chi_square(x: np.ndarray | float, dims: int = DIMS) -> np.ndarray | float:
    """Distribution function for an even number of degrees."""
    h = np.minimum(np.asarray(x, float) / 2, 700)
    return 1 - np.exp(-h) * sum(h ** i / math.factorial(i) for i in range(dims // 2))


def directions(dim: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, dims))


def met(r2: np.ndarray, d: np.ndarray | float) -> np.ndarray:
    """Whether the stopping test holds at squared projected distance r2 and last answer d."""
    d = np.asarray(d, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(d > 0, r2 / (d * d), np.where(r2 > 0, np.inf, 0.0))
    return chi_square(ratio) >= SURE


class Cells:
    """The top of the kd-tree: boxes of the projected space that cover it, split at medians of the sample."""

    def __init__(self, sample: np.ndarray, count: int):
        self.split: list[tuple[int, float, int, int]] = []  # axis, value, child, child; a child < 0 is cell ~child
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.root = self._grow(sample, max(0, math.ceil(math.log2(max(1, count)))), np.full(DIMS, -np.inf), np.full(DIMS, np.inf))
        self.low, self.high = (np.array(x) for x in zip(*self.boxes))

    def _grow(self, x: np.ndarray, levels: int, low: np.ndarray, high: np.ndarray) -> int:
        if levels and len(x) > 1:
            axis = int((x.max(axis=0) - x.min(axis=0)).argmax())
            value = float(np.median(x[:, axis]))
            left = x[:, axis] <= value
            if 0 < left.sum() < len(x):
                at = len(self.split)
                self.split.append((axis, value, 0, 0))
                up, down = high.copy(), low.copy()
                up[axis] = down[axis] = value
                self.split[at] = (axis, value, self._grow(x[left], levels - 1, low, up), self._grow(x[~left], levels - 1, down, high))
                return at
        self.boxes.append((low, high))
        return ~(len(self.boxes) - 1)

    def of(self, p: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(p), np.int64), [(self.root, np.arange(len(p)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = ~at
            else:
                axis, value, a, b = self.split[at]
                left = p[rows, axis] <= value
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def distance(self, p: np.ndarray) -> np.ndarray:
        """Squared projected distance of points (rows) to cells (columns)."""
        gap = np.maximum(np.maximum(self.low[None] - p[:, None], p[:, None] - self.high[None]), 0)
        return (gap ** 2).sum(axis=2)


class Tree:
    """The kd-tree of one cell: leaves with tight boxes, and the vectors behind them."""

    def __init__(self, x: np.ndarray, p: np.ndarray, ids: list):
        order, self.start = [], [0]
        todo = [np.arange(len(x))]
        while todo:
            rows = todo.pop()
            if len(rows) > LEAF:
                axis = int((p[rows].max(axis=0) - p[rows].min(axis=0)).argmax())
                by = rows[np.argpartition(p[rows, axis], len(rows) // 2)]
                todo += [by[:len(rows) // 2], by[len(rows) // 2:]]
            else:
                order.append(rows)
                self.start.append(self.start[-1] + len(rows))
        order = np.concatenate(order)
        self.x, p, self.ids = x[order], p[order], [ids[i] for i in order]
        self.low = np.minimum.reduceat(p, self.start[:-1])
        self.high = np.maximum.reduceat(p, self.start[:-1])
        self.start = np.array(self.start)

    def search(self, q: np.ndarray, p: np.ndarray, keep: int, bound: float) -> tuple[list[int], list[float]]:
        """Ids and distances of the first ``keep`` found; ``bound`` is a distance known to be enough."""
        gap = np.maximum(np.maximum(self.low - p, p - self.high), 0)
        r2 = (gap ** 2).sum(axis=1)
        order = np.argsort(r2, kind="stable")
        n, i, step, last = len(order), 0, 4, bound
        rows, dist = [], []
        while i < n and not met(r2[order[i]], last):
            take = order[i:i + step]
            at = np.concatenate([np.arange(self.start[j], self.start[j + 1]) for j in take])
            rows.append(at)
            dist.append(np.sqrt(((self.x[at] - q) ** 2).sum(axis=1)))
            i, step = i + step, step * 2
            d = np.concatenate(dist)
            if len(d) >= keep:
                last = min(last, float(np.partition(d, keep - 1)[keep - 1]))
        if not rows:
            return [], []
        at, d = np.concatenate(rows), np.concatenate(dist)
        near = np.flatnonzero(d <= bound)
        return vectors.first_ids(d[near], [self.ids[j] for j in at[near]], keep)


def _visit(cells: DataFrame, asked: DataFrame, a: np.ndarray, keep: int) -> DataFrame:
    """Answers of (cell, rep, v, bound) rows from the cells they name."""
    def work(key, data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asks):
            x, q = vectors.matrix(data["v"]), vectors.matrix(asks["v"])
            tree, p = Tree(x, x @ a, data["ids"].tolist()), q @ a
            for i, (rep, bound) in enumerate(zip(asks["rep"], asks["bound"])):
                ids, score = tree.search(q[i], p[i], keep, bound)
                out += [(rep, v, s) for v, s in zip(ids, score)]
        return pd.DataFrame(out, columns=["rep", "vec_id", "score"]).astype({"rep": "int64", "vec_id": "int64", "score": "float64"})

    return asked.groupBy("cell").cogroup(cells.groupBy("cell")).applyInPandas(lambda k, l, r: work(k, r, l), ANSWER)


def nearest(df: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k`` nearest
    rows found, by Euclidean distance."""
    spark = df.sparkSession
    rows = vectors.usable(df, vec_id, vector, zero=False)
    data = vectors.distinct(rows, k + 1)
    data = stored(data, "vectors")
    n = data.count()
    some = data.where(sampled(F.xxhash64("v"), 1.3 * SAMPLE / n)) if n > 2 * SAMPLE else data
    sample = some.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toPandas()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = vectors.matrix(sample["v"])
    a = directions(x.shape[1])
    top = Cells(x @ a, -(-n // CELL))

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=top.of(vectors.matrix(b["v"]) @ a))

    def route(first: bool):
        def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, 4_000_000 // (len(top.boxes) * DIMS))
            for b in (batch[i:i + step] for batch in batches for i in range(0, len(batch), step)):
                far = top.distance(vectors.matrix(b["v"]) @ a)
                home = np.argsort(far, axis=1, kind="stable")[:, :HOME]
                want = np.zeros(far.shape, bool)
                np.put_along_axis(want, home, True, axis=1)
                if not first:
                    want = ~want & ~met(far, b["bound"].to_numpy()[:, None])
                i, c = np.nonzero(want)
                yield pd.DataFrame({"cell": c, "rep": b["rep"].to_numpy()[i], "v": b["v"].to_numpy()[i], "bound": b["bound"].to_numpy()[i]})
        return work

    cells = stored(data.mapInPandas(place, "v array<double>, ids array<long>, cell long"), "cells")
    asked = stored(vectors.queries(rows, every), "queries")
    once = asked.where("query_id = rep").select("rep", "v", F.lit(float("inf")).alias("bound"))
    routed = "cell long, rep long, v array<double>, bound double"
    one = stored(_visit(cells, once.mapInPandas(route(True), routed), a, k + 1), "near")
    last = one.groupBy("rep").agg(F.array_sort(F.collect_list("score")).alias("s")).select(
        "rep", F.coalesce(F.get("s", F.lit(k)), F.lit(float("inf"))).alias("bound"))
    more = once.drop("bound").join(last, "rep", "left").select("rep", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    two = _visit(cells, more.mapInPandas(route(False), routed), a, k + 1)
    return vectors.ranked(one.unionByName(two), asked, k, [F.asc("score"), F.asc("vec_id")])
