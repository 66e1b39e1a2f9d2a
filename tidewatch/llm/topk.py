"""Exact top-k by inner product: aggregation of sorted lists without random access.

Components become integers floor(1024 x). Rows are dealt into blocks; a block keeps, for each
dimension, its vectors sorted by that component. A query reads all lists of a block in step, from the
end that its own component favours. What a vector's unread dimensions can add lies between the lists'
last and current entries, which gives each vector a lower and an upper bound of its score. Reading
stops when no vector outside a short list of contenders can reach the k-th lower bound; the contenders'
scores are then resolved exactly, and the blocks' answers are merged. The first block's answer is a
floor that the other blocks start from. Queries of a block read together.

Scores are exact. The bounds are products of floating-point matrices only where dimensions x largest component
x largest query component is below 2^51, so that every partial sum is a whole number a double holds; below 2^61
they are 64-bit integers, and beyond that scores are summed in Python integers (a final score beyond 64 bits is
held at their ends). A block holds about ``BLOCK`` vectors and meets ``ASKED`` queries at a time, whatever the table's size.

Defined cases: null ids, null or empty vectors and vectors with null or non-finite components take no
part, nor do vectors of another length; a zero vector does; fewer than k candidates give all of them;
ties go to the smaller id; an empty table gives an empty table; other columns are not looked at."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import vectors
from tidewatch.plans.lineage import stored

SCALE = 1024
BLOCK = 4096  # distinct vectors in a block, about
ASKED = 4096  # queries that meet a block in one group, about
ROUNDS = 8  # steps in which a list would be read to its end
QUERIES = 256  # queries that read together
ANSWER = "rep long, vec_id long, score long"


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 x): int64 where all of it fits, else Python integers."""
    if not x.size or np.abs(x).max() < 2.0 ** 62 / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[math.floor(Fraction(float(v)) * SCALE) for v in row] for row in x], object)


class Lists:
    """Sorted lists of a block, one for each dimension, read in step by many queries.

    A query reads a list from its top where its own component is positive, from its foot where it is
    negative. To a depth, what all queries have read is one of two sets of entries per list, so the
    sums over read entries, and the bounds for unread ones, are products of a matrix of queries with
    matrices of entries."""

    def __init__(self, x: np.ndarray, ids: list):
        self.x, self.ids = x, ids
        self.kind: type | None = None
        self.most = int(np.abs(x).max()) if x.dtype != object and x.size else 0

    def _read_as(self, kind: type) -> None:
        """Lists of numbers of a kind: doubles or 64-bit integers."""
        if self.kind is not kind:
            self.kind, n = kind, len(self.x)
            order = np.argsort(self.x, axis=0, kind="stable").T
            self.cols = np.ascontiguousarray(self.x.T).astype(kind)
            self.sorted = np.take_along_axis(self.cols, order, axis=1)  # rising, per dimension
            self.rank = np.empty(order.shape, np.int64)
            np.put_along_axis(self.rank, order, np.broadcast_to(np.arange(n), order.shape), axis=1)

    def search(self, q: np.ndarray, keep: int, floor: np.ndarray | None = None) -> list[tuple[list[int], list[int]]]:
        """For each query (row) its first ``keep`` ids and scores, highest first; scores below the query's ``floor`` may be missing."""
        largest = self.x.shape[1] * self.most * int(np.abs(q).max()) if q.dtype != object and q.size else 0
        if self.x.dtype == object or q.dtype == object or largest >= 2 ** 61:
            every = np.arange(len(self.x))
            return [self._answer(every, np.array([sum(int(a) * int(b) for a, b in zip(v, one)) for v in self.x], object), keep) for one in q]
        self._read_as(float if largest < 2 ** 51 else np.int64)
        least = -np.inf if self.kind is float else -2 ** 62
        out = []
        for i in range(0, len(q), QUERIES):
            part = q[i:i + QUERIES]
            low = np.full(len(part), least, self.kind)
            if floor is not None:
                own = floor[i:i + QUERIES]
                low = np.where(np.isfinite(own), np.nan_to_num(own, neginf=0.0), least).astype(self.kind)
            held = self._contenders(part, keep, low)
            out += [self._answer(rows, self.x[rows] @ one, keep) for one, rows in zip(part, held)]
        return out

    def _answer(self, rows: np.ndarray, score: np.ndarray, keep: int) -> tuple[list[int], list[int]]:
        ids, worst = vectors.first_ids(-score, [self.ids[i] for i in rows], keep)
        return ids, [max(-2 ** 63, min(2 ** 63 - 1, -int(s))) for s in worst]

    def _contenders(self, q: np.ndarray, keep: int, floor: np.ndarray) -> list[np.ndarray]:
        """Per query the vectors that may be among the first; all others provably are not."""
        n = len(self.x)
        if self.kind is None:
            self._read_as(float)
        few = max(keep, n // 16)
        if n <= few:
            return [np.arange(n)] * len(q)
        out: list[np.ndarray] = [np.arange(n)] * len(q)
        todo = np.arange(len(q))
        up, down = np.maximum(q, 0).astype(self.kind), np.minimum(q, 0).astype(self.kind)
        least, most = self.sorted[:, 0], self.sorted[:, -1]
        for round_ in range(1, ROUNDS + 1):
            depth = -(-n * round_ // ROUNDS)
            high_read, low_read = self.rank >= n - depth, self.rank < depth
            u, d = up[todo], down[todo]
            rest = u @ least + d @ most  # what a vector gets at least where nothing of it is read
            entries = np.concatenate([self.cols * high_read, self.cols * low_read, high_read, low_read])
            low = rest[:, None] + np.concatenate([u, d, -u * least, -d * most], axis=1) @ entries
            # what an unread entry may add beyond the least one: from the list's end to where reading stands
            slack = np.concatenate([u * (self.sorted[:, n - depth] - least), d * (self.sorted[:, depth - 1] - most)], axis=1)
            high = low + slack.sum(axis=1)[:, None] - slack @ entries[2 * len(least):]
            reached = np.maximum(np.partition(low, n - keep, axis=1)[:, n - keep], floor[todo])
            inside = high >= reached[:, None]
            done = (inside.sum(axis=1) <= few) | (round_ == ROUNDS)
            for k in np.flatnonzero(done):
                out[todo[k]] = np.flatnonzero(inside[k])
            todo = todo[~done]
            if not len(todo):
                break
        return out


def top(df: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k`` rows
    with the highest integer inner product."""
    rows = vectors.usable(df, vec_id, vector, zero=True)
    data = stored(vectors.distinct(rows, k + 1), "vectors")
    n = data.count()
    blocks = max(1, n // BLOCK)
    asked = stored(vectors.queries(rows, every), "queries")
    once = asked.where("query_id = rep").select("rep", "v")
    parts = max(1, asked.count() // ASKED)
    dealt = data.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keep = k + 1

    def work(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asks):
            lists = Lists(scaled(vectors.matrix(data["v"])), data["ids"].tolist())
            floor = asks["floor"].astype(float).fillna(-np.inf).to_numpy()
            for rep, (ids, score) in zip(asks["rep"], lists.search(scaled(vectors.matrix(asks["v"])), keep, np.where(np.abs(floor) < 2 ** 53, floor, -np.inf))):
                out += [(rep, i, s) for i, s in zip(ids, score)]
        return pd.DataFrame(out, columns=["rep", "vec_id", "score"]).astype("int64")

    def visit(asks: DataFrame) -> DataFrame:
        own = asks.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(parts)).cast("int"))
        return own.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInPandas(lambda asks, data: work(data, asks), ANSWER)

    # first one block for each query: its answer is a floor for all others
    home = F.pmod(F.xxhash64("rep"), F.lit(blocks))
    one = stored(visit(once.select(home.alias("block"), "rep", "v", F.lit(None).cast("long").alias("floor"))), "first-block")
    reached = one.groupBy("rep").agg(F.array_sort(F.collect_list("score")).alias("s")).select(
        "rep", F.when(F.size("s") >= keep, F.element_at("s", 1)).alias("floor"))
    rest = once.join(reached, "rep", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(F.col("block") != home)
    two = visit(rest.select(F.col("block").cast("long").alias("block"), "rep", "v", "floor"))
    return vectors.ranked(one.unionByName(two), asked, k, [F.desc("score"), F.asc("vec_id")])
