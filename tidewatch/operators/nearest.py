"""Exact nearest neighbours by blocks that the triangle inequality skips.

Rows are cut into compact blocks by a kd-tree fitted on a bounded sample; a block has the box that bounds its
rows. A query first looks into the block of its own leaf, which bounds the distance of its k-th
neighbour; then it visits only blocks that may hold something nearer, by the distance to the box. Inside a block
queries and rows are cut into small cells that are skipped in the same way. Blocks hold max(BLOCK, sqrt(n)) rows, so
there are at most about 2 sqrt(n) boxes; only those, the sample and the tree are on the driver. Of equal vectors only the
first few keys can be neighbours, so no more are kept, and the queries of a much
visited block are dealt over tasks, so no group grows with a hot value."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numeric import box_gaps, cells, nearest_rows, tree_leaves
from tidewatch.plans.lineage import stored

BLOCK = 32_768  # rows of a block, at least
SAMPLE = 200_000  # rows the tree is fitted on, at most
QUERIES = 65_536  # queries that meet a block in one task
SLACK = 1e-9  # relative slack of bounds, against rounding


def _tree(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, cut, left, right) of a kd-tree over the widest dimension; a child below 0 is leaf -child - 1."""
    nodes: list[tuple[int, float, int, int]] = []
    count = [0]

    def grow(rows: np.ndarray, want: int) -> int:
        if want > 1 and len(rows) > 1:
            spread = x[rows].max(0) - x[rows].min(0)
            d = int(np.argmax(spread))
            if spread[d] > 0:
                half = want // 2
                cut = float(np.quantile(x[rows, d], half / want, method="lower"))
                left = x[rows, d] <= cut
                if left.all():
                    cut = float(np.max(x[rows, d][x[rows, d] < x[rows, d].max()]))
                    left = x[rows, d] <= cut
                at = len(nodes)
                nodes.append((d, cut, 0, 0))
                a, b = grow(rows[left], half), grow(rows[~left], want - half)
                nodes[at] = (d, cut, a, b)
                return at
        count[0] += 1
        return -count[0]

    grow(np.arange(len(x)), leaves)
    return nodes


class Blocks:
    """Rows dealt into blocks: ``rows`` (k, x, block) stored, boxes ``lows`` to ``highs`` by ``numbers``."""

    def __init__(self, rows: DataFrame, key: str, x: str, block: int = BLOCK, sample: int = SAMPLE):
        data = stored(rows.select(F.col(key).alias("k"), F.col(x).alias("x")), "points")
        n = data.count()
        size = max(block, math.isqrt(n))
        leaves = max(1, -(-n // size))
        share = min(1.0, min(sample, 64 * leaves) / max(1, n))
        picked = data.where(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20)))).select("x").limit(sample).collect() if leaves > 1 else []
        self.tree = _tree(np.array([r.x for r in picked], float), leaves) if picked else []
        leafed = self.leafed(data)
        # a leaf that the sample took for smaller is cut by key
        counts = {r.leaf: r.n for r in leafed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        parts = {leaf: -(-c // (4 * size)) for leaf, c in counts.items()}
        cut = F.create_map(*[F.lit(v) for pair in parts.items() for v in pair])[F.col("leaf")] if parts else F.lit(1)
        self.rows = stored(leafed.withColumn("block", F.col("leaf") * F.lit(1 << 20) + F.pmod(F.xxhash64("k"), cut)), "blocks")

        def box(pdf: pd.DataFrame) -> pd.DataFrame:
            v = np.stack(pdf["x"].to_numpy())
            v = v[np.isfinite(v).all(1)]
            low, high = (v.min(0), v.max(0)) if len(v) else ([], [])  # rows that are not finite are nobody's neighbours
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "low": [low], "high": [high]})

        boxes = self.rows.groupBy("block").applyInPandas(box, "block long, low array<double>, high array<double>").where("size(low) > 0").collect()
        boxes.sort(key=lambda b: b.block)
        self.numbers = np.array([b.block for b in boxes], np.int64)
        self.lows, self.highs = np.array([b.low for b in boxes], float), np.array([b.high for b in boxes], float)

    def leafed(self, df: DataFrame) -> DataFrame:
        """(k, x, leaf) of rows (k, x): the leaf of the tree that each falls into."""
        tree, kind = self.tree, df.schema["k"].dataType.simpleString()

        def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(leaf=tree_leaves(np.stack(pdf["x"].to_numpy()), tree))

        return df.select("k", "x").mapInPandas(walk, f"k {kind}, x array<double>, leaf long")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _listed(v: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1] if v.size else np.zeros(len(v) + 1, np.int32)),
                                    pa.array(np.ascontiguousarray(v).ravel(), pa.float64()))


def visits(queries: DataFrame, blocks: Blocks, k: int) -> tuple[DataFrame, DataFrame]:
    """(found in the own leaf (k, n), further blocks to visit (k, x, bound, block)) of queries (k, x); ``n`` holds structs (d, x, id)."""
    kind = queries.schema["k"].dataType.simpleString()
    homed = blocks.leafed(queries).select("k", "x", F.lit(float("inf")).alias("bound"), (F.lit(1 << 20) * F.col("leaf")).alias("block"))
    found = stored(_meet(homed, blocks, k, kind), "found")
    numbers, lows, highs = blocks.numbers, blocks.lows, blocks.highs
    bounded = found.select("k", "x", "block", F.when(F.size("n") >= k, F.element_at("n", -1)["d"]).otherwise(F.lit(float("inf"))).alias("bound"))

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            v, home, most = _vectors(t["x"]), t["block"].to_numpy(), t["bound"].to_numpy()
            for rows in cells(np.where(np.isfinite(v), v, 0.0), 256) if len(numbers) else []:
                q, reach = v[rows], most[rows] + SLACK * (1 + np.abs(most[rows]))
                some = np.flatnonzero(~(box_gaps(q.min(0), q.max(0), lows, highs) > reach.max()))  # many are far from all
                gap = box_gaps(q[:, None, :], q[:, None, :], lows[None, some], highs[None, some])
                a, b = np.nonzero((gap <= reach[:, None]) & (numbers[None, some] != home[rows][:, None]))
                yield pa.RecordBatch.from_arrays([t["k"].combine_chunks().take(pa.array(rows[a])), _listed(q[a]), pa.array(most[rows][a]),
                                                  pa.array(numbers[some[b]])], names=["k", "x", "bound", "block"])

    return found.select("k", "n"), bounded.mapInArrow(choose, f"k {kind}, x array<double>, bound double, block long")


def _meet(queries: DataFrame, blocks: Blocks, k: int, kind: str) -> DataFrame:
    """(k, x, block, n): of each query the k nearest rows of each block it visits, nearer than its bound or as near."""
    own_kind = blocks.rows.schema["k"].dataType.simpleString()
    queries = stored(queries.select("k", "x", "bound", "block"), "visits")
    load = queries.groupBy("block").agg((1 + F.floor(F.count("*") / QUERIES)).cast("int").alias("parts"))
    left = queries.join(load, "block").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).drop("parts")
    right = blocks.rows.join(load, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "leaf")

    def look(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        at, d, near = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if len(mine) and len(theirs):
            # in the order that settles ties: by vector, then by id, a null id first
            ids = theirs["k"].combine_chunks()
            ranks = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            order = np.lexsort((ranks, *_vectors(theirs["x"]).T[::-1]))
            theirs, names = theirs.take(pa.array(order)), ids.drop_null().unique()
            number = lambda t, other: pc.fill_null(pc.index_in(t["k"].combine_chunks(), names), other).to_numpy(zero_copy_only=False)
            at, d, near = nearest_rows(_vectors(mine["x"]), _vectors(theirs["x"]), number(mine, -1), number(theirs, -2), mine["bound"].to_numpy(), k)
        rows = theirs.take(pa.array(near))
        n = pa.StructArray.from_arrays([pa.array(d, pa.float64()), rows["x"].combine_chunks(), rows["k"].combine_chunks()], names=["d", "x", "id"])
        ends = np.searchsorted(at, np.arange(len(mine) + 1)).astype(np.int32)
        return pa.table({"k": mine["k"], "x": mine["x"], "block": mine["block"], "n": pa.ListArray.from_arrays(pa.array(ends), n)})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        look, f"k {kind}, x array<double>, block long, n array<struct<d:double,x:array<double>,id:{own_kind}>>")


def _needed(rows: DataFrame, key: str, x: str, k: int) -> DataFrame:
    """The rows that can be among ``k`` neighbours: of equal vectors only the first by key count, ``k`` of them beside the
    rows of any one key."""
    copies, equals = Window.partitionBy(x, key).orderBy(key), Window.partitionBy(x).orderBy(key)
    some = rows.select(key, x).withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= k).drop("_c")
    return some.withColumn("_c", F.row_number().over(equals)).where(F.col("_c") <= 2 * k).drop("_c")


def nearest(queries: DataFrame, rows: DataFrame, key: str, x: str, k: int, block: int = BLOCK) -> DataFrame:
    """(key, x, _n): for each query row the ``k`` rows with the smallest Euclidean distance of the vector column ``x``, the
    row with its own key left out; ``_n`` holds structs (d, x, id), nearest first, ties by vector, then id; exact."""
    blocks = Blocks(_needed(rows, key, x, k), key, x, block)
    asked = stored(queries.select(F.col(key).alias("k"), F.col(x).alias("x")), "queries")
    found, more = visits(asked, blocks, k)
    every = found.unionByName(_meet(more, blocks, k, asked.schema["k"].dataType.simpleString()).select("k", "n"))
    lists = every.where("k IS NOT NULL AND size(n) > 0").groupBy("k").agg(F.collect_list("n").alias("n"))
    best = lists.select("k", F.slice(F.array_sort(F.flatten("n")), 1, k).alias("_n"))
    return asked.join(best, "k").withColumnsRenamed({"k": key, "x": x})
