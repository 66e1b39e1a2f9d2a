"""Chains of random forest regressions over one table, as chained imputation needs them.

The numeric columns are written once as blocks of rows, packed arrays of one table row each. A fit reads them, bins the
inputs of its rows at cuts from a bounded sample, draws every row's weight in every tree and writes that once; then a
level of all trees is one pass over the packed bytes. Tasks send sums per tree, open node, input and bin, which are added
up and searched in Spark; the driver holds the trees and the sample. Filled values are not written after every fit:
they follow from the trees, so a pass fills the gaps of its blocks by the forests since the blocks were last written."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.constants import POISSON_CUTS
from tidewatch.functions.resample import weights
from tidewatch.functions.trees import Forest, Growth, best_splits, bins_of, bytes_row, chain, each_block, matrix, thresholds, two_a_byte
from tidewatch.plans.lineage import dropped, stored

BLOCK = 65_536  # rows of a block
DRAWN = 8_192  # rows whose weights are drawn at once
BINS = 32  # bins of a column, at most 255
SAMPLE = 10_000  # rows the cuts of a fit are taken from, about
CHUNK = 1 << 18  # bytes of sums that travel as one row
FILES = {"parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false", "compression": "uncompressed"}  # a reader holds whole row groups

PACKED = "id long, x binary, gaps binary, fit binary"


def pack(data: DataFrame, columns: list[str], gaps: list[str | None], fit: str) -> DataFrame:
    """Blocks of ``columns`` as doubles, columns x rows, with their gaps and the rows that fits may use; stored."""
    size = BLOCK

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 24, [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = np.stack([t[f"x{i}"].to_numpy().astype(float) for i in range(len(columns))])
            if np.isnan(x).any():
                raise ValueError("a column of the chain holds NaN, or a NULL that has no fill")
            none = np.zeros(n, bool)
            g = np.stack([none if c is None else t[f"g{i}"].to_numpy() for i, c in enumerate(gaps)])
            return bytes_row(id=number, x=x, gaps=g, fit=t["fit"].to_numpy())

        for b in batches:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, size - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == size:
                    yield block()
                    number, held, n = number + 1, [], 0
        if n:
            yield block()

    cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    flags = [F.col(g).alias(f"g{i}") for i, g in enumerate(gaps) if g is not None]
    return stored(data.select(*cols, *flags, F.col(fit).alias("fit")).mapInArrow(work, PACKED), "packed", **FILES)


def repack(blocks: DataFrame, width: int, forests: list[Forest]) -> DataFrame:
    """The blocks with their gaps filled by ``forests``; stored."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, x, g, fit in each_block(batches, width):
            yield bytes_row(id=number, x=chain(x, g, forests), gaps=g, fit=fit)

    return stored(blocks.mapInArrow(work, PACKED), "packed", **FILES)


def sample(blocks: DataFrame, width: int, observed: dict[int, int], seed: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(values, gaps, rows per target): about SAMPLE of the ``observed`` rows of every target, all if there are fewer.

    The samples of targets overlap as far as they can, so the driver seldom holds many more rows than one has."""
    limits = {c: min(1.0, SAMPLE / max(1, n)) for c, n in observed.items()}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, x, g, fit in each_block(batches, width):
            u = np.random.default_rng([seed % (1 << 32), number]).random(len(fit))
            by = np.stack([fit & ~g[c] & (u < limit) for c, limit in limits.items()])
            rows = np.flatnonzero(by.any(axis=0))
            if len(rows):
                yield bytes_row(id=number, x=x[:, rows], gaps=g[:, rows], fit=by[:, rows])

    found = sorted(blocks.mapInArrow(work, PACKED).collect(), key=lambda r: r.id)
    x = np.concatenate([np.frombuffer(r.x).reshape(width, -1) for r in found] or [np.zeros((width, 0))], axis=1)
    g = np.concatenate([np.frombuffer(r.gaps, bool).reshape(width, -1) for r in found] or [np.zeros((width, 0), bool)], axis=1)
    by = np.concatenate([np.frombuffer(r.fit, bool).reshape(len(limits), -1) for r in found] or [np.zeros((len(limits), 0), bool)], axis=1)
    return x, g, {c: np.flatnonzero(by[i]) for i, c in enumerate(limits)}


def fit(blocks: DataFrame, width: int, target: int, known: np.ndarray, rows: int, forests: list[Forest], *, trees: int,
        depth: int, seed: int) -> Forest:
    """A forest for column ``target`` from all others, over its observed rows with gaps elsewhere filled by ``forests``.

    Every tree weighs each row by a Poisson(1) number; a node tries a third of the columns and splits at the cut that
    leaves the least variance. ``known`` are sampled rows, columns x rows, which give the cuts and nothing else; ``rows``
    is the number of all rows of the fit."""
    columns = [c for c in range(width) if c != target]
    cuts = [thresholds(known[c], min(BINS, rows) - 1) for c in columns]
    centre = float(known[target].mean()) if known.shape[1] else 0.0
    bits, step = BLOCK.bit_length() - 1, DRAWN
    each = np.arange(1, trees + 1)

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, x, g, fit_rows in each_block(batches, width):
            here = np.flatnonzero(fit_rows & ~g[target])
            if not len(here):
                continue
            x = chain(x, g, forests)[:, here]
            bins = np.stack([bins_of(x[k], c) for k, c in zip(columns, cuts)])
            keys = (number << bits) + here
            w = np.concatenate([two_a_byte(weights(keys[a:a + step], each, seed, POISSON_CUTS).T) for a in range(0, len(keys), step)], axis=1)
            yield bytes_row(bins=bins, y=x[target] - centre, w=w)

    table = stored(blocks.mapInArrow(draw, "bins binary, y binary, w binary"), "drawn", **FILES)
    most = max((len(c) for c in cuts), default=0) + 1
    growth = Growth(trees, depth, len(columns), math.ceil(len(columns) / 3) if trees > 1 else len(columns), most, seed % (1 << 32))
    while columns and (level := growth.level()) is not None:
        per = max(1, CHUNK // (16 * level.width * growth.tried))

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, masks, part = level.empty(), level.masks(), TaskContext.get().partitionId()
            for b in batches:
                for bins, y, w in zip(*(b.column(i) for i in range(3))):
                    level.add(sums, matrix(bins, len(columns)), matrix(y, 1, float)[0].copy(), matrix(w, (trees + 1) // 2), masks)  # a copy is aligned
            for t, s in enumerate(sums):
                s = s.reshape(2, s.shape[1], -1, level.width)
                for k in range(0, s.shape[2], per):
                    yield bytes_row(tree=t, first=k, part=part, sums=np.ascontiguousarray(s[:, :, k:k + per]))

        def search(key: tuple, parts: pa.Table) -> pa.Table:
            t, k = key[0].as_py(), key[1].as_py()
            tried = level.inputs[t][k:k + per]
            total = np.zeros(2 * tried.size * level.width)
            for s in parts.sort_by("part")["sums"]:
                total += np.frombuffer(s.as_buffer())
            return pa.Table.from_batches([bytes_row(tree=t, first=k, found=best_splits(total, tried, level.width))])

        sums = table.mapInArrow(add, "tree int, first int, part int, sums binary")
        found = sums.groupBy("tree", "first").applyInArrow(search, "tree int, first int, found binary").collect()
        by: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r.tree, r.first)):
            by.setdefault(r.tree, []).append(np.frombuffer(r.found).reshape(-1, 8))
        growth.take({t: np.concatenate(v) for t, v in by.items()})
    dropped(table)
    return growth.forest(target, columns, cuts, centre)


def filled(data: DataFrame, columns: list[str], gaps: list[str | None], forests: list[Forest]) -> DataFrame:
    """``data`` with the gaps of ``columns`` filled by the forests, one after the other; other columns never leave the JVM."""
    targets = sorted({f.target for f in forests})
    flagged = [i for i, g in enumerate(gaps) if g is not None]

    def work(*arrays: pa.Array) -> pa.Array:
        x = np.stack([a.to_numpy(zero_copy_only=False).astype(float) for a in arrays[:len(columns)]])
        g = np.zeros(x.shape, bool)
        for i, a in zip(flagged, arrays[len(columns):]):
            g[i] = a.to_numpy(zero_copy_only=False)
        chain(x, g, forests)
        return pa.StructArray.from_arrays([pa.array(x[c]) for c in targets], names=[f"x{c}" for c in targets])

    new = F.arrow_udf(work, ", ".join(f"x{c} double" for c in targets))
    rows = data.withColumn("_new", new(*[F.col(c).cast("double") for c in columns], *[F.col(g) for g in gaps if g is not None]))
    pick: dict[str, Column] = {columns[c]: F.when(F.col(gaps[c]), F.col(f"_new.x{c}")).otherwise(F.col(columns[c])) for c in targets}
    return rows.withColumns(pick).drop("_new")
