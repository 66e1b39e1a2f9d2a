"""Regression trees over binned columns, on plain arrays: what a task does with a block and the driver with its sums.

Nodes are in heap order from 1: a value up to the cut of node i goes to node 2i, a value above it to 2i + 1."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

CLOSED = 255  # the bin at which a node that is not split sends all its rows to node 2i
MASKED = 6  # levels whose nodes are bits of one number
SMALLEST = 1e-12  # a gain below this share of the node's own term is rounding


def thresholds(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts between the values, each with about as many of them on either side as the next."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) - 1 <= most:
        return (found[:-1] + found[1:]) / 2.0
    stride = len(values) / (most + 1)
    cuts, target = [], stride
    upto = np.cumsum(counts).tolist()
    for k in range(1, len(found)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            cuts.append((found[k - 1] + found[k]) / 2.0)
            target += stride
    return np.array(cuts)


def bins_of(x: np.ndarray, cuts: np.ndarray, step: int = 8192) -> np.ndarray:
    """Number of cuts below each value; for a few cuts, counting is faster than searching."""
    out = np.zeros(len(x), np.uint8)
    for a in range(0, len(x), step):
        part, into = x[a:a + step], out[a:a + step]
        for c in cuts:
            into += part > c
    return out


def _at(a: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``a[places]``; places are in bounds, and without the check for that it takes a third of the time."""
    return a.take(places, mode="wrap")


@dataclass
class Forest:
    """Trees that fill column ``target`` from the others, all of them grown out to full depth."""

    target: int
    feature: np.ndarray  # trees x inner nodes: a column
    cut: np.ndarray  # trees x inner nodes
    value: np.ndarray  # trees x leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees for the rows of ``x``, columns x rows."""
        n, leaves = x.shape[1], self.value.shape[1]
        flat, at, total = x.ravel(), np.arange(n), np.zeros(n)
        for feature, cut, value in zip(self.feature * n, self.cut, self.value):
            node = np.ones(n, np.int64)
            for _ in range(leaves.bit_length() - 1):
                off = _at(feature, node)
                off += at
                above = _at(flat, off) > _at(cut, node)
                node <<= 1
                node += above
            node -= leaves
            total += _at(value, node)
        return total / len(self.value)


def chain(x: np.ndarray, gaps: np.ndarray, forests: list[Forest]) -> np.ndarray:
    """Fill the gaps of a block, columns x rows, in place by one forest after the other."""
    for f in forests:
        rows = np.flatnonzero(gaps[f.target])
        if len(rows):
            x[f.target, rows] = f.predict(x[:, rows])
    return x


@dataclass
class Level:
    """The nodes of one depth that may be split, and the trees above them."""

    depth: int
    width: int  # bins of a column, at most
    count: int  # inputs
    feature: np.ndarray  # trees x inner nodes: an input
    split: np.ndarray  # trees x inner nodes: the last bin that goes to node 2i
    slots: np.ndarray  # trees x nodes of this depth: place among the open ones, -1 if closed
    inputs: list[np.ndarray]  # per tree, open nodes x inputs tried there

    def empty(self) -> list[np.ndarray]:
        return [np.zeros((2, s.shape[1], len(s) * self.width)) for s in self.inputs]

    def masks(self) -> list[list[np.ndarray | None]] | None:
        """Per tree and pair of inputs, by the bins of both: bits of the nodes up to MASKED levels down that are not
        ruled out; None for a pair that rules out nothing. The first node that no pair rules out is the row's.

        It costs a step per pair instead of one per level, so there are none where levels are fewer."""
        every, n, deep = ~np.uint64(0), self.count, min(self.depth, MASKED)
        if 2 * deep <= n // 2 + 4:
            return None
        out = []
        for feature, split in zip(self.feature, self.split):
            m = np.full((n + n % 2, self.width), every)
            for k in range(1, 1 << deep):
                if split[k] != CLOSED:
                    below = 1 << deep - k.bit_length()
                    first = (2 * k * below) - (1 << deep)
                    m[feature[k], int(split[k]) + 1:] &= ~np.uint64(((1 << below) - 1) << first)
            pairs = [(m[i][:, None] & m[i + 1][None, :]).ravel() for i in range(0, n, 2)]
            out.append([None if (p == every).all() else p for p in pairs])
        return out

    def add(self, sums: list[np.ndarray], bins: np.ndarray, y: np.ndarray, w: np.ndarray, masks: list | None) -> None:
        """Add weight and weighted label of a block per tree, input tried, open node and bin. ``w`` holds two trees a byte."""
        n, flat = len(y), bins.ravel()
        codes = []
        for i in range(0, len(bins) if masks else 0, 2):
            code = bins[i] * np.int64(self.width)
            codes.append(code + bins[i + 1] if i + 1 < len(bins) else code)
        for t, into in enumerate(sums):
            if not len(self.inputs[t]):
                continue
            every = w[t // 2] >> 4 if t % 2 else w[t // 2] & 15
            rows = np.flatnonzero(every > 0)  # several times as fast on truth values
            if masks:
                node, done = _at(_first(codes, masks[t], n), rows).astype(np.int64), min(self.depth, MASKED)
                node += 1 << done
            else:
                node, done = np.ones(len(rows), np.int64), 0
            feature = self.feature[t] * n
            for _ in range(done, self.depth):
                off = _at(feature, node)
                off += rows
                above = _at(flat, off) > _at(self.split[t], node)
                node <<= 1
                node += above
            node -= 1 << self.depth
            slot = _at(self.slots[t], node)
            if len(self.inputs[t]) < self.slots.shape[1]:
                some = np.flatnonzero(slot >= 0)
                rows, slot = _at(rows, some), _at(slot, some)
            weight = _at(every, rows).astype(float)
            label = _at(y, rows)
            label *= weight
            start, tried = slot * self.width, np.ascontiguousarray(self.inputs[t].T) * n
            for j in range(len(tried)):
                off = _at(tried[j], slot)
                off += rows
                key = start + _at(flat, off)
                into[0, j] += np.bincount(key, weight, into.shape[2])
                into[1, j] += np.bincount(key, label, into.shape[2])


def _first(codes: list[np.ndarray], masks: list[np.ndarray | None], n: int) -> np.ndarray:
    left = None
    for code, m in zip(codes, masks):
        if m is not None:
            left = _at(m, code) if left is None else np.bitwise_and(left, _at(m, code), out=left)
    if left is None:
        return np.zeros(n, np.uint8)
    below = left - np.uint64(1)
    below &= np.invert(left, out=left)
    return np.bitwise_count(below)


def two_a_byte(w: np.ndarray) -> np.ndarray:
    """Rows of numbers below 16, each even row with the next one in its upper bits."""
    out = w[::2].astype(np.uint8)
    out[:len(w) // 2] |= w[1::2].astype(np.uint8) << 4
    return out


def best_splits(sums: np.ndarray, inputs: np.ndarray, width: int) -> np.ndarray:
    """Rows (input or -1, bin, weight and label below, weight and label above, of both) per open node: the split
    that leaves the least variance, among those with a row on either side; the first of equal ones."""
    sums = sums.reshape(2, inputs.shape[1], len(inputs), width).transpose(0, 2, 1, 3)
    w, y = np.cumsum(sums, axis=3)
    every = np.stack((w[:, 0, -1], y[:, 0, -1]), axis=1)
    wl, yl = w[:, :, :-1], y[:, :, :-1]
    wr, yr = w[:, :, -1:] - wl, y[:, :, -1:] - yl
    some = (wl >= 1) & (wr >= 1)
    whole = np.divide(y[:, :, -1:] ** 2, w[:, :, -1:], out=np.zeros_like(y[:, :, -1:]), where=w[:, :, -1:] > 0)
    gain = np.full(some.shape, -1.0)
    np.divide(yl * yl, wl, out=gain, where=some)
    gain += np.divide(yr * yr, wr, out=np.zeros(some.shape), where=some) - whole
    gain[~some | (gain <= SMALLEST * whole)] = 0.0
    flat = gain.reshape(len(inputs), -1)
    at = flat.argmax(axis=1) if flat.shape[1] else np.zeros(len(inputs), int)
    out = np.full((len(inputs), 8), -1.0)
    out[:, 6:] = every
    good = np.flatnonzero(flat.max(axis=1, initial=0.0) > 0)
    j, b = np.divmod(at[good], width - 1) if width > 1 else (at[good], at[good])
    out[good, 0], out[good, 1] = inputs[good, j], b
    for k, v in enumerate((wl, yl, wr, yr), 2):
        out[good, k] = v[good, j, b]
    return out


class Growth:
    """Trees as they grow, a level at a time; every node tries ``tried`` of the inputs, drawn by seed, tree and depth."""

    def __init__(self, trees: int, depth: int, inputs: int, tried: int, width: int, seed: int):
        self.depth, self.inputs, self.tried, self.width, self.seed = depth, inputs, tried, width, seed
        self.feature = np.zeros((trees, 1 << depth), np.int64)
        self.split = np.full((trees, 1 << depth), CLOSED, np.uint8)
        self.sums = np.zeros((trees, 2 << depth, 2))
        self.open = [np.array([1]) for _ in range(trees)]
        self.at = 0

    def level(self) -> Level | None:
        if self.at == self.depth or not any(len(o) for o in self.open):
            return None
        slots = np.full((len(self.open), 1 << self.at), -1, np.int64)
        drawn = []
        for t, o in enumerate(self.open):
            slots[t, o - (1 << self.at)] = np.arange(len(o))
            order = np.random.default_rng([self.seed, t, self.at]).random((1 << self.at, self.inputs)).argsort(axis=1)
            drawn.append(order[o - (1 << self.at), :self.tried])
        return Level(self.at, self.width, self.inputs, self.feature[:, :1 << self.at], self.split[:, :1 << self.at], slots, drawn)

    def take(self, found: dict[int, np.ndarray]) -> None:
        """Go down a level by the ``best_splits`` of each tree's open nodes."""
        for t, o in enumerate(self.open):
            r = found.get(t)
            if r is None:  # closed, or there were no rows
                self.open[t] = o[:0]
                continue
            if self.at == 0:
                self.sums[t, 1] = r[0, 6:]
            cut = r[:, 0] >= 0
            o, r = o[cut], r[cut]
            self.feature[t, o], self.split[t, o] = r[:, 0].astype(np.int64), r[:, 1].astype(np.uint8)
            self.sums[t, 2 * o], self.sums[t, 2 * o + 1] = r[:, 2:4], r[:, 4:6]
            below = np.stack((2 * o, 2 * o + 1), axis=1).ravel()
            self.open[t] = below[self.sums[t, below, 0] >= 2]  # a single row cannot be split
        self.at += 1

    def forest(self, target: int, columns: list[int], cuts: list[np.ndarray], centre: float) -> Forest:
        """The trees over the table's columns; ``cuts`` are those of the inputs' bins."""
        closed = self.split == CLOSED
        for k in range(1, 1 << self.depth):  # a leaf hands its sums down to full depth
            t = np.flatnonzero(closed[:, k])
            self.sums[t, 2 * k] = self.sums[t, 2 * k + 1] = self.sums[t, k]
        table = np.full((len(cuts), 256), np.inf)
        for i, c in enumerate(cuts):
            table[i, :len(c)] = c
        w, y = self.sums[:, 1 << self.depth:, 0], self.sums[:, 1 << self.depth:, 1]
        value = np.divide(y, w, out=np.zeros_like(y), where=w > 0) + centre
        return Forest(target, np.array(columns)[self.feature], table[self.feature, self.split], value)


def bytes_row(**values) -> pa.RecordBatch:
    """One row of numbers, and of arrays as their bytes."""
    kinds = {"id": pa.int64(), "tree": pa.int32(), "first": pa.int32(), "part": pa.int32()}
    cells = [pa.array([v], kinds[k]) if k in kinds else pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in values.items()]
    return pa.RecordBatch.from_arrays(cells, names=list(values))


def matrix(cell: pa.Scalar, rows: int, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind).reshape(rows, -1)


def each_block(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, values, gaps, rows of fits) of packed blocks; the values may be written to."""
    for b in batches:
        for number, x, gaps, fit in zip(*(b.column(i) for i in range(4))):
            yield number.as_py(), matrix(x, width, float).copy(), matrix(gaps, width, bool), matrix(fit, 1, bool)[0]


# the helpers travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
