"""Per-task helpers of the bootstrap: all replicates of a sorted run of scores at once.

A task sees rows ordered by (model, cell, piece, falling score), in batches. For each run of
one (model, cell, piece) it keeps vectors over the replicates, never the rows."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from tidewatch.functions.constants import MIX

BLOCK_CELLS = 2_000_000  # rows x replicates counted at once
NEAR_CELLS = 50_000  # rows x replicates that a run works on at once: they stay near the processor


def mix(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 32-bit numbers: shifts and odd multipliers in turn, so no affine structure stays."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX[0])
    x = (x ^ (x >> np.uint32(15))) * np.uint32(MIX[1])
    return x ^ (x >> np.uint32(15))


def weights(keys: np.ndarray, replicates: np.ndarray, seed: int, cuts: list[float]) -> np.ndarray:
    """Poisson(1) weights, rows x replicates: the same integers as the column expression.

    Both halves of the 64-bit key enter two independent row hashes; each replicate mixes them anew."""
    k = np.asarray(keys, np.int64).view(np.uint64)
    low, high = (k & np.uint64(0xFFFFFFFF)).astype(np.uint32), (k >> np.uint64(32)).astype(np.uint32)
    s = mix(np.array([seed & 0xFFFFFFFF], np.uint32))
    a, b = mix(mix(low ^ s) ^ high), mix(mix(low ^ mix(s ^ np.uint32(MIX[2]))) ^ high)
    r = mix(np.asarray(replicates).astype(np.uint32) ^ s)
    u = a[:, None] ^ r[None, :]
    _mix_here(u)
    u ^= b[:, None]
    _mix_here(u)
    out, over = np.zeros(u.shape, np.int8), np.empty(u.shape, bool)
    for c in cuts:
        out += np.greater_equal(u, np.uint32(min(math.ceil(c * 4294967296.0), 4294967295)), out=over).view(np.int8)
    return out.astype(np.int64)


def _mix_here(u: np.ndarray) -> None:
    """``mix`` in place."""
    part = np.empty_like(u)
    for shift, by in ((16, MIX[0]), (15, MIX[1]), (15, None)):
        u ^= np.right_shift(u, np.uint32(shift), out=part)
        if by is not None:
            u *= np.uint32(by)


class Run:
    """Sums of one (model, cell, piece); the latest score is held back until it is complete."""

    def __init__(self, n: int, threshold: float, start: tuple[np.ndarray, np.ndarray] | None):
        self.threshold = threshold
        self.start = start
        self.pos, self.neg = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.tp, self.fp = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.area, self.brier, self.ap, self.pr = (np.zeros(n) for _ in range(4))
        self.held: tuple[float, np.ndarray, np.ndarray] | None = None

    def add(self, p: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        both = w.astype(float)  # whole numbers, so sums are exact
        pos = both * y[:, None]
        first = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1))
        if len(first) < len(p):
            p, pos, both = p[first], np.add.reduceat(pos, first, axis=0), np.add.reduceat(both, first, axis=0)
        neg = np.subtract(both, pos, out=both)
        if self.held is not None:
            hp, hpos, hneg = self.held
            if hp == p[0]:
                pos[0] += hpos
                neg[0] += hneg
            else:
                self._close(np.array([hp]), hpos[None, :], hneg[None, :])
        self.held = (p[-1], pos[-1], neg[-1])
        self._close(p[:-1], pos[:-1], neg[:-1])

    def finish(self) -> None:
        if self.held is not None:
            p, pos, neg = self.held
            self.held = None
            self._close(np.array([p]), pos[None, :], neg[None, :])

    def _close(self, p: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        if not len(p):
            return
        tp = np.cumsum(pos, axis=0)
        tp += self.pos
        if self.start is None:
            self.area += np.einsum("ij,ij->j", neg, tp) - np.einsum("ij,ij->j", neg, pos) / 2.0
            over = (p >= self.threshold).astype(float)
            hits, misses = np.stack(((1 - p) ** 2, over)) @ pos, np.stack((p * p, over, np.ones(len(p)))) @ neg
            self.brier += hits[0] + misses[0]
            self.tp += hits[1].astype(np.int64)
            self.fp += misses[1].astype(np.int64)
            self.neg += misses[2].astype(np.int64)
        else:
            fp = np.cumsum(neg, axis=0)
            fp += self.neg
            self.neg = fp[-1].astype(np.int64)
            some = np.flatnonzero(pos.any(axis=1))  # only positives have terms
            ap, pr = curve_terms(self.start[0] + tp[some], self.start[1] + fp[some], pos[some], neg[some])
            self.ap += ap.sum(axis=0)
            self.pr += pr.sum(axis=0)
        self.pos = tp[-1].astype(np.int64)


def curve_terms(tp, fp, pos, neg):
    """Terms of average precision and of the trapezoid area for score groups with totals tp, fp."""
    seen, before = tp + fp, tp + fp - pos - neg
    precision = np.divide(tp, seen, out=np.zeros(np.shape(tp)), where=seen > 0)
    previous = np.divide(tp - pos, before, out=np.ones(np.shape(tp)), where=before > 0)
    return pos * precision, pos * (precision + previous) / 2.0


def runs(batches: Iterable[pd.DataFrame], n_boot: int, seed: int, cuts: list[float], thresholds: list[float],
         starts: dict | None) -> Iterator[tuple[tuple[int, int], Run]]:
    """Finished runs of a task. With ``starts`` (totals before each cell) only curve terms are summed,
    and cells without an entry are passed over."""
    replicates = np.arange(1, n_boot + 1, dtype=np.int64)
    step = max(1, NEAR_CELLS // n_boot)
    key, run = None, None
    for pdf in batches:
        if not len(pdf):
            continue
        ids = pdf[["m", "cell", "piece"]].to_numpy()
        p, y, k = pdf["p"].to_numpy(float), pdf["y"].to_numpy(np.int64), pdf["k"].to_numpy(np.int64)
        bounds = np.concatenate(([0], np.flatnonzero((np.diff(ids, axis=0) != 0).any(axis=1)) + 1, [len(pdf)]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            here = tuple(int(v) for v in ids[a])
            if here != key:
                if run is not None:
                    run.finish()
                    yield key[:2], run
                key, run = here, None
                if starts is None or here[:2] in starts:
                    run = Run(n_boot, thresholds[here[0]], None if starts is None else starts[here[:2]])
            if run is not None:
                for s in range(a, b, step):
                    t = min(b, s + step)
                    run.add(p[s:t], y[s:t], weights(k[s:t], replicates, seed, cuts))
    if run is not None:
        run.finish()
        yield key[:2], run


# the helpers travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
