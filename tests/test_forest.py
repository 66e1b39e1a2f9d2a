"""Chained imputation by forests: trees against plain loops, rows against what they must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import trees as T
from tidewatch.functions.constants import POISSON_CUTS
from tidewatch.functions.resample import weights
from tidewatch.operators import forest, impute


def _table(spark, n=1500):
    """y and z follow x (z with noise, and 100 higher in rows that are not for fits); every sixth y and every seventh z is missing."""
    rng = np.random.default_rng(5)
    x, e = rng.uniform(0, 10, n), rng.normal(0, 0.05, n)
    rows = [(None if i % 11 == 0 else i // 2, f"t{i}", float(x[i]), None if i % 6 == 0 else float(3 * x[i] + 20), None if i % 7 == 0 else float(x[i] ** 2 + e[i] + 100 * (i % 10 == 9)),
             None if i % 13 == 0 else i % 3 // 2, i % 10 != 9) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, text string, x double, y double, z double, flag long, fit boolean").repartition(5, "text")


def test_chained_forests_fill_gaps_and_nothing_else(spark):
    rows, df = _table(spark)
    out = impute.impute_chained(df, ["x", "y", "z", "flag"], key="k", rounds=2, trees=10, fit_on=F.col("fit"))
    assert out.columns == df.columns and [t for _, t in out.dtypes] == ["bigint", "string", "double", "double", "double", "double", "boolean"]
    by = {r.text: r for r in out.collect()}
    assert len(by) == len(rows)
    for k, text, x, y, z, flag, fit in rows:  # keys repeat and are missing
        r = by[text]
        assert (r.k, r.x, r.fit) == (k, x, fit) and (y is None or r.y == y) and (z is None or r.z == z) and r.flag == (0 if flag is None else flag)
    gaps_y = [abs(by[t].y - (3 * x + 20)) for _, t, x, y, *_ in rows if y is None]
    gaps_z = [abs(by[t].z - x * x) for _, t, x, _, z, _, _ in rows if z is None]
    assert np.mean(gaps_y) < 2.5 and np.mean(gaps_z) < 4.0  # by the median: 7.5 and over 25


def test_chained_forests_write_the_rows_twice(spark, monkeypatch):
    """Not once per column and round: the fits read packed columns."""
    _, df = _table(spark, 200)
    times, cut = [], impute.cut_lineage
    monkeypatch.setattr(impute, "DEPTH", 2)
    monkeypatch.setattr(impute, "cut_lineage", lambda d: times.append(1) or cut(d))
    assert impute.impute_chained(df, ["x", "y", "z"], key="k", rounds=2, trees=2).count() == 200
    assert len(times) == 2


def test_blocks_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 64)
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS a", "id % 2 AS b", "id % 5 = 0 AS _gap", "id % 3 > 0 AS _fit").repartition(3)
    blocks = forest.pack(df, ["a", "b"], ["_gap", None], "_fit").collect()
    assert len({r.id for r in blocks}) == len(blocks) and all(len(r.fit) <= 64 for r in blocks)
    a = np.concatenate([np.frombuffer(r.x).reshape(2, -1) for r in blocks], axis=1)
    g = np.concatenate([np.frombuffer(r.gaps, bool).reshape(2, -1) for r in blocks], axis=1)
    fit = np.concatenate([np.frombuffer(r.fit, bool) for r in blocks])
    assert sorted(a[0]) == list(range(1000)) and (a[1] == a[0] % 2).all() and (g[0] == (a[0] % 5 == 0)).all() and not g[1].any() and (fit == (a[0] % 3 > 0)).all()
    with pytest.raises(Exception, match="NaN"):
        forest.pack(df.withColumn("a", F.expr("IF(b = 1, double('NaN'), a)")), ["a", "b"], ["_gap", None], "_fit")


def test_fit_does_not_depend_on_blocks(spark, monkeypatch):
    """All rows of the fit count, in whichever block they lie: with one tree and many rows, leaves hold the local mean."""
    df = spark.range(5000).selectExpr("CAST(id % 100 AS DOUBLE) AS x", "CAST(id % 100 * 2 AS DOUBLE) AS y", "id % 10 = 0 AS _gap", "id < 4000 AS _fit").repartition(4)
    monkeypatch.setattr(forest, "BLOCK", 300)
    blocks = forest.pack(df, ["x", "y"], [None, "_gap"], "_fit")
    known, _, rows = forest.sample(blocks, 2, {1: 3600}, 3)
    assert len(rows[1]) == 3600  # fewer than SAMPLE: all of them
    f, again = (forest.fit(blocks, 2, 1, known[:, rows[1]], 3600, [], trees=1, depth=5, seed=1) for _ in range(2))
    assert np.array_equal(f.cut, again.cut) and np.array_equal(f.value, again.value)
    x = np.stack([np.arange(100.0), np.zeros(100)])
    assert np.abs(f.predict(x) - 2 * x[0]).max() <= 6


def test_thresholds():
    assert T.thresholds(np.array([1.0, 1, 2, 4]), 31).tolist() == [1.5, 3.0] and T.thresholds(np.array([7.0, 7]), 31).tolist() == []
    x = np.random.default_rng(0).normal(size=3000)
    cuts = T.thresholds(x, 31)
    b = T.bins_of(x, cuts)
    assert len(cuts) == 31 and (b == np.searchsorted(cuts, x)).all() and np.bincount(b).min() > 80


@pytest.mark.parametrize("inputs", [1, 2, 5])
def test_trees_against_loops(inputs):
    """Sums, splits and predictions of whole trees are those of one row after the other, with and without masks."""
    rng = np.random.default_rng(inputs)
    n, trees, depth, tried = 700, 3, 8, -(-inputs // 3)
    x = rng.normal(size=(inputs, n))
    y = x[0] * 2 + np.sin(x[-1]) + rng.normal(size=n) / 5
    cuts = [T.thresholds(c, 15) for c in x]
    bins = np.stack([T.bins_of(a, c) for a, c in zip(x, cuts)])
    w = weights(np.arange(n), np.arange(1, trees + 1), 9, POISSON_CUTS).T
    growth = T.Growth(trees, depth, inputs, tried, 16, 4)
    at = np.ones((trees, n), int)  # the node of a row, -1 once it is closed
    masked = 0
    while (level := growth.level()) is not None:
        sums, stepped = level.empty(), level.empty()
        masks = level.masks()
        masked += masks is not None
        for a in (0, 300):
            level.add(sums, np.ascontiguousarray(bins[:, a:a + 300 + a]), y[a:a + 300 + a], T.two_a_byte(w[:, a:a + 300 + a]), masks)
            level.add(stepped, np.ascontiguousarray(bins[:, a:a + 300 + a]), y[a:a + 300 + a], T.two_a_byte(w[:, a:a + 300 + a]), None)
        assert all(np.array_equal(p, q) for p, q in zip(sums, stepped))
        found = {}
        for t in range(trees):
            found[t] = T.best_splits(sums[t], level.inputs[t], 16)
            for node, tries, r in zip(growth.open[t], level.inputs[t], found[t]):
                here = at[t] == node
                best = 0.0
                for f in tries:
                    for b in range(len(cuts[f])):
                        low = here & (bins[f] <= b)
                        wl, wr = w[t, low].sum(), w[t, here & ~low].sum()
                        if wl >= 1 and wr >= 1:
                            sl, sr = (w[t] * y)[low].sum(), (w[t] * y)[here & ~low].sum()
                            best = max(best, sl * sl / wl + sr * sr / wr - (sl + sr) ** 2 / (wl + wr))
                if r[0] < 0:
                    assert best < 1e-9
                    at[t, here] = -1
                    continue
                assert r[3] ** 2 / r[2] + r[5] ** 2 / r[4] - r[7] ** 2 / r[6] == pytest.approx(best)
                low = bins[int(r[0])] <= r[1]
                assert r[2] == w[t, here & low].sum() and r[5] == pytest.approx((w[t] * y)[here & ~low].sum())
                at[t, here & low], at[t, here & ~low] = 2 * node, 2 * node + 1
        growth.take(found)
    assert growth.at > 4 and masked
    f = growth.forest(inputs, list(range(inputs)), cuts, 1.0)
    full = np.concatenate([x, np.zeros((1, n))])
    p = np.zeros(n)
    for t in range(trees):
        for i in range(n):
            k = 1
            for _ in range(depth):
                k = 2 * k + (full[f.feature[t, k], i] > f.cut[t, k])
            p[i] += f.value[t, k - (1 << depth)]
    assert f.predict(full) == pytest.approx(p / trees) and np.var(y + 1 - p / trees) < np.var(y) / 4
