from collections import defaultdict

import numpy as np
import pytest

from tidewatch.llm import ann, vectors


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, v in rows:
        if q % every == 0:
            d = np.sqrt(((x - np.asarray(v, float)) ** 2).sum(axis=1))
            out[q] = [(i, s) for s, i in sorted((s, i) for s, i in zip(d, ids) if i != q)[:k]]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_chi_square():
    r = np.random.default_rng(0)
    x = (r.standard_normal((200_000, ann.DIMS)) ** 2).sum(axis=1)
    for t in (1.0, 5.0, 8.0, 15.0, 20.0):
        assert ann.chi_square(t) == pytest.approx((x <= t).mean(), abs=5e-3)


def test_cells_cover_and_bound():
    r = np.random.default_rng(1)
    x = r.standard_normal((500, ann.DIMS))
    c = ann.Cells(x, 9)
    cell, far = c.of(x), c.distance(x)
    assert len(c.boxes) == 16 and (far[np.arange(500), cell] == 0).all()
    for i in range(0, 500, 50):
        for j in range(500):
            assert far[i, cell[j]] <= ((x[i] - x[j]) ** 2).sum() + 1e-12


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 256)
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, x[0].tolist()) for i in range(60)]
    got = answers(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100))
    want = brute(rows, 10, 100)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) / 10 >= 0.9
    at = dict(rows)
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found, key=lambda x: (x[1], x[0])) and q not in dict(found)
        for i, s in found:
            assert s == pytest.approx(np.sqrt(((np.array(at[q]) - np.array(at[i])) ** 2).sum()), rel=1e-12)
    assert got[0] == [(10_000 + i, 0.0) for i in range(10)] and got[10_000] == [(0, 0.0)] + [(10_001 + i, 0.0) for i in range(9)]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (100, [0.0, 1.0], None), (1, [1.0, 1.0], "b"), (2, None, "c"), (3, [0.0, 0.0], "c"), (4, [nan, 1.0], "c"), (5, [inf, 1.0], "c"),
            (200, [None, 1.0], "c"), (6, [1.0, 2.0, 3.0], "c"), (None, [1.0, 1.0], "c"), (300, [], "c"), (7, [1.0, 1.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = answers(ann.nearest(df))
    assert got == {0: [(1, 1.0), (7, 1.0), (100, 2 ** 0.5)], 100: [(1, 1.0), (7, 1.0), (0, 2 ** 0.5)]}
    assert ann.nearest(df.limit(0)).collect() == [] and ann.nearest(df.where("vec_id = 0")).collect() == []


def test_query_recall(spark):
    from tidewatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = answers(QUERIES["op6_ann"](spark, sf)), brute(rows, 10, 100)
    assert set(got) == set(want) and np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]) / 10 >= 0.95


def test_first_ids():
    assert vectors.first_ids(np.array([2.0, 1.0, 1.0]), [[1], [9, 12], [3]], 2) == ([3, 9], [1.0, 1.0])
