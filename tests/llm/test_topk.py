from collections import defaultdict

import numpy as np
import pytest

from tidewatch.llm import topk


@pytest.mark.parametrize("seed", range(8))
def test_lists_keep_the_first(seed):
    r = np.random.default_rng(seed)
    n, d = int(r.integers(1, 600)), int(r.integers(1, 20))
    x = r.integers(-3 if seed % 2 else -500, 4 if seed % 2 else 500, (n, d))
    ids = [[int(v)] for v in r.permutation(n)]
    lists = topk.Lists(x, ids)
    qs = np.stack([*r.integers(-300, 300, (5, d)), np.zeros(d, np.int64)])
    want = [sorted(zip((-(x @ q)).tolist(), [i[0] for i in ids]))[:11] for q in qs]
    floors = np.array([-w[-1][0] for w in want], float)
    for got in (lists.search(qs, 11), lists.search(qs, 11, floors), [lists.search(q[None], 11)[0] for q in qs]):
        assert [list(zip([-s for s in g[1]], g[0])) for g in got] == want


def test_reading_stops_early():
    r = np.random.default_rng(0)
    x = r.integers(-500, 500, (5000, 4))
    assert len(topk.Lists(x, [[i] for i in range(5000)])._contenders(np.array([[300, -20, 5, 1]]), 11, np.array([-np.inf]))[0]) <= 5000 // 16


def test_scaled():
    assert topk.scaled(np.array([[0.5, -0.0001, 1.0]])).tolist() == [[512, -1, 1024]]
    assert topk.scaled(np.array([[1e300, -0.3]])).tolist() == [[int(1e300) * 1024, -308]]


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_against_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (1200, 12))
    x[300:700] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    z = np.floor(x * 1024).astype(int)
    want = {q: [(i, s) for s, i in sorted((-int(z[q] @ z[i]), i) for i in range(1200) if i != q)[:10]] for q in range(0, 1200, 100)}
    assert answers(topk.top(df)) == {q: [(i, -s) for i, s in v] for q, v in want.items()}


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (100, [0.0, 0.0], None), (1, [1.0, 1.0], "b"), (2, None, "c"), (4, [nan, 1.0], "c"), (5, [inf, 1.0], "c"), (200, [None, 1.0], "c"),
            (6, [1.0, 2.0, 3.0], "c"), (None, [1.0, 1.0], "c"), (300, [], "c"), (7, [1.0, 1.0], "b"), (8, [1e18, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    one = 1024 * 1024
    assert answers(topk.top(df)) == {0: [(8, 2 ** 63 - 1), (1, one), (7, one), (100, 0)], 100: [(0, 0), (1, 0), (7, 0), (8, 0)]}
    assert topk.top(df.limit(0)).collect() == [] and topk.top(df.where("vec_id = 0")).collect() == []


@pytest.mark.parametrize("size", [2 ** 20, 2 ** 26, 2 ** 29, 2 ** 40])
def test_large_components_are_exact(size):
    """Permutations of one vector have the same score with a constant query, so ids alone decide."""
    r = np.random.default_rng(size)
    v = r.integers(-size, size, 200)
    x = np.stack([r.permutation(v) for _ in range(400)])
    ids = r.permutation(400).tolist()
    q = np.full((3, 200), [[1], [3], [size]])
    q[1, 0] += 1
    score = np.array([[sum(int(a) * int(b) for a, b in zip(row, one)) for row in x] for one in q], object)
    held = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    for one, (got, scores) in zip(score, topk.Lists(x, [[i] for i in ids]).search(q, 11)):
        want = sorted((-s, i) for s, i in zip(one, ids))[:11]
        assert got == [i for _, i in want] and scores == [held(-s) for s, _ in want]


def test_queries_are_dealt_in_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "ASKED", 3)
    r = np.random.default_rng(4)
    x = r.normal(0, 2.0 ** 16, (300, 5))
    df = spark.createDataFrame([(10 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    z = np.floor(x * 1024).astype(np.int64).astype(object)
    want = {q: [(10 * i, -s) for s, i in sorted((-int(z[q // 10] @ z[i]), i) for i in range(300) if i != q // 10)[:10]] for q in range(0, 3000, 100)}
    assert answers(topk.top(df)) == {q: [(i, max(-2 ** 63, min(2 ** 63 - 1, s))) for i, s in v] for q, v in want.items()}
