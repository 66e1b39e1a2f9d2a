"""Fits of many groups, isotonic pools, neighbours, own metrics: against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.numeric import newton_groups, pool_violators
from tidewatch.operators import bootstrap, calibrate, models, nearest
from tidewatch.sources import tables as S


def counts_of(spark, rows):
    return spark.createDataFrame(rows, "g string, x double, pos long, neg long")


def test_newton_states_why(spark):
    rng = random.Random(1)
    rows = [("good", float(x), rng.randint(1, 9), rng.randint(1, 9)) for x in range(12)] + [(None, float(x), rng.randint(1, 9), rng.randint(1, 9)) for x in range(12)]
    rows += [("one", 0.1 * x, 3, 0) for x in range(5)] + [("apart", float(x), int(x > 4), int(x <= 4)) for x in range(10)] + [("point", 2.0, 3, 4)]
    df = counts_of(spark, rows)
    a = {r.g: r for r in calibrate.newton_logistic(df, ["g"], "x", ridge=0.0, steps=20).collect()}
    b = {r.g: r for r in calibrate.newton_logistic(df, ["g"], "x", ridge=0.0, steps=20, group_rows=3).collect()}  # the sums of few large groups
    assert set(a) == set(b) == {"good", None, "one", "apart", "point"}
    assert [a[g].status for g in ("good", None, "one", "point")] == ["converged", "converged", "one class", "singular"] and a["apart"].status != "converged"
    for g, r in a.items():
        assert r.status == b[g].status or g == "apart"
        assert (r.slope is None) == (r.status != "converged") == (b[g].slope is None)
        if r.slope is not None:
            assert (r.intercept, r.slope) == pytest.approx((b[g].intercept, b[g].slope), rel=1e-8)
            own = [(x, p, n) for k, x, p, n in rows if k == g]
            mu = lambda x: 1 / (1 + math.exp(-(r.intercept + r.slope * x)))
            assert abs(sum(p - (p + n) * mu(x) for x, p, n in own)) < 1e-7 and abs(sum((p - (p + n) * mu(x)) * x for x, p, n in own)) < 1e-6


def test_newton_fits_many_groups_in_one_job(spark):
    n = 100_000
    x = F.col("id") % 4
    df = spark.range(4 * n).select((F.col("id") / 4).cast("long").alias("g"), x.cast("double").alias("x"), (1 + x + F.col("id") % 3).alias("pos"), (5 - x).alias("neg"))
    out = calibrate.newton_logistic(df, ["g"], "x")
    assert out.where("status = 'converged' AND slope > 0").count() == n
    g, pos, neg = 77, [1 + i + (4 * 77 + i) % 3 for i in range(4)], [5 - i for i in range(4)]
    a, b, _ = newton_groups(np.arange(4.0), np.array(pos, float), np.array(neg, float), np.array([0]), 1e-6, 100, 1e-10)
    r = out.where(F.col("g") == g).first()
    assert (r.intercept, r.slope) == pytest.approx((a[0], b[0]))


def max_min(s, w):
    """Isotonic fit by its max-min form."""
    n = len(s)
    mean = lambda a, b: sum(s[a:b + 1]) / sum(w[a:b + 1])
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_pools_against_max_min(spark, seed):
    rng = random.Random(seed)
    p = sorted({round(rng.random(), 3) for _ in range(60)})
    pos, neg = [rng.randint(0, 5) for _ in p], [rng.randint(0, 5) + 1 for _ in p]
    want = max_min(pos, [a + b for a, b in zip(pos, neg)])
    df = spark.createDataFrame(list(zip(p, pos, neg)), "p double, pos long, neg long")
    for per in (3, 7, 10_000):
        pools = sorted(tuple(r) for r in calibrate.isotonic_pools(df, per_bucket=per, fan=2).collect())
        got = [next(t / n for a, b, t, n in pools if a <= x <= b) for x in p]
        assert got == pytest.approx(want) and sum(n for *_, n in pools) == sum(pos) + sum(neg)
    assert pool_violators(*(np.array([]),) * 4)[0].size == 0


@pytest.mark.parametrize("knots", [1, 3, 64])
def test_isotonic_applies_between_and_outside(spark, monkeypatch, knots):
    monkeypatch.setattr(calibrate, "KNOTS", knots)
    pools = spark.createDataFrame([(0.2, 0.3, 0.1, 5.0), (0.5, 0.5, 0.4, 1.0), (0.6, 0.8, 0.9, 4.0)], "p_low double, p_high double, value double, n double")
    x = [0.0, 0.2, 0.25, 0.3, 0.4, 0.5, 0.55, 0.6, 0.7, 0.8, 1.0, None]
    df = spark.createDataFrame([(i, v, "a") for i, v in enumerate(x)], "i int, p double, x string")
    got = [r.p_calibrated for r in calibrate.apply_isotonic(df, pools).orderBy("i").collect()]
    kx, kv = [0.2, 0.3, 0.5, 0.6, 0.8], [0.1, 0.1, 0.4, 0.9, 0.9]
    assert got[:-1] == pytest.approx(np.interp(x[:-1], kx, kv).tolist()) and got[-1] is None


def brute_nearest(q, x, ids, own, k):
    d = np.sqrt(((x - q) ** 2).sum(1))
    order = sorted((d[i], x[i].tolist(), ids[i]) for i in range(len(x)) if ids[i] != own)
    return [(a, c) for a, _, c in order[:k]]


def test_neighbours_skip_most_blocks_of_clustered_rows(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.05, (60, 3)) for c in r.normal(0, 10, (20, 3))])
    x[5] = x[6] = x[1000]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    blocks = nearest.Blocks(rows, "id", "x", 30)
    asked = rows.select(F.col("id").alias("k"), "x")
    _, more = nearest.visits(asked, blocks, 5)
    visited = len(x) + more.count()
    assert len(blocks.numbers) >= 30 and visited < len(x) * len(blocks.numbers) / 3
    got = {q.id: [(n.d, n.id) for n in q._n] for q in nearest.nearest(rows, rows, "id", "x", 5, 30).collect()}
    for i in range(0, len(x), 7):
        want = brute_nearest(x[i], x, list(range(len(x))), i, 5)
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in want]) and [j for _, j in got[i]] == [j for _, j in want]


@pytest.mark.parametrize("n", [1, 3, 200])
def test_neighbours_of_equal_rows_and_few_rows(spark, n, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES", 16)
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(n)], "id long, x array<double>")
    got = nearest.nearest(rows, rows, "id", "x", 4, 10).collect()
    if n == 1:
        assert [r._n for r in got if r._n] == []
    else:
        assert len(got) == n and all(len(r._n) == min(4, n - 1) and all(m.d == 0 for m in r._n) for r in got)
    q = spark.createDataFrame([(-1, [0.0, 2.0])], "id long, x array<double>")
    assert [m.d for m in nearest.nearest(q, rows, "id", "x", 4, 10).first()._n] == [1.0] * min(4, n)


def test_ties_are_cut_in_order_and_few_rows_are_kept_of_equal_ones(spark):
    x = np.zeros((500, 2))
    at, d, near = nearest.nearest_rows(x[:20], x, np.arange(20), np.arange(500), np.full(20, np.inf), 3)
    assert len(at) == 60 and (d == 0).all() and near[:6].tolist() == [1, 2, 3, 0, 2, 3]
    rows = spark.createDataFrame([(i // 2 if i else None, [float(i > 399), 0.0]) for i in range(500)] + [(900, [float("nan"), 0.0])], "id long, x array<double>")
    assert nearest.Blocks(nearest._needed(rows, "id", "x", 3), "id", "x", 10).rows.count() == 13
    got = {r.id: [(n.d, n.id) for n in r._n] for r in nearest.nearest(rows, rows, "id", "x", 3, 10).collect()}
    assert got[0] == [(0.0, None), (0.0, 1), (0.0, 1)] and got[1] == [(0.0, None), (0.0, None), (0.0, 0)] and got[249][0] == (0.0, 200)
    assert len(got) == 250 and 900 not in got


def test_adasyn_against_brute_force(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0, 1, (150, 2)), r.normal(1.5, 1, (40, 2))])
    y = [0] * 150 + [1] * 40
    df = spark.createDataFrame([(i, float(a), float(b), c) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y int")
    out = models.adasyn(df, ["a", "b"], "y", "id").collect()
    ids = list(range(190))
    share = {i: sum(y[j] == 0 for _, j in brute_nearest(x[i], x, ids, i, 5)) / 5 for i in range(150, 190)}
    want = {i: int(np.rint(s / sum(share.values()) * 110)) for i, s in share.items()}
    got = {i: sum(o.source_key == i for o in out) for i in want}
    assert got == want
    for o in out:
        p, s = x[o.source_key], np.array([o.a, o.b])
        near = [x[j] for _, j in brute_nearest(p, x[150:], ids[150:], o.source_key, 5)]
        assert any(abs(np.linalg.norm(s - p) + np.linalg.norm(q - s) - np.linalg.norm(q - p)) < 1e-9 for q in near) and o.y == 1
    far = spark.createDataFrame([(i, float(i), 1) for i in range(9)] + [(100 + i, 1e6 + i, 0) for i in range(30)], "id long, a double, y int")
    with pytest.raises(ValueError, match="another class"):
        models.adasyn(far, ["a"], "y", "id")


def scores(spark, n=400):
    rng = random.Random(2)
    y = [int(rng.random() < 0.4) for _ in range(n)]
    return spark.createDataFrame([(i, v, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * v, 0.2))), 2)) for i, v in enumerate(y)], "row_id long, y int, p double")


def auc(x, pos, neg):
    below = np.cumsum(neg) - neg
    return (pos * (below + neg / 2)).sum() / (pos.sum() * neg.sum())


def test_own_metric_equals_the_named_one(spark):
    df = scores(spark)
    got = {(r.replicate, r.metric): r.value for r in bootstrap.replicate_values(
        df, "row_id", {"auc": auc, "rows": bootstrap.of_rows(lambda y, p: len(y)), "brier": bootstrap.of_rows(lambda y, p: ((y - p) ** 2).mean()),
                       "broken": lambda x, pos, neg: 1 / 0, "nan": lambda x, pos, neg: float("nan")}, n_boot=30).collect()}
    named = {r.replicate: r for r in bootstrap.replicate_metrics(df, "row_id", n_boot=30).collect()}
    for i in range(1, 31):
        assert got[i, "auc"] == pytest.approx(named[i].auc_roc) and got[i, "brier"] == pytest.approx(named[i].brier_score)
        assert got[i, "broken"] is None and got[i, "nan"] is None and 300 < got[i, "rows"] < 500
    ci = {r.metric: r for r in bootstrap.bootstrap_ci(df, "row_id", n_boot=30, metrics=("auc_roc",), callbacks={"auc": auc, "broken": lambda *a: 1 / 0}).collect()}
    assert (ci["auc"].ci_lower, ci["auc"].ci_upper) == pytest.approx((ci["auc_roc"].ci_lower, ci["auc_roc"].ci_upper))
    assert ci["broken"].n_success == 0 and ci["broken"].ci_lower is None and ci["auc"].n_success == 30


def test_files_carry_their_own_names(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "n long, kind string").coalesce(1)
    b = spark.createDataFrame([(2, 0.5)], "n long, score double").coalesce(1)
    a.write.parquet(str(tmp_path / "s1"))
    b.write.mode("append").parquet(str(tmp_path / "s1"))
    b.write.option("header", "true").csv(str(tmp_path / "s2"))
    parquet = S.collect_files(spark, {("r", "one"): str(tmp_path / "s1")}).collect()
    assert len({r.source_file for r in parquet}) == 2 and all(r.source_file.endswith(".parquet") for r in parquet)
    assert {(r.n, r.kind, r.score) for r in parquet} == {(1, "x", None), (2, None, 0.5)}
    csv = S.collect_files(spark, {("r", "two"): str(tmp_path / "s2")}, "csv", {"two": b.schema}).collect()
    assert csv[0].source_file.endswith(".csv") and csv[0].stage == "two" and csv[0].score == 0.5
    with pytest.raises(ValueError):
        S.collect_files(spark, {("r", "two"): str(tmp_path / "s2")}, "csv")


def test_many_categories_are_hashed(spark):
    from tidewatch.operators import impute
    df = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2], "train" if i % 3 else "test") for i in range(60)] + [(60, None, None, "train")],
                               "k long, free string, few string, split string")
    p = impute.fit_preprocessor(df, [], ["free", "few"], F.col("split") == "train", max_categories=5, width=8)
    out = impute.apply_preprocessor(df, p, ["k"])
    assert p.hashed == {"free": 8} and out.columns == ["k", *sorted(["few_a", "few_b"]), *[f"free_hash_{i}" for i in range(8)]]
    assert all(sum(r[f"free_hash_{i}"] for i in range(8)) == 1 for r in out.collect())


def test_observed_counts_come_with_the_one_pass(spark, at):
    from tidewatch.operators import cohort as C
    stays = spark.createDataFrame([(1, 1, at(0), at(10)), (2, 1, at(5), at(20)), (3, 2, at(0), at(3)), (4, 3, at(0), at(9))],
                                  "stay_id long, subject_id long, intime timestamp_ntz, outtime timestamp_ntz")
    events = spark.createDataFrame([(1, at(1)), (1, at(2)), (3, at(1)), (2, at(6)), (4, None)], "stay_id long, charttime timestamp_ntz")
    cohort, flow = C.observed_cohort(stays, events, min_hours=6.0)
    assert [r.stay_id for r in cohort.collect()] == [1]
    assert {r.name: r.n for r in flow.collect()} == {"total_stays": 4, "subjects": 3, "first_stays": 3, "excluded_repeat_stays": 1, "excluded_no_record": 1,
                                                    "excluded_short": 1, "final_cohort": 1, "events_read": 5, "events_without_time": 1}
    rows = spark.createDataFrame([(1, at(1), 7, 2.0), (1, None, 7, 2.0), (1, at(1), 8, 2.0), (9, at(1), 7, 2.0), (1, at(99), 7, 2.0)],
                                 "stay_id long, charttime timestamp_ntz, itemid int, valuenum double")
    kept, report = S.observed_event_scan(rows, stays.select("stay_id", "intime"), spark.createDataFrame([(7, "x")], "itemid int, variable string"), max_hours=6.0)
    assert kept.count() == 1 and [r.n for r in report.orderBy("step").collect()] == [5, 1, 1, 1, 1, 1]
    empty, report = S.observed_event_scan(rows.limit(0), stays.select("stay_id", "intime"), spark.createDataFrame([(7, "x")], "itemid int, variable string"), max_hours=6.0)
    assert empty.count() == 0 and {r.n for r in report.collect()} == {0}
