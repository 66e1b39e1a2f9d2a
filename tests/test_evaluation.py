import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tidewatch.functions import resample
from tidewatch.functions.constants import POISSON_CUTS
from tidewatch.functions.exprs import poisson_weight
from tidewatch.functions.resample import weights
from tidewatch.operators import bootstrap, calibrate, ensemble, metrics, profile, results, split, subgroups, thresholds

SCHEMA = "y int, p double"


def frame(spark, ys, ps):
    return spark.createDataFrame([(i, int(y), float(p)) for i, (y, p) in enumerate(zip(ys, ps))], "row_id long, " + SCHEMA)


def brute_auc(y, p):
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(y, p):
    out, prev = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp = sum(b for a, b in zip(p, y) if a >= t)
        recall, precision = tp / sum(y), tp / sum(a >= t for a in p)
        out, prev = out + (recall - prev) * precision, recall
    return out


def test_confusion_fact(spark):
    r = metrics.binary_metrics(frame(spark, [0, 0, 1, 1], [.1, .6, .7, .2])).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 1, 1)
    assert {r.accuracy, r.precision, r.recall, r.specificity, r.f1, r.npv} == {0.5}


@pytest.mark.parametrize("digits", [1, 6])
def test_curve_metrics_against_brute_force(spark, digits):
    rng = random.Random(digits)
    y = [int(rng.random() < 0.3) for _ in range(300)]
    p = [round(min(1, max(0, rng.random() * 0.8 + 0.2 * v)), digits) for v in y]
    r = metrics.ranking_metrics(frame(spark, y, p)).first()
    assert r.auc_roc == pytest.approx(brute_auc(y, p)) and r.average_precision == pytest.approx(brute_ap(y, p))
    assert r.brier_score == pytest.approx(np.mean([(a - b) ** 2 for a, b in zip(p, y)]))
    t = {x.threshold: x for x in thresholds.threshold_table(frame(spark, y, p)).collect()}
    assert set(t) == set(p) | {0.0, 1.0}
    for k in list(t)[::7]:
        tp, fp = sum(b for a, b in zip(p, y) if a >= k), sum(1 - b for a, b in zip(p, y) if a >= k)
        assert (t[k].tp, t[k].fp) == (tp, fp) and t[k].cost == fp + 2 * (sum(y) - tp)


def test_one_class_group(spark):
    r = metrics.ranking_metrics(frame(spark, [1, 1], [.2, .3])).first()
    assert r.auc_roc is None and r.average_precision == 0.0


def test_threshold_fallbacks(spark):
    t = thresholds.threshold_table(frame(spark, [0, 0, 0, 1], [.9, .8, .7, .1]))
    got = {r.policy: r for r in thresholds.select_policies(t, precision=0.9).collect()}
    assert got["high_sensitivity"].threshold == 0.1 and not got["high_sensitivity"].fallback_used
    assert got["high_precision"].fallback_used and got["high_precision"].threshold == 0.1
    good = thresholds.select_policies(thresholds.threshold_table(frame(spark, [0, 0, 1, 1], [.1, .4, .6, .9])))
    assert {r.policy: r.threshold for r in good.collect()} == {"high_sensitivity": 0.6, "balanced_f1": 0.6, "high_precision": 0.9}
    with pytest.raises(ValueError):
        thresholds.optimal_threshold(t, "nope")


def test_thresholds_come_from_validation(spark):
    rows = [("m", "validation", y, p) for y, p in [(0, .1), (0, .4), (1, .6), (1, .9)]] + [("m", "test", y, p) for y, p in [(1, .2), (0, .95)]]
    df = spark.createDataFrame(rows, "model_name string, split string, y int, p double")
    out = thresholds.fixed_thresholds(df).collect()
    by = {(r.split, r.threshold_policy): r.threshold for r in out}
    assert all(by[("test", k)] == by[("validation", k)] for k in ("high_sensitivity", "balanced_f1", "high_precision"))
    assert list(out[0].asDict())[:3] == ["model_name", "split", "auc_roc"]


def test_calibration(spark):
    rng = random.Random(4)
    p = [rng.uniform(0.05, 0.95) for _ in range(2000)]
    y = [int(rng.random() < a) for a in p]
    df = frame(spark, y, p)
    s = calibrate.calibration_summary(df).first()
    assert s.calibration_slope == pytest.approx(1.0, abs=0.15) and abs(s.calibration_intercept) < 0.15
    assert s.expected_calibration_error < 0.06
    m = calibrate.fit_platt(df).first()
    x = np.log(np.array(p) / (1 - np.array(p)))
    mu = 1 / (1 + np.exp(-(m.intercept + m.coefficient * x)))
    assert abs(np.sum(mu - y)) < 1e-5 and abs(np.sum((mu - y) * x) + m.coefficient) < 1e-4  # gradient is zero
    assert m.fit_n == 2000 and m.method == "platt_scaling"
    with pytest.raises(ValueError):
        calibrate.fit_platt(frame(spark, [1, 1], [.2, .3]))
    iso = calibrate.apply_isotonic(df, calibrate.fit_isotonic(df)).orderBy("p").collect()
    v = [r.p_calibrated for r in iso]
    assert all(a <= b + 1e-12 for a, b in zip(v, v[1:])) and 0 <= v[0] and v[-1] <= 1
    curve = metrics.calibration_curve(frame(spark, [0, 1], [.3, 1.0])).orderBy("bin").collect()
    assert len(curve) == 10 and curve[2].n == 1 and curve[3].n == 0 and curve[3].observed_event_rate is None and curve[9].n == 1
    one = calibrate.calibration_slope(spark.createDataFrame([("a", 1, .3), ("a", 1, .4), ("b", 0, .2), ("b", 1, .3), ("b", 0, .4), ("b", 1, .6)], "g string, " + SCHEMA), ["g"])
    got = {r.g: r for r in one.collect()}
    assert got["a"].calibration_slope is None and got["b"].calibration_slope is not None


def test_poisson_weights(spark):
    w = spark.range(4000).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(20)))).select("id", "b", poisson_weight("id", "b").alias("w"))
    s = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert s[0] == pytest.approx(1.0, abs=0.02) and s[1] == pytest.approx(1.0, abs=0.04)
    keys = np.array([0, 1, 5, 1 << 33, (1 << 40) + 7, -3])
    got = weights(keys, np.arange(1, 40), 99, POISSON_CUTS)
    df = spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "i long, id long").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(39))))
    assert all(got[r.i, r.b - 1] == r.w for r in df.select("i", "b", poisson_weight("id", "b", 99).alias("w")).collect())


@pytest.mark.parametrize("seed", [1, 12345, 777])
@pytest.mark.parametrize("keys", ["consecutive", "strided", "random", "high"])
def test_resamples_spread_as_they_should(seed, keys):
    """Spread of size, mean and AUC over 1000 replicates against their known values; no lag correlation."""
    n, rng = 2000, np.random.default_rng(4)
    k = {"consecutive": np.arange(n), "strided": np.arange(n) * 4096, "random": rng.integers(0, 1 << 62, n), "high": np.arange(n) << 32}[keys]
    w = weights(k, np.arange(1, 1001), seed, POISSON_CUTS)
    x = rng.normal(size=n)
    size, mean = w.sum(axis=0), (w * x[:, None]).sum(axis=0) / w.sum(axis=0)
    assert size.std() / np.sqrt(n) == pytest.approx(1.0, abs=0.08)
    assert mean.std() / (x.std() / np.sqrt(n)) == pytest.approx(1.0, abs=0.08)
    for s in (size, mean):
        assert abs(np.corrcoef(s[1:], s[:-1])[0, 1]) < 0.1
    y, p = rng.random(n) < 0.4, np.sort(rng.random(n))
    pos, neg = w * y[:, None], w * ~y[:, None]
    below = np.cumsum(neg, axis=0) - neg / 2
    auc = (pos * below).sum(axis=0) / (pos.sum(axis=0) * neg.sum(axis=0))
    g = np.random.default_rng(8)
    ref = []
    for _ in range(1000):
        v = g.poisson(1.0, n)
        a, b = v * y, v * ~y
        ref.append((a * (np.cumsum(b) - b / 2)).sum() / (a.sum() * b.sum()))
    assert auc.std() / np.std(ref) == pytest.approx(1.0, abs=0.1)


def test_null_keys_and_labels_are_kept(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 5 == 0 else f"g{i % 2}", None if i % 4 == 0 else i % 2, rng.random(), None if i % 10 == 0 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, g string, y int, p double, v double")
    full = df.where("y IS NOT NULL")
    assert {r.g: r.n for r in metrics.binary_metrics(full, groups=["g"]).collect()} == {r.g: r["count"] for r in full.groupBy("g").count().collect()}
    assert {r.g for r in thresholds.threshold_table(full.withColumnRenamed("g", "model_name"), ["model_name"]).select(F.col("model_name").alias("g")).collect()} == {None, "g0", "g1"}
    alone = calibrate.calibration_slope(full.where("g IS NULL").drop("g")).first()
    by = {r.g: r for r in calibrate.calibration_slope(full, ["g"]).collect()}
    assert by[None].calibration_slope == pytest.approx(alone.calibration_slope, rel=1e-6)
    q = subgroups.rank_quartile(df, "v", "k").collect()
    assert len(q) == 100 and all((r.quartile is None) == (r.v is None) for r in q) and {r.quartile for r in q} == {None, 1, 2, 3, 4}
    over = split.resample(df, "y", "k", how="over").groupBy("y").count().collect()
    assert {r.y for r in over} == {None, 0, 1} and len({r["count"] for r in over}) == 1
    with pytest.raises(Exception, match="needs a label"):
        split.split_rows(df, "k", "y").collect()
    text = split.split_rows(df.where("g IS NOT NULL"), "k", "g").collect()
    assert len(text) == 80
    sure = spark.createDataFrame([(int(i > 10), i / 21) for i in range(1, 21)], "y int, p double")
    assert calibrate.newton_logistic(metrics.score_counts(sure).withColumn("x", F.col("p")), [], "x", ridge=0.0, steps=15).first().slope is None


def test_bootstrap(spark):
    rng = random.Random(7)
    y = [int(rng.random() < 0.4) for _ in range(200)]
    p = [round(min(1, max(0, rng.random() * 0.7 + 0.3 * v)), 2) for v in y]
    df = frame(spark, y, p)
    per = {r.replicate: r for r in bootstrap.replicate_metrics(df, "row_id", n_boot=8).collect()}
    weights = {(r.id, r.b): r.w for r in spark.range(200).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(8))))
               .select("id", "b", poisson_weight("id", "b").alias("w")).collect()}
    for b in (1, 5, 8):
        yy = [v for i, v in enumerate(y) for _ in range(weights[(i, b)])]
        pp = [v for i, v in enumerate(p) for _ in range(weights[(i, b)])]
        assert per[b].auc_roc == pytest.approx(brute_auc(yy, pp)) and per[b].average_precision == pytest.approx(brute_ap(yy, pp))
        assert per[b].tp == sum(v for v, q in zip(yy, pp) if q >= 0.5) and per[b].n == len(yy)
        assert per[b].brier_score == pytest.approx(np.mean([(q - v) ** 2 for v, q in zip(yy, pp)]))
    ci = {r.metric: r for r in bootstrap.bootstrap_ci(df, "row_id", n_boot=50).collect()}
    assert len(ci) == 9 and all(r.ci_lower <= r["mean"] <= r.ci_upper and r.n_success == 50 for r in ci.values())
    tiny = {r.metric: r for r in bootstrap.bootstrap_ci(frame(spark, [0, 1], [.2, .8]), "row_id", n_boot=30).collect()}
    assert 0 < tiny["auc_roc"].n_success < 30
    d = bootstrap.paired_difference(df.withColumn("q", 1 - F.col("p")), "row_id", metric="auc_roc", model_a=("a", "p"), model_b=("b", "q"), n_boot=25)
    r = d.first()
    assert len(d.columns) == 12 and r.difference > 0 and r.ci_lower > 0 and r.p_value_two_sided == 0


def test_subgroups(spark):
    rows = [(i, 40 + i * 3, "M" if i % 2 else "F", "dx" if i % 3 else "other", None if i % 4 == 0 else 2.0, i % 5, i % 6, i % 7, "MICU", i % 2, i % 2, 0.1 + 0.05 * i)
            for i in range(16)]
    df = spark.createDataFrame(rows, "row_id long, age int, sex string, major_diagnosis_group string, lactate_max_0_6h double, panel_missing_count_0_6h int, "
                               "total_lab_count int, total_vital_count int, icu_unit_type string, ventilation_status int, y int, p double")
    lab = subgroups.subgroup_labels(df, "row_id")
    assert {r.g_age_group for r in lab.collect()} == {"<50", "50-64", "65-79", "80+"}
    out = subgroups.subgroup_metrics(lab, threshold=0.5, min_n=5).collect()
    assert len({r.subgroup_variable for r in out}) == 8 and any(r.small_subgroup for r in out)
    for n in (7, 10, 13, 101):
        q = spark.range(n).select("id", F.col("id").alias("v"))
        got = [r.quartile for r in subgroups.rank_quartile(q, "v", "id").orderBy("id").collect()]
        edges = np.quantile(np.arange(1, n + 1), [0.25, 0.5, 0.75])
        assert got == [1 + int(sum(k > e for e in edges)) for k in range(1, n + 1)]


def test_ensembles(spark):
    preds = spark.createDataFrame([(1, "a", 0, .1), (2, "a", 1, .8), (1, "b", 0, .2), (2, "b", 1, .7)], "row_id long, model_name string, y_true int, p_pred double")
    wide = ensemble.prediction_pivot(preds, ["a", "b"])
    assert [tuple(r) for r in wide.orderBy("row_id").collect()] == [(1, 0, .1, .2), (2, 1, .8, .7)]
    ensemble.require_complete(wide, ["a", "b"])
    with pytest.raises(ValueError):
        ensemble.require_complete(ensemble.prediction_pivot(preds.where("not (row_id = 1 and model_name = 'b')"), ["a", "b"]), ["a", "b"])
    with pytest.raises(ValueError):
        ensemble.ensemble_average(wide, ["a"])
    with pytest.raises(ValueError):
        ensemble.fit_stacker(wide, ["a", "b"], split="test")
    assert [r.p_ensemble for r in ensemble.ensemble_average(wide, ["a", "b"]).orderBy("row_id").collect()] == pytest.approx([0.15, 0.75])
    rng = random.Random(8)
    df = spark.createDataFrame([(i, i % 30, x := rng.gauss(0, 1), int(x + rng.gauss(0, 1) > 0)) for i in range(200)], "id long, e long, x double, y int")
    out, meta, bases = ensemble.oof_stacker(df, ["x"], {"lr": lambda: LogisticRegression(featuresCol="_x", labelCol="_y")}, entity="e", label="y", k=3)
    assert out.count() == 200 and len(bases) == 1 and metrics.ranking_metrics(out, p="p_stacked").first().auc_roc > 0.6


def test_result_tables(spark):
    rec = spark.createDataFrame([("a", "test", "balanced_f1", .5, .7), ("b", "test", "balanced_f1", .6, .6), ("a", "validation", "balanced_f1", .9, .9),
                                 ("c", "test", "other", .1, .2)], "model_name string, split string, threshold_policy string, average_precision double, auc_roc double")
    assert [r.model_name for r in results.primary_results(rec).collect()] == ["b", "a", "c"]
    s = {r.metric: r for r in profile.seed_stability(spark.createDataFrame([(1, .5, .6), (2, .6, .7), (3, .7, .8)], "seed int, average_precision double, auc_roc double"),
                                                     ["average_precision", "auc_roc"]).collect()}
    assert s["auc_roc"].n == 3 and s["auc_roc"]["mean"] == pytest.approx(0.7)
    odds = results.odds_ratios(spark.createDataFrame([("a", 0.0), ("b", 1.0)], "feature string, coefficient double")).collect()
    assert odds[0].feature == "b" and odds[0].odds_ratio == pytest.approx(np.e)


def test_suite_and_plans(spark, cohort, long_events):
    from tidewatch.plans import features, preprocess, suite
    rng = random.Random(9)
    rows = [(i, i // 2, x := rng.gauss(0, 1), None if i % 11 == 0 else 60 + 10 * x, "M" if i % 2 else "F", int(x + rng.gauss(0, 0.7) > 0.4)) for i in range(240)]
    df = spark.createDataFrame(rows, "stay_id long, subject_id long, lactate_max double, map_min double, sex string, mortality int")
    r = suite.run_suite(df, entity="subject_id", label="mortality", row_key="stay_id", enabled=["logistic", "forest"], categorical=["sex"], n_boot=5)
    assert {x.status for x in r.status.collect()} == {"completed"} and r.records.count() == 12
    assert "auc_roc_ci_lower" in r.comparison.columns and not set(r.comparison.columns) & {"stay_id", "subject_id", "row_id"}
    with pytest.raises(ValueError):
        suite.run_suite(df, entity="subject_id", label="mortality", row_key="stay_id", enabled=["nope"])
    clean_table, report = preprocess.preprocess(df.drop("subject_id").withColumnRenamed("sex", "gender"), key="stay_id", label="mortality")
    assert clean_table.count() == 240 and all(v == 0 for v in preprocess.nulls_left(clean_table).first())
    assert [r.mortality for r in clean_table.orderBy("stay_id").collect()] == [r[5] for r in rows]
    o = features.FeatureOptions(vitals=["heart_rate"], labs=["lactate"], check_provenance=True, row_rules=False)
    out = features.build_features(cohort, long_events, o).orderBy("stay_id").collect()
    assert out[0].heart_rate_max == 120 and out[0].lactate_bin_2_3h_last == 2.5 and out[2].heart_rate_measured == 0


def test_paired_comparison_makes_one_pass_over_the_rows(spark, monkeypatch):
    """Terms of the precision curve are only worked out where a metric needs them."""
    calls, plain = [], bootstrap.replicate_metrics

    def noted(*args, **options):
        calls.append(options.get("precision_curve", True))
        return plain(*args, **options)
    monkeypatch.setattr(bootstrap, "replicate_metrics", noted)
    df = spark.createDataFrame([(i, i % 3 % 2, (i * 7 % 40) / 40, (i * 11 % 40) / 40) for i in range(400)], "k long, y int, p double, q double")
    got = {m: bootstrap.paired_difference(df, "k", metric=m, model_a=("a", "p"), model_b=("b", "q"), n_boot=20).first() for m in ("auc_roc", "average_precision")}
    assert calls == [False, True]
    per = plain(df, "k", n_boot=20, models={"a": "p", "b": "q"}).collect()
    for m, r in got.items():
        d = sorted(x[m] - y[m] for x in per if x.model == "a" for y in per if y.model == "b" and x.replicate == y.replicate)
        assert r.n_success == 20 and r.ci_lower == pytest.approx(np.quantile(d, 0.025)) and r.ci_upper == pytest.approx(np.quantile(d, 0.975))


def test_runs_in_small_blocks():
    """A run's sums do not depend on how its rows are cut, and weigh each replicate's rows as one table."""
    rng = np.random.default_rng(3)
    n, reps = 900, 200
    rows = pd.DataFrame({"m": 0, "cell": 0, "piece": 0, "p": np.sort(rng.integers(0, 60, n) / 60)[::-1], "y": rng.integers(0, 2, n), "k": np.arange(n)})
    w = weights(rows["k"].to_numpy(), np.arange(1, reps + 1), 5, POISSON_CUTS)
    ((_, r),) = resample.runs([rows.iloc[:400], rows.iloc[400:]], reps, 5, POISSON_CUTS, [0.5], None)
    y, p = rows["y"].to_numpy()[:, None], rows["p"].to_numpy()[:, None]
    assert (r.pos == (w * y).sum(axis=0)).all() and (r.neg == (w * (1 - y)).sum(axis=0)).all()
    assert (r.tp == (w * y * (p >= 0.5)).sum(axis=0)).all() and (r.fp == (w * (1 - y) * (p >= 0.5)).sum(axis=0)).all()
    assert np.allclose(r.brier, (w * (p - y) ** 2).sum(axis=0))
    over = (p > p.T) + (p == p.T) / 2
    assert np.allclose(r.area, np.einsum("ir,ij,jr->r", w * y, over, w * (1 - y), optimize=True))
    assert resample.NEAR_CELLS < n * reps  # several blocks


def test_isotonic_knots_are_searched_once_a_row(spark):
    from tidewatch.operators import calibrate
    pools = spark.createDataFrame([(0.1, 0.2, 0.3, 5.0), (0.5, 0.5, 0.6, 2.0)], "p_low double, p_high double, value double, n double")
    out = calibrate.apply_isotonic(spark.createDataFrame([(0.0,), (0.15,), (0.35,), (0.5,), (0.9,), (None,)], "p double"), pools)
    assert out.columns == ["p", "p_calibrated"]
    got = [r.p_calibrated for r in out.sort(out.p.asc_nulls_last()).collect()]
    assert [round(v, 9) for v in got[:-1]] == [0.3, 0.3, 0.45, 0.6, 0.6] and got[-1] is None
    assert out._jdf.queryExecution().optimizedPlan().toString().count("filter(_k") == 2
