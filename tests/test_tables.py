import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators import clean, grid, guards, impute, models, profile, ranking, rules, scale, select, split
from tidewatch.sources import tables as S


def test_exact_quantiles_all_paths(spark):
    rng = random.Random(1)
    rows = [(rng.gauss(0, 10), float(rng.randint(0, 3)), None if i % 3 else rng.lognormvariate(0, 2), None) for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    arr = {c: np.array([r[i] for r in rows if r[i] is not None], dtype=float) for i, c in enumerate("abc")}
    for options in ({}, {"limit": 10}, {"accuracy": 50, "limit": 10}, {"accuracy": 50, "limit": 1}):
        q = ranking.exact_quantiles(df, list("abcd"), probs, **options)
        for c in "abc":
            assert q[c] == pytest.approx(np.quantile(arr[c], probs).tolist(), abs=1e-9)
        assert q["d"] == [None] * len(probs)


def test_bucket_of(spark):
    df = spark.range(0, 400).select((F.col("id") / 3).alias("v"))
    for n in (1, 5, 97, 250):
        edges = [i * 100 / n for i in range(n)]
        got = df.select("v", ranking.bucket_of("v", edges).alias("b")).collect()
        assert all(r.b == sum(e < r.v for e in edges) for r in got)
    assert spark.range(1).select(ranking.bucket_of(F.lit(None), [1.0]), ranking.bucket_of(F.lit(None), list(map(float, range(200))))).first()[0] == -1


def test_running_totals_and_ranks_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, "g1" if i % 3 else "g2", 5.0 if rng.random() < 0.4 else round(rng.random() * 9, 1)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    edges = ranking.fit_edges(df, "v", 16)
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for desc in (False, True):
        got = {(r.g, r.v): r.cum_n for r in ranking.running_totals(counts, ["g"], "v", ["n"], edges, desc).collect()}
        for (g, v), c in got.items():
            assert c == sum(1 for _, h, x in rows if h == g and (x >= v if desc else x <= v))
    ranked = ranking.value_ranks(df, "v", "id").collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 901))
    by = sorted(ranked, key=lambda r: r["rank"])
    assert all(a.v <= b.v for a, b in zip(by, by[1:]))
    h = ranking.hash_ranks(df, ["g"], "id").collect()
    for g in ("g1", "g2"):
        assert sorted(r["rank"] for r in h if r.g == g) == list(range(1, 1 + sum(r[1] == g for r in rows)))


def test_organ_and_interaction_rules(spark):
    cols = dict(map_min=60, sbp_min=85, shock_index=1.0, spo2_min=90, resp_rate_max=32, resp_distress_score=31, creatinine_max=2.0,
                bun_max=45, urine_output_total=200.0, bilirubin_max=3.0, inr_max=2.0, platelets_min=64, hemoglobin_min=7,
                lactate_max=4.0, bicarbonate_min=15, anion_gap_max=18, age=80, prev_dx_count_total=3, resp_rate_mean=28, sirs_criteria_count=2,
                lactate_mean=3.0, critical_value_count=5, panel_missing_count_0_6h=3)
    df = spark.createDataFrame([tuple(float(v) for v in cols.values()), tuple([None] * len(cols))],
                               ", ".join(f"{c} double" for c in cols))
    a, b = rules.interactions(rules.organ_flags(df)).collect()
    assert a.organ_dysfunction_count == 6 and b.organ_dysfunction_count == 0
    assert (a.age_x_prev_dx_count, a.age_x_shock_index, a.lactate_x_hypotension, a.resp_rate_x_spo2_deficit) == (240, 80, 4, 280)
    assert (a.platelets_x_inr, a.sirs_x_lactate, a.creatinine_x_urine_output, a.bilirubin_x_inr,
            a.critical_count_x_missing_lab_count) == (128, 6, 400, 6, 15)
    assert "renal_dysfunction" not in rules.organ_flags(spark.range(1)).columns


def test_calendar_skips_numeric_columns(spark):
    df = spark.createDataFrame([(1, "2024-01-06 05:30:00", 3.0)], "id long, intime string, heart_rate_hour_0 double")
    out = rules.calendar_features(df)
    r = out.first()
    assert r.intime_hour == 5 and r.intime_dayofweek == 5 and r.intime_is_weekend == 1 and r.heart_rate_hour_0 == 3.0
    assert "heart_rate_hour_0_hour" not in out.columns


def test_guards(spark):
    df = spark.createDataFrame([(1, 2, 0, "x", "y", 3.0, 50, 2.0)] * 3, "subject_id int, stay_id int, mortality int, death_time string, "
                               "discharge_location string, duration_hours double, age int, lactate_max double")
    assert guards.feature_matrix(df).columns == ["age", "lactate_max"]
    with pytest.raises(ValueError):
        guards.assert_no_leakage(df)
    names = spark.createDataFrame([("heart_rate_mean",), ("has_metastatic_cancer",), ("total_other_measurements_0_6h",)], "n string")
    assert {r.n: r.status for r in guards.provenance(names, "n").collect()} == {
        "heart_rate_mean": "matched", "has_metastatic_cancer": "disallowed", "total_other_measurements_0_6h": "unmatched"}
    assert guards.registry(spark).count() == 22
    with pytest.raises(ValueError):
        guards.require_all_ids(df.select("stay_id"), spark.createDataFrame([(99,)], "stay_id int"), "stay_id")
    with pytest.raises(ValueError):
        guards.check_prediction_frame(spark.createDataFrame([("t", "m", 1, 0.5, 7)], "split string, model_name string, y_true int, p_pred double, subject_id int"))
    assert [c for c in ("chloride_max", "stay_id") if spark.createDataFrame([(c,)], "c string").select(guards.irrelevant(F.col("c"))).first()[0]] == ["stay_id"]


def test_split_keeps_entities_together(spark):
    df = spark.createDataFrame([(i, i % 40, int(i % 40 % 4 == 0)) for i in range(400)], "row long, entity long, y int")
    out = split.split_rows(df, "entity", "y").cache()
    assert out.count() == 400 and split.split_overlap(out, "entity").count() == 0
    n = {(r.split, r.y): r["count"] for r in out.groupBy("split", "y").count().collect()}
    assert n[("test", 1)] == 20 and n[("test", 0)] == 60 and n[("validation", 1)] == 20 and n[("train", 0)] == 180
    folds = split.fold_entities(df, "entity", "y", k=50).groupBy("fold").count().collect()
    assert len(folds) == 10  # capped by the ten positive entities
    lone = spark.createDataFrame([(i, i, int(i == 0)) for i in range(20)], "row long, entity long, y int")
    assert split.split_rows(lone, "entity", "y").count() == 20


def test_imputation_and_scaling(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x = rng.gauss(50, 10)
        rows.append((i, x, None if i % 7 == 0 else 2 * x + rng.gauss(0, 1), None if i % 9 == 0 else i % 2, i % 2))
    df = spark.createDataFrame(rows, "stay_id long, x double, y double, flag long, mortality long")
    out = {r.stay_id: r for r in impute.impute_chained(df, ["x", "y", "flag"], key="stay_id", rounds=2, estimator="linear").collect()}
    assert all(r.y is not None and r.flag in (0, 1) for r in out.values())
    assert all(out[i].y == y for i, _, y, _, _ in rows if y is not None)
    assert np.mean([abs(out[i].y - 2 * x) for i, x, y, _, _ in rows if y is None]) < 3
    fill = impute.fit_fill(df, ["y"], F.col("stay_id") < 100)
    assert fill.values["y"] == pytest.approx(np.median([r[2] for r in rows[:100] if r[2] is not None]))
    s = scale.scale_if_needed(df.withColumn("wide", F.col("x") * 100))
    assert [r.mortality for r in s.orderBy("stay_id").collect()] == [r[4] for r in rows]
    const = scale.robust_scale(spark.createDataFrame([(1.0,), (1.0,)], "c double"))
    assert [r.c for r in const.collect()] == [0.0, 0.0]


def test_winsorize_and_skew_edges(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 5.0, None)], "chloride_id long, v double, e double")
    assert clean.winsorize(df).columns == df.columns
    assert df.select(rules.adjusted_skew("v")).first()[0] is None


def test_p_values(spark):
    assert profile.t_two_sided(2.0, 10.0) == pytest.approx(0.0733880, abs=1e-6)
    assert profile.t_two_sided(0.0, 5.0) == pytest.approx(1.0)
    assert profile.t_two_sided(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)
    df = spark.createDataFrame([(float(i % 13), i % 2, int(i % 3 == 0)) for i in range(90)], "a double, g int, b int")
    t = {r.column_name: r for r in profile.with_p_values(profile.table_one(df, ["a", "b"], "g")).collect()}
    assert t["a"].kind == "continuous" and 0 < t["a"].p_value <= 1 and t["b"].kind == "binary"
    assert t["b"].p_value == pytest.approx(math.erfc(math.sqrt(t["b"].statistic / 2)))


def test_smote_rows_lie_between_minority_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random(), int(i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = models.smote(df, ["a", "b"], "y", "id").collect()
    assert len(out) == 160 - 40
    pts = {r[0]: np.array(r[1:3]) for r in rows if r[3] == 1}
    for r in out:
        p, s = pts[r.source_key], np.array([r.a, r.b])
        assert any(abs(np.linalg.norm(s - p) + np.linalg.norm(q - s) - np.linalg.norm(q - p)) < 1e-9 for q in pts.values())


def test_selection(spark):
    rng = random.Random(6)
    rows = [(x := rng.gauss(0, 1), 2 * x + rng.gauss(0, 0.01), rng.gauss(0, 1), 1.0, int(x > 0)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double, y int")
    assert select.variance_filter(df, ["a", "b", "c", "k"]) == ["a", "b", "c"]
    assert select.corr_filter(df, ["a", "b", "c"]) == ["a", "c"]
    assert select.redundancy_greedy(df, ["a", "b", "c"]) == ["b", "c"]
    assert select.corr_filter_protected(df, ["a", "b", "c"], ["b"]) == ["a", "b", "c"]
    assert select.top_k(select.anova_scores(df, ["a", "b", "c"], "y"), 1).first().column_name in ("a", "b")
    sub = select.importance_above_mean(spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "column_name string, score double"), ["c"])
    assert {r.column_name for r in sub.collect()} == {"a", "c"}
    assert select.pca_reduce(df, ["a", "b", "c"], 0.8).columns == ["pc_1"]


def test_grid_facts(spark, at):
    ev = [(1, at(0.1), "heart_rate", 80.0), (1, at(0.3), "heart_rate", 90.0), (1, at(0.3), "sbp", 100.0), (1, at(0.35), "map", 60.0),
          (1, at(0.6), "lactate", 2.5), (1, at(6.0), "lactate", 3.0), (1, at(0.3), "spo2", 88.0)]
    win = spark.createDataFrame([(i, t, v, x, (t - at(0)).total_seconds() / 3600) for i, t, v, x in ev],
                                "stay_id long, charttime timestamp_ntz, variable string, valuenum double, hours_from_admit double")
    ids = spark.createDataFrame([(1,)], "stay_id long")
    g = {(r.bin, r.channel): r for r in grid.build_grid(win, ids).collect()}
    assert len(grid.CHANNELS) == 43 and len(g) == 24 * 43
    assert g[(0, "heart_rate_last")].value == 80 and g[(1, "heart_rate_last")].value == 90
    assert g[(2, "lactate_last")].value == 2.5 and g[(23, "lactate_last")].value == 3.0
    assert g[(1, "shock_index_bin")].value == pytest.approx(0.9) and g[(1, "hypotension_flag_bin")].value == 1
    assert g[(1, "hypoxemia_flag_bin")].value == 1 and g[(1, "critical_value_count_bin")].value == 2
    assert g[(3, "heart_rate_last")].mask == 0 and g[(2, "heart_rate_last")].delta == 0.25 and g[(0, "lactate_last")].delta == 6.0
    packed = grid.pack(grid.build_grid(win, ids), grid.CHANNELS).first()
    assert len(packed.value) == 24 and len(packed.value[0]) == 43 and packed.value[1][0] == 90


def test_grid_normalizer(spark):
    g = spark.createDataFrame([("train", "x", 10.0, 1, 0.0, 12), ("train", "x", 20.0, 1, 6.0, 0), ("train", "x", 0.0, 0, 6.0, 0),
                               ("validation", "x", 1000.0, 1, 0.0, 1)], "split string, channel string, value double, mask int, delta double, count long")
    p = grid.fit_normalizer(g, F.col("split") == "train")
    assert tuple(p.first()) == ("x", 15.0, 5.0)
    out = sorted((r.value, r.delta, r["count"]) for r in grid.normalize(g, p).collect())
    assert [o[0] for o in out] == [-1.0, 0.0, 1.0, 5.0]
    assert (-1.0, 0.0, 1.0) in out and (1.0, 1.0, 0.0) in out


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 3), (2, "bad", 4)], "a long, t string, b int")
    p = str(tmp_path / "t.csv")
    df.write.option("header", "true").csv(p)
    with pytest.raises(ValueError):
        S.scan(spark, p, fmt="csv")
    back = S.scan(spark, p, ["a", "t"], "csv", df.schema)
    assert back.columns == ["a", "t"] and back.count() == 2
    parsed = S.parse_timestamps(back, ["t"], coerce=True).orderBy("a").collect()
    assert parsed[0].t == dt.datetime(2024, 1, 1) and parsed[1].t is None
    checks = {r.check_name: r.passed for r in S.table_contract(df, "t", ["a", "zz"]).collect()}
    assert checks == {"column:a": True, "column:zz": False, "has_rows": True}
    assert S.read_or_empty(spark, str(tmp_path / "none"), df.schema).count() == 0
    with pytest.raises(ValueError):
        S.write_report(df.withColumnRenamed("a", "stay_id"), str(tmp_path), "r", [])
    paths = S.write_report(df, str(tmp_path), "r", ["b", "a"])
    assert spark.read.json(paths["json"]).count() == 2
    assert open(next((tmp_path / "r_csv").glob("part-*.csv"))).readline().strip() == "b,a,t"
    ev = spark.createDataFrame([(2, 1, "x"), (1, 2, "y"), (1, 1, "z")], "stay_id long, charttime long, variable string")
    S.write_events(ev, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 3


def test_expressions(spark):
    df = spark.createDataFrame([(" Heart-Rate (bpm) ", 0.3), ("!!", 1.0), (None, None)], "s string, p double")
    got = df.select(X.sanitize_token("s"), X.edge_bin("p", X.grid_edges(10)), X.clip("p", 0.5, 0.9), X.flag(F.col("p") > 0.5)).collect()
    assert [r[0] for r in got] == ["heart_rate_bpm", "feature", None]
    assert [r[1] for r in got] == [2, 9, None]  # 0.3 lies below the edge 0.30000000000000004
    assert [r[2] for r in got] == [0.5, 0.9, None] and [r[3] for r in got] == [0, 1, 0]
    xs = spark.createDataFrame([(1.0, None, 5.0, 7.0)], "a double, b double, c double, d double")
    r = xs.select(X.row_slope(list("abcd"), [0, 1, 2, 3]), X.row_std(list("abcd")), X.row_mean(list("abcd"))).first()
    assert r[0] == pytest.approx(np.polyfit([0, 2, 3], [1, 5, 7], 1)[0]) and r[1] == pytest.approx(np.std([1, 5, 7], ddof=1))


def test_corr_pairs_with_gaps_and_offsets(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    x[:, 1] += 0.5 * x[:, 0]
    x[:, 2] = 1e9 + 1e-2 * x[:, 0] + 1e-3 * x[:, 3]
    x[::3, 1] = np.nan
    x[::5, 3] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (7.0, None) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(5)
    got = {(r.a, r.b): r.r for r in select.corr_pairs(df, list("abcdef")).collect()}
    assert len(got) == 15
    for i in range(4):
        for j in range(i + 1, 4):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got["abcd"[i], "abcd"[j]] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-5)
    assert got["a", "e"] is None and got["a", "f"] is None


def test_date_columns_of_a_numeric_table(spark):
    assert guards.date_columns(spark.range(3).toDF("x")).collect() == []


def test_restored_columns_and_fit_rows(spark):
    rows = [(i, float(i), i % 2, 20.0 + 10 * (i % 2) + (i % 3), None if i == 4 else "a", i < 10) for i in range(20)]
    full = spark.createDataFrame(rows, "k long, age double, gender_numeric int, bmi double, has_prior_diagnoses string, train boolean")
    out = {r.k: r for r in impute.restore_columns(full.select("k"), full, "k").collect()}
    by = {g: float(np.median([r[3] for r in rows if r[2] == g])) for g in (0, 1)}
    assert all(r.bmi == by[int(r.gender_numeric)] and r.has_prior_diagnoses == "a" and r.age == r.k for r in out.values())
    train = {r.k: r for r in impute.restore_columns(full.select("k"), full, "k", F.col("train")).collect()}
    assert train[19].bmi == float(np.median([r[3] for r in rows if r[2] == 1 and r[5]]))
    alone = impute.restore_columns(full.select("k"), full.drop("gender_numeric"), "k").first()
    assert alone.bmi == float(np.median([r[3] for r in rows]))


def test_chained_imputation_learns_from_named_rows_only(spark):
    rng = random.Random(9)
    rows = [(i, float(i % 17), None if i % 5 == 0 else 3.0 * (i % 17) + (1000.0 if i >= 150 else rng.random()), i < 150) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, x double, y double, train boolean")
    out = {r.k: r.y for r in impute.impute_chained(df, ["x", "y"], key="k", rounds=1, max_missing=0.5, estimator="linear", fit_on=F.col("train")).collect()}
    assert all(out[i] < 100 for i in range(150, 200, 5))


def test_neighbours_are_exact_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(models, "NEIGHBOUR_BLOCK", 40)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 3))
    x[10] = x[11]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    for r in models.neighbours(df, "id", "x", 4).collect():
        d = np.sqrt(((x - x[r.id]) ** 2).sum(axis=1))
        want = sorted(d[i] for i in range(150) if i != r.id)[:4]
        assert [n["d"] for n in r._n] == pytest.approx(want)
    with pytest.raises(ValueError, match="two minority rows"):
        models.smote(spark.createDataFrame([(1, 1.0, 1), (2, 2.0, 0), (3, 3.0, 0)], "id long, a double, y int"), ["a"], "y", "id")
