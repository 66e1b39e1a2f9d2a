import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cohort as C
from tidewatch.operators import events as E
from tidewatch.operators import windows as W
from tidewatch.operators.joins import keep_members, spread_join


@pytest.fixture(scope="module")
def win(long_events, cohort):
    return W.windowed_events(long_events, cohort, hours=6.0, variable_col="variable").cache()


def rows(df, key="stay_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_window_is_inclusive(long_events, cohort, at):
    kept = W.filter_to_window(long_events, cohort, hours=6.0)
    assert kept.columns == long_events.columns
    got = kept.collect()
    assert sorted(r.valuenum for r in got) == [2.5, 80.0, 90.0, 100.0, 120.0]
    assert max(r.charttime for r in got) == at(6.0)


@pytest.mark.parametrize("salt", [1, 7])
def test_spread_join_equals_join(spark, salt):
    big = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (3, "b")], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=str)
        assert sorted(map(tuple, spread_join(big, small, ["k"], by=["v"], how=how, salt=salt).collect()), key=str) == want
    twice = small.unionByName(small)
    assert keep_members(big, twice, "k", by=["v"]).count() == big.join(small, "k", "left_semi").count()


def test_vital_summary(win):
    got = {(r.stay_id, r.variable): r for r in E.vital_summary(win, hours=6.0).collect()}
    hr = got[(1, "heart_rate")]
    assert hr.max == 120 and hr.min == 80 and hr.measured == 1
    assert hr.mean == pytest.approx((80 * 1.25 + 100 * 4.5) / 5.75)
    assert got[(2, "heart_rate")].mean == 90


@pytest.mark.parametrize("slices", [1, 3, 4096])
def test_vital_summary_same_time_and_slices(spark, at, slices):
    ev = spark.createDataFrame([(1, "x", at(1), 1.0, 4.0), (1, "x", at(1), 1.0, 8.0), (2, "x", at(1), 1.0, 2.0), (2, "x", at(1), 1.0, 6.0),
                                (2, "x", at(3), 3.0, 10.0), (2, "x", at(4), 4.0, 0.0)],
                               "stay_id long, variable string, charttime timestamp_ntz, hours_from_admit double, valuenum double")
    got = rows(E.vital_summary(ev, hours=6.0, slices=slices))
    assert got[1]["mean"] == 6.0  # all readings at one time: plain mean
    assert got[2]["mean"] == pytest.approx((6 * 2 + 10 * 1) / 3)  # tie order by value; last reading weighs 0


def test_nearest_value(win):
    got = {(r.stay_id, r.variable): r for r in E.nearest_at_anchors(win, [0, 1, 2, 6]).collect()}
    assert got[(1, "heart_rate")].hour_6 == 120 and got[(1, "heart_rate")].hour_0 == 80
    assert got[(1, "heart_rate")].hour_1 == 100 and got[(1, "lactate")].hour_2 == 2.5
    assert got[(2, "heart_rate")].hour_6 is None


def test_hourly_bins(win, cohort):
    b = rows(E.hourly_bins(win, cohort, ["heart_rate", "lactate"]))
    assert b[1]["heart_rate_bin_0_1h_mean"] == 80 and b[1]["heart_rate_bin_1_2h_last"] == 100
    assert b[1]["heart_rate_bin_5_6h_max"] == 120 and b[1]["heart_rate_bin_5_6h_count"] == 1
    assert b[2]["heart_rate_bin_0_1h_count"] == 1 and b[2]["heart_rate_bin_5_6h_observed"] == 0
    assert b[3]["heart_rate_bin_0_1h_count"] == 0 and b[3]["heart_rate_bin_0_1h_mean"] is None
    assert all(v != 999 for r in b.values() for v in r.values())
    with pytest.raises(ValueError):
        E.hourly_bins(win, cohort, ["heart_rate"], aggregations=("median",))


def test_trajectory(win):
    t = {(r.stay_id, r.variable): r for r in E.trajectory(win).collect()}
    r = t[(1, "heart_rate")]
    assert (r["first"], r["last"], r.last_minus_first, r.percent_change) == (80, 120, 40, 0.5)
    assert (r.first_2h_mean, r.last_2h_mean, r.last2h_minus_first2h) == (90, 120, 30)
    assert r.slope_0_6h > 0 and r.deterioration_flag == 1 and r.recovery_flag == 0
    assert t[(2, "heart_rate")].slope_0_6h is None


def test_measurement_process(win, cohort):
    m = rows(E.measurement_process(win, cohort, ["heart_rate", "lactate"], sources=["lab", "vital"],
                                   expected=["heart_rate", "lactate", "creatinine"]))
    assert m[1]["heart_rate_measured_0_6h"] == 1 and m[1]["heart_rate_measurement_count_0_6h"] == 3
    assert m[1]["heart_rate_time_to_first_measurement"] == 0.25 and m[1]["heart_rate_time_since_last_measurement_at_6h"] == 0
    assert (m[1]["total_measurements_0_6h"], m[1]["total_vital_measurements_0_6h"], m[1]["total_lab_measurements_0_6h"]) == (4, 3, 1)
    assert m[1]["panel_missing_count_0_6h"] == 1 and m[2]["heart_rate_time_since_last_measurement_at_6h"] == 5.5
    assert m[3]["heart_rate_measured_0_6h"] == 0 and m[3]["heart_rate_time_to_first_measurement"] is None


def test_instability(win):
    i = {(r.stay_id, r.variable): r for r in E.instability(win).collect()}
    r = i[(1, "heart_rate")]
    assert (r.range_0_6h, r.abnormal_count_0_6h, r.longest_abnormal_run_0_6h, r.worst_recent_value_0_6h) == (40, 1, 1, 120)
    assert i[(2, "heart_rate")].std_0_6h == 0 and i[(2, "heart_rate")].cv_0_6h is None


@pytest.mark.parametrize("slices", [1, 2, 5, 100])
def test_longest_run_against_brute_force(spark, at, slices):
    pattern = [1, 1, 0, 1, 1, 1, 1, 0, 0, 1, 1, 1, 0, 1]
    data = [(1, "x", at(i * 0.4), i * 0.4, float(v)) for i, v in enumerate(pattern)]
    data += [(2, "x", at(i * 0.4), i * 0.4, 1.0) for i in range(12)] + [(3, "x", at(1), 1.0, 0.0)]
    ev = spark.createDataFrame(data, "stay_id long, variable string, charttime timestamp_ntz, hours_from_admit double, valuenum double")
    got = rows(E.longest_run(ev, F.col("valuenum") == 1, hours=6.0, slices=slices))
    assert [got[k]["longest_run"] for k in (1, 2, 3)] == [4, 12, 0]


def test_cohort_and_history(spark, at):
    stays = spark.createDataFrame([(1, 9, at(5), at(50)), (2, 9, at(1), at(40)), (3, 8, at(0), at(3)), (4, 7, at(0), at(30))],
                                  "stay_id long, subject_id long, intime timestamp_ntz, outtime timestamp_ntz")
    ev = spark.createDataFrame([(2, at(2)), (3, at(1)), (1, at(6))], "stay_id long, charttime timestamp_ntz")
    assert {r.stay_id for r in C.first_per_entity(stays).collect()} == {2, 3, 4}
    assert [r.stay_id for r in C.select_cohort(stays, ev).collect()] == [2]
    flow = {r.name: r.n for r in C.cohort_flow(stays, ev, min_hours=6.0).collect()}
    assert flow == {"total_stays": 4, "subjects": 3, "first_stays": 3, "excluded_repeat_stays": 1, "excluded_no_record": 1,
                    "excluded_short": 1, "final_cohort": 1}
    codes = spark.createDataFrame([("V10", 9), ("410.1", 9), ("1970", 9), ("199.0", 9), ("C78.0", 10), ("D62", 10), (None, 10), ("xyz", 3)],
                                  "code string, version int")
    got = [tuple(r) for r in codes.select(C.diagnosis_chapter(F.col("code"), F.col("version")), C.metastatic(F.col("code"), F.col("version"))).collect()]
    assert [g[0] for g in got] == ["other_icd9", "circulatory", "other_icd9", "neoplasms", "neoplasms", "blood_disorders", "unknown", "unknown"]
    assert [bool(g[1]) for g in got] == [False, False, True, True, True, False, False, False]


def test_stream_equals_batch(spark, long_events, cohort, tmp_path):
    from tidewatch.streaming import windows as S
    src = str(tmp_path / "in")
    for i, part in enumerate(long_events.randomSplit([0.5, 0.5], 3)):
        part.write.mode("append").parquet(src)
    stream = spark.readStream.schema(long_events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.run_available(S.process_stream(stream, cohort, hours=6.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = S.latest(spark, str(tmp_path / "out"), ["stay_id", "variable", "source"])
    want = E.process_base(W.windowed_events(long_events, cohort, hours=6.0, variable_col="variable"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
