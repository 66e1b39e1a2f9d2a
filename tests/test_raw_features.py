"""Features from raw rows: one exchange of events, hot stays, overlapping stays."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.operators import cohort as C
from tidewatch.operators import onepass
from tidewatch.plans import raw_features as R

CHART = "stay_id long, charttime timestamp_ntz, itemid int, valuenum double"
LABS = "subject_id long, charttime timestamp_ntz, itemid int, valuenum double"


@pytest.fixture(scope="module")
def raw(spark, at):
    cohort = spark.createDataFrame([(1, 11, 111, at(0)), (2, 12, 112, at(0)), (3, 11, 113, at(3))], "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz")
    chart = [(1, at(1.5), 220045, 90.0), (1, at(6), 220045, 100.0), (1, at(6.1), 220045, 999.0), (1, at(-0.1), 220045, 999.0), (1, at(1), 223761, 98.6),
             (1, at(2), 223762, 38.0), (1, at(1), 226559, 100.0), (1, at(2), 226631, 50.0), (1, at(3), 226559, None), (1, at(1), 226730, 70.0),
             (1, at(2), 226730, 10.0), (1, at(1), 226531, 200.0), (1, at(1), 42, 5.0), (None, at(1), 220045, 1.0), (1, None, 220045, 1.0), (2, at(1), 226707, 90.0),
             (2, at(1), 226512, 70.0), (9, at(1), 220045, 1.0)]
    labs = [(11, at(2), 50813, 2.5), (11, at(5), 50813, 3.5), (11, at(4), 51237, 1.1), (11, at(4.5), 51675, 1.5), (12, at(1), 50813, None), (12, at(7), 50813, 9.0),
            (77, at(1), 50813, 9.0)]
    patients = spark.createDataFrame([(11, "M", 60, 2020), (12, "F", 88, 2020)], "subject_id long, gender string, anchor_age int, anchor_year int")
    admissions = spark.createDataFrame([(11, 111, at(0)), (11, 113, at(3)), (12, 112, at(0)), (11, 100, at(-900))], "subject_id long, hadm_id long, admittime timestamp_ntz")
    codes = spark.createDataFrame([(11, 100, "428.0", 9), (11, 100, "C780", 10), (12, 112, "I10", 10)], "subject_id long, hadm_id long, icd_code string, icd_version int")
    dead = spark.createDataFrame([(12,)], "subject_id long")
    return R.RawTables(cohort, spark.createDataFrame(chart, CHART), spark.createDataFrame(labs, LABS), patients, admissions, codes, dead)


def rows(df, key="stay_id"):
    return {r[key]: r for r in df.collect()}


def test_raw_rows_to_features(raw):
    got = rows(R.raw_features(raw, R.RawOptions()))
    one, two, three = got[1], got[2], got[3]
    assert one.heart_rate_mean == 90.0 and one.heart_rate_max == 100.0 and one.heart_rate_measurement_count_0_6h == 2  # the last reading weighs nothing
    assert one.heart_rate_bin_5_6h_last == 100.0 and one.heart_rate_last == 100.0 and 999.0 not in {v for v in one if isinstance(v, float)}
    assert one.temp_min == pytest.approx(37.0) and one.temp_max == 38.0
    assert one.urine_output_total == 150.0 and one.urine_output_measured == 1 and two.urine_output_total is None and two.urine_output_measured == 0
    assert one.bmi == pytest.approx(200 * 0.453592 / 1.778 ** 2) and one.bmi_measured == 1 and two.bmi is None and two.bmi_measured == 0
    assert one.inr_mean == pytest.approx(1.3) and one.inr_max == 1.5 and one.lactate_delta == 1.0
    # the same laboratory readings lie in the second stay's window too
    assert three.lactate_min == 3.5 and three.lactate_measured == 1 and three.heart_rate_measured == 0 and three.inr_measured == 1
    assert two.lactate_measured == 0 and two.lactate_measurement_count_0_6h == 1 and two.total_lab_measurements_0_6h == 1
    assert (one.age, one.gender_numeric, two.age, two.gender_numeric) == (64, 1, 90, 0)
    assert one.prev_dx_circulatory_count == 1 and one.has_prior_diagnoses == 1 and one.has_metastatic_cancer == 1 and two.prev_dx_count_total == 0
    assert (one.mortality, two.mortality, three.mortality) == (0, 1, 0)
    assert one.total_vital_measurements_0_6h == 4 and one.panel_missing_count_0_6h == len(K.VITAL_CODES) + len(K.LAB_CODES) - 4


def test_provenance_and_missing_columns(raw):
    R.raw_features(raw, R.RawOptions(check_provenance=True, row_rules=False))
    with pytest.raises(ValueError, match="chart events missing columns"):
        R.raw_features(R.RawTables(raw.cohort, raw.chart.drop("itemid"), raw.labs))


def test_events_are_exchanged_once(spark, raw):
    """Between the scans and the pieces of a stay lies one exchange that carries readings; others carry counts or the cohort."""
    o = R.RawOptions()
    plan = onepass.pieces(R.windowed_codes(raw, o), hours=o.hours, sources=["lab", "vital"])._jdf.queryExecution().executedPlan().toString()
    carried = [x for x in plan.splitlines() if re.search(r"Exchange hashpartitioning\(", x) and "variable" in x]
    assert len(carried) == 1 and "_bin" in carried[0]
    wide = R.raw_features(raw, o)._jdf.queryExecution().executedPlan().toString()
    assert sum("_slice" in x and "Exchange hashpartitioning" in x for x in wide.splitlines()) == 1


@pytest.mark.parametrize("per_slice", [1, 3, 10])
def test_slices_of_hot_stays_change_nothing(spark, at, per_slice):
    import random
    rng = random.Random(per_slice)
    chart = [(rng.choice([1, 1, 1, 2]), at(rng.choice([rng.uniform(-1, 7), rng.randint(0, 6)])), rng.choice([220045, 220179, 223761, 226559]),
              rng.choice([None, rng.uniform(30, 200)])) for _ in range(300)]
    labs = [(rng.choice([11, 12]), at(rng.uniform(0, 7)), rng.choice([50813, 51237]), rng.uniform(0.5, 9)) for _ in range(80)]
    cohort = spark.createDataFrame([(1, 11, 111, at(0)), (2, 12, 112, at(0)), (3, 13, 113, at(0))], "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz")
    t = R.RawTables(cohort, spark.createDataFrame(chart, CHART), spark.createDataFrame(labs, LABS))
    plain, sliced = (rows(R.raw_features(t, R.RawOptions(row_rules=False, per_slice=n))) for n in (10**9, per_slice))
    for k, r in plain.items():
        for c, v in r.asDict().items():
            assert sliced[k][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (k, c)


def test_bridge_to_overlapping_stays(spark, at):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    stays = spark.createDataFrame([(1, 11, day(0), day(400)), (2, 11, day(10), day(11)), (3, 11, day(20), day(19)), (4, 12, day(0), None), (5, None, day(0), day(9))],
                                  "stay_id long, subject_id long, intime timestamp_ntz, outtime timestamp_ntz")
    events = spark.createDataFrame([(11, day(10)), (11, day(11)), (11, day(300)), (11, day(401)), (11, day(-1)), (12, day(1)), (None, day(1)), (11, None)],
                                   "subject_id long, charttime timestamp_ntz")
    for width in (1.0, 24.0, 10000.0):
        got = sorted((r.charttime, r.stay_id) for r in C.bridge_overlapping(events, stays, width=width).collect())
        assert got == [(day(10), 1), (day(10), 2), (day(11), 1), (day(11), 2), (day(300), 1)]


def test_empty_raw_tables(spark, raw):
    none = R.RawTables(raw.cohort, raw.chart.limit(0), raw.labs.limit(0))
    got = rows(R.raw_features(none, R.RawOptions(row_rules=False)))
    assert len(got) == 3 and all(r.heart_rate_measured == 0 and r.bmi is None and r.total_measurements_0_6h == 0 for r in got.values())


def test_wide_rows_are_made_once_and_never_moved(raw):
    out = R.raw_features(raw, R.RawOptions(row_rules=False))
    todo, wide = [out._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        wide += [node.nodeName()] if node.output().size() > 300 else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert wide == ["Project"] and len(out.columns) > 300


def test_a_stay_keeps_its_rows_for_every_subject_and_admission(spark, raw):
    twice = raw.cohort.unionByName(raw.cohort.where("stay_id = 1").withColumn("hadm_id", F.lit(77).cast("bigint")))
    none = raw.cohort.where("stay_id = 1").withColumn("stay_id", F.lit(None).cast(raw.cohort.schema["stay_id"].dataType))
    got = R.raw_features(R.RawTables(twice.unionByName(none), raw.chart, raw.labs, positives=raw.positives), R.RawOptions(row_rules=False))
    assert sorted((r.stay_id, r.hadm_id, r.heart_rate_mean) for r in got.where("stay_id = 1").collect()) == sorted(
        (1, h, 90.0) for h in {r.hadm_id for r in raw.cohort.where("stay_id = 1").collect()} | {77})
    assert got.where("stay_id IS NULL").count() == 0 and got.columns[0] == "subject_id" and got.columns[-1] == "mortality"
