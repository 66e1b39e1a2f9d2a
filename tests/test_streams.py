"""Streams: state that expires, late events, a log that stays small."""

import datetime as dt
import os

import pytest

from tidewatch.operators import events as E
from tidewatch.operators.windows import windowed_events
from tidewatch.streaming import windows as S

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "stay_id long, charttime timestamp_ntz, variable string, source string, valuenum double"
KEYS = ["stay_id", "variable", "source"]


def when(h):
    return DAY + dt.timedelta(hours=h)


@pytest.fixture(scope="module")
def admissions(spark):
    """Ten stays a day over ten days."""
    return spark.createDataFrame([(10 * d + i, when(24 * d + 2 * i)) for d in range(10) for i in range(10)], "stay_id long, intime timestamp_ntz")


def day_rows(d):
    return [(10 * d + i, when(24 * d + 2 * i + h), v, "vital", float(h + i)) for i in range(10) for h in (0.5, 1.5, 5.0) for v in ("heart_rate", "map")]


def files(spark, path, days):
    """One file per day, with rising times, so that the stream reads them in order."""
    for n, rows in enumerate(days):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/tmp{n}")
        part = [f for f in os.listdir(f"{path}/tmp{n}") if f.endswith(".parquet")][0]
        os.makedirs(f"{path}/in", exist_ok=True)
        target = f"{path}/in/{n:03d}.parquet"
        os.rename(f"{path}/tmp{n}/{part}", target)
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    return f"{path}/in"


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def as_set(df, columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_state_and_log_stay_small(spark, admissions, tmp_path):
    src = files(spark, tmp_path, [day_rows(d) for d in range(10)])
    out, sizes = str(tmp_path / "out"), []
    keep = S.compact

    def seen(*args):
        keep(*args)
        sizes.append((sorted(os.listdir(out)), spark.read.parquet(*[f"{out}/{f}" for f in os.listdir(out) if f.startswith("open=")]).count()))

    S.compact = seen
    try:
        told = S.run_available(S.process_stream(stream(spark, src), admissions, hours=6.0, late=1.0), out, str(tmp_path / "cp"), KEYS, behind=7.0, every=3)
    finally:
        S.compact = keep
    assert told["arrived"] == 600 and told["late_groups"] == 0 and told["batches"] >= 10
    # 200 groups in all; a day has 20, of which few are still open a day later
    assert told["state_groups"] <= 40 and len(sizes) >= 3
    assert all(open_ <= 40 for _, open_ in sizes)
    assert all(sum(f.startswith("batch=") for f in names) == 0 and sum(f.startswith("open=") for f in names) == 1 for names, _ in sizes)
    assert sum(f.startswith("batch=") for f in os.listdir(out)) < 3
    batch = E.process_base(windowed_events(spark.read.schema(SCHEMA).parquet(src), admissions, hours=6.0, variable_col="variable"))
    columns = [*KEYS, "_n", "_a", "_z"]
    assert as_set(S.latest(spark, out, KEYS), columns) == as_set(batch, columns) and batch.count() == 200


def test_bins_expire_before_their_stay_closes(spark, admissions, tmp_path):
    src = files(spark, tmp_path, [day_rows(d) for d in range(10)])
    out = str(tmp_path / "out")
    told = S.run_available(S.bins_stream(stream(spark, src), admissions, hours=6.0, bin_hours=1.0, late=0.0), out, str(tmp_path / "cp"),
                           ["stay_id", "variable", "bin"], behind=1.0, every=4)
    assert told["state_groups"] <= 12 and told["late_groups"] == 0
    batch = E.bins_base(windowed_events(spark.read.schema(SCHEMA).parquet(src), admissions, hours=6.0, variable_col="variable"), hours=6.0, bin_hours=1.0)
    columns = ["stay_id", "variable", "bin", "mean", "min", "max", "last", "count"]
    assert as_set(S.latest(spark, out, ["stay_id", "variable", "bin"]), columns) == as_set(batch, columns) and batch.count() == 600


def test_late_events_are_left_out_and_counted(spark, admissions, tmp_path):
    late = [(0, when(5.5), "heart_rate", "vital", 500.0)]  # stay 0 closed at hour 6
    src = files(spark, tmp_path, [day_rows(0), day_rows(1), day_rows(2) + late, day_rows(3)])
    out = str(tmp_path / "out")
    told = S.run_available(S.process_stream(stream(spark, src), admissions, hours=6.0, late=1.0), out, str(tmp_path / "cp"), KEYS, behind=7.0, every=2)
    got = {(r.stay_id, r.variable): r["_n"] for r in S.latest(spark, out, KEYS).collect()}
    assert told["late_groups"] == 1 and told["arrived"] == 241 and got[0, "heart_rate"] == 3 and len(got) == 80 and sum(got.values()) == 240


def test_restart_goes_on(spark, admissions, tmp_path):
    days = [day_rows(d) for d in range(6)]
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    src = files(spark, tmp_path, days[:3])
    S.run_available(S.process_stream(stream(spark, src), admissions, hours=6.0, late=1.0), out, cp, KEYS, behind=7.0, every=2)
    for n in range(3, 6):
        spark.createDataFrame(days[n], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/more{n}")
        part = [f for f in os.listdir(f"{tmp_path}/more{n}") if f.endswith(".parquet")][0]
        os.rename(f"{tmp_path}/more{n}/{part}", f"{src}/{n:03d}.parquet")
    S.run_available(S.process_stream(stream(spark, src), admissions, hours=6.0, late=1.0), out, cp, KEYS, behind=7.0, every=2)
    got = {(r.stay_id, r.variable): r["_n"] for r in S.latest(spark, out, KEYS).collect()}
    assert len(got) == 120 and set(got.values()) == {3}


def test_a_repeated_compaction_changes_nothing(spark, tmp_path):
    out = str(tmp_path)
    rows = lambda n: spark.createDataFrame([(1, "a", when(0), n), (2, "a", when(50 + n), n)], "stay_id long, variable string, closes timestamp, v int")
    for n in range(2):
        rows(n).write.parquet(f"{out}/batch={n}")
    S.compact(spark, out, ["stay_id", "variable"], 10.0, 1)
    before = as_set(S.latest(spark, out, ["stay_id", "variable"]), ["stay_id", "v"])
    rows(7).write.parquet(f"{out}/batch=1")  # a replayed batch after its compaction
    S.compact(spark, out, ["stay_id", "variable"], 10.0, 1)
    assert as_set(S.latest(spark, out, ["stay_id", "variable"]), ["stay_id", "v"]) == before == {(1, 1), (2, 1)}
