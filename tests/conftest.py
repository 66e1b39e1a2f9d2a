import datetime as dt

import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    s = make_session()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def at():
    """Timestamp at hour h (may be fractional) of the first test day."""
    day = dt.datetime(2024, 1, 1)
    return lambda h: day + dt.timedelta(hours=h)


@pytest.fixture(scope="session")
def cohort(spark, at):
    return spark.createDataFrame([(1, 11, at(0)), (2, 12, at(0)), (3, 13, at(0))], "stay_id long, subject_id long, intime timestamp_ntz")


@pytest.fixture(scope="session")
def long_events(spark, at):
    rows = [(1, at(0.25), "Heart Rate", "vital", 80.0), (1, at(1.5), "heart_rate", "vital", 100.0),
            (1, at(6.0), "heart_rate", "vital", 120.0), (1, at(2.0), "lactate", "lab", 2.5),
            (1, at(6.1), "heart_rate", "vital", 999.0), (2, at(0.5), "heart_rate", "vital", 90.0),
            (2, at(-1.0), "heart_rate", "vital", 999.0)]
    return spark.createDataFrame(rows, "stay_id long, charttime timestamp_ntz, variable string, source string, valuenum double")
