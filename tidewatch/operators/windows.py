"""Observation windows over long events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import hours_between, plus_hours, sanitize_token
from tidewatch.operators.joins import SALT, spread_join


def _joined(events, cohort, id_col, time_col, intime_col, salt):
    one = cohort.groupBy(id_col).agg(F.min(intime_col).alias("_intime"))
    return spread_join(events, one, [id_col], by=[time_col], salt=salt)


def filter_to_window(events: DataFrame, cohort: DataFrame, *, hours: float = 6.0, id_col: str = "stay_id",
                     time_col: str = "charttime", intime_col: str = "intime", salt: int = SALT) -> DataFrame:
    """Events with intime <= t <= intime + hours, both ends included; event columns only."""
    j = _joined(events, cohort, id_col, time_col, intime_col, salt)
    inside = (F.col(time_col) >= F.col("_intime")) & (F.col(time_col) <= plus_hours("_intime", hours))
    return j.where(inside).select(*events.columns)


def windowed_events(events: DataFrame, cohort: DataFrame, *, hours: float = 6.0, id_col: str = "stay_id",
                    time_col: str = "charttime", intime_col: str = "intime", variable_col: str | None = None,
                    salt: int = SALT) -> DataFrame:
    """Window filter that also keeps ``hours_from_admit`` and, if asked, a clean variable token."""
    j = _joined(events, cohort, id_col, time_col, intime_col, salt)
    inside = (F.col(time_col) >= F.col("_intime")) & (F.col(time_col) <= plus_hours("_intime", hours))
    out = j.where(inside).withColumn("hours_from_admit", hours_between("_intime", time_col)).drop("_intime")
    if variable_col:
        out = out.withColumn(variable_col, sanitize_token(variable_col))
    return out
