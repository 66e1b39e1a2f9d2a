"""Robust scaling: (x - median) / IQR, an IQR of 0 counting as 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.operators.clean import fit_rows
from tidewatch.operators.profile import numeric_columns, per_column
from tidewatch.operators.ranking import exact_quantiles
from tidewatch.plans.lineage import scanned


def scalable(df: DataFrame, excluded: list[str] = ()) -> list[str]:
    """Numeric columns that are no identifier, target, flag or missing indicator."""
    no = set(K.SCALE_EXCLUDED) | set(excluded)
    return [c for c in numeric_columns(df)
            if c not in no and not c.endswith(("_missing", "_flag")) and not c.startswith("has_")]


def robust_scale(df: DataFrame, columns: list[str] | None = None, fit_on: Column | None = None) -> DataFrame:
    cols = columns or [c for c in scalable(df) if c not in ("gender_numeric", "sirs_criteria_count")]
    df = scanned(df)  # read for the quantiles and again for the result
    q = exact_quantiles(fit_rows(df, fit_on), cols, [0.25, 0.5, 0.75])
    new = {}
    for c in cols:
        a, m, b = q[c]
        if m is not None:
            new[c] = (F.col(c).cast("double") - F.lit(m)) / F.lit((b - a) or 1.0)
    return df.withColumns(new)


def scale_check(df: DataFrame, columns: list[str] | None = None, max_range: float = 100.0,
                max_std: float = 10.0) -> DataFrame:
    """Range and standard deviation per column, and whether either is too wide."""
    cols = columns or scalable(df)
    d = lambda c: F.col(c).cast("double")
    out = per_column(df, cols, lambda c: [("value_range", F.max(d(c)) - F.min(d(c))), ("std", F.stddev_samp(d(c)))])
    return out.withColumn("issue", F.coalesce((F.col("value_range") > max_range) | (F.col("std") > max_std), F.lit(False)))


def scale_if_needed(df: DataFrame, fit_on: Column | None = None) -> DataFrame:
    """Scale every eligible column when at least one is too wide; else leave all as they are."""
    cols = scalable(df)
    if not scale_check(fit_rows(df, fit_on), cols).where("issue").limit(1).count():
        return df
    return robust_scale(df, cols, fit_on)
