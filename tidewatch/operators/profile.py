"""Profiles of a wide table. Each takes one aggregate pass and returns one row per column."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import flag, ratio
from tidewatch.operators.ranking import exact_quantiles
from tidewatch.plans.lineage import scanned

NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC]


def per_column(df: DataFrame, columns: list[str], stats, extra=()) -> DataFrame:
    """One aggregate row turned into (column, stat...) rows. ``stats(c)`` gives (name, Column)
    pairs; ``extra`` are further fields of the row computed from the aggregates."""
    aggs, fields = [], []
    for i, c in enumerate(columns):
        names = []
        for name, expr in stats(c):
            aggs.append(expr.alias(f"_{i}_{name}"))
            names.append(F.col(f"_{i}_{name}").alias(name))
        fields.append(F.struct(F.lit(c).alias("column_name"), *names))
    out = df.agg(*aggs).select(F.explode(F.array(*fields)).alias("s")).select("s.*")
    return out.select("*", *extra)


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    return per_column(df, columns, lambda c: [("non_null", F.count(c)), ("n", F.count("*"))],
                      [ratio(F.col("non_null") * 100.0, "n").alias("pct_complete")])


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing share per column and its band: >80, 50-80, 20-50, <=20 percent."""
    m = ratio((F.col("n") - F.col("non_null")) * 100.0, "n")
    band = (F.when(m > 80, "extreme").when(m > 50, "high").when(m > 20, "moderate").otherwise("low"))
    out = per_column(df, columns or df.columns, lambda c: [("non_null", F.count(c)), ("n", F.count("*"))])
    return out.select("column_name", m.alias("missing_pct"), band.alias("band"))


def describe_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max and missing share per numeric column."""
    df = scanned(df.select(*columns))
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    d = lambda c: F.col(c).cast("double")
    return per_column(df, columns, lambda c: [
        ("count", F.count(c)), ("mean", F.avg(d(c))), ("std", F.stddev_samp(d(c))), ("min", F.min(d(c))),
        ("p25", F.max(F.lit(q[c][0]).cast("double"))), ("p50", F.max(F.lit(q[c][1]).cast("double"))),
        ("p75", F.max(F.lit(q[c][2]).cast("double"))), ("max", F.max(d(c))),
        ("missing_pct", ratio((F.count("*") - F.count(c)) * 100.0, F.count("*")))])


def table_one(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Characteristics overall and by a 0/1 group.

    Continuous columns (more than two distinct values): mean and sd, Welch t. Others: sum and
    percent, 2x2 chi-square with continuity correction. All from sums in one pass."""
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{t}{i}") for i, c in enumerate(columns)
                    for f, t in ((F.min, "lo"), (F.max, "hi"))]).first()

    def stats(c):
        i = columns.index(c)
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        v = F.col(c).cast("double")
        mid = flag((v != F.lit(lo)) & (v != F.lit(hi))) if lo is not None else F.lit(0)
        out = [("inner", F.sum(mid)), ("n", F.count("*")), ("mean", F.avg(v)), ("sd", F.stddev_samp(v)), ("sum", F.sum(v))]
        for g in (0, 1):
            on = F.when(F.col(group) == g, v)
            out += [(f"n{g}", F.count(on)), (f"rows{g}", F.sum(flag(F.col(group) == g))), (f"mean{g}", F.avg(on)),
                    (f"var{g}", F.var_samp(on)), (f"sum{g}", F.sum(on)),
                    (f"hi{g}", F.sum(flag((F.col(group) == g) & (v == F.lit(hi)))))]
        return out

    w = per_column(df, columns, stats)
    se0, se1 = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    se = se0 + se1
    t = (F.col("mean0") - F.col("mean1")) / F.sqrt(se)
    t_df = se * se / (se0 * se0 / (F.col("n0") - 1) + se1 * se1 / (F.col("n1") - 1))
    a, b = F.col("hi0").cast("double"), F.col("hi1").cast("double")
    c, d = F.col("n0") - a, F.col("n1") - b
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    chi = ratio(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))
    cont = F.col("inner") > 0
    pick = lambda x, y: F.when(cont, x).otherwise(y)
    return w.select("column_name", F.when(cont, "continuous").otherwise("binary").alias("kind"), "n",
                    pick(F.col("mean"), F.col("sum")).alias("value_all"),
                    pick(F.col("sd"), F.col("sum") / F.col("n") * 100).alias("spread_all"),
                    pick(F.col("mean0"), F.col("sum0")).alias("value_0"),
                    pick(F.sqrt("var0"), F.col("sum0") / F.col("rows0") * 100).alias("spread_0"),
                    pick(F.col("mean1"), F.col("sum1")).alias("value_1"),
                    pick(F.sqrt("var1"), F.col("sum1") / F.col("rows1") * 100).alias("spread_1"),
                    pick(t, chi).alias("statistic"), pick(t_df, F.lit(1.0)).alias("dof"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


# the p-value helpers travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def with_p_values(table: DataFrame) -> DataFrame:
    """Add p-values to the few rows of ``table_one``."""
    def one(kind, s, dof):
        if s is None or dof is None or np.isnan(s) or np.isnan(dof):
            return None
        return t_two_sided(s, dof) if kind == "continuous" else math.erfc(math.sqrt(s / 2.0))

    @F.pandas_udf("double")
    def p(kind: pd.Series, s: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([one(*r) for r in zip(kind, s, dof)], dtype="float64")

    return table.withColumn("p_value", p("kind", "statistic", "dof"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, value, columns) rows: shapes, dropped and new columns, missing cells."""
    def shape(df):
        miss = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in df.columns[1:]),
                   F.sum(F.col(df.columns[0]).isNull().cast("bigint")))
        return df.agg(F.count("*").alias("rows"), miss.alias("missing"))

    gone = sorted(set(before.columns) - set(after.columns))
    new = sorted(set(after.columns) - set(before.columns))
    one = shape(before).select(F.col("rows").alias("r0"), F.col("missing").alias("m0")).crossJoin(
        shape(after).select(F.col("rows").alias("r1"), F.col("missing").alias("m1")))
    rows = [("rows_before", F.col("r0"), None), ("rows_after", F.col("r1"), None),
            ("columns_before", F.lit(len(before.columns)), None), ("columns_after", F.lit(len(after.columns)), None),
            ("missing_before", F.col("m0"), None), ("missing_after", F.col("m1"), None),
            ("columns_dropped", F.lit(len(gone)), ",".join(gone)), ("columns_new", F.lit(len(new)), ",".join(new))]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), v.cast("bigint").alias("value"), F.lit(c).cast("string").alias("columns"))
        for m, v, c in rows])).alias("s")).select("s.*")


def class_weights(df: DataFrame, label: str, max_classes: int = 10, min_ratio: float = 1.5) -> DataFrame:
    """Class counts, imbalance ratio, whether resampling is worthwhile, and positive weights."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    tot = counts.agg(F.max("n").alias("_hi"), F.min("n").alias("_lo"), F.count("*").alias("_k"),
                     F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("_pos"),
                     F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("_neg"))
    r = ratio("_hi", "_lo")
    w = F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), ratio("_neg", "_pos"))
    return counts.crossJoin(tot).select(
        "label", "n", r.alias("imbalance_ratio"), ((F.col("_k") <= max_classes) & (r >= min_ratio)).alias("resample"),
        F.coalesce(w, F.lit(1.0)).alias("scale_pos_weight"), F.coalesce(F.sqrt(w), F.lit(1.0)).alias("sqrt_pos_weight"))


def group_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def seed_stability(records: DataFrame, metrics: list[str]) -> DataFrame:
    """Spread of each metric over repeated runs (population standard deviation)."""
    long = records.unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                      F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
                                      F.max("value").alias("max"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row exactly."""
    return (df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")))


def target_correlation(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """|correlation| with the target over pairwise complete rows, and its rank."""
    y = F.col(target).cast("double")
    out = per_column(df, columns, lambda c: [("c", F.corr(F.col(c).cast("double"), y))])
    return out.select("column_name", F.abs("c").alias("abs_corr"))


def variable_power(correlations: DataFrame, variable: Column) -> DataFrame:
    """Average |correlation| and best column per variable (family of columns)."""
    return correlations.where(F.col("abs_corr").isNotNull()).groupBy(variable.alias("variable")).agg(
        F.avg("abs_corr").alias("mean_abs_corr"),
        F.max_by("column_name", F.struct("abs_corr", "column_name")).alias("best_column"))
