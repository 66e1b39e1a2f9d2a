"""The cleaning sequence from a wide feature table to model-ready columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import clean, guards, impute, profile, rules, scale, select
from tidewatch.operators.profile import numeric_columns
from tidewatch.plans.lineage import cut_lineage


def preprocess(df: DataFrame, *, key: str, label: str, fit_on: Column | None = None, chained: bool = False,
               recipe: str | None = None, min_variance: float = 0.005, top_k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(clean table, before/after report). Every fitted number comes from the ``fit_on`` rows.

    Calendar and irrelevant columns, sex code, missing flags, imputation, units, critical
    values, outliers, skew, indicators, trends, variance, selection, restored columns, scaling.
    The table is written out after imputation and before the last fits, so that no step
    recomputes the ones before it."""
    work = rules.calendar_features(df)
    work = guards.drop_date_columns(work)
    work = work.select(key, label, *[c for c in guards.drop_irrelevant(work, label).columns if c not in (key, label)])
    if "gender" in work.columns:
        work = clean.map_with_mode_fill(work, "gender", {"M": 1, "F": 0}, "gender_numeric", fit_on).drop("gender")
    work = impute.missing_flags(work, fit_on=fit_on)
    features = [c for c in work.columns if c not in (key, label)]
    if chained:
        nums = [c for c in features if c in numeric_columns(work)]
        work = impute.impute_chained(work, nums, key=key, fit_on=fit_on)
    work = cut_lineage(impute.apply_fill(work, impute.fit_fill(work, features, fit_on)))
    work = clean.unit_normalize(work, fit_on)
    work = rules.critical_values(work)
    work = clean.winsorize(clean.range_clip(work), [c for c in numeric_columns(work) if c not in (key, label)], fit_on=fit_on)
    work = rules.skew_log(work, [c for c in numeric_columns(work) if c not in (key, label)], fit_on=fit_on)
    work = rules.polynomial(rules.minmax_trends(rules.advanced_features(rules.focused_indicators(work, fit_on))))
    work = cut_lineage(select.drop_named_redundant(work))
    nums = [c for c in numeric_columns(work) if c not in (key, label)]
    kept = select.variance_filter(clean.fit_rows(work, fit_on), nums, min_variance)
    if recipe == "logistic":
        kept = select.logistic_recipe(clean.fit_rows(work, fit_on), kept, label, top_k)
    elif recipe == "tree":
        kept = select.tree_recipe(clean.fit_rows(work.select(label, *kept), fit_on), label, top_k)
    work = work.select(key, label, *kept)
    original = clean.map_with_mode_fill(df, "gender", {"M": 1, "F": 0}, "gender_numeric", fit_on) if "gender" in df.columns else df
    work = impute.restore_columns(work, original, key, fit_on)
    final = scale.robust_scale(work, [c for c in scale.scalable(work, [key, label])], fit_on)
    return final, profile.before_after(df, final)


def nulls_left(df: DataFrame) -> DataFrame:
    return df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
