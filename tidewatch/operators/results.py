"""Tables built from result records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIMARY_POLICY = "balanced_f1"


def primary_results(records: DataFrame, policy: str = PRIMARY_POLICY) -> DataFrame:
    """Test rows of the primary policy (all test rows of a model without it), best first."""
    test = records.where(F.col("split") == "test")
    has = test.groupBy("model_name").agg(F.max((F.col("threshold_policy") == policy).cast("int")).alias("_has"))
    out = test.join(has, "model_name").where((F.col("_has") == 0) | (F.col("threshold_policy") == policy)).drop("_has")
    return out.orderBy(F.desc("average_precision"), F.desc("auc_roc"), "model_name")


def model_comparison(records: DataFrame, intervals: DataFrame, metrics: list[str], policy: str = PRIMARY_POLICY) -> DataFrame:
    """One test record per model with its bootstrap interval columns, best first.

    ``intervals`` holds (model_name, metric, ci_lower, ci_upper, n_success)."""
    wide = intervals.groupBy("model_name").pivot("metric", metrics).agg(
        F.first("ci_lower").alias("ci_lower"), F.first("ci_upper").alias("ci_upper"), F.first("n_success").alias("ci_n_success"))
    return primary_results(records, policy).join(wide, "model_name", "left").orderBy(
        F.desc("average_precision"), F.desc("auc_roc"), "model_name")


def ablation_table(records: DataFrame, baseline: str, metrics: list[str], run: str = "run_name") -> DataFrame:
    """Metrics per run and their difference to the baseline run."""
    base = records.where(F.col(run) == baseline).agg(*[F.max(m).alias(f"_{m}") for m in metrics])
    return records.crossJoin(base).select(run, *metrics, *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in metrics]).orderBy(
        F.desc(metrics[0]), run)


def odds_ratios(coefficients: DataFrame, name: str = "feature", coef: str = "coefficient") -> DataFrame:
    """exp(coef) and percent change per feature, largest change first."""
    odds = F.exp(coef)
    pct = (odds - 1) * 100
    return coefficients.select(name, coef, odds.alias("odds_ratio"), pct.alias("pct_change")).orderBy(F.desc(F.abs(pct)), name)


def fold_metrics(per_fold: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and spread of fold metrics (one row per fold in)."""
    long = per_fold.unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.count("value").alias("folds"))
