"""The model suite: split, train-only preprocessing, fits, fixed thresholds, intervals, comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import bootstrap, guards, impute, models, results, split, thresholds
from tidewatch.operators.metrics import ranking_metrics
from tidewatch.operators.profile import NUMERIC, duplicate_rows, target_correlation
from tidewatch.plans.lineage import cut_lineage

REGISTRY = ("logistic", "forest", "boosted")


@dataclass
class SuiteReport:
    records: DataFrame
    comparison: DataFrame
    status: DataFrame
    predictions: DataFrame


def prepare(df: DataFrame, *, entity: str, label: str, row_key: str, categorical: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Guarded features, grouped split and train-only preprocessing, written once for all fits.

    Every safe column is kept: numbers and booleans as numbers, all others, and those named in
    ``categorical``, as one column per training category."""
    safe = [c for c in guards.feature_matrix(df, label).columns if c not in (entity, row_key)]
    number = lambda t: t in (*NUMERIC, "boolean") or t.startswith("decimal")
    nums = [c for c, t in df.dtypes if c in safe and c not in categorical and number(t)]
    cats = [c for c in safe if c not in nums]
    typed = df.select(entity, row_key, label, *[F.col(c).cast("double").alias(c) for c in nums], *[F.col(c).cast("string").alias(c) for c in cats])
    rows = split.split_rows(typed, entity, label)
    p = impute.fit_preprocessor(rows, nums, cats, F.col("split") == "train")
    out = impute.apply_preprocessor(rows, p, [entity, row_key, label, "split"])
    return cut_lineage(out), [c for c in out.columns if c not in (entity, row_key, label, "split")]


def fit_scores(data: DataFrame, columns: list[str], name: str, *, label: str, row_key: str, trees: int = 300, rounds: int = 1000) -> DataFrame:
    """Validation and test scores of one registered model: (model_name, split, row_id, y, p)."""
    vec = models.assemble(data, columns, label, [row_key])
    train, rest = vec.where("split = 'train'"), vec.where("split <> 'train'")
    if name == "logistic":
        train, rest = models.scaled(train, rest)
        model = models.logistic(1.0, train.count()).fit(train)
    elif name == "forest":
        model = models.forest(trees=trees, depth=6).fit(train)
    elif name == "boosted":
        both = vec.where("split <> 'test'").withColumn("is_valid", F.col("split") == "validation")
        model = models.boosted(rounds=rounds).fit(both)
    else:
        raise ValueError(f"unknown model: {name}")
    return models.score(model, rest).select(F.lit(name).alias("model_name"), "split", F.col(row_key).alias("row_id"),
                                            F.col("label").cast("int").alias("y"), "p")


def run_suite(df: DataFrame, *, entity: str, label: str, row_key: str, enabled: list[str] = REGISTRY, categorical: list[str] = (),
              n_boot: int = 200, trees: int = 300, rounds: int = 1000) -> SuiteReport:
    """Fit every enabled model; data that it cannot be fitted on becomes a status row, an unknown
    name an error. ``trees`` and ``rounds`` bound the forest and the boosted trees."""
    unknown = sorted(set(enabled) - set(REGISTRY))
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    data, columns = prepare(df, entity=entity, label=label, row_key=row_key, categorical=categorical)
    preds, status = None, []
    for name in enabled:
        try:
            one = cut_lineage(fit_scores(data, columns, name, label=label, row_key=row_key, trees=trees, rounds=rounds))
        except (IllegalArgumentException, AnalysisException, ValueError) as e:  # data a model cannot be fitted on; the suite goes on
            status.append((name, "failed", str(e)))
            continue
        status.append((name, "completed", ""))
        preds = one if preds is None else preds.unionByName(one)
    spark = df.sparkSession
    st = spark.createDataFrame(status, "model_name string, status string, detail string")
    if preds is None:
        raise RuntimeError(f"no model completed: {status}")
    records = thresholds.fixed_thresholds(preds)
    ivs = None
    test = preds.where("split = 'test'").withColumn("_k", F.conv(F.substring(F.md5(F.col("row_id").cast("string")), 1, 12), 16, 10).cast("bigint"))
    for name, state, _ in status:
        if state == "completed":
            iv = bootstrap.bootstrap_ci(test.where(F.col("model_name") == name), "_k", n_boot=n_boot,
                                        metrics=("auc_roc", "average_precision", "brier_score")).withColumn("model_name", F.lit(name))
            ivs = iv if ivs is None else ivs.unionByName(iv)
    comparison = results.model_comparison(records, ivs, ["auc_roc", "average_precision", "brier_score"])
    return SuiteReport(records, comparison, st, preds)


def leakage_probe(df: DataFrame, *, entity: str, label: str, row_key: str, corr_limit: float = 0.9) -> DataFrame:
    """(check, subject, value) rows: suspicious names, high |correlation|, duplicates, quick model AUC."""
    bad = guards.feature_columns(df, label)[1]
    nums = [c for c, t in df.dtypes if t in ("double", "int", "bigint") and c not in (label, entity, row_key)]
    spark = df.sparkSession
    names = spark.createDataFrame([("suspicious_name", c, 1.0) for c in bad], "check_name string, subject string, value double")
    corr = target_correlation(df, nums, label).where(F.col("abs_corr") > corr_limit).select(
        F.lit("high_correlation").alias("check_name"), F.col("column_name").alias("subject"), F.col("abs_corr").alias("value"))
    dup = duplicate_rows(df.drop(row_key)).select(F.lit("duplicate_rows").alias("check_name"), F.lit("all").alias("subject"),
                                                  F.col("duplicate_rows").cast("double").alias("value"))
    data, columns = prepare(df, entity=entity, label=label, row_key=row_key)
    s = fit_scores(data, columns, "logistic", label=label, row_key=row_key).where("split = 'test'")
    probe = ranking_metrics(s).select(F.lit("probe_auc").alias("check_name"), F.lit("logistic").alias("subject"),
                                      F.col("auc_roc").alias("value"))
    return names.unionByName(corr).unionByName(dup).unionByName(probe)
