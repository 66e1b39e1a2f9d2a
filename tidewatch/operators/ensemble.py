"""Combining model scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.guards import check_prediction_frame
from tidewatch.operators.joins import spread_join
from tidewatch.operators.models import plain
from tidewatch.operators.split import fold_entities
from tidewatch.plans.lineage import cut_lineage


def prediction_pivot(preds: DataFrame, models: list[str], *, row_key: str = "row_id", model: str = "model_name",
                     y: str = "y_true", p: str = "p_pred") -> DataFrame:
    """(row_id, y_true, one column per model), aligned by row id; a full prediction table is checked against its contract."""
    if {"split", "model_name", "y_true", "p_pred"} <= set(preds.columns):
        check_prediction_frame(preds)
    return preds.groupBy(row_key).agg(F.max(y).alias(y), *[F.max(F.when(F.col(model) == m, F.col(p))).alias(m) for m in models])


def require_complete(wide: DataFrame, models: list[str]) -> None:
    """Fail when a model lacks a row that another one has."""
    row = wide.agg(*[F.sum(F.col(m).isNull().cast("int")).alias(m) for m in models]).first()
    gaps = {m: row[m] for m in models if row[m]}
    if gaps:
        raise ValueError(f"models without a prediction for some rows: {gaps}")


def ensemble_average(wide: DataFrame, models: list[str], name: str = "p_ensemble") -> DataFrame:
    """Mean of at least two model scores; a score outside [0, 1] fails the job."""
    if len(models) < 2:
        raise ValueError("an ensemble needs at least two models")
    require_complete(wide, models)
    total = sum((F.col(m) for m in models[1:]), F.col(models[0]))
    ok = F.lit(True)
    for m in models:
        ok = ok & F.col(m).between(0.0, 1.0)
    return wide.withColumn(name, F.when(ok, total / len(models)).otherwise(
        F.raise_error(F.lit("model scores must lie in [0, 1]")).cast("double")))


def _vec(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_x").transform(df)


def _score(model, df: DataFrame, name: str, features: str = "_x") -> DataFrame:
    keep = df.columns
    out = plain(model, df).transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias(name))


def fit_stacker(wide: DataFrame, models: list[str], *, split: str, y: str = "y_true", C: float = 1.0):
    """L2 logistic stacker on validation scores; any other split is refused."""
    if split != "validation":
        raise ValueError("the stacker may only be fitted on validation predictions")
    require_complete(wide, models)
    data = _vec(wide, models).withColumn("_y", F.col(y).cast("double"))
    n = data.count()
    return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (n * C), elasticNetParam=0.0,
                              standardization=False).fit(data)


def apply_stacker(model, wide: DataFrame, models: list[str], name: str = "p_stacked") -> DataFrame:
    return _score(model, _vec(wide, models), name).drop("_x")


def oof_stacker(df: DataFrame, features: list[str], bases: dict[str, Callable[[], Estimator]], *, entity: str, label: str,
                k: int = 3, seed: int = 42):
    """Out-of-fold stacking: every row's base scores come from models that never saw its entity.

    Estimators read ``_x`` and ``_y``. Gives (rows with out-of-fold scores, meta model,
    base models refitted on all rows)."""
    folds = fold_entities(df, entity, label, k=k, seed=seed)
    data = cut_lineage(_vec(spread_join(df, folds, [entity], by=features), features).withColumn("_y", F.col(label).cast("double")))
    scored = None
    n_folds = data.agg(F.max("fold")).first()[0] + 1
    for f in range(n_folds):
        train, hold = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        for name, make in bases.items():
            hold = _score(make().fit(train), hold, name)
        scored = hold if scored is None else scored.unionByName(hold)
    scored = cut_lineage(scored)
    names = list(bases)
    meta_in = VectorAssembler(inputCols=names, outputCol="_m").transform(scored)
    meta = LogisticRegression(featuresCol="_m", labelCol="_y", regParam=1.0 / scored.count(), standardization=False).fit(meta_in)
    out = _score(meta, meta_in, "p_stacked").drop("_m", "_x", "_y")
    return out, meta, {name: make().fit(data) for name, make in bases.items()}
