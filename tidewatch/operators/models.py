"""Risk models on MLlib. Estimators read ``features`` and ``label`` of an assembled table."""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import hash_fraction
from tidewatch.operators import metrics as M
from tidewatch.operators.joins import spread_join
from tidewatch.operators.nearest import nearest
from tidewatch.operators.ranking import fit_edges, hash_ranks
from tidewatch.operators.split import fold_entities
from tidewatch.plans.lineage import shared_folder, stored


def assemble(df: DataFrame, columns: list[str], label: str, keep: list[str] = ()) -> DataFrame:
    """features, label and balanced class weight n / (2 n_class), counted over the table's train rows."""
    data = df.withColumn("label", F.col(label).cast("double"))
    fit = data.where("split = 'train'") if "split" in df.columns else data
    row = fit.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    pos, neg = row.p or 0.0, row.n - (row.p or 0.0)
    w = F.when(F.col("label") == 1.0, F.lit(row.n / (2.0 * pos) if pos else 1.0)).otherwise(
        F.lit(row.n / (2.0 * neg) if neg else 1.0))
    out = VectorAssembler(inputCols=columns, outputCol="features").transform(data.withColumn("weight", w))
    return out.select(*keep, *(["split"] if "split" in df.columns else []), "features", "label", "weight")


def scaled(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Standardise features with the training mean and deviation."""
    model = StandardScaler(inputCol="features", outputCol="_z", withMean=True).fit(train)
    return [model.transform(d).drop("features").withColumnRenamed("_z", "features") for d in (train, *others)]


def logistic(C: float = 1.0, n: int = 1000, l1: float = 0.0) -> LogisticRegression:
    """Logistic regression with the strength 1 / (n C)."""
    return LogisticRegression(weightCol="weight", regParam=1.0 / (n * C), elasticNetParam=l1, standardization=False, maxIter=100)


def forest(trees: int = 300, depth: int = 8, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)


def boosted(rounds: int = 100, depth: int = 4, step: float = 0.1, seed: int = 42) -> GBTClassifier:
    """Boosted trees that stop when the rows flagged ``is_valid`` no longer improve."""
    return GBTClassifier(weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed,
                         validationIndicatorCol="is_valid", validationTol=0.001)


def plain(model, df: DataFrame):
    """The model without its training summary, by saving it in the shared folder of ``df``'s session and loading it.

    Tasks that score take the model with its summary, and that with its session; a session that was ever used for an
    ``Observation`` cannot be sent."""
    if not getattr(model, "hasSummary", False):
        return model
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tidewatch-model-{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)


def score(model, df: DataFrame, name: str = "p") -> DataFrame:
    keep = df.columns
    return plain(model, df).transform(df).select(*keep, vector_to_array("probability")[1].alias(name))


def l1_select(train: DataFrame, columns: list[str], *, C: float = 0.1, limit: float = 0.01) -> DataFrame:
    """Columns whose coefficient survives an L1 penalty."""
    (z,) = scaled(train)
    model = logistic(C, train.count(), 1.0).fit(z)
    rows = [(c, float(v)) for c, v in zip(columns, model.coefficients.toArray())]
    return train.sparkSession.createDataFrame(rows, "column_name string, coefficient double").where(
        F.abs("coefficient") > limit)


def seed_ensemble(train: DataFrame, df: DataFrame, make: Callable[[int], Estimator], seeds: list[int]) -> DataFrame:
    """Scores of the same model over several seeds (``p_<seed>``) and their mean ``p``."""
    out = df
    for s in seeds:
        out = score(make(s).fit(train), out, f"p_{s}")
    return out.withColumn("p", sum((F.col(f"p_{s}") for s in seeds[1:]), F.col(f"p_{seeds[0]}")) / len(seeds))


def random_search(train: DataFrame, make: Estimator, space: dict, *, draws: int, entity: str, k: int = 3, seed: int = 42,
                  parallelism: int = 4) -> tuple[object, DataFrame]:
    """Sampled parameter settings under entity-grouped cross-validation on training rows only."""
    rng = random.Random(seed)
    grid = []
    for _ in range(draws):
        b = ParamGridBuilder()
        for param, values in space.items():
            b = b.baseOn({param: rng.choice(values)})
        grid.append(b.build()[0])
    folds = fold_entities(train, entity, "label", k=k, seed=seed)
    data = stored(spread_join(train, folds, [entity], by=["label", "weight", "features"]), "folds")
    # the search scores with models that hold their training summary, see ``plain``: a session of its own can be sent
    data = train.sparkSession.newSession().read.schema(data.schema).parquet(*data.inputFiles())
    cv = CrossValidator(estimator=make, estimatorParamMaps=grid, numFolds=k, foldCol="fold", parallelism=parallelism,
                        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"))
    model = cv.fit(data)
    rows = [(i, ", ".join(f"{p.name}={v}" for p, v in g.items()), float(m)) for i, (g, m) in enumerate(zip(grid, model.avgMetrics))]
    return model.bestModel, train.sparkSession.createDataFrame(rows, "draw int, params string, auc_roc double")


def permutation_importance(model, df: DataFrame, columns: list[str], *, label: str, row_key: str, repeats: int = 2,
                           seed: int = 42, metric: str = "auc_roc") -> DataFrame:
    """Drop of the metric when one column is shuffled: the column's values are paired with rows
    through two independent hash orders of the table, an even shuffle join.

    The rows are written once; all repeats of a column are ranked, paired, scored and measured in one job."""
    model = plain(model, df)
    rows = stored(df.select(row_key, *columns, label), "rows")

    def scores(data):
        vec = VectorAssembler(inputCols=columns, outputCol="features").transform(data)
        return score(model, vec).withColumnRenamed(label, "y")

    first = stored(M.score_counts(scores(rows)), "scores")
    edges = fit_edges(first, "p")  # they balance the shuffled scores as well: only one column of them differs
    base = M.curve_metrics(M.curve(first, (), edges)).first()[metric]
    found = []
    for c in columns:
        counts = stored(M.score_counts(scores(_shuffled(rows, c, row_key, repeats, seed)), ["_repeat"]), "scores")
        per = {r["_repeat"]: r[metric] for r in M.curve_metrics(M.curve(counts, ["_repeat"], edges), ["_repeat"]).collect()}
        drops = [base - per.get(r) for r in range(repeats)]
        mean = sum(drops) / repeats
        found.append((c, float(mean), float((sum((d - mean) ** 2 for d in drops) / repeats) ** 0.5)))
    return df.sparkSession.createDataFrame(found, "column_name string, importance double, std double")


def _shuffled(rows: DataFrame, column: str, row_key: str, repeats: int, seed: int) -> DataFrame:
    """``rows`` once per ``_repeat``, each time with another pairing of the column's values."""
    each = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_repeat")
    salt = lambda side: F.concat(F.lit(f"|{side}{seed}"), F.col("_repeat").cast("string"), F.lit(column))
    left = hash_ranks(rows.drop(column).select("*", each), ["_repeat"], row_key, salt("rows"), rank="_rank").drop("n")
    right = hash_ranks(rows.select(row_key, column, each), ["_repeat"], row_key, salt("values"), rank="_rank").select("_repeat", "_rank", column)
    return left.join(right, ["_repeat", "_rank"])


NEIGHBOUR_BLOCK = 32_768  # rows of a block of neighbours, at least


def neighbours(rows: DataFrame, row_key: str, x: str, k: int) -> DataFrame:
    """(row_key, x, _n): the ``k`` other rows with the smallest Euclidean distance of the vector column
    ``x``, nearest first, ties by vector; exact, by blocks of which most are skipped."""
    return nearest(rows, rows, row_key, x, k, NEIGHBOUR_BLOCK)


def _between(data: DataFrame, times: Column, row_key: str, columns: list[str], label: str, minority: int, seed: int) -> DataFrame:
    """``times`` synthetic rows per minority row (row_key, _x, _n), each on the way to one of its neighbours ``_n``."""
    rows = data.withColumn("_t", times.cast("int")).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t"))))
    key = F.col(row_key).cast("string")
    pick = F.floor(hash_fraction(key, F.col("copy").cast("string"), "neighbour", seed) * F.size("_n")).cast("int")
    frac = hash_fraction(key, F.col("copy").cast("string"), "fraction", seed)
    other = F.element_at("_n", pick + 1)["x"]
    new = F.zip_with("_x", other, lambda a, b: a + (b - a) * frac)
    out = rows.select(F.col(row_key).alias("source_key"), "copy", new.alias("_s"), F.lit(minority).alias(label))
    return out.select("source_key", "copy", *[F.col("_s")[i].alias(c) for i, c in enumerate(columns)], label)


def smote(df: DataFrame, columns: list[str], label: str, row_key: str, *, minority: int = 1, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows up to the majority count, each on the segment between a minority
    row and one of its ``k`` nearest minority rows. Apply it to training rows only; fewer than two
    minority rows are an error."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if counts.get(minority, 0) < 2:
        raise ValueError("synthetic rows need at least two minority rows")
    small = df.where(F.col(label) == minority).select(
        row_key, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    data = stored(neighbours(stored(small, "minority"), row_key, "_x", k), "neighbours")
    need = max(counts.values()) - counts.get(minority, 0)
    order = hash_ranks(data, [], row_key, salt=f"|{seed}", rank="_r")
    times = F.floor(F.lit(need) / F.col("n")) + F.when(F.col("_r") <= F.lit(need) % F.col("n"), 1).otherwise(0)
    return _between(order, times, row_key, columns, label, minority, seed)


def adasyn(df: DataFrame, columns: list[str], label: str, row_key: str, *, minority: int = 1, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows where the minority is hard to tell: a row gets them in proportion to the share of other
    classes among its ``k`` nearest rows of all classes, about majority less minority in all (each count is rounded to the
    nearest integer, halves to even). Each lies between the row and one of its ``k`` nearest minority rows.

    Apply it to training rows only; fewer than two minority rows, or none with a neighbour of another class, are an error."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if counts.get(minority, 0) < 2:
        raise ValueError("synthetic rows need at least two minority rows")
    rows = stored(df.select(row_key, F.col(label).alias("_y"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")), "rows")
    small = stored(rows.where(F.col("_y") == minority).select(row_key, "_x"), "minority")
    near = nearest(small, rows, row_key, "_x", k, NEIGHBOUR_BLOCK).select(row_key, F.explode("_n.id").alias("_id"))
    kinds = near.join(rows.select(F.col(row_key).alias("_id"), "_y"), "_id")
    share = stored(kinds.groupBy(row_key).agg(F.avg(F.when(F.col("_y") == minority, 0.0).otherwise(1.0)).alias("_r")), "shares")
    total = share.agg(F.sum("_r")).first()[0] or 0.0
    if not total:
        raise ValueError("no minority row has a neighbour of another class")
    need = max(counts.values()) - counts[minority]
    data = neighbours(small, row_key, "_x", k).join(share, row_key)
    return _between(data, F.rint(F.col("_r") / F.lit(total) * F.lit(float(need))), row_key, columns, label, minority, seed)
