"""Iterative operators and streams on the test tables. They have no SQL form, except where a
batch query gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from tidewatch.operators import ensemble, impute, metrics, models, select
from tidewatch.operators import events as E
from tidewatch.operators.split import split_rows
from tidewatch.plans import features as plan_features
from tidewatch.plans import preprocess as plan_preprocess
from tidewatch.plans import suite
from tidewatch.plans.lineage import cut_lineage, shared_folder, stored
from tidewatch.streaming import windows as stream
from workload import raw
from workload.base import (BIN, HOURS, ORACLES, SOURCES, VARIABLES, event_cohort, long_events, query, rounded, scored, table, wide, win_sql)

FEATURES = ["age", "heart_rate_mean", "sbp_mean", "resp_rate_mean", "temp_mean", "lactate_mean", "glucose_mean", "sodium_mean",
            "alkaline_phosphatase_mean", "risk"]
COLS = [*FEATURES, "mortality"]


def _split(spark, sf):
    """Order-level rows, split by customer, medians from the training rows.

    The order-level rows are made once; a checkpoint keeps their partitions, which the samples of the fits follow."""
    w = cut_lineage(split_rows(cut_lineage(wide(spark, sf, COLS).drop("intime")), "subject_id", "mortality"))
    return impute.apply_fill(w, impute.fit_fill(w, FEATURES, F.col("split") == "train"))


def _vec(spark, sf):
    return models.assemble(_split(spark, sf), FEATURES, "mortality", ["stay_id", "subject_id"])


def _report(scores):
    return rounded(metrics.binary_metrics(scores.withColumn("y", F.col("label").cast("int")), 0.5, ["split"]), 4)


@query("impute_chained")
def impute_chained(spark, sf):
    w = wide(spark, sf, ["age", "heart_rate_mean", "sbp_mean", "resp_rate_mean", "temp_mean", "glucose_mean"])
    cols = ["age", "heart_rate_mean", "sbp_mean", "resp_rate_mean", "temp_mean", "glucose_mean"]
    return impute.impute_chained(stored(w.drop("intime"), "wide"), cols, key="stay_id", rounds=2, trees=20)


@query("importance_topk")
def importance_topk(spark, sf):
    return select.top_k(select.importance_scores(cut_lineage(wide(spark, sf, COLS)), FEATURES, "mortality", trees=100), 5)


@query("pca_reduce")
def pca_reduce(spark, sf):
    return select.pca_reduce(wide(spark, sf, FEATURES), FEATURES, 0.8, "stay_id")


@query("select_recipe")
def select_recipe(spark, sf):
    w = cut_lineage(wide(spark, sf, COLS))
    rows = [("logistic", c) for c in select.logistic_recipe(w, FEATURES, "mortality", 5)]
    rows += [("tree", c) for c in select.tree_recipe(w.select(*COLS), "mortality", 5)]
    return spark.createDataFrame(rows, "recipe string, column_name string")


@query("smote")
def smote(spark, sf):
    train = _split(spark, sf).where("split = 'train'")
    return models.smote(train, ["heart_rate_mean", "sbp_mean", "lactate_mean", "risk"], "mortality", "stay_id")


@query("adasyn")
def adasyn(spark, sf):
    train = _split(spark, sf).where("split = 'train'")
    return models.adasyn(train, ["heart_rate_mean", "sbp_mean", "lactate_mean", "risk"], "mortality", "stay_id")


@query("leakage_probe")
def leakage_probe(spark, sf):
    w = wide(spark, sf, COLS).drop("intime").withColumn("death_time_hours", F.col("risk") * 2)
    return suite.leakage_probe(w, entity="subject_id", label="mortality", row_key="stay_id")


def _preds(spark, sf):
    s = scored(spark, sf)
    return s.select("split", "row_id", F.col("y").alias("y_true"), F.col("p_a").cast("double").alias("model_a"),
                    F.col("p_b").cast("double").alias("model_b"))


@query("validation_stacker")
def validation_stacker(spark, sf):
    w = _preds(spark, sf)
    model = ensemble.fit_stacker(w.where("split = 'validation'"), ["model_a", "model_b"], split="validation")
    out = ensemble.apply_stacker(model, w.where("split <> 'train'"), ["model_a", "model_b"])
    return rounded(metrics.binary_metrics(out, 0.5, ["split"], "y_true", "p_stacked"), 4)


@query("oof_stacker")
def oof_stacker(spark, sf):
    data = _split(spark, sf).where("split = 'train'")
    bases = {"p_lr": lambda: LogisticRegression(featuresCol="_x", labelCol="_y"),
             "p_rf": lambda: RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=5, maxDepth=4, seed=1)}
    out, _, _ = ensemble.oof_stacker(data, FEATURES, bases, entity="subject_id", label="mortality", k=2)
    return out.select("stay_id", "fold", "mortality", "p_lr", "p_rf", "p_stacked")


@query("permutation_importance")
def permutation_importance(spark, sf):
    data = _split(spark, sf)
    vec = models.assemble(data, ["risk", "age", "glucose_mean"], "mortality", ["stay_id"])
    train = vec.where("split = 'train'")
    model = models.logistic(1.0, train.count()).fit(train)
    test = data.where("split = 'test'").select("stay_id", "risk", "age", "glucose_mean", "mortality")
    return models.permutation_importance(model, test, ["risk", "age", "glucose_mean"], label="mortality", row_key="stay_id", repeats=10)


@query("fit_logistic")
def fit_logistic(spark, sf):
    v = _vec(spark, sf)
    train, rest = models.scaled(v.where("split = 'train'"), v.where("split <> 'train'"))
    return _report(models.score(models.logistic(1.0, train.count()).fit(train), rest))


@query("l1_select")
def l1_select(spark, sf):
    return models.l1_select(_vec(spark, sf).where("split = 'train'"), FEATURES, C=0.1)


@query("fit_forest")
def fit_forest(spark, sf):
    v = _vec(spark, sf)
    return _report(models.score(models.forest(30, 6).fit(v.where("split = 'train'")), v.where("split <> 'train'")))


@query("fit_gbt")
def fit_gbt(spark, sf):
    v = _vec(spark, sf).withColumn("is_valid", F.col("split") == "validation")
    model = models.boosted(15, 3).fit(v.where("split <> 'test'"))
    return _report(models.score(model, v.where("split <> 'train'")))


@query("seed_ensemble")
def seed_ensemble(spark, sf):
    v = _vec(spark, sf)
    return _report(models.seed_ensemble(v.where("split = 'train'"), v.where("split <> 'train'"),
                                        lambda s: models.forest(10, 5, s), [42, 123, 777]))


@query("random_search")
def random_search(spark, sf):
    train = _vec(spark, sf).where("split = 'train'")
    lr = models.logistic(1.0, train.count())
    space = {lr.regParam: [0.001, 0.01, 0.1], lr.elasticNetParam: [0.0, 0.5, 1.0]}
    return models.random_search(train, lr, space, draws=5, entity="subject_id")[1]


@query("model_suite")
def model_suite(spark, sf):
    w = cut_lineage(wide(spark, sf, [*COLS, "first_careunit"]).drop("intime"))
    r = suite.run_suite(w, entity="subject_id", label="mortality", row_key="stay_id", n_boot=200, trees=100, rounds=30, categorical=["first_careunit"])
    return rounded(r.comparison, 4)


# --- composed pipelines --------------------------------------------------------------------------
@query("preprocess_table")
def preprocess_table(spark, sf):
    w = wide(spark, sf, [*COLS, "gender", "heart_rate_min", "heart_rate_max", "creatinine_mean", "bun_mean", "map_mean"])
    return plan_preprocess.preprocess(w.drop("subject_id"), key="stay_id", label="mortality")[0]


@query("feature_table", win_sql().replace(" AS h\n", " AS h, valuenum AS v\n") + ", "
       + raw.stats_sql(HOURS, BIN, [0, 24, 48, 96], 0.5, 1.0, 2.0, VARIABLES)
       + f" SELECT c.stay_id, {raw.columns_sql(['click', 'error', 'view'], ['purchase', 'signup'], HOURS, BIN, [0, 24, 48, 96])}, "
       "CASE WHEN c.stay_id IN (SELECT user_id FROM events WHERE value > 200) THEN 1 ELSE 0 END AS mortality "
       "FROM cohort c LEFT JOIN s USING (stay_id) LEFT JOIN tot USING (stay_id) GROUP BY c.stay_id")
def feature_table(spark, sf):
    o = plan_features.FeatureOptions(hours=HOURS, bin_hours=BIN, anchors=[0, 24, 48, 96], vitals=["click", "error", "view"],
                                     labs=["purchase", "signup"], row_rules=False)
    e = long_events(spark, sf)
    return rounded(plan_features.build_features(event_cohort(spark, sf), e, o, positives=e.where("valuenum > 200")))


# --- streams: the same rows as the batch operators --------------------------------------------------
def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    source = F.when(F.col("event_type").isin("purchase", "signup"), "lab").otherwise("vital")
    return e.select(F.col("user_id").alias("stay_id"), F.col("ts").alias("charttime"), F.col("event_type").alias("variable"),
                    source.alias("source"), F.col("value").alias("valuenum"))


def _folder(spark) -> str:
    """A fresh folder under the shared folder of the session."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("stream_measurement_process", ORACLES["measurement_process"])
def stream_measurement_process(spark, sf):
    at, cohort = _folder(spark), event_cohort(spark, sf)
    stream.run_available(stream.process_stream(_event_stream(spark, sf), cohort, hours=6.0), f"{at}/rows", f"{at}/state")
    base = stream.latest(spark, f"{at}/rows", ["stay_id", "variable", "source"])
    return rounded(E.process_features(base, cohort, VARIABLES, hours=6.0, sources=SOURCES, expected=["click", "error", "view", "refund"]))


@query("stream_hourly_bins", ORACLES["hourly_bins"])
def stream_hourly_bins(spark, sf):
    at, cohort = _folder(spark), event_cohort(spark, sf)
    stream.run_available(stream.bins_stream(_event_stream(spark, sf), cohort, hours=HOURS, bin_hours=BIN), f"{at}/rows", f"{at}/state")
    base = stream.latest(spark, f"{at}/rows", ["stay_id", "variable", "bin"])
    return rounded(E.bins_features(base, cohort, VARIABLES, hours=HOURS, bin_hours=BIN, aggregations=("mean", "min", "max", "last")))
