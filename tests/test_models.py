import hashlib

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewatch.operators import ensemble, models


@pytest.fixture
def rows(spark):
    """Assembled rows, in a session that was used for an observation."""
    o = Observation("n")
    spark.range(3).observe(o, F.count("*").alias("n")).collect()
    assert o.get["n"] == 3
    df = spark.createDataFrame([(i, i % 30, i % 2, float(i % 7), float(i % 2) + (i % 5) / 4) for i in range(240)],
                               "k long, entity long, y int, a double, b double")
    return models.assemble(df, ["a", "b"], "y", ["k", "entity", "a", "b"])


def test_models_score_in_a_session_with_observations(rows):
    for make in (models.logistic(1.0, 240), models.forest(3, 3)):
        model = make.fit(rows)
        assert model.hasSummary
        p = {r.k: r.p for r in models.score(model, rows).collect()}
        assert len(p) == 240 and min(p[i] for i in range(240) if i % 2 and i % 5 > 1) > max(p[i] for i in range(0, 240, 2) if i % 5 < 3)
    drop = {r.column_name: r.importance for r in models.permutation_importance(model, rows.select("k", "a", "b", "label"), ["a", "b"], label="label", row_key="k").collect()}
    assert drop["b"] > 0.2 > abs(drop["a"])


def test_search_in_a_session_with_observations(rows):
    lr = models.logistic(1.0, 240)
    best, found = models.random_search(rows, lr, {lr.regParam: [0.001, 0.1]}, draws=2, entity="entity", k=2)
    assert [r.draw for r in found.orderBy("draw").collect()] == [0, 1] and all(r.auc_roc > 0.8 for r in found.collect())
    assert models.score(best, rows).count() == 240


def test_stackers_in_a_session_with_observations(rows):
    wide = rows.select("k", F.col("label").alias("y_true"), (F.col("b") / 2).alias("m1"), (F.col("a") / 7).alias("m2"))
    out = ensemble.apply_stacker(ensemble.fit_stacker(wide, ["m1", "m2"], split="validation"), wide, ["m1", "m2"])
    assert out.where("p_stacked BETWEEN 0 AND 1").count() == 240
    bases = {"p_lr": lambda: LogisticRegression(featuresCol="_x", labelCol="_y"),
             "p_rf": lambda: RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=2, maxDepth=2, seed=1)}
    scored, _, _ = ensemble.oof_stacker(rows.drop("features"), ["a", "b"], bases, entity="entity", label="label", k=2)
    assert scored.where("p_stacked BETWEEN 0 AND 1").count() == 240


def test_importance_pairs_rows_by_two_hash_orders_in_few_jobs(spark):
    """Brute force over the same pairings, and no more jobs for more repeats."""
    n = 120
    data = [(i, float((i * 37) % 11), float((i * 53) % 17), int((i * 37) % 11 + (i * 7) % 5 > 6)) for i in range(n)]
    df = spark.createDataFrame(data, "k long, a double, b double, y int")
    vec = models.assemble(df, ["a", "b"], "y", ["k"])
    model = models.logistic(1.0, n).fit(vec)
    weight, start = model.coefficients.toArray(), model.intercept

    def auc(rows):
        s = [(start + a * weight[0] + b * weight[1], y) for a, b, y in rows]
        pairs = [(p, q) for p, y in s if y for q, z in s if not z]
        return sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in pairs) / len(pairs)

    def order(salt):
        return sorted(range(n), key=lambda i: hashlib.md5(f"{i}{salt}".encode()).hexdigest())

    def drops(column, repeats):
        out = []
        for r in range(repeats):
            value = {i: data[j][1 + column] for i, j in zip(order(f"|rows42{r}{'ab'[column]}"), order(f"|values42{r}{'ab'[column]}"))}
            out.append(auc([(a, b, y) for _, a, b, y in data]) - auc([(value[i] if column == 0 else a, value[i] if column == 1 else b, y) for i, a, b, y in data]))
        return out

    sc, jobs = spark.sparkContext, {}
    for repeats in (2, 5):
        sc.setJobGroup(f"importance{repeats}", "test")
        got = {r.column_name: r for r in models.permutation_importance(model, df, ["a", "b"], label="y", row_key="k", repeats=repeats).collect()}
        jobs[repeats] = len(sc.statusTracker().getJobIdsForGroup(f"importance{repeats}"))
        for i, c in enumerate("ab"):
            want = drops(i, repeats)
            assert got[c].importance == pytest.approx(np.mean(want), abs=1e-12) and got[c].std == pytest.approx(np.std(want), abs=1e-12)
    sc._jsc.sc().clearJobGroup()
    assert jobs[5] <= jobs[2] + 4


def test_order_rows_are_made_once(spark, tmp_path, monkeypatch):
    """Fits and quantiles read the checkpointed rows, not the join of orders and lines again."""
    from workload import events as _registered, learning  # noqa: F401  (streams take the SQL of the batch queries)
    spark.range(60).selectExpr("id AS o_orderkey", "id % 20 AS o_custkey", "timestamp_ntz'2024-01-01' AS o_orderdate", "IF(id % 3 = 0, 'F', 'O') AS o_orderstatus",
                               "'1-URGENT' AS o_orderpriority", "1000.0D * id AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(180).selectExpr("id % 60 AS l_orderkey", "id % 50 AS l_quantity", "900.0D + id AS l_extendedprice", "0.05D AS l_discount", "0.02D AS l_tax").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    plans = []
    seen = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    fill, importance = learning.impute.fit_fill, learning.select.importance_scores
    monkeypatch.setattr(learning.impute, "fit_fill", lambda df, *a: seen(df) or fill(df, *a))
    monkeypatch.setattr(learning.select, "importance_scores", lambda df, *a, **k: seen(df) or importance(df, *a, trees=2))
    assert learning._split(spark, str(tmp_path)).count() == 60
    assert learning.importance_topk(spark, str(tmp_path)).count() == 5
    assert len(plans) == 2 and not any("Join" in p or "Aggregate" in p for p in plans)
