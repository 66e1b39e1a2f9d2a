"""Threshold tables, selection policies and sweeps. Thresholds are chosen on validation rows
and applied unchanged elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions.exprs import clip, or_zero, ratio
from tidewatch.operators import metrics as M
from tidewatch.operators.ranking import fit_edges


def threshold_table(df: DataFrame, groups: list[str] = (), y: str = "y", p: str = "p", fn_cost: float = 2.0,
                    fp_cost: float = 1.0) -> DataFrame:
    """Counts, rates and cost at every distinct score and at 0 and 1. Scores are probabilities."""
    groups = list(groups)
    counts = M.score_counts(df.withColumn(p, clip(F.col(p).cast("double"), 0.0, 1.0)), groups, y, p)
    ends = F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("p")
    base = df.select(*groups).distinct() if groups else df.sparkSession.range(1)
    zero = F.lit(0).cast("bigint")
    both = counts.unionByName(base.select(*groups, ends).withColumns({"pos": zero, "neg": zero}))
    both = both.groupBy(*groups, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pts = M.with_totals(M.curve(both, groups, fit_edges(df, p)), counts, groups)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("n_pos") - tp, F.col("n_neg") - fp
    r = M.rates(tp, fp, fn, tn)
    return pts.select(*groups, F.col("p").alias("threshold"),
                      *[r[k].alias(k) for k in ("precision", "recall", "f1", "specificity", "npv")],
                      tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"),
                      (fp * F.lit(float(fp_cost)) + fn * F.lit(float(fn_cost))).alias("cost"))


def select_policies(table: DataFrame, groups: list[str] = (), *, recall: float = 0.85, precision: float = 0.65,
                    min_recall: float = 0.20) -> DataFrame:
    """(groups, policy, threshold, fallback_used, precision, recall, f1) chosen from a threshold table.

    Each choice is a maximum over a struct, ties resolved by its later fields."""
    c = F.col
    row = lambda *first: F.struct(*[c(x).alias(f"o{i}") for i, x in enumerate(first)], "threshold", "precision", "recall", "f1")
    base_rate = ratio(c("tp") + c("fn"), c("tn") + c("fp") + c("fn") + c("tp"))
    best = lambda cond, *order: F.max(F.when(cond, row(*order)))
    yes = F.lit(True)
    g = table.groupBy(*groups).agg(
        best(c("recall") >= recall, "threshold").alias("hs"),
        best(c("precision") > base_rate, "recall", "precision").alias("hs1"),
        best(yes, "recall", "precision").alias("hs2"), best(yes, "f1").alias("bf"),
        best((c("precision") >= precision) & (c("tp") + c("fp") > 0), "threshold").alias("hp"),
        best(c("recall") >= min_recall, "precision", "recall").alias("hp1"),
        best(yes, "precision", "recall").alias("hp2"))
    plain = lambda name: F.when(c(name).isNotNull(), F.struct(*[c(f"{name}.{f}").alias(f) for f in
                                                                ("threshold", "precision", "recall", "f1")]))
    pick = {"high_sensitivity": (F.coalesce(plain("hs"), plain("hs1"), plain("hs2")), c("hs").isNull()),
            "balanced_f1": (plain("bf"), F.lit(False)),
            "high_precision": (F.coalesce(plain("hp"), plain("hp1"), plain("hp2")), c("hp").isNull())}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("r"), f.alias("fallback_used"))
                               for k, (v, f) in pick.items()]))
    return g.select(*groups, rows.alias("s")).select(*groups, "s.policy", "s.r.threshold", "s.fallback_used",
                                                     "s.r.precision", "s.r.recall", "s.r.f1")


def optimal_threshold(table: DataFrame, strategy: str = "f1") -> DataFrame:
    """The best threshold by F1, cost or |precision - recall|; the lowest on ties."""
    c = F.col
    order: dict[str, Column] = {"f1": -c("f1"), "cost": c("cost"), "balanced": F.abs(c("precision") - c("recall"))}
    if strategy not in order:
        raise ValueError(f"unknown threshold strategy: {strategy}")
    best = F.min_by(F.struct(*table.columns), F.struct(order[strategy], c("threshold")))
    return table.agg(best.alias("s")).select(F.lit(strategy).alias("strategy"), "s.*")


def linear_grid(start: float, stop: float, n: int) -> list[float]:
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [stop]


def utility_sweep(df: DataFrame, y: str = "y", p: str = "p", recall_weight: float = 1.5, beta: float = 1.5) -> DataFrame:
    """Rates and four utilities on the fixed grid 0.1 .. 0.9 in 17 steps."""
    t = M.confusion_on_grid(df, linear_grid(0.1, 0.9, 17), y, p)
    r = M.rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    P, R, b2 = r["precision"], r["recall"], beta * beta
    return t.select("threshold", *[r[k].alias(k) for k in ("accuracy", "precision", "recall", "f1")],
                    ((R * recall_weight + P) / (recall_weight + 1)).alias("clinical_utility"), ((R + P) / 2).alias("balanced"),
                    or_zero(ratio((1 + b2) * P * R, b2 * P + R)).alias("f_beta"))


def cost_sweep(df: DataFrame, fn_costs: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0, 16.0), fp_cost: float = 1.0, y: str = "y",
               p: str = "p") -> DataFrame:
    """Cheapest threshold of the grid 0.01 .. 0.99 per false-negative cost, with its F1."""
    t = M.confusion_on_grid(df, linear_grid(0.01, 0.99, 99), y, p)
    f1 = M.rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))["f1"]
    long = t.select("threshold", "fp", "fn", f1.alias("f1"), F.explode(F.array(*[F.lit(float(c)) for c in fn_costs])).alias("fn_cost"))
    cost = F.col("fp") * fp_cost + F.col("fn") * F.col("fn_cost")
    best = long.groupBy("fn_cost").agg(F.min(F.struct(cost.alias("cost"), "threshold", "f1")).alias("s"))
    return best.select("fn_cost", "s.threshold", "s.cost", "s.f1")


def named_thresholds(df: DataFrame, thresholds: dict[str, float] = K.NAMED_THRESHOLDS, y: str = "y", p: str = "p") -> DataFrame:
    """Metrics at the fixed named thresholds."""
    t = M.confusion_on_grid(df, sorted(set(thresholds.values())), y, p)
    name = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("v")) for k, v in thresholds.items()]))
    r = M.rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return (t.withColumn("s", name).where(F.col("s.v") == F.col("threshold"))
            .select(F.col("s.name").alias("name"), "threshold", "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in r.items()]))


def fixed_thresholds(df: DataFrame, *, model: str = "model_name", split: str = "split", y: str = "y", p: str = "p",
                     selected_on: str = "validation", apply_to: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """Policies chosen on the validation rows of each model, applied unchanged to every split,
    in the ordered result schema."""
    valid = df.where(F.col(split) == selected_on)
    policies = select_policies(threshold_table(valid, [model], y, p), [model]).select(
        model, F.col("policy").alias("threshold_policy"), F.col("threshold").alias("_t"))
    rows = df.where(F.col(split).isin(*apply_to))
    keys = [model, split]
    pts = M.curve(M.score_counts(rows, keys, y, p), keys, fit_edges(rows, p)).join(policies, model)
    out = M.curve_metrics(pts, [*keys, "threshold_policy"], F.col("_t"))
    return out.select(F.col(model).alias("model_name"), F.col(split).alias("split"),
                      *[c for c in K.RESULT_FIELDS if c not in ("model_name", "split")])
