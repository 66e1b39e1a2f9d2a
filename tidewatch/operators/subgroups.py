"""Subgroup labels and metrics per subgroup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import cut_right_closed
from tidewatch.operators import calibrate, metrics
from tidewatch.operators.ranking import exact_quantiles, value_ranks
from tidewatch.plans.lineage import cut_lineage

FIRST_OF = {"sex": ["sex", "gender"],
            "major_diagnosis_group": ["major_diagnosis_group", "diagnosis_group", "admission_diagnosis_group"],
            "icu_unit_type": ["icu_unit_type", "first_careunit", "careunit"]}
VENTILATION = ["ventilation_status", "mechanical_ventilation", "ventilated", "ventilation_flag"]


def rank_bucket(rank: Column, n: Column, q: int) -> Column:
    """1-based quantile bucket of a rank: the first k with rank <= 1 + (n - 1) k / q."""
    out = F.lit(q)
    for k in range(q - 1, 0, -1):
        out = F.when(rank <= 1 + (n - 1) * F.lit(float(k)) / F.lit(float(q)), F.lit(k)).otherwise(out)
    return out


def rank_quartile(df: DataFrame, value: str, row_key: str, q: int = 4, name: str = "quartile") -> DataFrame:
    """Quartile by rank with ties split by row key order (md5, then key); NULL for a null value."""
    ranked = value_ranks(df, value, row_key, rank="_rank")
    n = df.agg(F.count(value).alias("_n"))
    bucket = F.when(F.col("_rank").isNotNull(), rank_bucket(F.col("_rank"), F.col("_n"), q))
    return ranked.crossJoin(n).withColumn(name, bucket).drop("_rank", "_n")


def _first(df: DataFrame, names: list[str]) -> str | None:
    return next((c for c in names if c in df.columns), None)


def _sum(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])


def subgroup_labels(df: DataFrame, row_key: str) -> DataFrame:
    """The input columns and a ``g_<variable>`` label for every subgroup that can be derived."""
    out = df
    new: dict[str, Column] = {}
    if "age" in df.columns:
        new["g_age_group"] = cut_right_closed("age", [None, 49, 64, 79, None], ["<50", "50-64", "65-79", "80+"])
    for variable, names in FIRST_OF.items():
        c = _first(df, names)
        if c:
            new[f"g_{variable}"] = F.col(c).cast("string")
    lactate = [c for c in df.columns if "lactate" in c.lower()]
    if "lactate_measured" in df.columns:
        measured = F.col("lactate_measured").cast("boolean")
    else:
        measured = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in lactate], F.lit(False))
    new["g_lactate_measured"] = F.when(measured, "lactate_measured").otherwise("lactate_not_measured")
    missing = [c for c in df.columns if "missing" in c.lower()]
    if missing:
        score = _sum(missing)
        median = exact_quantiles(df.select(score.alias("s")), ["s"], [0.5])["s"][0]
        new["g_missingness_level"] = F.when(score > F.lit(median), "high_missingness").otherwise("low_missingness")
    v = _first(df, VENTILATION)
    if v:
        new["g_ventilation_status"] = F.when(F.coalesce(F.col(v).cast("boolean"), F.lit(False)), "ventilated").otherwise("not_ventilated")
    intensity = [c for c in df.columns if "measurement_count" in c.lower() or "event_count" in c.lower()
                 or c.lower() in ("total_lab_count", "total_vital_count")]
    out = out.withColumns(new)
    if intensity:
        out = out.withColumn("_i", _sum(intensity))
        kinds = min(4, len(out.select("_i").distinct().limit(4).collect()))
        if kinds >= 2:
            out = rank_quartile(out, "_i", row_key, kinds, "_q")
            out = out.withColumn("g_measurement_intensity_quartile", F.concat(F.lit("Q"), F.col("_q").cast("string"))).drop("_q")
        out = out.drop("_i")
    return out


def subgroup_metrics(labelled: DataFrame, *, threshold: float, min_n: int = 30, y: str = "y", p: str = "p",
                     variables: list[str] | None = None) -> DataFrame:
    """Metrics per (subgroup variable, value) with a small-group flag, all in one grouped curve."""
    cols = variables or [c for c in labelled.columns if c.startswith("g_")]
    parts = F.explode(F.array(*[F.struct(F.lit(c[2:] if c.startswith("g_") else c).alias("v"), F.col(c).cast("string").alias("g"))
                                for c in cols]))
    long = labelled.select(F.col(y).alias("y"), F.col(p).cast("double").alias("p"), parts.alias("s")).select(
        "y", "p", F.col("s.v").alias("subgroup_variable"), F.col("s.g").alias("subgroup")).where("subgroup IS NOT NULL")
    keys = ["subgroup_variable", "subgroup"]
    counts = cut_lineage(metrics.score_counts(long, keys))
    m = metrics.curve_metrics(metrics.curve(counts, keys), keys, F.lit(float(threshold)))
    c = calibrate.slope_of_counts(counts, keys)
    small = F.col("n") < min_n
    return m.join(c, keys).select(
        *keys, small.alias("small_subgroup"),
        F.when(small, "small subgroup; interpret cautiously").otherwise("aggregate subgroup estimate").alias("interpretation_note"),
        F.col("positive_rate").alias("mortality_rate"), "auc_roc", "average_precision", "brier_score", "calibration_slope",
        "calibration_intercept", F.col("recall").alias("recall_at_screening_threshold"),
        F.col("precision").alias("precision_at_screening_threshold"),
        F.col("specificity").alias("specificity_at_screening_threshold"), "threshold", "n")
