"""Value cleaning. Fitted numbers come from the rows ``fit_on`` names (all rows by default)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions.exprs import clip, flag, outside
from tidewatch.operators.profile import numeric_columns, per_column
from tidewatch.operators.ranking import exact_quantiles
from tidewatch.operators.rules import adjusted_skew


def fit_rows(df: DataFrame, fit_on: Column | None) -> DataFrame:
    return df if fit_on is None else df.where(fit_on)


def range_clip(df: DataFrame, ranges: dict[str, tuple[float, float]] = K.OUTLIER_RANGES) -> DataFrame:
    return df.withColumns({c: clip(c, *r) for c, r in ranges.items() if c in df.columns})


def range_clip_counts(df: DataFrame, ranges: dict[str, tuple[float, float]] = K.OUTLIER_RANGES) -> DataFrame:
    """How many values of each column lie outside its range."""
    cols = [c for c in ranges if c in df.columns]
    return per_column(df, cols, lambda c: [("clipped", F.sum(flag(outside(c, *ranges[c]))))])


def _limits(columns: list[str]) -> dict[str, tuple[float, float]]:
    out: dict[str, tuple[float, float]] = {}
    for base, r in {**K.LAB_LIMITS, **K.VITAL_LIMITS}.items():
        for s in ("_mean", "_min", "_max", "_first", "_last"):
            if base + s in columns:
                out[base + s] = r
    return out


def unit_normalize(df: DataFrame, fit_on: Column | None = None) -> DataFrame:
    """Clip to plausible limits and convert columns whose median shows another unit.

    One fit pass finds the medians of the clipped columns, one projection applies them."""
    cols = df.columns
    new: dict[str, Column] = {c: clip(c, *r) for c, r in _limits(cols).items()}
    if "bmi" in cols:
        new["bmi"] = clip("bmi", 10, 80)
    if "urine_output_total" in cols:
        new["urine_output_total"] = clip("urine_output_total", 0, 10000)
    temps = [c for c in cols if "temp" in c.lower() and "_mean" in c.lower()]
    units = {
        "glucose": (lambda m: 0 < m < 20, lambda v: v * 18),
        "creatinine": (lambda m: m > 50, lambda v: v / 88.4),
        "bilirubin": (lambda m: m > 20, lambda v: v / 17.1),
        "hemoglobin": (lambda m: m > 30, lambda v: v / 10),
        "hgb": (lambda m: m > 30, lambda v: v / 10),
    }
    checked = {c: u for u in units for c in cols if u in c.lower() and c in numeric_columns(df)}
    base = fit_rows(df, fit_on).select(*[F.col(c) for c in temps], *[new.get(c, F.col(c)).alias(c) for c in checked])
    medians = exact_quantiles(base, temps + list(checked), [0.5]) if base.columns else {}
    for c in temps:
        m = medians[c][0]
        v = F.col(c)
        if m is not None and m > 90:
            v = F.when(v > 90, (v - 32) * 5 / 9).otherwise(v)
        new[c] = clip(v, 35, 42)
    for c, u in checked.items():
        test, convert = units[u]
        if medians[c][0] is not None and test(medians[c][0]):
            new[c] = convert(new.get(c, F.col(c)))
    return df.withColumns(new)


def map_with_mode_fill(df: DataFrame, column: str, mapping: dict[str, int], name: str,
                       fit_on: Column | None = None) -> DataFrame:
    """Map text to codes and fill unknown with the most frequent code (smallest on ties)."""
    code = F.when(F.lit(False), F.lit(0))
    for k, v in mapping.items():
        code = code.when(F.col(column) == k, F.lit(v))
    row = (fit_rows(df, fit_on).select(code.alias("c")).where("c IS NOT NULL").groupBy("c").agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), "c").first())
    return df.withColumn(name, F.coalesce(code, F.lit(row.c if row else None).cast("int")))


def winsorize(df: DataFrame, columns: list[str] | None = None, *, low: float = 0.01, high: float = 0.99,
              limit: float = 2.0, skip: tuple[str, ...] = tuple(K.OUTLIER_RANGES), substring: bool = False,
              fit_on: Column | None = None) -> DataFrame:
    """Cap columns with |adjusted skew| above the limit at their fitted percentiles.

    Identifier columns are recognised by the token ``id``; ``substring=True`` skips every name
    containing the letters, as older result tables did."""
    is_id = (lambda c: "id" in c.lower()) if substring else (lambda c: "id" in c.lower().split("_"))
    cols = [c for c in (columns or numeric_columns(df)) if c not in skip and not is_id(c) and "_missing" not in c]
    base = fit_rows(df, fit_on)
    if not cols:
        return df
    skew = base.agg(*[adjusted_skew(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    cols = [c for i, c in enumerate(cols) if skew[f"s{i}"] is not None and abs(skew[f"s{i}"]) > limit]
    if not cols:
        return df
    q = exact_quantiles(base, cols, [low, high])
    return df.withColumns({c: clip(F.col(c).cast("double"), *q[c]) for c in cols})
