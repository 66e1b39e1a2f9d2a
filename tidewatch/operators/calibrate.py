"""Recalibration. Two-parameter logistic fits run as grouped Newton steps over score counts, isotonic
fits as pools of violators merged upwards; coefficients and pools are tables, never rows on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.exprs import clip, logit, sigmoid
from tidewatch.functions.numeric import newton_groups, pool_violators
from tidewatch.operators import metrics as M
from tidewatch.operators.joins import null_safe_join
from tidewatch.operators.ranking import bucket_of, fit_edges
from tidewatch.plans.lineage import cut_lineage, stored

GROUP_ROWS = 1_000_000  # distinct values of a group up to which one task fits it


def newton_logistic(counts: DataFrame, groups: list[str], x: str, *, ridge: float = 1e-6, steps: int = 100,
                    tolerance: float = 1e-10, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(groups, intercept, slope, status) of y on x from (groups, x, pos, neg) rows. Both are NULL unless the status is
    "converged"; others are "one class", "singular" and "not converged", as with separable data.

    ``ridge`` penalises the slope only (1/C). One job fits all groups: rows are shuffled by group, and each task steps
    through all groups of its batches at once. Only groups of more than ``group_rows`` distinct values, at most
    rows / ``group_rows`` many, are fitted by map-side combined sums instead, seven per group and step."""
    counts = counts.select(*groups, F.col(x).cast("double").alias("x"), F.col("pos").cast("double").alias("pos"), F.col("neg").cast("double").alias("neg"))
    counts = stored(counts.withColumn("_key", F.to_json(F.struct(*groups)) if groups else F.lit("")), "counts")
    large = counts.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("_key")
    huge = [r[0] for r in large.collect()]
    small = counts.where(~F.col("_key").isin(huge)) if huge else counts
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for g in groups for f in counts.schema.fields if f.name == g)
    names = [*groups, "intercept", "slope", "status"]

    def fit(table: pa.Table) -> pa.RecordBatch:
        key = table.column("_key").combine_chunks()
        starts = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))]).astype(np.int64)
        a, b, status = newton_groups(*(table.column(c).to_numpy() for c in ("x", "pos", "neg")), starts, ridge, steps, tolerance)
        bad = status != "converged"
        first = table.select(groups).take(pa.array(starts)).combine_chunks()
        cols = [first.column(g).combine_chunks() for g in groups]
        return pa.RecordBatch.from_arrays([*cols, pa.array(a, mask=bad), pa.array(b, mask=bad), pa.array(status, pa.string())], names=names)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = held.column("_key")
            if key[0].as_py() == key[-1].as_py():
                continue  # one group so far
            last = pc.index(key, key[-1]).as_py()
            yield fit(held.slice(0, last))
            held = held.slice(last)
        if held is not None:
            yield fit(held)

    dealt = small.repartition("_key").sortWithinPartitions("_key")
    out = dealt.mapInArrow(work, (kinds + ", " if kinds else "") + "intercept double, slope double, status string")
    if huge:
        out = out.unionByName(_newton_sums(counts.where(F.col("_key").isin(huge)).drop("_key"), groups, ridge, steps, tolerance))
    return out


def _newton_sums(counts: DataFrame, groups: list[str], ridge: float, steps: int, tolerance: float) -> DataFrame:
    """The same fits by one aggregate of seven sums per group and step: for few groups of very many values."""
    spark = counts.sparkSession
    counts = cut_lineage(counts)
    kinds = [f for f in counts.schema.fields if f.name in groups]
    schema = T.StructType([*sorted(kinds, key=lambda f: groups.index(f.name)), T.StructField("_a", T.DoubleType()),
                           T.StructField("_b", T.DoubleType()), T.StructField("status", T.StringType())])
    coef: dict[tuple, tuple[float | None, float | None, str]] = {}
    X, n = F.col("x"), F.col("pos") + F.col("neg")
    for step in range(steps):
        if step == 0:
            data = counts.withColumns({"_a": F.lit(0.0), "_b": F.lit(0.0)})
        else:
            known = spark.createDataFrame([(*k, *v) for k, v in coef.items() if v[2] == "not converged"], schema).drop("status")
            data = null_safe_join(counts, known, groups) if groups else counts.crossJoin(F.broadcast(known))
        mu = sigmoid(F.col("_a") + F.col("_b") * X)
        w, g = n * mu * (1 - mu), F.col("pos") - n * mu
        rows = data.groupBy(*groups).agg(
            F.sum(w).alias("h00"), F.sum(w * X).alias("h01"), F.sum(w * X * X).alias("h11"), F.sum(g).alias("g0"),
            F.sum(g * X).alias("g1"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
        for r in rows:
            key = tuple(r[k] for k in groups)
            a, b, _ = coef.get(key, (0.0, 0.0, ""))
            if not (r.pos and r.neg):
                coef[key] = (None, None, "one class")
                continue
            h11, g1 = r.h11 + ridge, r.g1 - ridge * b
            det = r.h00 * h11 - r.h01 * r.h01
            if not det:
                coef[key] = (None, None, "singular")
                continue
            da, db = (h11 * r.g0 - r.h01 * g1) / det, (r.h00 * g1 - r.h01 * r.g0) / det
            near = max(abs(da), abs(db)) < tolerance * max(1.0, abs(a + da), abs(b + db))
            coef[key] = (a + da, b + db, "converged" if near else "not converged")
        if all(v[2] != "not converged" for v in coef.values()):
            break
    done = [(*k, *(v if v[2] == "converged" else (None, None, v[2]))) for k, v in coef.items()]
    return spark.createDataFrame(done, schema).withColumnsRenamed({"_a": "intercept", "_b": "slope"})


def calibration_slope(df: DataFrame, groups: list[str] = (), y: str = "y", p: str = "p", steps: int = 100) -> DataFrame:
    """Calibration intercept and slope: logistic regression of y on logit(p), near-unpenalised;
    NULL for a group with one class."""
    return slope_of_counts(M.score_counts(df, groups, y, p), list(groups), steps)


def slope_of_counts(counts: DataFrame, groups: list[str], steps: int = 100, status: bool = False) -> DataFrame:
    """``status`` adds the column calibration_status, which says why a slope is NULL."""
    fit = newton_logistic(counts.withColumn("x", logit("p")), groups, "x", ridge=1e-6, steps=steps)
    fit = fit.withColumnsRenamed({"intercept": "calibration_intercept", "slope": "calibration_slope", "status": "calibration_status"})
    return fit if status else fit.drop("calibration_status")


def calibration_summary(df: DataFrame, groups: list[str] = (), y: str = "y", p: str = "p", n_bins: int = 10) -> DataFrame:
    """Brier, expected calibration error, intercept and slope per group."""
    groups = list(groups)
    a, b, c = M.brier(df, groups, y, p), M.ece(df, groups, n_bins, y, p), calibration_slope(df, groups, y, p)
    return null_safe_join(null_safe_join(a, b, groups), c, groups)


def _require_two_classes(valid: DataFrame, y: str) -> None:
    row = valid.agg(F.min(y).alias("a"), F.max(y).alias("b")).first()
    if row.a is None:
        raise ValueError("calibration needs at least one validation row")
    if row.a == row.b:
        raise ValueError("calibration needs both outcome classes in the validation labels")


def fit_platt(valid: DataFrame, y: str = "y", p: str = "p", C: float = 1.0, steps: int = 100) -> DataFrame:
    """One metadata row: sigmoid calibration fitted on validation logits with an L2 slope penalty."""
    _require_two_classes(valid, y)
    counts = M.score_counts(valid, (), y, p).withColumn("x", logit("p"))
    coef = newton_logistic(counts, [], "x", ridge=1.0 / C, steps=steps).drop("status")
    info = valid.agg(F.count("*").alias("fit_n"), F.avg(F.col(y).cast("double")).alias("fit_positive_rate"))
    return coef.crossJoin(info).select(F.lit("platt_scaling").alias("method"), F.lit("validation").alias("fit_split"), "fit_n",
                                       "fit_positive_rate", F.col("slope").alias("coefficient"), "intercept",
                                       F.lit(float(C)).alias("C"))


def apply_platt(df: DataFrame, fitted: DataFrame, p: str = "p", name: str = "p_calibrated") -> DataFrame:
    joined = df.crossJoin(fitted.select(F.col("coefficient").alias("_b"), F.col("intercept").alias("_a")))
    return joined.withColumn(name, sigmoid(F.col("_a") + F.col("_b") * logit(p))).drop("_a", "_b")


POOL = "p_low double, p_high double, total double, n double"


def isotonic_pools(counts: DataFrame, per_bucket: int = 20_000, fan: int = 16) -> DataFrame:
    """(p_low, p_high, total, n) pools of the isotonic fit of (p, pos, neg) rows, one row per distinct p.

    Scores are cut into buckets of about ``per_bucket`` distinct values, each pooled by itself; then ``fan`` neighbouring
    buckets at a time are put together and pooled again, until one is left. Pools are the edges of a convex chain under
    the running counts, so n rows leave at most about n^(2/3) of them, however the scores lie: that is the most
    that ever meets in one task."""
    n = F.col("pos") + F.col("neg")
    edges = fit_edges(counts, "p", max(1, counts.count() // per_bucket))
    pools = counts.select(bucket_of("p", edges).alias("bucket"), F.col("p").cast("double").alias("p_low"), F.col("p").cast("double").alias("p_high"),
                          F.col("pos").cast("double").alias("total"), n.cast("double").alias("n"))
    left = len(edges) + 1

    def pooled(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p_low", kind="stable")
        made = pool_violators(*(part[c].to_numpy() for c in ("p_low", "p_high", "total", "n")))
        return pd.DataFrame({"bucket": part["bucket"].iloc[0], **dict(zip(("p_low", "p_high", "total", "n"), made))})

    while True:
        pools = pools.groupBy("bucket").applyInPandas(pooled, f"bucket int, {POOL}")
        if left == 1:
            return pools.drop("bucket")
        pools = pools.withColumn("bucket", F.floor(F.col("bucket") / fan).cast("int"))
        left = -(-left // fan)


def fit_isotonic(valid: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(p_low, p_high, value, n): the pools of an isotonic fit on validation probabilities, stored once."""
    _require_two_classes(valid, y)
    counts = stored(M.score_counts(valid, (), y, p), "scores")
    return stored(isotonic_pools(counts).select("p_low", "p_high", (F.col("total") / F.col("n")).alias("value"), "n"), "pools")


KNOTS = 64  # knots of a pool table that a row is held against


def apply_isotonic(df: DataFrame, pools: DataFrame, p: str = "p", name: str = "p_calibrated") -> DataFrame:
    """Interpolated fit, constant outside the fitted range, within [0, 1]; NULL for a null score.

    Rows join the few knots around them by bucket, so the pool table is never sent whole to a task."""
    knots = pools.select(F.explode(F.array(F.struct(F.col("p_low").alias("x"), F.col("value").alias("v")),
                                           F.struct(F.col("p_high").alias("x"), F.col("value").alias("v")))).alias("k")).select("k.*").distinct()
    knots = stored(knots, "knots")
    edges = fit_edges(knots, "x", max(1, knots.count() // KNOTS))
    own = knots.groupBy(bucket_of("x", edges).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("_k"))
    # one row per bucket, with the last knot before and the first after; buckets lie between neighbouring edges
    near = own.select("_b", "_k", F.element_at("_k", 1).alias("a"), F.element_at("_k", -1).alias("z"))
    ahead = near.select((F.col("_b") + 1).alias("_b"), F.array("z").alias("_prev"))
    behind = near.select((F.col("_b") - 1).alias("_b"), F.array("a").alias("_next"))
    none = F.slice(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("v"))), 1, 0)
    both = near.select("_b", "_k").join(ahead, "_b", "left").join(behind, "_b", "left").select(
        "_b", F.concat(F.coalesce("_prev", none), "_k", F.coalesce("_next", none)).alias("_k"))
    x = F.col(p).cast("double")
    joined = df.withColumn("_b", bucket_of(x, edges)).join(both, "_b", "left")
    under, over = F.filter("_k", lambda k: k["x"] <= x), F.filter("_k", lambda k: k["x"] >= x)
    # columns of their own, so that a row's knots are searched once, however often the value names them
    joined = joined.select(*df.columns, F.try_element_at(under, F.lit(-1)).alias("_lo"), F.try_element_at(over, F.lit(1)).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    part = F.try_divide(x - lo["x"], hi["x"] - lo["x"])
    value = F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (lo["x"] == hi["x"]), lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * part)
    return joined.withColumn(name, F.when(x.isNotNull(), clip(value, 0.0, 1.0))).drop("_lo", "_hi")
