"""Exact, tie-aware classification metrics, grouped.

Rows are first counted per distinct score (map-side), then running totals by falling score are
built in buckets (``ranking.running_totals``). Every metric is a plain sum over that curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import edge_bin, grid_edges, or_zero, ratio
from tidewatch.operators.joins import null_safe_join
from tidewatch.operators.ranking import fit_edges, running_totals


def score_counts(df: DataFrame, groups: list[str] = (), y: str = "y", p: str = "p", weight: Column | None = None) -> DataFrame:
    """(groups, p, pos, neg): weighted positives and negatives per distinct score."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*groups, F.col(p).cast("double").alias("p")).agg(
        F.sum(w * F.col(y)).cast("bigint").alias("pos"), F.sum(w * (1 - F.col(y))).cast("bigint").alias("neg"))


def curve(counts: DataFrame, groups: list[str] = (), edges: list[float] | None = None) -> DataFrame:
    """Score counts with ``tp`` and ``fp``: totals at and above each score."""
    edges = fit_edges(counts, "p") if edges is None else edges
    out = running_totals(counts, list(groups), "p", ["pos", "neg"], edges, descending=True)
    return out.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, specificity, F1, NPV; a zero denominator gives 0."""
    precision, recall = or_zero(ratio(tp, tp + fp)), or_zero(ratio(tp, tp + fn))
    return {"accuracy": or_zero(ratio(tp + tn, tp + fp + fn + tn)), "precision": precision, "recall": recall,
            "specificity": or_zero(ratio(tn, tn + fp)),
            "f1": or_zero(ratio(2 * precision * recall, precision + recall)), "npv": or_zero(ratio(tn, tn + fn))}


def curve_metrics(points: DataFrame, groups: list[str] = (), threshold: Column | None = None) -> DataFrame:
    """One row per group: AUC (NULL for one class), average precision (0 for one class), PR area by
    trapezoid, Brier, n, positive rate and, at a threshold, the confusion counts and rates."""
    pos, neg, tp, fp, p = (F.col(c) for c in ("pos", "neg", "tp", "fp", "p"))
    prec = ratio(tp, tp + fp)
    before = F.coalesce(ratio(tp - pos, tp + fp - pos - neg), F.lit(1.0))
    aggs = [F.sum(pos).alias("_P"), F.sum(neg).alias("_N"),
            F.sum(neg * (tp - pos / F.lit(2.0))).alias("_auc"), F.sum(pos * prec).alias("_ap"),
            F.sum(pos * (prec + before) / 2).alias("_pr"),
            F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("_brier")]
    if threshold is not None:
        aggs += [F.sum(F.when(p >= threshold, pos).otherwise(0)).alias("tp"),
                 F.sum(F.when(p >= threshold, neg).otherwise(0)).alias("fp"), F.max(threshold).alias("threshold")]
    return finish_metrics(points.groupBy(*groups).agg(*aggs), groups, threshold is not None)


def finish_metrics(g: DataFrame, groups: list[str], with_counts: bool) -> DataFrame:
    """Metrics from the sums of a curve."""
    P, N = F.col("_P"), F.col("_N")
    two = (P > 0) & (N > 0)
    out = [*groups, F.when(two, F.col("_auc") / (P.cast("double") * N)).alias("auc_roc"),
           F.when(two, F.col("_ap") / P).otherwise(F.lit(0.0)).alias("average_precision"),
           F.when(two, F.col("_pr") / P).alias("pr_auc"), ratio("_brier", P + N).alias("brier_score"),
           (P + N).alias("n"), ratio(P, P + N).alias("positive_rate")]
    if with_counts:
        tp_, fp_ = F.col("tp"), F.col("fp")
        out += [tp_, fp_, (P - tp_).alias("fn"), (N - fp_).alias("tn"), "threshold",
                *[c.alias(k) for k, c in rates(tp_, fp_, P - tp_, N - fp_).items()]]
    return g.select(*out)


def binary_metrics(df: DataFrame, threshold: float = 0.5, groups: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """All metrics of each group at one threshold (predict positive when p >= threshold)."""
    points = curve(score_counts(df, groups, y, p), groups, fit_edges(df, p))
    return curve_metrics(points, groups, F.lit(float(threshold)))


def ranking_metrics(df: DataFrame, groups: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return curve_metrics(curve(score_counts(df, groups, y, p), groups, fit_edges(df, p)), groups)


def totals(counts: DataFrame, groups: list[str] = ()) -> DataFrame:
    return counts.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def with_totals(points: DataFrame, counts: DataFrame, groups: list[str] = ()) -> DataFrame:
    t = totals(counts, groups)
    return null_safe_join(points, t, list(groups))


def roc_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score."""
    c = score_counts(df, (), y, p)
    pts = with_totals(curve(c, (), fit_edges(df, p)), c)
    return pts.select(F.col("p").alias("threshold"), ratio("fp", "n_neg").alias("fpr"), ratio("tp", "n_pos").alias("tpr"))


def pr_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    c = score_counts(df, (), y, p)
    pts = with_totals(curve(c, (), fit_edges(df, p)), c)
    return pts.select(F.col("p").alias("threshold"), ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
                      ratio("tp", "n_pos").alias("recall"))


def brier(df: DataFrame, groups: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    d = F.col(p) - F.col(y)
    return df.groupBy(*groups).agg(F.avg(d * d).alias("brier_score"))


def confusion_on_grid(df: DataFrame, grid: list[float], y: str = "y", p: str = "p") -> DataFrame:
    """Confusion counts at every threshold of a fixed ascending grid.

    A row is counted once, in the cell between two thresholds; totals over the cells then give
    all thresholds, so rows are never repeated per threshold."""
    cell = F.lit(0)
    for t in grid:
        cell = cell + (F.col(p) >= F.lit(t)).cast("int")
    cells = df.groupBy(cell.alias("k")).agg(F.sum(F.col(y)).cast("bigint").alias("pos"),
                                            F.sum(1 - F.col(y)).cast("bigint").alias("neg"))
    thresholds = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(t).alias("t")) for i, t in enumerate(grid)])
    at = cells.withColumn("s", F.explode(thresholds))
    above = F.col("k") >= F.col("s.k")
    out = at.groupBy(F.col("s.t").alias("threshold")).agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"))
    return out


def calibration_bins(df: DataFrame, groups: list[str] = (), n_bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """(groups, bin, n, mean_predicted, observed) for the non-empty fixed-width bins."""
    b = edge_bin(p, grid_edges(n_bins))
    return (df.groupBy(*groups, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted_probability"),
                                                    F.avg(F.col(y).cast("double")).alias("observed_event_rate"))
            .where(F.col("bin").isNotNull()))


def ece(df: DataFrame, groups: list[str] = (), n_bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Expected calibration error over fixed-width bins, the last bin closed."""
    gap = F.abs(F.col("mean_predicted_probability") - F.col("observed_event_rate"))
    return calibration_bins(df, groups, n_bins, y, p).groupBy(*groups).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("expected_calibration_error"))


def calibration_curve(df: DataFrame, n_bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """One row per bin, empty bins included (n = 0, NULL means)."""
    e = grid_edges(n_bins)
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(e[i]).alias("lower"), F.lit(e[i + 1]).alias("upper"))
                     for i in range(n_bins)])
    frame = df.sparkSession.range(1).select(F.explode(bins).alias("s")).select("s.*")
    out = frame.join(calibration_bins(df, (), n_bins, y, p), "bin", "left")
    return out.select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted_probability",
                      "observed_event_rate")
