"""Bootstrap intervals by Poisson resampling.

A row's weight in a replicate is a pure function of (row, replicate, seed), so replicates need
no state, survive retries and are equal on every engine. Rows are never repeated per replicate:
they are shuffled once into score cells and ordered inside them, and a task carries vectors
over all replicates along its cells. A score held by many rows has a cell of its own that is
spread over many tasks. Nothing but edges of cells reaches the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.constants import POISSON_CUTS
from tidewatch.functions.resample import BLOCK_CELLS, runs, weights
from tidewatch.operators import metrics as M
from tidewatch.operators.ranking import cell_of, fit_cells, fit_edges
from tidewatch.plans.lineage import stored

METRICS = ("auc_roc", "average_precision", "brier_score", "accuracy", "precision", "recall", "specificity", "f1", "npv")


SUMS = "m int, cell int, piece int, replicate int, pos long, neg long, area double, brier double, tp long, fp long"
TERMS = "m int, replicate int, ap double, pr double"
PER_CELL = 20_000  # rows of a cell, about


def _cells(df: DataFrame, row_key: str, models: list[str], y: str) -> DataFrame:
    """Rows (m, cell, piece, p, y, k) written once, each cell in one place and ordered by falling score.

    The number of cells follows the number of rows; a score that fills cells by itself is one cell,
    cut into pieces by the row key."""
    size = df.count()
    buckets = max(16, size // PER_CELL)
    parts = max(1, min(size // PER_CELL, 1 << 20))
    scores = []
    for m, c in enumerate(models):
        edges, often = fit_cells(df, c, buckets)
        p = F.col(c).cast("double")
        alone = p.isin(often) if often else F.lit(False)
        scores.append(F.struct(F.lit(m).alias("m"), cell_of(p, edges, often).alias("cell"), p.alias("p"),
                               F.when(alone, F.pmod(F.xxhash64(row_key), F.lit(parts)).cast("int")).otherwise(0).alias("piece"),
                               alone.alias("alone")))
    rows = df.select(F.col(y).cast("bigint").alias("y"), F.col(row_key).cast("bigint").alias("k"), F.explode(F.array(*scores)).alias("s"))
    rows = rows.select("s.m", "s.cell", "s.piece", "s.p", "s.alone", "y", "k").repartition("m", "cell", "piece")
    return stored(rows.sortWithinPartitions("m", "cell", "piece", F.desc("p")), "cells")


def replicate_metrics(df: DataFrame, row_key: str, *, n_boot: int, threshold: float = 0.5, seed: int = 12345,
                      models: dict[str, str] | None = None, y: str = "y", p: str = "p",
                      thresholds: dict[str, float] | None = None, precision_curve: bool = True) -> DataFrame:
    """(replicate, model, metrics): with ``models`` (name -> score column) all scores share the
    same resamples, as a paired comparison needs. Without ``precision_curve`` the two areas under it
    stay NULL, and the pass over the rows that only they need is left out.

    Cells meet in Spark: running totals over the cells of each (model, replicate) give what stands
    above a cell, and go back to the cells' tasks for the terms of the precision curve."""
    models = models or {"model": p}
    names = list(models)
    cuts, limits = POISSON_CUTS, [float((thresholds or {}).get(m, threshold)) for m in names]
    rows = _cells(df, row_key, list(models.values()), y)
    reps = np.arange(1, n_boot + 1)

    def sums(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (m, cell), r in runs([pdf.sort_values("p", ascending=False, kind="stable")], n_boot, seed, cuts, limits, None):
            out.append(pd.DataFrame({"m": m, "cell": cell, "piece": keys[2], "replicate": reps, "pos": r.pos, "neg": r.neg, "area": r.area,
                                     "brier": r.brier, "tp": r.tp, "fp": r.fp}))
        return pd.concat(out)

    part = stored(rows.groupBy("m", "cell", "piece").applyInPandas(sums, SUMS), "cell-sums")
    single = rows.select("m", "cell", "alone").distinct()
    # pieces of one cell hold one score: their counts add up, and so does everything but the area
    cells = part.groupBy("m", "cell", "replicate").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "area", "brier", "tp", "fp")])
    above = Window.partitionBy("m", "replicate").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(single, ["m", "cell"]).withColumns({f"{c}0": F.coalesce(F.sum(c).over(above), F.lit(0)) for c in ("pos", "neg")})
    tp, seen0 = F.col("pos0") + F.col("pos"), (F.col("pos0") + F.col("neg0")).cast("double")
    seen = (tp + F.col("neg0") + F.col("neg")).cast("double")
    precision = F.when(seen > 0, tp / seen).otherwise(0.0)
    before = F.when(seen0 > 0, F.col("pos0") / seen0).otherwise(1.0)
    alone = lambda x: F.sum(F.when(F.col("alone"), x).otherwise(0.0))
    area = F.when(F.col("alone"), F.col("pos") * F.col("neg") / 2.0).otherwise(F.col("area"))
    total = cells.groupBy("m", "replicate").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "brier", "tp", "fp")], F.sum(F.col("pos0") * F.col("neg") + area).alias("auc"),
        alone(F.col("pos") * precision).alias("ap1"), alone(F.col("pos") * (precision + before) / 2.0).alias("pr1"))
    known = F.create_map(*[x for m, n in enumerate(names) for x in (F.lit(m), F.struct(F.lit(n).alias("n"), F.lit(limits[m]).alias("t")))])[F.col("m")]

    def finished(both: DataFrame, ap: Column, pr: Column) -> DataFrame:
        table = both.withColumn("_k", known).select(
            F.col("replicate").cast("int").alias("replicate"), F.col("_k.n").alias("model"), F.col("pos").alias("_P"), F.col("neg").alias("_N"),
            F.col("auc").cast("double").alias("_auc"), ap.alias("_ap"), pr.alias("_pr"), F.col("brier").alias("_brier"), "tp", "fp", F.col("_k.t").alias("threshold"))
        return M.finish_metrics(table, ["replicate", "model"], True)

    if not precision_curve:
        none = F.lit(None).cast("double")
        return finished(total, none, none).withColumn("average_precision", none)
    starts = cells.where(~F.col("alone")).groupBy("m", "cell").agg(F.array_sort(F.collect_list(F.struct("replicate", "pos0", "neg0"))).alias("s"))
    starts = starts.select("m", "cell", F.transform("s", lambda x: x["pos0"]).alias("pos0"), F.transform("s", lambda x: x["neg0"]).alias("neg0"))

    def terms(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        at = {(int(r.m), int(r.cell)): (np.asarray(r.pos0, np.int64), np.asarray(r.neg0, np.int64)) for r in start.itertuples()}
        out = [pd.DataFrame({"m": m, "replicate": reps, "ap": r.ap, "pr": r.pr})
               for (m, _), r in runs([pdf.sort_values("p", ascending=False, kind="stable")], n_boot, seed, cuts, limits, at)]
        return pd.concat(out) if out else pd.DataFrame({"m": [], "replicate": [], "ap": [], "pr": []})

    curve = rows.where(~F.col("alone")).groupBy("m", "cell").cogroup(starts.groupBy("m", "cell")).applyInPandas(terms, TERMS)
    curve = curve.groupBy("m", "replicate").agg(F.sum("ap").alias("ap2"), F.sum("pr").alias("pr2"))
    add = lambda a, b: F.coalesce(F.col(a), F.lit(0.0)) + F.coalesce(F.col(b), F.lit(0.0))
    return finished(total.join(curve, ["m", "replicate"], "left"), add("ap1", "ap2"), add("pr1", "pr2"))


def replicate_values(df: DataFrame, row_key: str, callbacks: dict[str, Callable], *, n_boot: int, seed: int = 12345, models: dict[str, str] | None = None,
                     y: str = "y", p: str = "p") -> DataFrame:
    """(replicate, model, metric, value) of the caller's own metrics on the same resamples as ``replicate_metrics``.

    A metric is a function of three arrays: distinct scores in rising order, and how many positive and negative rows
    the replicate has at each (``of_rows`` wraps a function of labels and scores). An error or a value that is not a
    finite number leaves the value NULL. Weights are counted per score in the tasks that hold the rows, so rows are
    never repeated; one replicate's counts, 24 bytes per distinct score, meet in one task, as any function of all scores needs."""
    models = models or {"model": p}
    cuts, reps, names = POISSON_CUTS, np.arange(1, n_boot + 1, dtype=np.int64), list(models)
    scores = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).cast("double").alias("p")) for m, c in enumerate(models.values())]))
    rows = df.select(F.col(y).cast("bigint").alias("y"), F.col(row_key).cast("bigint").alias("k"), scores.alias("s")).select("s.m", "s.p", "y", "k")
    rows = rows.where("p IS NOT NULL AND y IS NOT NULL")

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m, own in pdf.groupby("m", sort=False):
                own = own.sort_values("p", kind="stable")
                step = max(1, BLOCK_CELLS // n_boot)
                for i in range(0, len(own), step):
                    part = own.iloc[i:i + step]
                    x, label = part["p"].to_numpy(float), part["y"].to_numpy(np.int64)
                    w = weights(part["k"].to_numpy(np.int64), reps, seed, cuts)
                    first = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1))
                    pos = np.add.reduceat(w * label[:, None], first, axis=0)
                    neg = np.add.reduceat(w, first, axis=0) - pos
                    some = (pos + neg) > 0
                    at = x[first]
                    yield pd.DataFrame({"m": m, "replicate": reps, "x": [at[some[:, r]] for r in range(n_boot)],
                                        "pos": [pos[some[:, r], r] for r in range(n_boot)], "neg": [neg[some[:, r], r] for r in range(n_boot)]})

    counted = rows.mapInPandas(count, "m int, replicate int, x array<double>, pos array<bigint>, neg array<bigint>")

    def value(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, pos, neg = (np.concatenate(pdf[c].to_numpy()) for c in ("x", "pos", "neg"))
        order = np.argsort(x, kind="stable")
        x, pos, neg = x[order], pos[order], neg[order]
        if len(x):
            first = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1))
            x, pos, neg = x[first], np.add.reduceat(pos, first), np.add.reduceat(neg, first)
        out = []
        for name, fn in callbacks.items():
            try:
                v = float(fn(x, pos, neg))
            except Exception:  # a metric that a resample leaves undefined
                v = float("nan")
            out.append(v if np.isfinite(v) else None)
        return pd.DataFrame({"replicate": np.int32(keys[1]), "model": names[keys[0]], "metric": list(callbacks), "value": pd.array(out, dtype="Float64")})

    return counted.groupBy("m", "replicate").applyInPandas(value, "replicate int, model string, metric string, value double")


def of_rows(fn: Callable) -> Callable:
    """A metric of (labels, scores) as a metric of score counts."""
    def metric(x, pos, neg):
        return fn(np.repeat(np.tile([1, 0], len(x)), np.stack([pos, neg], 1).ravel()), np.repeat(np.repeat(x, 2), np.stack([pos, neg], 1).ravel()))
    return metric


def _cut(models: dict[str, str], thresholds: dict[str, float]) -> Column:
    t = F.when(F.lit(False), F.lit(0.0))
    for m in models:
        t = t.when(F.col("model") == m, F.lit(float(thresholds[m])))
    return t


def _interval(value: str, confidence: float) -> list[Column]:
    a = (1.0 - confidence) / 2.0
    return [F.avg(value).alias("mean"), F.percentile(value, F.lit(a)).alias("ci_lower"),
            F.percentile(value, F.lit(1.0 - a)).alias("ci_upper"), F.count(value).alias("n_success")]


def _two_classes(name: str) -> Column:
    """Average precision of a one-class resample is undefined here, so it is skipped."""
    return F.col(name) if name != "average_precision" else F.when(F.col("auc_roc").isNotNull(), F.col(name))


def bootstrap_ci(df: DataFrame, row_key: str, *, threshold: float = 0.5, n_boot: int = 1000, seed: int = 12345,
                 confidence: float = 0.95, metrics: tuple[str, ...] = METRICS, callbacks: dict[str, Callable] | None = None,
                 y: str = "y", p: str = "p") -> DataFrame:
    """(metric, mean, ci_lower, ci_upper, n_success, n_boot, confidence); resamples where a
    metric is undefined are left out of it. Percentiles run over n_boot values only.

    ``callbacks`` adds the caller's own metrics by name, see ``replicate_values``."""
    parts = []
    if metrics:
        per = replicate_metrics(df, row_key, n_boot=n_boot, threshold=threshold, seed=seed, y=y, p=p,
                                precision_curve=bool({"average_precision", "pr_auc"} & set(metrics)))
        parts.append(per.select("replicate", *[_two_classes(m).alias(m) for m in metrics]).unpivot(["replicate"], list(metrics), "metric", "value"))
    if callbacks:
        parts.append(replicate_values(df, row_key, callbacks, n_boot=n_boot, seed=seed, y=y, p=p).select("replicate", "metric", "value"))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return long.groupBy("metric").agg(*_interval("value", confidence)).withColumns(
        {"n_boot": F.lit(n_boot), "confidence": F.lit(confidence)})


def paired_difference(df: DataFrame, row_key: str, *, metric: str, model_a: tuple[str, str], model_b: tuple[str, str],
                      n_boot: int = 1000, seed: int = 12345, confidence: float = 0.95, threshold_a: float = 0.5,
                      threshold_b: float = 0.5, y: str = "y") -> DataFrame:
    """metric(a) - metric(b) on shared resamples, with interval and two-sided p-value."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}; for an own function compare replicate_values of both models")
    models = dict([model_a, model_b])
    cuts = {model_a[0]: threshold_a, model_b[0]: threshold_b}
    a, b = model_a[0], model_b[0]
    side = lambda m: F.max(F.when(F.col("model") == m, _two_classes(metric)))
    per = replicate_metrics(df, row_key, n_boot=n_boot, seed=seed, models=models, thresholds=cuts, y=y, precision_curve=metric == "average_precision")
    d = per.groupBy("replicate").agg((side(a) - side(b)).alias("d"))
    stats = d.agg(*_interval("d", confidence), F.avg((F.col("d") <= 0).cast("double")).alias("_lo"),
                  F.avg((F.col("d") >= 0).cast("double")).alias("_hi"))
    scores = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p")) for m, c in models.items()]))
    long = df.select(F.col(y).alias("y"), scores.alias("s")).select("y", "s.model", "s.p")
    edges = sorted({e for c in models.values() for e in fit_edges(df, c)})
    full = M.curve_metrics(M.curve(M.score_counts(long, ["model"]), ["model"], edges), ["model"], _cut(models, cuts))
    est = full.agg(side(a).alias("estimate_a"), side(b).alias("estimate_b"))
    return est.crossJoin(stats).select(
        F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.lit(metric).alias("metric"), "estimate_a", "estimate_b",
        (F.col("estimate_a") - F.col("estimate_b")).alias("difference"), "ci_lower", "ci_upper",
        F.least(F.lit(1.0), 2 * F.least("_lo", "_hi")).alias("p_value_two_sided"), F.lit(n_boot).alias("n_boot"), "n_success",
        F.lit(confidence).alias("confidence"))
