"""Feature selection: statistics on Spark, choices over one row per column or pair."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions.exprs import flag, ratio
from tidewatch.operators.guards import drop_irrelevant
from tidewatch.operators.impute import apply_fill, fit_fill
from tidewatch.operators.profile import numeric_columns, per_column
from tidewatch.operators.ranking import exact_quantiles
from tidewatch.plans.lineage import scanned


def median_filled(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    return apply_fill(df, fit_fill(df, columns, fit_on))


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance per column after median filling."""
    filled = median_filled(df, columns)
    return per_column(filled, columns, lambda c: [("variance", F.var_pop(c))])


def variance_filter(df: DataFrame, columns: list[str], threshold: float = 0.01) -> list[str]:
    """The columns whose variance exceeds the threshold."""
    keep = {r.column_name for r in variances(df, columns).where(F.col("variance") > threshold).collect()}
    return [c for c in columns if c in keep]


def anova_scores(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """ANOVA F per column (median filled): one aggregate per class, then sums over classes.

    Values are centred on the overall mean first, so the sums of squares do not cancel. The columns are
    written once if they are more than a scan, for all passes over them."""
    filled = median_filled(scanned(df.select(label, *[c for c in columns if c != label])), columns)
    means = filled.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    d = lambda i, c: F.col(c) - F.lit(means[f"m{i}"] or 0.0)
    per_class = filled.groupBy(label).agg(
        F.count("*").alias("n"), *[a for i, c in enumerate(columns)
                                   for a in (F.sum(d(i, c)).alias(f"s{i}"), F.sum(d(i, c) * d(i, c)).alias(f"q{i}"))])
    aggs = [F.sum("n").alias("_n"), F.count("*").cast("double").alias("_k")]
    for i in range(len(columns)):
        aggs += [F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.col("n")).alias(f"b{i}"), F.sum(f"q{i}").alias(f"q{i}"),
                 F.sum(f"s{i}").alias(f"s{i}")]
    one = per_class.agg(*aggs)
    fields = []
    for i, c in enumerate(columns):
        between = F.col(f"b{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col("_n")
        within = F.col(f"q{i}") - F.col(f"b{i}")
        f = ratio(between / (F.col("_k") - 1), within / (F.col("_n") - F.col("_k")))
        fields.append(F.struct(F.lit(c).alias("column_name"), f.alias("score")))
    return one.select(F.explode(F.array(*fields)).alias("s")).select("s.*")


def binned_mi(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of the label with each column cut at its quantiles."""
    probs = [i / bins for i in range(1, bins)]
    df = scanned(df.select(label, *[c for c in columns if c != label]))
    q = exact_quantiles(df, columns, probs)
    parts = []
    for c in columns:
        edges = sorted(set(x for x in q[c] if x is not None))
        b = sum(((F.col(c) > F.lit(e)).cast("int") for e in edges), F.lit(0))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.coalesce(b, F.lit(-1)).alias("b")))
    cells = (df.select(F.col(label).alias("y"), F.explode(F.array(*parts)).alias("s"))
             .groupBy("s.column_name", "s.b", "y").agg(F.count("*").alias("n")))
    col_w, bin_w = Window.partitionBy("column_name"), Window.partitionBy("column_name", "b")
    y_w = Window.partitionBy("column_name", "y")
    n, tot = F.col("n").cast("double"), F.sum("n").over(col_w).cast("double")
    nb, ny = F.sum("n").over(bin_w), F.sum("n").over(y_w)
    terms = cells.select("column_name", (n / tot * F.log(n * tot / (nb * ny))).alias("t"))
    return terms.groupBy("column_name").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return scores.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "column_name").limit(k)


def corr_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every column pair, over pairwise complete rows.

    One pass adds up cross products of all pairs as matrices, one per task, around the column means,
    so that large offsets cost no digits; the tasks' matrices meet row by row. r is NULL where a
    column does not vary over the pair's rows."""
    spark = df.sparkSession
    p = len(columns)
    if p < 2:
        return spark.createDataFrame([], "a string, b string, r double")
    data = scanned(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    row = data.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(p)]).first()
    means = np.array([0.0 if v is None else v for v in row], float)

    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, p, p))
        for b in batches:
            x = b.to_numpy(float) - means
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pd.DataFrame({"i": np.arange(p), "s": [total[:, i, :].ravel() for i in range(p)]})

    def pairs(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "s": [np.sum(np.stack(g["s"].to_numpy()), axis=0)]})

    parts = data.mapInPandas(sums, "i int, s array<double>").groupBy("i").applyInPandas(pairs, "i int, s array<double>")
    # a pair's sums of its second column stand in that column's row
    lines = parts.select("i", *[F.slice("s", 1 + k * p, p).alias(n) for k, n in enumerate(("n", "x", "xx", "xy"))])
    cells = lines.select("i", F.posexplode(F.arrays_zip("n", "x", "xx", "xy")).alias("j", "v")).select("i", "j", "v.*")
    other = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    both = cells.where("i < j").join(other, ["i", "j"])
    n = F.col("n")
    sx, sy = F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n
    sxy = F.col("xy") - F.col("x") * F.col("y") / n
    tiny = lambda s, raw: s <= 1e-13 * F.col(raw)
    r = F.when((n > 1) & ~tiny(sx, "xx") & ~tiny(sy, "yy"), sxy / F.sqrt(sx * sy))
    names = F.array(*[F.lit(c) for c in columns])
    return both.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.when(n > 0, r).alias("r"))


def corr_filter(df: DataFrame, columns: list[str], threshold: float = 0.8) -> list[str]:
    """Keep a column unless an earlier one correlates with it above the threshold."""
    hit = {r.b for r in corr_pairs(df, columns).where(F.abs("r") > threshold).select("b").distinct().collect()}
    return [c for c in columns if c not in hit]


def column_scores(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """variance x (1 - missing share) per column."""
    row = df.agg(*[(F.var_samp(F.col(c).cast("double")) * F.count(c) / F.count("*")).alias(f"v{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: row[f"v{i}"] or 0.0 for i, c in enumerate(columns)}


def corr_filter_protected(df: DataFrame, columns: list[str], protected: list[str] = (), threshold: float = 0.85) -> list[str]:
    """Correlation filter that keeps the best-scored column of each cluster and never a protected one out."""
    pairs = corr_pairs(df, columns).where(F.abs("r") > threshold).collect()
    earlier: dict[str, list[str]] = {}
    for p in pairs:
        earlier.setdefault(p.b, []).append(p.a)
    score = column_scores(df, columns)
    gone: set[str] = set()
    for c in columns:
        if c in earlier and c not in protected and c not in gone:
            cluster = sorted([c, *earlier[c]], key=lambda x: -score[x])
            gone.update(cluster[1:])
    return [c for c in columns if c not in gone]


def redundancy_greedy(df: DataFrame, columns: list[str], threshold: float = 0.85, clinical_threshold: float = 0.95,
                      keep_transformed: bool = True, keep_clinical: bool = True) -> list[str]:
    """Walk correlated pairs from the strongest down and drop the weaker column of each.

    Score: variance x (1 - missing), x1.5 for clinical names, x0.9 for a derived name met by a
    plain one. Clinical pairs need the higher threshold; a plain and a derived form of one
    quantity stay together."""
    clinical = lambda c: any(t in c for t in K.CLINICAL_TERMS)
    derived = lambda c: c.endswith(tuple(K.DERIVED_SUFFIXES))
    pairs = corr_pairs(df, columns).where(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "a", "b").collect()
    base = column_scores(df, columns)
    gone: set[str] = set()
    for a, b, r in pairs:
        if a in gone or b in gone:
            continue
        both = clinical(a) and clinical(b)
        same = both and any(t in a and t in b for t in K.CLINICAL_TERMS)
        if keep_transformed and same and derived(a) != derived(b):
            continue
        if keep_clinical and both and abs(r) <= clinical_threshold:
            continue
        score = {c: base[c] * (1.5 if keep_clinical and clinical(c) else 1.0) for c in (a, b)}
        if derived(a) != derived(b):
            score[a if derived(a) else b] *= 0.9
        gone.add(a if score[a] < score[b] else b)
    return [c for c in columns if c not in gone]


def _assembled(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    filled = median_filled(df, columns)
    keep = [F.col(label).cast("double").alias(label)] if label else []
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled.select(*columns, *keep))


def importance_scores(df: DataFrame, columns: list[str], label: str, trees: int = 50, seed: int = 42) -> DataFrame:
    """Random-forest importance per column."""
    model = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=6, seed=seed).fit(_assembled(df, columns, label))
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "column_name string, score double")


def importance_above_mean(scores: DataFrame, protected: list[str] = (), pattern: str | None = None) -> DataFrame:
    """Columns at or above the mean importance, plus protected and pattern-matched ones."""
    mean = scores.agg(F.avg("score").alias("_m"))
    keep = (F.col("score") >= F.col("_m")) | F.col("column_name").isin(list(protected))
    if pattern:
        keep = keep | F.col("column_name").rlike(pattern)
    return scores.crossJoin(mean).where(keep).select("column_name", "score")


def pca_reduce(df: DataFrame, columns: list[str], share: float = 0.8, key: str | None = None) -> DataFrame:
    """Leading principal components that explain at least ``share`` of the variance."""
    filled = median_filled(df, columns)
    vec = VectorAssembler(inputCols=columns, outputCol="_x").transform(filled)
    model = PCA(k=len(columns), inputCol="_x", outputCol="_pc").fit(vec)
    total, k = 0.0, 0
    for v in model.explainedVariance.toArray():
        total, k = total + float(v), k + 1
        if total >= share:
            break
    out = model.transform(vec).withColumn("_a", vector_to_array("_pc"))
    return out.select(*([key] if key else []), *[F.col("_a")[i].alias(f"pc_{i + 1}") for i in range(k)])


def logistic_recipe(df: DataFrame, columns: list[str], label: str, k: int = 50) -> list[str]:
    """Variance over 0.01, then correlation 0.8, then the k best ANOVA scores."""
    cols = variance_filter(df, columns, 0.01)
    cols = corr_filter(df, cols, 0.8)
    return [r.column_name for r in top_k(anova_scores(df, cols, label), min(k, len(cols))).collect()]


def tree_recipe(df: DataFrame, label: str, k: int = 100, trees: int = 50) -> list[str]:
    """Irrelevant names out, variance over 0.001, then the k most important columns."""
    kept = drop_irrelevant(df, label)
    cols = variance_filter(kept, [c for c in numeric_columns(kept) if c != label], 0.001)
    return [r.column_name for r in top_k(importance_scores(df, cols, label, trees), min(k, len(cols))).collect()]


NAMED_PAIRS = {"age": "anchor_age", "duration_hours": "duration_hours_log"}


def drop_named_redundant(df: DataFrame) -> DataFrame:
    return df.drop(*[b for a, b in NAMED_PAIRS.items() if a in df.columns and b in df.columns])


def label_share(df: DataFrame, label: str) -> DataFrame:
    """Rows, positives and positive share."""
    return df.agg(F.count("*").alias("n"), F.sum(flag(F.col(label) == 1)).alias("positives"),
                  F.avg(F.col(label).cast("double")).alias("positive_rate"))
