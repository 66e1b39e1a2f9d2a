"""Imputation and train-only preprocessing: fit on named rows, apply to all."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions.exprs import flag
from tidewatch.functions.trees import Forest, chain
from tidewatch.operators import forest
from tidewatch.operators.clean import fit_rows
from tidewatch.operators.profile import numeric_columns
from tidewatch.operators.ranking import exact_quantiles
from tidewatch.plans.lineage import cut_lineage, dropped


def missing_counts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row.n, {c: row.n - row[f"c{i}"] for i, c in enumerate(columns)}


def missing_flags(df: DataFrame, *, max_missing: float = 0.8,
                  flagged: tuple[str, ...] = ("age", "gender_numeric", "bmi", "lactate_mean", "resp_rate_mean"),
                  fit_on: Column | None = None) -> DataFrame:
    """Drop columns missing in more than ``max_missing`` of the rows; flag the named ones."""
    n, missing = missing_counts(fit_rows(df, fit_on), df.columns)
    kept = [c for c in df.columns if not n or missing[c] / n <= max_missing]
    new = [flag(F.col(c).isNull()).alias(f"{c}_missing") for c in flagged if c in kept and missing[c] > 0]
    return df.select(*kept, *new)


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent text per column, smallest on ties; only the winners reach the driver."""
    if not columns:
        return {}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "c", "v")
    counts = long.where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v")).collect()
    found = {r.c: r.v for r in best}
    return {c: found.get(c) for c in columns}


@dataclass
class FillParams:
    values: dict[str, float] = field(default_factory=dict)
    texts: dict[str, str] = field(default_factory=dict)


def fit_fill(df: DataFrame, columns: list[str] | None = None, fit_on: Column | None = None) -> FillParams:
    """Median per numeric column (0 if all missing), mode per text column ('missing' if none)."""
    base = fit_rows(df, fit_on)
    cols = columns or df.columns
    nums = [c for c in cols if c in numeric_columns(df)]
    texts = [c for c, t in df.dtypes if c in cols and t == "string"]
    med = exact_quantiles(base, nums, [0.5]) if nums else {}
    return FillParams({c: 0.0 if med[c][0] is None else med[c][0] for c in nums},
                      {c: v or "missing" for c, v in modes(base, texts).items()})


def apply_fill(df: DataFrame, params: FillParams) -> DataFrame:
    new = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in params.values.items() if c in df.columns}
    new.update({c: F.coalesce(F.col(c), F.lit(v)) for c, v in params.texts.items() if c in df.columns})
    return df.withColumns(new)


DEPTH = 8  # of the trees of chained imputation
MOST_CATEGORIES = 200  # categories of a column up to which each is a column of its own
HASHED = 64  # columns for a column with more categories


@dataclass
class Preprocessor:
    fill: FillParams
    categories: dict[str, list[str]]
    hashed: dict[str, int] = field(default_factory=dict)


def fit_preprocessor(df: DataFrame, numeric: list[str], categorical: list[str], fit_on: Column | None,
                     max_categories: int = MOST_CATEGORIES, width: int = HASHED) -> Preprocessor:
    """Train-only medians, modes and category lists (categories are columns of the result).

    A column with more than ``max_categories`` of them, as free text, is hashed into ``width`` columns instead, so
    neither the result's columns nor what the driver holds grow with the data."""
    base = fit_rows(df, fit_on)
    fill = fit_fill(df, numeric + categorical, fit_on)
    cats: dict[str, list[str]] = {}
    hashed: dict[str, int] = {}
    for c in categorical:
        filled = F.coalesce(F.col(c), F.lit(fill.texts[c]))
        found = [r[0] for r in base.select(filled.alias(c)).distinct().limit(max_categories + 1).collect()]
        if len(found) > max_categories:
            hashed[c] = width
        else:
            cats[c] = sorted(found)
    return Preprocessor(fill, cats, hashed)


def apply_preprocessor(df: DataFrame, p: Preprocessor, keep: list[str]) -> DataFrame:
    """Filled numeric columns and one-hot columns; a category unseen in training is all zeros, unless its column is hashed."""
    filled = apply_fill(df, p.fill)
    hot = [flag(F.col(c) == v).alias(f"{c}_{v}") for c, vs in p.categories.items() for v in vs]
    hot += [flag(F.pmod(F.xxhash64(c), F.lit(n)) == i).alias(f"{c}_hash_{i}") for c, n in p.hashed.items() for i in range(n)]
    return filled.select(*keep, *p.fill.values, *hot)


def impute_chained(df: DataFrame, columns: list[str], *, key: str, rounds: int = 10, max_missing: float = 0.2,
                   estimator: str = "forest", trees: int = 50, seed: int = 42, fit_on: Column | None = None) -> DataFrame:
    """Chained-equation imputation over the numeric columns missing in at most ``max_missing``.

    Every column is filled with its median first; then, round by round, each column with gaps
    is regressed on the others over its observed rows and only its gaps are replaced. Binary
    columns (two values) keep their mode. Forests are fitted on packed columns and fill the rows in
    one last pass; for ``linear`` the lineage is cut after every column. Which columns take part,
    their first fill and every regression come from the ``fit_on`` rows."""
    base = fit_rows(df, fit_on)
    n, missing = missing_counts(base, columns)
    todo = [c for c in columns if 0 < missing[c] <= max_missing * n]
    ends = base.agg(*[f(c).alias(f"{t}{i}") for i, c in enumerate(todo) for f, t in ((F.min, "a"), (F.max, "z"))]).first()
    inner = base.agg(*[F.max(flag((F.col(c) != F.lit(ends[f"a{i}"])) & (F.col(c) != F.lit(ends[f"z{i}"])))).alias(f"m{i}")
                     for i, c in enumerate(todo)]).first() if todo else None
    binary = [c for i, c in enumerate(todo) if not inner[f"m{i}"]]
    params = fit_fill(df, columns, fit_on)
    for c, v in modes(base, binary).items():
        params.values[c] = float(v)
    gaps = [F.col(c).isNull().alias(f"_gap_{c}") for c in todo]
    gaps.append((F.lit(True) if fit_on is None else F.coalesce(fit_on, F.lit(False))).alias("_fit"))
    data = cut_lineage(apply_fill(df.select("*", *gaps), params))
    targets = [c for c in todo if c not in binary]
    if estimator == "forest":
        data = _by_forests(data, columns, targets, {c: n - missing[c] for c in targets}, rounds, trees, seed) if targets and rounds else data
        return data.drop("_fit", *[f"_gap_{c}" for c in todo])
    for r in range(rounds):
        for c in targets:
            vec = VectorAssembler(inputCols=[x for x in columns if x != c], outputCol="_x").transform(data)
            reg = LinearRegression(regParam=1e-6, featuresCol="_x", labelCol=c, predictionCol="_p")
            model = reg.fit(vec.where(~F.col(f"_gap_{c}") & F.col("_fit")))
            data = model.transform(vec).withColumn(c, F.when(F.col(f"_gap_{c}"), F.col("_p")).otherwise(F.col(c)))
            data = cut_lineage(data.drop("_x", "_p"))
    return data.drop("_fit", *[f"_gap_{c}" for c in todo])


def _by_forests(data: DataFrame, columns: list[str], targets: list[str], observed: dict[str, int], rounds: int, trees: int, seed: int) -> DataFrame:
    """The rounds of forests over packed blocks of the columns, then one pass that fills the rows themselves."""
    gaps = [f"_gap_{c}" if c in targets else None for c in columns]
    width, at = len(columns), {c: columns.index(c) for c in targets}
    blocks = forest.pack(data, columns, gaps, "_fit")
    known, open_cells, rows = forest.sample(blocks, width, {at[c]: observed[c] for c in targets}, seed)
    every: list[Forest] = []
    for r in range(rounds):
        new: list[Forest] = []
        for i, c in enumerate(targets):
            new.append(forest.fit(blocks, width, at[c], known[:, rows[at[c]]], observed[c], new, trees=trees, depth=DEPTH, seed=seed + r * 1000 + i))
            chain(known, open_cells, new[-1:])
        every += new
        if r < rounds - 1:
            before, blocks = blocks, forest.repack(blocks, width, new)
            dropped(before)
    dropped(blocks)
    return cut_lineage(forest.filled(data, columns, gaps, every))


def group_medians(df: DataFrame, group: str, column: str, fit_on: Column | None = None) -> dict:
    """Exact median of a column per category of a low-cardinality column."""
    df = fit_rows(df, fit_on)
    cats = [r[0] for r in df.select(group).distinct().collect()]
    cats = [c for c in cats if c is not None]
    wide = df.select(*[F.when(F.col(group) == c, F.col(column).cast("double")).alias(f"g{i}") for i, c in enumerate(cats)])
    q = exact_quantiles(wide, wide.columns, [0.5])
    return {c: q[f"g{i}"][0] for i, c in enumerate(cats)}


def group_median_fill(df: DataFrame, group: str, column: str, fit_on: Column | None = None) -> DataFrame:
    """Fill gaps with the median of the row's category, then with the overall median."""
    by = group_medians(df, group, column, fit_on)
    overall = exact_quantiles(fit_rows(df, fit_on), [column], [0.5])[column][0]
    pick = F.when(F.lit(False), F.lit(0.0))
    for c, m in by.items():
        pick = pick.when(F.col(group) == c, F.lit(m))
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), pick, F.lit(overall)))


def restore_columns(processed: DataFrame, original: DataFrame, key: str, fit_on: Column | None = None) -> DataFrame:
    """Bring back protected columns that preprocessing dropped, filled by median or, for text, mode.

    Limits on the missing share: demographic 0.3, vitals 0.5, labs 0.6; sex, prior history and
    duration have none. Body mass index comes back as the median of the row's sex, or of all rows
    where the sex is not known as a column."""
    wanted = {c: K.RESTORE_LIMITS[kind] for kind, cs in K.RESTORE_COLUMNS.items() for c in cs
              if c in original.columns and c not in processed.columns}
    mass = "bmi" in original.columns and "bmi" not in processed.columns
    if not wanted and not mass:
        return processed
    n, missing = missing_counts(fit_rows(original, fit_on), list(wanted))
    back = [c for c, limit in wanted.items() if n and (limit is None or missing[c] / n < limit)]
    out = processed
    if back:
        filled = apply_fill(original.select(key, *back), fit_fill(original, back, fit_on))
        out = processed.join(filled, key, "left")
    if mass:
        if "gender_numeric" in out.columns and "gender_numeric" in original.columns:
            value = F.lit(None).cast("double")
            for sex, median in group_medians(original, "gender_numeric", "bmi", fit_on).items():
                value = F.when(F.col("gender_numeric") == sex, F.lit(median)).otherwise(value)
        else:
            value = F.lit(exact_quantiles(fit_rows(original, fit_on), ["bmi"], [0.5])["bmi"][0]).cast("double")
        out = out.withColumn("bmi", value)
    return out
