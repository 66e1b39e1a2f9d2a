"""Column-name guards, feature provenance and row alignment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.sources.tables import require_columns


def normalized_name(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def leakage_reason(name: Column, target: str = "mortality") -> Column:
    """Why a column may not be a feature: target, identifier or outcome; NULL if it may."""
    terms = "|".join(re.escape(t) for t in K.OUTCOME_TERMS)
    want = re.sub(r"[^a-z0-9]+", "_", target.strip().lower()).strip("_")
    return (F.when(name == want, F.lit("target")).when(name.isin(K.IDENTIFIER_COLUMNS), F.lit("identifier"))
            .when(name.rlike(f"^los$|^los_|_los$|{terms}"), F.lit("outcome")))


def leakage_report(names: DataFrame, column: str = "column_name", target: str = "mortality") -> DataFrame:
    """(column, normalized, reason) for every column name that must be dropped."""
    out = names.select(F.col(column), normalized_name(column).alias("normalized"))
    out = out.withColumn("reason", leakage_reason(F.col("normalized"), target))
    return out.where(F.col("reason").isNotNull())


def _names(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")


def feature_columns(df: DataFrame, target: str = "mortality") -> tuple[list[str], list[str]]:
    """(safe, dropped) columns of a table. Only the names are looked at."""
    dropped = {r.column_name for r in leakage_report(_names(df), target=target).collect()}
    return [c for c in df.columns if c not in dropped], [c for c in df.columns if c in dropped]


def feature_matrix(df: DataFrame, target: str = "mortality") -> DataFrame:
    """The safe columns; fails when the target is absent."""
    require_columns(df, [target])
    safe, _ = feature_columns(df, target)
    assert_no_leakage(df.select(*safe), target)
    return df.select(*safe)


def assert_no_leakage(df: DataFrame, target: str = "mortality") -> None:
    _, bad = feature_columns(df, target)
    if bad:
        raise ValueError(f"potential leakage columns in model features: {bad}")


def irrelevant(name: Column, substring: bool = False) -> Column:
    """True for id, time, date, minute, hour or day names, except useful durations.

    Whole name tokens are matched; ``substring=True`` matches anywhere in the name, which also
    hits words like chloride."""
    low = F.lower(name)
    some = "|".join(K.IRRELEVANT_TERMS)
    hit = low.rlike(some) if substring else low.rlike(f"(^|[^a-z0-9])({some})([^a-z0-9]|$)")
    return hit & ~low.rlike("|".join(K.KEPT_TIME_TERMS))


def drop_irrelevant(df: DataFrame, target: str | None = None, substring: bool = False) -> DataFrame:
    hit = {r.column_name for r in _names(df).where(irrelevant(F.col("column_name"), substring)).collect()} - {target}
    return df.select(*[c for c in df.columns if c not in hit])


def date_columns(df: DataFrame) -> DataFrame:
    """(column_name, reason): dates by type or name, or text values with '-' and ':'."""
    kinds = dict(df.dtypes)
    rows, texts = [], []
    for c in df.columns:
        if kinds[c] in ("timestamp", "timestamp_ntz", "date"):
            rows.append((c, F.lit("type")))
        elif re.search("date|time", c.lower()) and kinds[c] == "string":
            rows.append((c, F.lit("name")))
        elif kinds[c] == "string":
            texts.append(c)
    one = df.agg(F.count("*").alias("_n"),
                 *[F.max((F.col(c).contains("-") & F.col(c).contains(":")).cast("int")).alias(f"_{i}")
                   for i, c in enumerate(texts)])
    rows += [(c, F.when(F.col(f"_{i}") == 1, F.lit("values"))) for i, c in enumerate(texts)]
    if not rows:
        return one.sparkSession.createDataFrame([], "column_name string, reason string")
    packed = F.array(*[F.struct(F.lit(c).alias("column_name"), r.alias("reason")) for c, r in rows])
    return one.select(F.explode(packed).alias("s")).select("s.*").where(F.col("reason").isNotNull())


def drop_date_columns(df: DataFrame) -> DataFrame:
    gone = {r.column_name for r in date_columns(df).collect()}
    return df.select(*[c for c in df.columns if c not in gone])


def registry(spark, families=K.FEATURE_FAMILIES) -> DataFrame:
    """The feature families as a table; callers may pass a longer list."""
    rows = [(i, n, f"^(?:{p})$", g, a) for i, (n, p, g, a) in enumerate(families)]
    return spark.createDataFrame(rows, "pos int, feature_name string, pattern string, feature_group string, allowed boolean")


def provenance(names: DataFrame, column: str, families=K.FEATURE_FAMILIES) -> DataFrame:
    """(column, feature_name, status): first matching family; matched, unmatched or disallowed.

    The families are a fixed list of patterns, so the match is a projection: no join."""
    hit = F.when(F.lit(False), F.lit(None).cast("string"))
    ok = F.when(F.lit(False), F.lit(True))
    for name, pattern, _, allowed in families:
        here = F.col(column).rlike(f"^(?:{pattern})$")
        hit = hit.when(here, F.lit(name))
        ok = ok.when(here, F.lit(allowed))
    out = names.select(column, hit.alias("feature_name"), ok.alias("_ok"))
    return out.select(column, "feature_name", F.when(F.col("feature_name").isNull(), "unmatched")
                      .when(F.col("_ok"), "matched").otherwise("disallowed").alias("status"))


def provenance_details(names: DataFrame, column: str, hours: float = 6.0, families=K.FEATURE_FAMILIES) -> DataFrame:
    """Where a feature comes from, read off its name: (column, feature_name, feature_group, source, source_variable,
    window_start, window_end, statistic, is_binary, is_missingness_indicator, leakage_risk, allowed_for_model).

    Hours count from admission; features of the time before it have no window. A name of no family is excluded."""
    n = F.col(column)
    first = lambda pick: _first_family(n, families, pick)
    group, allowed = first(lambda f: F.lit(f[2])), F.coalesce(first(lambda f: F.lit(f[3])), F.lit(False))
    vitals, labs = "|".join(K.VITAL_CODES), "|".join(K.LAB_CODES)
    found = F.regexp_extract(n, f"^({vitals}|{labs}|urine_output|age|gender|bmi|prev_dx)(?:_|$)", 1)
    variable = F.when(found != "", found)
    source = (F.when(group.isin("demographic") & (variable != "bmi"), "patients").when(group == "diagnosis", "diagnoses")
              .when(variable.isin(list(K.VITAL_CODES)) | variable.isin("bmi", "urine_output"), "chart events")
              .when(variable.isin(list(K.LAB_CODES)), "lab events").when(group.isNotNull(), "derived"))
    at = F.regexp_extract(n, "_hour_([0-9]+)$", 1).try_cast("double")
    low, high = (F.regexp_extract(n, "_bin_([0-9]+)_([0-9]+)h_", i).try_cast("double") for i in (1, 2))
    inside = source.isin("chart events", "lab events", "derived")
    edge = F.lit(hours / 3.0)
    start = F.when(inside, F.coalesce(at, low, F.when(n.rlike("last_2h_mean$"), F.lit(hours) - edge).otherwise(F.lit(0.0))))
    end = F.when(inside, F.coalesce(at, high, F.when(n.rlike("first_2h_mean$"), edge).otherwise(F.lit(float(hours)))))
    told = F.regexp_extract(n, "_(mean|min|max|delta|last|first|total|count|slope|trend|std|cv|range|measured|observed|missing|squared|log)(?:_0_6h)?$", 1)
    statistic = F.when(told != "", told)
    binary = n.rlike("(_measured|_measured_0_6h|_missing|_observed|_flag|_dysfunction)$|^has_|^gender_")
    absent = F.coalesce(group == "missingness", F.lit(False)) | n.rlike("_observed$|_measured_0_6h$")
    known = first(lambda f: F.lit(f[0]))
    return names.select(column, known.alias("feature_name"), group.alias("feature_group"), source.alias("source"), variable.alias("source_variable"),
                        start.alias("window_start"), end.alias("window_end"), statistic.alias("statistic"), binary.alias("is_binary"),
                        absent.alias("is_missingness_indicator"), F.when(allowed, "low").otherwise("excluded").alias("leakage_risk"),
                        allowed.alias("allowed_for_model"))


def _first_family(name: Column, families, pick) -> Column:
    """What ``pick`` says of the first family whose pattern the whole name matches."""
    out = None
    for f in families:
        here = name.rlike(f"^(?:{f[1]})$")
        out = F.when(here, pick(f)) if out is None else out.when(here, pick(f))
    return out


def provenance_gate(df: DataFrame, ignore: list[str] = ()) -> None:
    """Fail when a feature column is unknown or not allowed."""
    names = _names(df.select(*[c for c in df.columns if c not in ignore]))
    bad = provenance(names, "column_name").where("status != 'matched'").collect()
    if bad:
        raise ValueError(f"feature provenance gate: {sorted((r.column_name, r.status) for r in bad)}")


def align_features(features: DataFrame, ids: DataFrame, key: str, *, order: str) -> DataFrame:
    """Feature rows for the given ids, one per id (smallest ``order`` column wins)."""
    rest = [c for c in features.columns if c not in (key, order)]
    one = features.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_s"))
    one = one.select(key, F.col(f"_s.{order}").alias(order), *[F.col(f"_s.{c}").alias(c) for c in rest])
    return ids.select(key).distinct().join(one, key).select(*features.columns)


def require_all_ids(features: DataFrame, ids: DataFrame, key: str) -> None:
    missing = ids.select(key).join(features.select(key), key, "left_anti").take(5)
    if missing:
        raise ValueError(f"ids without features, for example {[r[0] for r in missing]}")


def check_prediction_frame(df: DataFrame) -> None:
    """Contract of a prediction table: required columns, no identifiers."""
    require_columns(df, ["split", "model_name", "y_true", "p_pred"], "prediction frame")
    bad = sorted(set(df.columns) & set(K.IDENTIFIER_COLUMNS))
    if bad:
        raise ValueError(f"prediction frame must not carry identifiers: {bad}")


def prediction_contract(df: DataFrame) -> DataFrame:
    """(check_name, passed) rows of the prediction contract, with the row-level checks counted."""
    v = df.agg(F.count("*").alias("n"), F.sum((~F.col("y_true").isin(0, 1)).cast("int")).alias("bad_y"),
               F.sum((~F.col("p_pred").between(0.0, 1.0)).cast("int")).alias("bad_p"))
    rows = [(f"column:{c}", F.lit(c in df.columns)) for c in ("split", "model_name", "y_true", "p_pred")]
    rows += [(f"forbidden:{c}", F.lit(c not in df.columns)) for c in K.IDENTIFIER_COLUMNS]
    rows += [("has_rows", F.col("n") > 0), ("labels_binary", F.col("bad_y") == 0), ("scores_in_range", F.col("bad_p") == 0)]
    return v.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), p.alias("passed")) for n, p in rows]))
                    .alias("s")).select("s.*")


