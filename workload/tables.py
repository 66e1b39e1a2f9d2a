"""Assembly, history, profiles, cleaning, scaling, selection, splits and guards on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.exprs import flag
from tidewatch.operators import clean, cohort, guards, impute, profile, scale, select, split, windows
from workload.base import (HOURS, SCORED, WIDE_COLUMNS, event_cohort, long_events, query, rounded, scored, table, wide,
                           wide_sql, win_sql)

ALL = list(WIDE_COLUMNS)
VITALS = ["heart_rate_mean", "sbp_mean", "dbp_mean", "map_mean", "resp_rate_mean", "temp_mean", "spo2_mean"]
LABS = ["wbc_mean", "lactate_mean", "creatinine_mean", "bun_mean", "bilirubin_mean", "glucose_mean", "sodium_mean",
        "alkaline_phosphatase_mean", "urine_output_total"]
NUM = VITALS + LABS


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


# --- assembly and history ------------------------------------------------------------------------
@query("demographics", """SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
 CAST(CASE WHEN 18 + c_nationkey * 3 + year(o_orderdate) - 1995 > 89 THEN 90 ELSE 18 + c_nationkey * 3 + year(o_orderdate) - 1995 END AS INTEGER) AS age,
 CASE WHEN c_mktsegment < 'H' THEN 1 ELSE 0 END AS gender_numeric FROM orders JOIN customer ON o_custkey = c_custkey""")
def demographics(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"), (18 + F.col("c_nationkey") * 3).alias("anchor_age"),
        F.lit(1995).alias("anchor_year"), F.when(F.col("c_mktsegment") < "H", "M").otherwise("F").alias("gender"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
                                          F.col("o_orderdate").alias("admittime"))
    return cohort.demographics(o.select("subject_id", "hadm_id"), c, o)


@query("assemble_features", win_sql() + """, a AS (SELECT stay_id, round(avg(valuenum), 6) AS click_mean FROM win WHERE variable = 'click' GROUP BY 1),
 s AS (SELECT stay_id, round(sum(valuenum), 6) AS purchase_total FROM win WHERE variable = 'purchase' GROUP BY 1),
 l AS (SELECT DISTINCT user_id AS stay_id FROM events WHERE value > 200)
SELECT c.stay_id, intime, click_mean, purchase_total, CASE WHEN l.stay_id IS NULL THEN 0 ELSE 1 END AS label
FROM cohort c LEFT JOIN a USING (stay_id) LEFT JOIN s USING (stay_id) LEFT JOIN l USING (stay_id)""")
def assemble_features(spark, sf):
    e, c = long_events(spark, sf), event_cohort(spark, sf)
    win = windows.windowed_events(e, c, hours=HOURS)
    feats = win.groupBy("stay_id").agg(
        F.avg(F.when(F.col("variable") == "click", F.col("valuenum"))).alias("click_mean"),
        F.sum(F.when(F.col("variable") == "purchase", F.col("valuenum"))).alias("purchase_total"))
    return rounded(cohort.label_flag(c.join(feats, "stay_id", "left"), e.where("valuenum > 200"), "stay_id"))


@query("label_flag", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 1 ELSE 0 END AS label FROM customer")
def label_flag(spark, sf):
    pos = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return cohort.label_flag(table(spark, sf, "customer").select("c_custkey"), pos, "c_custkey")


@query("label_rate", """SELECT count(*) AS n, CAST(sum(l) AS BIGINT) AS positives, round(avg(l), 6) AS positive_rate FROM
 (SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 1 ELSE 0 END AS l FROM customer) x""")
def label_rate(spark, sf):
    return rounded(select.label_share(label_flag(spark, sf), "label"))


def _prior(spark, sf):
    """Codes of earlier orders: part brand digits as ICD-9 like codes, part types as ICD-10 like."""
    o = table(spark, sf, "orders")
    last = o.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.max("o_orderdate").alias("intime"))
    adm = o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
                   F.col("o_orderdate").alias("admittime"))
    p = table(spark, sf, "part")
    code = F.when(F.col("p_size") % 2 == 0, F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")).otherwise(
        F.concat(F.substring("p_type", 1, 1), (F.col("p_size") % 10).cast("string")))
    codes = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("hadm_id"), code.alias("icd_code"),
        F.when(F.col("p_size") % 2 == 0, 9).otherwise(10).alias("icd_version"))
    return last.select("subject_id"), cohort.prior_codes(last, adm, codes)


_PRIOR = """last AS (SELECT o_custkey AS subject_id, max(o_orderdate) AS intime FROM orders GROUP BY 1),
codes AS (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
 CASE WHEN p_size % 2 = 0 THEN lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') ELSE substr(p_type, 1, 1) || CAST(p_size % 10 AS VARCHAR) END AS icd_code,
 CASE WHEN p_size % 2 = 0 THEN 9 ELSE 10 END AS icd_version
 FROM orders JOIN last ON o_custkey = subject_id JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
 WHERE o_orderdate < intime)"""


@query("prior_history", f"WITH {_PRIOR} SELECT * FROM codes")
def prior_history(spark, sf):
    return _prior(spark, sf)[1].select("subject_id", "hadm_id", "icd_code", "icd_version")


def _chapter_sql() -> str:
    from tidewatch.functions import constants as K
    nine = " ".join(f"WHEN CAST(icd_code AS INTEGER) BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in K.ICD9_RANGES)
    ten = " ".join(f"WHEN regexp_matches(icd_code, '{p}') THEN '{n}'" for p, n in K.ICD10_PREFIXES)
    ch = (f"CASE WHEN icd_version = 9 THEN CASE {nine} ELSE 'other_icd9' END ELSE CASE {ten} ELSE 'other_icd10' END END")
    cols = ", ".join(f"count(*) FILTER (ch = '{c}') AS prev_dx_{c}_count" for c in K.CHAPTERS)
    return (f"WITH {_PRIOR}, g AS (SELECT subject_id, icd_version, icd_code, {ch.replace('CAST(icd_code AS INTEGER)', 'TRY_CAST(icd_code AS INTEGER)')} AS ch FROM codes) "
            f"SELECT l.subject_id, CASE WHEN count(ch) > 0 THEN 1 ELSE 0 END AS has_prior_diagnoses, {cols}, "
            "count(ch) AS prev_dx_count_total FROM last l LEFT JOIN g USING (subject_id) GROUP BY 1")


@query("chapter_counts", _chapter_sql())
def chapter_counts(spark, sf):
    subjects, codes = _prior(spark, sf)
    return cohort.chapter_counts(subjects, codes, cohort.diagnosis_chapter(F.col("icd_code"), F.col("icd_version")))


@query("any_code_flag", f"""WITH {_PRIOR} SELECT l.subject_id, coalesce(max(CASE WHEN icd_version = 9 AND (icd_code IN ('1990', '1991')
 OR substr(icd_code, 1, 3) IN ('196', '197', '198')) THEN 1 WHEN icd_version = 10 AND substr(icd_code, 1, 3) IN ('C77', 'C78', 'C79', 'C7B', 'C80') THEN 1
 ELSE 0 END), 0) AS has_metastatic_cancer FROM last l LEFT JOIN codes USING (subject_id) GROUP BY 1""")
def any_code_flag(spark, sf):
    subjects, codes = _prior(spark, sf)
    return cohort.any_code_flag(subjects, codes, cohort.metastatic(F.col("icd_code"), F.col("icd_version")),
                                "has_metastatic_cancer")


# --- profiles ---------------------------------------------------------------------------------
@query("completeness", f"WITH {wide_sql(NUM)} " + _union(
    [f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) AS n, round(count({c}) * 100.0 / count(*), 6) AS pct_complete FROM wide" for c in NUM]))
def completeness(spark, sf):
    return rounded(profile.completeness(wide(spark, sf, NUM), NUM))


def _band(c: str) -> str:
    m = f"(count(*) - count({c})) * 100.0 / count(*)"
    return (f"SELECT '{c}' AS column_name, round({m}, 6) AS missing_pct, CASE WHEN {m} > 80 THEN 'extreme' WHEN {m} > 50 THEN 'high' "
            f"WHEN {m} > 20 THEN 'moderate' ELSE 'low' END AS band FROM w2")


_GAPS = ("w2 AS (SELECT *, CASE WHEN stay_id % 6 = 0 THEN spo2_max END AS rare_a, CASE WHEN stay_id % 3 = 0 THEN spo2_max END AS rare_b FROM wide)")
_MISS = ["age", "heart_rate_mean", "lactate_mean", "wbc_mean", "rare_a", "rare_b"]


def _gappy(spark, sf):
    w = wide(spark, sf, ["age", "heart_rate_mean", "lactate_mean", "wbc_mean", "spo2_max"])
    return w.select("*", F.when(F.col("stay_id") % 6 == 0, F.col("spo2_max")).alias("rare_a"),
                    F.when(F.col("stay_id") % 3 == 0, F.col("spo2_max")).alias("rare_b"))


_GAPPY = f"WITH {wide_sql(['age', 'heart_rate_mean', 'lactate_mean', 'wbc_mean', 'spo2_max'])}, {_GAPS}"


@query("missing_profile", _GAPPY + " " + _union([_band(c) for c in _MISS]))
def missing_profile(spark, sf):
    return rounded(profile.missing_profile(_gappy(spark, sf), _MISS))


@query("missing_flags", _GAPPY + """ SELECT stay_id, age, round(lactate_mean, 6) AS lactate_mean, round(rare_b, 6) AS rare_b,
 CASE WHEN age IS NULL THEN 1 ELSE 0 END AS age_missing, CASE WHEN lactate_mean IS NULL THEN 1 ELSE 0 END AS lactate_mean_missing FROM w2""")
def missing_flags(spark, sf):
    out = impute.missing_flags(_gappy(spark, sf))
    return rounded(out.drop("subject_id", "intime", "heart_rate_mean", "wbc_mean", "spo2_max"))


@query("describe_table", f"WITH {wide_sql(NUM)} " + _union([
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, "
    f"round(max({c}), 6) AS max, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct FROM wide" for c in NUM]))
def describe_table(spark, sf):
    return rounded(profile.describe_table(wide(spark, sf, NUM), NUM))


def _t1(c: str, binary: bool) -> str:
    g = lambda f, k: f"{f} FILTER (mortality = {k})"
    n0, n1 = g(f"count({c})", 0), g(f"count({c})", 1)
    if binary:
        a, b = g(f"sum({c})", 0), g(f"sum({c})", 1)
        s = (f"(SELECT n * greatest(abs(a * d - b * c) - n / 2, 0) * greatest(abs(a * d - b * c) - n / 2, 0) / ((a + b) * (c + d) * (a + c) * (b + d)) "
             f"FROM (SELECT {a} + 0.0e0 AS a, {b} + 0.0e0 AS b, {n0} - {a} + 0.0e0 AS c, {n1} - {b} + 0.0e0 AS d, {n0} + {n1} + 0.0e0 AS n FROM w3) z)")
        return (f"SELECT '{c}' AS column_name, 'binary' AS kind, count(*) AS n, round(sum({c}), 6)::DOUBLE AS value_all, round(sum({c}) * 100.0 / count(*), 6)::DOUBLE AS spread_all, "
                f"{a}::DOUBLE AS value_0, round({a} * 100.0 / {g('count(*)', 0)}, 6)::DOUBLE AS spread_0, {b}::DOUBLE AS value_1, round({b} * 100.0 / {g('count(*)', 1)}, 6)::DOUBLE AS spread_1, "
                f"round({s}, 6) AS statistic, 1.0::DOUBLE AS dof FROM w3")
    m0, m1, v0, v1 = g(f"avg({c})", 0), g(f"avg({c})", 1), g(f"var_samp({c})", 0), g(f"var_samp({c})", 1)
    return (f"SELECT '{c}', 'continuous', count(*), round(avg({c}), 6), round(stddev_samp({c}), 6), round({m0}, 6), round(sqrt({v0}), 6), "
            f"round({m1}, 6), round(sqrt({v1}), 6), round(({m0} - {m1}) / sqrt({v0} / {n0} + {v1} / {n1}), 6), "
            f"round(power({v0} / {n0} + {v1} / {n1}, 2) / (power({v0} / {n0}, 2) / ({n0} - 1) + power({v1} / {n1}, 2) / ({n1} - 1)), 4) FROM w3")


_T1 = ["age", "heart_rate_mean", "lactate_mean", "glucose_mean"]


@query("table_one", f"WITH {wide_sql(_T1 + ['mortality'])}, w3 AS (SELECT *, CASE WHEN age > 60 THEN 1 WHEN age <= 60 THEN 0 END AS is_old FROM wide) "
       + _union([_t1("is_old", True)] + [_t1(c, False) for c in _T1]))
def table_one(spark, sf):
    w = wide(spark, sf, _T1 + ["mortality"]).withColumn("is_old", F.when(F.col("age") > 60, 1).when(F.col("age") <= 60, 0))
    out = rounded(profile.table_one(w, ["is_old", *_T1], "mortality"))
    return out.withColumn("dof", F.round("dof", 4))


@query("before_after", f"""WITH {wide_sql(['age', 'heart_rate_mean', 'lactate_mean'])}, a AS (SELECT count(*) AS r, CAST(count(*) * 3 - count(age) - count(heart_rate_mean) - count(lactate_mean) AS BIGINT) AS m FROM wide)
SELECT 'rows_before' AS metric, r AS value, CAST(NULL AS VARCHAR) AS columns FROM a UNION ALL SELECT 'rows_after', r, NULL FROM a
UNION ALL SELECT 'columns_before', 6, NULL UNION ALL SELECT 'columns_after', 6, NULL UNION ALL SELECT 'missing_before', m, NULL FROM a
UNION ALL SELECT 'missing_after', 0, NULL UNION ALL SELECT 'columns_dropped', 1, 'intime' UNION ALL SELECT 'columns_new', 1, 'age_missing'""")
def before_after(spark, sf):
    w = wide(spark, sf, ["age", "heart_rate_mean", "lactate_mean"])
    after = impute.apply_fill(w, impute.fit_fill(w, ["age", "heart_rate_mean", "lactate_mean"]))
    after = after.drop("intime").withColumn("age_missing", F.lit(0))
    return profile.before_after(w, after)


@query("class_weights", f"""WITH {SCORED}, k AS (SELECT y AS label, count(*) AS n FROM scored GROUP BY 1)
SELECT label, n, round(max(n) OVER () * 1.0 / min(n) OVER (), 6) AS imbalance_ratio, max(n) OVER () * 1.0 / min(n) OVER () >= 1.5 AS resample,
 round(max(CASE WHEN label = 0 THEN n END) OVER () * 1.0 / max(CASE WHEN label = 1 THEN n END) OVER (), 6) AS scale_pos_weight,
 round(sqrt(max(CASE WHEN label = 0 THEN n END) OVER () * 1.0 / max(CASE WHEN label = 1 THEN n END) OVER ()), 6) AS sqrt_pos_weight FROM k""")
def class_weights(spark, sf):
    return rounded(profile.class_weights(scored(spark, sf), "y"))


@query("group_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_counts(spark, sf):
    return profile.group_counts(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


_SEEDS = ["mean_quantity", "mean_discount"]


@query("seed_stability", "WITH r AS (SELECT l_suppkey, avg(l_quantity) AS mean_quantity, avg(l_discount) AS mean_discount FROM lineitem GROUP BY 1) "
       + _union([f"SELECT '{m}' AS metric, count({m}) AS n, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std, round(min({m}), 6) AS min, round(max({m}), 6) AS max FROM r" for m in _SEEDS]))
def seed_stability(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean_quantity"),
                                                              F.avg("l_discount").alias("mean_discount"))
    return rounded(profile.seed_stability(r, _SEEDS))


_LINE = 'l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate'.split()


@query("duplicate_rows", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL_COLUMNS) x".replace("ALL_COLUMNS", ", ".join(_LINE)))
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "lineitem"))


@query("target_correlation", f"WITH {wide_sql(NUM + ['mortality'])}, c AS (" + _union(
    [f"SELECT '{c}' AS column_name, abs(corr({c}, mortality)) AS r FROM wide" for c in NUM]) + ") SELECT column_name, round(r, 6) AS abs_corr FROM c ORDER BY r DESC LIMIT 10")
def target_correlation(spark, sf):
    out = profile.target_correlation(wide(spark, sf, NUM + ["mortality"]), NUM, "mortality")
    return rounded(out.orderBy(F.desc("abs_corr")).limit(10))


_POWER = ["heart_rate_mean", "heart_rate_min", "heart_rate_max", "sbp_mean", "sbp_min", "sbp_max"]


@query("variable_power", f"WITH {wide_sql(_POWER + ['mortality'])}, c AS (" + _union(
    [f"SELECT '{c}' AS column_name, abs(corr({c}, mortality)) AS r FROM wide" for c in _POWER])
    + ") SELECT regexp_replace(column_name, '_(mean|min|max)$', '') AS variable, round(avg(r), 6) AS mean_abs_corr, arg_max(column_name, (r, column_name)) AS best_column FROM c GROUP BY 1")
def variable_power(spark, sf):
    c = profile.target_correlation(wide(spark, sf, _POWER + ["mortality"]), _POWER, "mortality")
    return rounded(profile.variable_power(c, F.regexp_replace("column_name", "_(mean|min|max)$", "")))


# --- cleaning -----------------------------------------------------------------------------------
_CLIP = {c: r for c, r in clean.K.OUTLIER_RANGES.items() if c in WIDE_COLUMNS}


def _clip_sql(c: str, a, b) -> str:
    return f"CASE WHEN {c} < {a} THEN {float(a)} WHEN {c} > {b} THEN {float(b)} ELSE {c} END"


@query("range_clip", f"WITH {wide_sql(list(_CLIP))} SELECT stay_id, " + ", ".join(
    f"round({_clip_sql(c, *r)}, 6) AS {c}" for c, r in _CLIP.items()) + " FROM wide")
def range_clip(spark, sf):
    return rounded(clean.range_clip(wide(spark, sf, list(_CLIP))).drop("subject_id", "intime"))


@query("range_clip_counts", f"WITH {wide_sql(list(_CLIP))} " + _union(
    [f"SELECT '{c}' AS column_name, count(*) FILTER ({c} < {a} OR {c} > {b}) AS clipped FROM wide" for c, (a, b) in _CLIP.items()]))
def range_clip_counts(spark, sf):
    return clean.range_clip_counts(wide(spark, sf, list(_CLIP)))


# units the test data is recorded in: Fahrenheit, mmol/L, umol/L, g/L
_UNITS = {"bmi": "heart_rate_mean / 3", "temp_mean": "temp_mean * 9 / 5 + 32", "glucose_mean": "glucose_mean / 18", "creatinine_mean": "creatinine_mean * 88.4",
          "hemoglobin_mean": "hemoglobin_mean * 10", "wbc_mean": "wbc_mean * 9", "urine_output_total": "urine_output_total * 3"}
_UCOLS = ["heart_rate_mean", "temp_mean", "glucose_mean", "creatinine_mean", "hemoglobin_mean", "wbc_mean", "urine_output_total"]


@query("unit_normalize", f"WITH {wide_sql(_UCOLS)}, u AS (SELECT stay_id, " + ", ".join(f"{e} AS {c}" for c, e in _UNITS.items()) + f""" FROM wide),
c AS (SELECT stay_id, {_clip_sql('bmi', 10, 80)} AS bmi, temp_mean, {_clip_sql('glucose_mean', 20, 600)} AS glucose_mean,
 {_clip_sql('creatinine_mean', 0.1, 15)} AS creatinine_mean, {_clip_sql('hemoglobin_mean', 1, 25)} AS hemoglobin_mean, {_clip_sql('wbc_mean', 0, 100)} AS wbc_mean,
 {_clip_sql('urine_output_total', 0, 10000)} AS urine_output_total FROM u),
m AS (SELECT median(temp_mean) AS t, median(glucose_mean) AS g, median(creatinine_mean) AS k, median(hemoglobin_mean) AS h FROM c),
f AS (SELECT c.*, CASE WHEN t > 90 AND temp_mean > 90 THEN (temp_mean - 32) * 5 / 9 ELSE temp_mean END AS tc, t, g, k, h FROM c, m)
SELECT stay_id, round(bmi, 6) AS bmi, round({_clip_sql('tc', 35, 42)}, 6) AS temp_mean,
 round(CASE WHEN g > 0 AND g < 20 THEN glucose_mean * 18 ELSE glucose_mean END, 6) AS glucose_mean,
 round(CASE WHEN k > 50 THEN creatinine_mean / 88.4 ELSE creatinine_mean END, 6) AS creatinine_mean,
 round(CASE WHEN h > 30 THEN hemoglobin_mean / 10 ELSE hemoglobin_mean END, 6) AS hemoglobin_mean,
 round(wbc_mean, 6) AS wbc_mean, round(urine_output_total, 6) AS urine_output_total FROM f""")
def unit_normalize(spark, sf):
    u = wide(spark, sf, _UCOLS).select("stay_id", *[F.expr(e).alias(c) for c, e in _UNITS.items()])
    return rounded(clean.unit_normalize(u))


@query("map_with_mode_fill", f"""WITH {wide_sql(['gender'])}, m AS (SELECT CASE gender WHEN 'M' THEN 1 WHEN 'F' THEN 0 END AS g, count(*) AS n FROM wide
 WHERE gender IS NOT NULL GROUP BY 1 ORDER BY n DESC, g LIMIT 1)
SELECT stay_id, CAST(coalesce(CASE gender WHEN 'M' THEN 1 WHEN 'F' THEN 0 END, (SELECT g FROM m)) AS INTEGER) AS gender_numeric FROM wide""")
def map_with_mode_fill(spark, sf):
    w = wide(spark, sf, ["gender"])
    return clean.map_with_mode_fill(w, "gender", {"M": 1, "F": 0}, "gender_numeric").select("stay_id", "gender_numeric")


@query("winsorize", """WITH e AS (SELECT event_id, value, value * value AS value_sq FROM events),
q AS (SELECT quantile_cont(value_sq, 0.01) AS a, quantile_cont(value_sq, 0.99) AS b, skewness(value_sq) AS s, skewness(value) AS sv,
 quantile_cont(value, 0.01) AS av, quantile_cont(value, 0.99) AS bv FROM e)
SELECT event_id, round(CASE WHEN abs(sv) > 2 AND value < av THEN av WHEN abs(sv) > 2 AND value > bv THEN bv ELSE value END, 6) AS value,
 round(CASE WHEN abs(s) > 2 AND value_sq < a THEN a WHEN abs(s) > 2 AND value_sq > b THEN b ELSE value_sq END, 6) AS value_sq FROM e, q""")
def winsorize(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", (F.col("value") * F.col("value")).alias("value_sq"))
    return rounded(clean.winsorize(e))


_IMP = ["age", "heart_rate_mean", "lactate_mean", "gender"]


@query("impute_median_mode", f"""WITH {wide_sql(_IMP)}, m AS (SELECT median(age) AS a, median(heart_rate_mean) AS h, median(lactate_mean) AS l FROM wide),
g AS (SELECT gender FROM wide WHERE gender IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, gender LIMIT 1)
SELECT stay_id, round(coalesce(age, a), 6)::DOUBLE AS age, round(coalesce(heart_rate_mean, h), 6) AS heart_rate_mean, round(coalesce(lactate_mean, l), 6) AS lactate_mean,
 coalesce(gender, (SELECT gender FROM g)) AS gender FROM wide, m""")
def impute_median_mode(spark, sf):
    w = wide(spark, sf, _IMP)
    return rounded(impute.apply_fill(w, impute.fit_fill(w, _IMP)).drop("subject_id", "intime"))


@query("train_only_preprocess", f"""WITH {wide_sql(['heart_rate_mean', 'lactate_mean', 'gender'])}, t AS (SELECT * FROM wide WHERE subject_id % 5 > 1),
m AS (SELECT median(heart_rate_mean) AS h, median(lactate_mean) AS l FROM t),
g AS (SELECT gender FROM t WHERE gender IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, gender LIMIT 1)
SELECT stay_id, round(coalesce(heart_rate_mean, h), 6) AS heart_rate_mean, round(coalesce(lactate_mean, l), 6) AS lactate_mean,
 CASE WHEN coalesce(gender, (SELECT gender FROM g)) = 'F' THEN 1 ELSE 0 END AS gender_F,
 CASE WHEN coalesce(gender, (SELECT gender FROM g)) = 'M' THEN 1 ELSE 0 END AS gender_M FROM wide, m""")
def train_only_preprocess(spark, sf):
    w = wide(spark, sf, ["heart_rate_mean", "lactate_mean", "gender"])
    p = impute.fit_preprocessor(w, ["heart_rate_mean", "lactate_mean"], ["gender"], F.col("subject_id") % 5 > 1)
    return rounded(impute.apply_preprocessor(w, p, ["stay_id"]))


@query("group_median_fill", f"""WITH {wide_sql(['gender', 'heart_rate_mean'])}, g AS (SELECT gender, median(heart_rate_mean) AS m FROM wide GROUP BY 1)
SELECT stay_id, gender, round(coalesce(heart_rate_mean, CASE WHEN w.gender IS NOT NULL THEN m END, (SELECT median(heart_rate_mean) FROM wide)), 6) AS heart_rate_mean
FROM wide w LEFT JOIN g USING (gender)""")
def group_median_fill(spark, sf):
    return rounded(impute.group_median_fill(wide(spark, sf, ["gender", "heart_rate_mean"]), "gender", "heart_rate_mean")
                   .drop("subject_id", "intime"))


_RC = ["age", "sbp_mean", "lactate_max", "wbc_mean", "heart_rate_mean"]


@query("restore_columns", f"""WITH {wide_sql(_RC)}, m AS (SELECT median(age) AS a, median(sbp_mean) AS s, median(lactate_max) AS l, median(wbc_mean) AS w FROM wide)
SELECT stay_id, round(heart_rate_mean, 6) AS heart_rate_mean, coalesce(age, a)::DOUBLE AS age, round(coalesce(sbp_mean, s), 6) AS sbp_mean,
 round(coalesce(lactate_max, l), 6) AS lactate_max, round(coalesce(wbc_mean, w), 6) AS wbc_mean FROM wide, m""")
def restore_columns(spark, sf):
    w = wide(spark, sf, _RC)
    return rounded(impute.restore_columns(w.select("stay_id", "heart_rate_mean"), w, "stay_id"))


@query("robust_scale", f"WITH {wide_sql(VITALS)}, q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) AS {c}_b" for c in VITALS)
    + " FROM wide) SELECT stay_id, " + ", ".join(f"round(({c} - {c}_m) / ({c}_b - {c}_a), 6) + 0.0 AS {c}" for c in VITALS) + " FROM wide, q")
def robust_scale(spark, sf):
    return rounded(scale.robust_scale(wide(spark, sf, VITALS), VITALS).drop("subject_id", "intime"))


@query("scale_check", f"WITH {wide_sql(NUM)} " + _union([
    f"SELECT '{c}' AS column_name, round(max({c}) - min({c}), 6) AS value_range, round(stddev_samp({c}), 6) AS std, "
    f"(max({c}) - min({c}) > 100 OR stddev_samp({c}) > 10) AS issue FROM wide" for c in NUM]))
def scale_check(spark, sf):
    return rounded(scale.scale_check(wide(spark, sf, NUM), NUM))


# --- selection -----------------------------------------------------------------------------------
def _filled(cols: list[str]) -> str:
    return (f"med AS (SELECT {', '.join(f'median({c}) AS {c}_m' for c in cols)} FROM wide), filled AS (SELECT stay_id, mortality, "
            + ", ".join(f"coalesce({c}, {c}_m) AS {c}" for c in cols) + " FROM wide, med)")


_FILL = f"WITH {wide_sql(NUM + ['mortality'])}, {_filled(NUM)}"


@query("variance_filter", _FILL + ", v AS (" + _union([f"SELECT '{c}' AS column_name, var_pop({c}) AS variance FROM filled" for c in NUM])
       + ") SELECT column_name, round(variance, 4) AS variance FROM v WHERE variance > 20.0")
def variance_filter(spark, sf):
    return rounded(select.variances(wide(spark, sf, NUM), NUM).where("variance > 20.0"), 4)


def _anova(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, (SELECT (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) FROM "
            f"(SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS ss, (SELECT avg({c}) FROM filled) AS g FROM filled GROUP BY mortality) z) AS score")


@query("anova_topk", _FILL + ", s AS (" + _union([_anova(c) for c in NUM]) + ") SELECT column_name, round(score, 5) AS score FROM s ORDER BY s.score DESC, column_name LIMIT 8")
def anova_topk(spark, sf):
    return rounded(select.top_k(select.anova_scores(wide(spark, sf, NUM + ["mortality"]), NUM, "mortality"), 8), 5)


def _mi(c: str) -> str:
    edges = ", ".join(f"quantile_cont({c}, {i / 10}) AS e{i}" for i in range(1, 10))
    b = " + ".join(f"(CASE WHEN {c} > e{i} AND e{i} > {'-1e308' if i == 1 else f'e{i - 1}'} THEN 1 ELSE 0 END)" for i in range(1, 10))
    return (f"SELECT '{c}' AS column_name, greatest(sum(n * 1.0 / t * ln(n * 1.0 * t / (nb * ny))), 0) AS score FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS nb, "
            f"sum(n) OVER (PARTITION BY mortality) AS ny FROM (SELECT CASE WHEN {c} IS NULL THEN -1 ELSE {b} END AS b, mortality, count(*) AS n FROM wide, (SELECT {edges} FROM wide) e GROUP BY 1, 2) x) y")


_MI = ["age", "heart_rate_mean", "lactate_mean", "creatinine_mean", "glucose_mean"]


@query("binned_mi", f"WITH {wide_sql(_MI + ['mortality'])}, s AS (" + _union([_mi(c) for c in _MI]) + ") SELECT column_name, round(score, 6) AS score FROM s")
def binned_mi(spark, sf):
    return rounded(select.binned_mi(wide(spark, sf, _MI + ["mortality"]), _MI, "mortality"))


_CP = ["heart_rate_mean", "sbp_mean", "map_mean", "resp_rate_mean", "temp_mean", "spo2_mean", "lactate_mean", "glucose_mean", "bun_mean"]
_PAIRS = [(a, b) for i, a in enumerate(_CP) for b in _CP[i + 1:]]


@query("corr_pairs", f"WITH {wide_sql(_CP)} " + _union([f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM wide" for a, b in _PAIRS]))
def corr_pairs(spark, sf):
    return rounded(select.corr_pairs(wide(spark, sf, _CP), _CP))


@query("corr_filter", f"WITH {wide_sql(_CP)}, p AS (" + _union([f"SELECT '{b}' AS b, abs(corr({a}, {b})) AS r FROM wide" for a, b in _PAIRS])
       + "), c AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in _CP) + "]) AS column_name) SELECT column_name FROM c WHERE column_name NOT IN (SELECT b FROM p WHERE r > 0.8)")
def corr_filter(spark, sf):
    kept = select.corr_filter(wide(spark, sf, _CP), _CP, 0.8)
    return spark.createDataFrame([(c,) for c in kept], "column_name string")


@query("redundancy_greedy")
def redundancy_greedy(spark, sf):
    kept = select.redundancy_greedy(wide(spark, sf, _CP), _CP)
    return spark.createDataFrame([(c,) for c in kept], "column_name string")


@query("topk_features", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topk_features(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@query("head_rows", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def head_rows(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").limit(20)


# --- splits, folds, sampling -----------------------------------------------------------------------
_ENT = "ent AS (SELECT o_custkey AS entity, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS y FROM orders GROUP BY 1)"
_RANK = ("rk AS (SELECT entity, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(entity AS VARCHAR) || '|42'), entity) AS r, "
         "count(*) OVER (PARTITION BY y) AS n FROM ent)")


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"),
                                             flag(F.col("o_orderstatus") == "F").alias("y"))


_SPLIT = ("CASE WHEN (r - 1) / CAST(n AS DOUBLE) < 0.2 THEN 'test' WHEN (r - 1) / CAST(n AS DOUBLE) < 0.4 THEN 'validation' ELSE 'train' END")


@query("stratified_group_split", f"WITH {_ENT}, {_RANK} SELECT o_orderkey, o_custkey AS entity, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, {_SPLIT} AS split FROM orders JOIN rk ON o_custkey = entity")
def stratified_group_split(spark, sf):
    return split.split_rows(_orders(spark, sf), "entity", "y")


@query("split_overlap", """SELECT o_custkey AS entity, min(o_orderstatus) AS first_split, max(o_orderstatus) AS last_split FROM orders
 GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1""")
def split_overlap(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("split"))
    return split.split_overlap(a, "entity")


@query("kfold_assign", f"WITH {_ENT}, {_RANK}, k AS (SELECT least(5, min(n)) AS k FROM rk) SELECT entity, CAST((r - 1) % k AS INTEGER) AS fold FROM rk, k")
def kfold_assign(spark, sf):
    return split.fold_entities(_orders(spark, sf), "entity", "y", k=5)


_SAMPLE = (f"WITH {SCORED}, s AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(row_id || '|42'), row_id) AS r, "
           "count(*) OVER (PARTITION BY y) AS n FROM scored), t AS (SELECT min(n) AS lo, max(n) AS hi FROM s)")


@query("resample_under", _SAMPLE + " SELECT row_id, y, 0 AS copy FROM s, t WHERE r <= lo")
def resample_under(spark, sf):
    return split.resample(scored(spark, sf).select("row_id", "y"), "y", "row_id", how="under")


@query("resample_over", _SAMPLE + """ SELECT row_id, y, CAST(copy AS INTEGER) AS copy FROM (SELECT row_id, y, unnest(range(0, CAST(hi // n + CASE WHEN r <= hi - (hi // n) * n THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM s, t) x""")
def resample_over(spark, sf):
    return split.resample(scored(spark, sf).select("row_id", "y"), "y", "row_id", how="over")


# --- guards -----------------------------------------------------------------------------------------
# candidate column names built from the part table
_NAMES = ("names AS (SELECT DISTINCT CASE p_size % 10 WHEN 0 THEN 'Subject ID' WHEN 1 THEN p_type || ' death-time' WHEN 2 THEN 'los_' || p_type "
          "WHEN 3 THEN p_name || ' LOS' WHEN 4 THEN 'mortality' WHEN 5 THEN 'chloride_' || p_type WHEN 6 THEN p_type || '_hour_' || CAST(p_size AS VARCHAR) "
          "WHEN 7 THEN p_name || '_duration_day' WHEN 8 THEN 'close_' || p_name ELSE p_name || '_date' END AS column_name FROM part)")


def _names(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.expr("""CASE p_size % 10 WHEN 0 THEN 'Subject ID' WHEN 1 THEN p_type || ' death-time' WHEN 2 THEN 'los_' || p_type
        WHEN 3 THEN p_name || ' LOS' WHEN 4 THEN 'mortality' WHEN 5 THEN 'chloride_' || p_type WHEN 6 THEN p_type || '_hour_' || CAST(p_size AS STRING)
        WHEN 7 THEN p_name || '_duration_day' WHEN 8 THEN 'close_' || p_name ELSE p_name || '_date' END""").alias("column_name")).distinct()


_TERMS = "|".join(guards.K.OUTCOME_TERMS)


@query("leakage_columns", f"""WITH {_NAMES}, n AS (SELECT column_name, regexp_replace(regexp_replace(lower(trim(column_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS normalized FROM names),
r AS (SELECT *, CASE WHEN normalized = 'mortality' THEN 'target' WHEN normalized IN ('subject_id', 'hadm_id', 'stay_id', 'patient_id', 'icustay_id') THEN 'identifier'
 WHEN normalized = 'los' OR starts_with(normalized, 'los_') OR ends_with(normalized, '_los') OR regexp_matches(normalized, '{_TERMS}') THEN 'outcome' END AS reason FROM n)
SELECT * FROM r WHERE reason IS NOT NULL""")
def leakage_columns(spark, sf):
    return guards.leakage_report(_names(spark, sf))


@query("irrelevant_columns", f"""WITH {_NAMES} SELECT column_name,
 regexp_matches(lower(column_name), '(^|[^a-z0-9])(id|time|date|minute|hour|day)([^a-z0-9]|$)') AND NOT regexp_matches(lower(column_name), 'los|time_in_hospital|time_delta|duration') AS by_token,
 regexp_matches(lower(column_name), 'id|time|date|minute|hour|day') AND NOT regexp_matches(lower(column_name), 'los|time_in_hospital|time_delta|duration') AS by_substring FROM names""")
def irrelevant_columns(spark, sf):
    c = F.col("column_name")
    return _names(spark, sf).select(c, guards.irrelevant(c).alias("by_token"), guards.irrelevant(c, True).alias("by_substring"))


@query("date_columns", """SELECT * FROM (SELECT 'o_orderdate' AS column_name, 'type' AS reason UNION ALL SELECT 'date_text', 'name'
 UNION ALL SELECT 'stamp', CASE WHEN (SELECT max(CASE WHEN contains(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ':') THEN 1 ELSE 0 END) FROM orders) = 1 THEN 'values' END) x WHERE reason IS NOT NULL""")
def date_columns(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    return guards.date_columns(o)


def _family_names() -> str:
    v = "CASE p_size % 5 WHEN 0 THEN 'heart_rate' WHEN 1 THEN 'lactate' WHEN 2 THEN 'sbp' WHEN 3 THEN 'albumin' ELSE 'inr' END"
    s = ("CASE p_partkey % 8 WHEN 0 THEN '_mean' WHEN 1 THEN '_hour_3' WHEN 2 THEN '_bin_0_1h_last' WHEN 3 THEN '_slope_0_6h' WHEN 4 THEN '_cv_0_6h' "
         "WHEN 5 THEN '_measured_0_6h' WHEN 6 THEN '_dysfunction' ELSE '_trend' END")
    return f"CASE WHEN p_partkey % 40 = 7 THEN 'has_metastatic_cancer' WHEN p_partkey % 40 = 8 THEN 'age' ELSE {v} || {s} END"


def _first_family() -> str:
    return " ".join(f"WHEN regexp_full_match(feature, '{p}') THEN '{n}'" for n, p, _, _ in guards.K.FEATURE_FAMILIES)


@query("provenance_match", f"""WITH f AS (SELECT DISTINCT {_family_names()} AS feature FROM part), m AS (SELECT feature, CASE {_first_family()} END AS feature_name FROM f)
SELECT feature, feature_name, CASE WHEN feature_name IS NULL THEN 'unmatched' WHEN feature_name = 'has_metastatic_cancer' THEN 'disallowed' ELSE 'matched' END AS status FROM m""")
def provenance_match(spark, sf):
    names = table(spark, sf, "part").select(F.expr(_family_names()).alias("feature")).distinct()
    return guards.provenance(names, "feature")


def _details_sql() -> str:
    pick = lambda i: " ".join(f"WHEN regexp_full_match(feature, '{f[1]}') THEN " + (f"'{f[i]}'" if i != 3 else str(f[i]).lower()) for f in guards.K.FEATURE_FAMILIES)
    vitals, labs = ", ".join(f"'{v}'" for v in guards.K.VITAL_CODES), ", ".join(f"'{v}'" for v in guards.K.LAB_CODES)
    known = "|".join([*guards.K.VITAL_CODES, *guards.K.LAB_CODES])
    return f"""WITH f AS (SELECT DISTINCT {_family_names()} AS feature FROM part),
m AS (SELECT feature, CASE {pick(0)} END AS feature_name, CASE {pick(2)} END AS feature_group, coalesce(CASE {pick(3)} END, false) AS ok,
 nullif(regexp_extract(feature, '^({known}|urine_output|age|gender|bmi|prev_dx)(?:_|$)', 1), '') AS v FROM f),
s AS (SELECT *, CASE WHEN feature_group = 'demographic' AND v <> 'bmi' THEN 'patients' WHEN feature_group = 'diagnosis' THEN 'diagnoses'
 WHEN v IN ({vitals}, 'bmi', 'urine_output') THEN 'chart events' WHEN v IN ({labs}) THEN 'lab events' WHEN feature_group IS NOT NULL THEN 'derived' END AS source FROM m)
SELECT feature, feature_name, feature_group, source, v AS source_variable,
 CASE WHEN source IN ('chart events', 'lab events', 'derived') THEN CASE WHEN feature LIKE '%_hour_3' THEN 3.0e0 WHEN feature LIKE '%last_2h_mean' THEN 4.0e0 ELSE 0.0e0 END END AS window_start,
 CASE WHEN source IN ('chart events', 'lab events', 'derived') THEN CASE WHEN feature LIKE '%_hour_3' THEN 3.0e0 WHEN feature LIKE '%_bin_0_1h_%' THEN 1.0e0 ELSE 6.0e0 END END AS window_end,
 nullif(regexp_extract(feature, '_(mean|min|max|delta|last|first|total|count|slope|trend|std|cv|range|measured|observed|missing|squared|log)(?:_0_6h)?$', 1), '') AS statistic,
 regexp_matches(feature, '(_measured|_measured_0_6h|_missing|_observed|_flag|_dysfunction)$|^has_|^gender_') AS is_binary,
 coalesce(feature_group = 'missingness', false) OR regexp_matches(feature, '_observed$|_measured_0_6h$') AS is_missingness_indicator,
 CASE WHEN ok THEN 'low' ELSE 'excluded' END AS leakage_risk, ok AS allowed_for_model FROM s"""


@query("provenance_details", _details_sql())
def provenance_details(spark, sf):
    names = table(spark, sf, "part").select(F.expr(_family_names()).alias("feature")).distinct()
    return guards.provenance_details(names, "feature")


@query("align_features", """WITH f AS (SELECT l_orderkey AS stay_id, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1)
SELECT f.* FROM f JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'P') o ON stay_id = o_orderkey""")
def align_features(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stay_id"), "l_partkey")
    ids = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("stay_id"))
    return guards.align_features(f, ids, "stay_id", order="l_partkey")
