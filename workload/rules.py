"""Row-rule operators on the order-level wide table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions import exprs as X
from tidewatch.operators import rules as R
from workload.base import WIDE_COLUMNS, query, rounded, table, wide, wide_sql

ALL = [c for c in WIDE_COLUMNS if c not in ("first_careunit", "ventilated", "risk", "total_lab_count")]


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def _only(df, keep):
    return rounded(df.select("stay_id", *keep))


def _regs(cols: list[str], xs: list[int], n: int) -> str:
    pts = ", ".join(f"({x}.0, {c})" for c, x in zip(cols, xs))
    return (f"(SELECT CASE WHEN count(y) >= {n} THEN regr_slope(y, x) END FROM (VALUES {pts}) t(x, y) WHERE y IS NOT NULL)")


_RR = [f"resp_rate_hour_{i}" for i in range(3)]
_HR = [f"heart_rate_hour_{i}" for i in range(3)]
_SHOCK = "CASE WHEN heart_rate_mean / nullif(sbp_mean, 0) > 2 THEN 2.0 ELSE heart_rate_mean / nullif(sbp_mean, 0) END"
_BUN = "CASE WHEN bun_mean / nullif(creatinine_mean, 0) > 30 THEN 30.0 ELSE bun_mean / nullif(creatinine_mean, 0) END"
_T1, _T2, _T3, _T4 = (_flag("heart_rate_mean > 90"), _flag("resp_rate_mean > 20"),
                      _flag("temp_mean > 38 OR temp_mean < 36"), _flag("wbc_mean > 12 OR wbc_mean < 4"))
_SIRS = f"({_T1}) + ({_T2}) + ({_T3}) + ({_T4})"

DERIVED = ["has_tachycardia", "has_tachypnea", "has_fever_or_hypothermia", "has_abnormal_wbc", "sirs_criteria_count",
           "resp_variability", "resp_trend", "heart_rate_trend", "shock_index", "shock_lactate_interaction",
           "bun_creatinine_ratio", "has_hypoxemia", "resp_distress_score", "age_group", "age_young_adult",
           "age_middle_aged", "age_elderly", "age_very_elderly", "age_comorbidity"]


@query("derived_flags", f"""WITH {wide_sql(ALL)} SELECT stay_id, {_T1} AS has_tachycardia, {_T2} AS has_tachypnea,
 {_T3} AS has_fever_or_hypothermia, {_T4} AS has_abnormal_wbc, {_SIRS} AS sirs_criteria_count,
 round((SELECT stddev_samp(y) FROM (VALUES ({_RR[0]}), ({_RR[1]}), ({_RR[2]})) t(y)), 6) AS resp_variability,
 round({_regs(_RR, [0, 1, 2], 2)}, 6) + 0.0 AS resp_trend, round({_regs(_HR, [0, 1, 2], 3)}, 6) + 0.0 AS heart_rate_trend,
 round({_SHOCK}, 6) AS shock_index, round(({_SHOCK}) * lactate_max, 6) AS shock_lactate_interaction,
 round({_BUN}, 6) AS bun_creatinine_ratio, {_flag("spo2_mean < 92")} AS has_hypoxemia,
 round(resp_rate_mean / (CASE WHEN spo2_mean < 80 THEN 80.0 WHEN spo2_mean > 100 THEN 100.0 ELSE spo2_mean END / 100), 6) AS resp_distress_score,
 CASE WHEN age > 0 AND age <= 40 THEN 'young_adult' WHEN age > 40 AND age <= 60 THEN 'middle_aged'
  WHEN age > 60 AND age <= 80 THEN 'elderly' WHEN age > 80 AND age <= 120 THEN 'very_elderly' END AS age_group,
 {_flag("age > 0 AND age <= 40")} AS age_young_adult, {_flag("age > 40 AND age <= 60")} AS age_middle_aged,
 {_flag("age > 60 AND age <= 80")} AS age_elderly, {_flag("age > 80 AND age <= 120")} AS age_very_elderly,
 age * prev_dx_count_total AS age_comorbidity FROM wide""")
def derived_flags(spark, sf):
    # the query drops the trends the oracle does not list
    return _only(R.derived_flags(wide(spark, sf, ALL)), DERIVED)


def _mm(c: str, inverted: bool) -> str:
    s = f"(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()))"
    return f"(1 - {s})" if inverted else s


def _row_mean(parts: list[str]) -> str:
    return f"list_avg(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"


SYSTEMS = {s: m for s, m in K.ORGAN_MARKERS.items() if s != "liver"}


@query("minmax_composite", f"""WITH {wide_sql(ALL)}, m AS (SELECT stay_id,
 {_row_mean([_mm("creatinine_max", False), _mm("bun_max", False), _mm("urine_output_total", True)])} AS renal,
 {_row_mean([_mm("bilirubin_max", False)])} AS liver,
 {_row_mean([_mm("heart_rate_max", False), _mm("sbp_min", True)])} AS cardiac,
 {_row_mean([_mm("resp_rate_max", False), _mm("spo2_min", True)])} AS respiratory,
 {_row_mean([_mm("platelets_min", True), _mm("inr_max", False), _mm("hemoglobin_min", True)])} AS hematologic FROM wide)
SELECT stay_id, round(renal, 6) AS renal_dysfunction, round(liver, 6) AS liver_dysfunction, round(cardiac, 6) AS cardiac_dysfunction,
 round(respiratory, 6) AS respiratory_dysfunction, round(hematologic, 6) AS hematologic_dysfunction,
 round({_row_mean(["renal", "liver", "cardiac", "respiratory", "hematologic"])}, 6) AS total_organ_dysfunction FROM m""")
def minmax_composite(spark, sf):
    out = R.minmax_composite(wide(spark, sf, ALL))
    return _only(out, [f"{s}_dysfunction" for s in K.ORGAN_MARKERS] + ["total_organ_dysfunction"])


def _with_derived(spark, sf):
    return R.derived_flags(wide(spark, sf, ALL))


@query("interactions_v1", f"""WITH {wide_sql(ALL)} SELECT stay_id, round(({_SHOCK}) * age, 6) AS shock_index_x_age,
 round(({_BUN}) * age, 6) AS bun_creat_ratio_x_age, round(lactate_mean * anion_gap_max, 6) AS lactate_x_anion_gap,
 prev_dx_count_total * age AS prev_dx_count_x_age, round(resp_rate_mean * (100 - spo2_min), 6) AS resp_distress,
 round((sbp_max - sbp_min) * lactate_mean, 6) AS map_variance_x_lactate, round(heart_rate_max / nullif(sbp_min, 0), 6) AS hr_sbp_ratio,
 round(({_SIRS}) * lactate_mean, 6) AS sirs_x_lactate FROM wide""")
def interactions_v1(spark, sf):
    return _only(R.interactions_v1(_with_derived(spark, sf)),
                 ["shock_index_x_age", "bun_creat_ratio_x_age", "lactate_x_anion_gap", "prev_dx_count_x_age",
                  "resp_distress", "map_variance_x_lactate", "hr_sbp_ratio", "sirs_x_lactate"])


_CRIT = [(c, op, t) for c, op, t in K.CRITICAL_RULES if c in WIDE_COLUMNS]
_CRIT_SUM = " + ".join(f"({_flag(f'{c} {op} {t}')})" for c, op, t in _CRIT)


@query("interactions", f"""WITH {wide_sql(ALL)} SELECT stay_id, age * prev_dx_count_total AS age_x_prev_dx_count,
 round(({_SHOCK}) * age, 6) AS age_x_shock_index, round(platelets_min * inr_max, 6) AS platelets_x_inr,
 round(({_SIRS}) * lactate_mean, 6) AS sirs_x_lactate, round(creatinine_max * urine_output_total, 6) AS creatinine_x_urine_output,
 round(bilirubin_max * inr_max, 6) AS bilirubin_x_inr, round(lactate_max * ({_flag("map_min < 65")}), 6) AS lactate_x_hypotension,
 round(resp_rate_mean * (100 - spo2_min), 6) AS resp_rate_x_spo2_deficit,
 ({_CRIT_SUM}) * panel_missing_count_0_6h AS critical_count_x_missing_lab_count FROM wide""")
def interactions(spark, sf):
    return _only(R.interactions(R.critical_values(_with_derived(spark, sf))),
                 ["age_x_prev_dx_count", "age_x_shock_index", "platelets_x_inr", "sirs_x_lactate",
                  "creatinine_x_urine_output", "bilirubin_x_inr", "lactate_x_hypotension", "resp_rate_x_spo2_deficit",
                  "critical_count_x_missing_lab_count"])


_LOGS = [lab for lab in K.LOG_LABS if f"{lab}_mean" in WIDE_COLUMNS]


@query("log_features", f"WITH {wide_sql(ALL)} SELECT stay_id, "
       + ", ".join(f"round(ln(1 + {lab}_mean), 6) AS {lab}_log" for lab in _LOGS) + " FROM wide")
def log_features(spark, sf):
    return _only(R.log_features(wide(spark, sf, ALL)), [f"{lab}_log" for lab in _LOGS])


def _organ(name: str) -> str:
    have = [f"{c} {op} {t}" for c, op, t in K.ORGAN_RULES[name] if c in WIDE_COLUMNS]
    return _flag(" OR ".join(have))


@query("organ_flags", f"WITH {wide_sql(ALL)} SELECT stay_id, " + ", ".join(f"{_organ(n)} AS {n}" for n in K.ORGAN_RULES)
       + ", " + " + ".join(f"({_organ(n)})" for n in K.ORGAN_RULES) + " AS organ_dysfunction_count FROM wide")
def organ_flags(spark, sf):
    return _only(R.organ_flags(wide(spark, sf, ALL)), list(K.ORGAN_RULES) + ["organ_dysfunction_count"])


@query("critical_values", f"WITH {wide_sql(ALL)} SELECT stay_id, "
       + ", ".join(f"{_flag(f'{c} {op} {t}')} AS {c}_critical" for c, op, t in _CRIT)
       + f", {_CRIT_SUM} AS critical_value_count, {_flag(f'({_CRIT_SUM}) >= 3')} AS multiple_critical_values FROM wide")
def critical_values(spark, sf):
    return _only(R.critical_values(wide(spark, sf, ALL)),
                 [f"{c}_critical" for c, _, _ in _CRIT] + ["critical_value_count", "multiple_critical_values"])


FOCUSED = ["bmi", "has_tachypnea", "has_bradypnea", "has_elevated_lactate", "has_severe_lactate", "has_tachycardia",
           "has_bradycardia", "has_high_anion_gap", "has_hypoxemia", "has_severe_hypoxemia", "shock_index", "has_shock",
           "spo2_delta_1to2", "lactate_delta_4to6", "dbp_delta_0to1"]


@query("focused_indicators", f"""WITH {wide_sql(ALL)} SELECT stay_id,
 CASE WHEN coalesce(gender, 'M') = 'M' THEN CASE WHEN age < 30 THEN 24.5 WHEN age < 45 THEN 26.0 WHEN age < 60 THEN 27.5 ELSE 26.8 END
  ELSE CASE WHEN age < 30 THEN 23.8 WHEN age < 45 THEN 25.5 WHEN age < 60 THEN 26.8 ELSE 26.2 END END::DOUBLE AS bmi,
 {_T2} AS has_tachypnea, {_flag("resp_rate_mean < 12")} AS has_bradypnea, {_flag("lactate_mean > 2")} AS has_elevated_lactate,
 {_flag("lactate_mean > 4")} AS has_severe_lactate, {_T1} AS has_tachycardia, {_flag("heart_rate_mean < 60")} AS has_bradycardia,
 {_flag("anion_gap_mean > 12")} AS has_high_anion_gap, {_flag("spo2_mean < 92")} AS has_hypoxemia,
 {_flag("spo2_mean < 88")} AS has_severe_hypoxemia, round(heart_rate_mean / nullif(sbp_mean, 0), 6) AS shock_index,
 {_flag("heart_rate_mean / nullif(sbp_mean, 0) > 0.9")} AS has_shock, round(spo2_2 - spo2_1, 6) AS spo2_delta_1to2,
 round(lactate_6 - lactate_4, 6) AS lactate_delta_4to6, round(dbp_1 - dbp_0, 6) AS dbp_delta_0to1 FROM wide""")
def focused_indicators(spark, sf):
    return _only(R.focused_indicators(wide(spark, sf, ALL)), FOCUSED)


def _trend(g: str) -> str:
    pct = f"coalesce(({g}_max - {g}_min) / nullif({g}_min, 0) * 100, 0)"
    return (f"round({g}_max - {g}_min, 6) AS {g}_delta, round({pct}, 6) AS {g}_pct_change, "
            f"CAST(CASE WHEN abs({pct}) < 5 THEN 0 ELSE sign({pct}) END AS DOUBLE) AS {g}_trend")


@query("minmax_trends", f"WITH {wide_sql(ALL)} SELECT stay_id, " + ", ".join(_trend(g) for g in K.TREND_GROUPS) + " FROM wide")
def minmax_trends(spark, sf):
    return _only(R.minmax_trends(wide(spark, sf, ALL)),
                 [f"{g}_{s}" for g in K.TREND_GROUPS for s in ("delta", "pct_change", "trend")])


@query("polynomial", f"WITH {wide_sql(ALL)} SELECT stay_id, " + ", ".join(
    f"round({c} * {c}, 6) AS {c}_squared, round(({c} - {v}) * ({c} - {v}), 6) AS {c}_dist_from_normal"
    for c, v in K.NORMAL_POINTS.items()) + " FROM wide")
def polynomial(spark, sf):
    return _only(R.polynomial(wide(spark, sf, ALL)),
                 [f"{c}_{s}" for c in K.NORMAL_POINTS for s in ("squared", "dist_from_normal")])


_SKEW = ["value", "value_sq", "event_id"]


@query("skew_log", """WITH e AS (SELECT event_id, value, value * value AS value_sq FROM events),
s AS (SELECT skewness(value) AS a, skewness(value_sq) AS b FROM e)
SELECT event_id, value, round(value_sq, 6) AS value_sq, round(ln(1 + value_sq), 6) AS value_sq_log FROM e, s WHERE abs(b) > 2""")
def skew_log(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", (F.col("value") * F.col("value")).alias("value_sq"))
    return rounded(R.skew_log(e, _SKEW))


@query("calendar_features", """SELECT event_id, ts, hour(ts)::INTEGER AS ts_time_hour, (isodow(ts) - 1)::INTEGER AS ts_time_dayofweek,
 CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS ts_time_is_weekend,
 hour(ts + INTERVAL '90 minutes')::INTEGER AS end_time_hour, (isodow(ts + INTERVAL '90 minutes') - 1)::INTEGER AS end_time_dayofweek,
 CASE WHEN isodow(ts + INTERVAL '90 minutes') >= 6 THEN 1 ELSE 0 END AS end_time_is_weekend,
 1.5::DOUBLE AS hours_since_ts_time_to_end_time FROM events""")
def calendar_features(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.col("ts").alias("ts_time"),
                                          (F.col("ts") + F.expr("INTERVAL '90' MINUTE")).alias("end_time"))
    return R.calendar_features(e).drop("ts_time", "end_time")


ADVANCED = ["shock_index_mean", "shock_index_max", "bun_creatinine_ratio", "map_below_65", "map_min_below_60", "pf_ratio",
            "mild_ards", "moderate_ards", "severe_ards", "liver_dysfunction_score", "glucose_variability",
            "resp_dysfunction", "cv_dysfunction", "renal_dysfunction", "hepatic_dysfunction", "coag_dysfunction",
            "organ_dysfunction_count"]
_PF = "pao2_mean / nullif(fio2_mean, 0)"
_AF = {"resp_dysfunction": f"{_PF} < 300", "cv_dysfunction": "map_min < 70", "renal_dysfunction": "creatinine_max > 1.2",
       "hepatic_dysfunction": "bilirubin_max > 1.2", "coag_dysfunction": "platelets_min < 150"}


@query("advanced_features", f"""WITH {wide_sql(ALL)} SELECT stay_id, round(heart_rate_mean / nullif(sbp_mean, 0), 6) AS shock_index_mean,
 round(heart_rate_max / nullif(sbp_min, 0), 6) AS shock_index_max, round(bun_mean / nullif(creatinine_mean, 0), 6) AS bun_creatinine_ratio,
 {_flag("map_mean < 65")} AS map_below_65, {_flag("map_min < 60")} AS map_min_below_60, round({_PF}, 6) AS pf_ratio,
 {_flag(f"{_PF} <= 300 AND {_PF} > 200")} AS mild_ards, {_flag(f"{_PF} <= 200 AND {_PF} > 100")} AS moderate_ards,
 {_flag(f"{_PF} <= 100")} AS severe_ards, round(bilirubin_mean / 1.2 + inr_mean / 1.1, 6) AS liver_dysfunction_score,
 round(glucose_max - glucose_min, 6) AS glucose_variability, {", ".join(f"{_flag(c)} AS {n}" for n, c in _AF.items())},
 {" + ".join(f"({_flag(c)})" for c in _AF.values())} AS organ_dysfunction_count FROM wide""")
def advanced_features(spark, sf):
    return _only(R.advanced_features(wide(spark, sf, ALL)), ADVANCED)


# --- scalar families ---------------------------------------------------------------------------
@query("sanitize_token", """SELECT DISTINCT o_orderpriority AS raw, regexp_replace(regexp_replace(lower(trim(o_orderpriority)),
 '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS token FROM orders""")
def sanitize_token(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("raw")).distinct().withColumn(
        "token", X.sanitize_token("raw"))


_ALIAS = {"promo": "promotion", "economy": "economy_line", "small": "small_line"}


@query("canonical_alias", """SELECT p_partkey, CASE lower(p_type) WHEN 'promo' THEN 'promotion' WHEN 'economy' THEN 'economy_line'
 WHEN 'small' THEN 'small_line' ELSE lower(p_type) END AS variable FROM part""")
def canonical_alias(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.canonical_variable("p_type", _ALIAS).alias("variable"))


@query("string_rules", r"""SELECT p_partkey, upper(p_name) AS upper_name, starts_with(p_type, 'S') AS starts_s,
 substr(p_type, 1, 1) BETWEEN 'A' AND 'L' AS first_half, CAST(nullif(regexp_extract(p_brand, '([0-9]+)$', 1), '') AS INTEGER) AS brand_no,
 CAST(nullif(regexp_extract(p_brand, '([0-9]+)$', 1), '') AS INTEGER) BETWEEN 10 AND 19 AS brand_teens,
 regexp_matches(p_name, 'red|hot') AS contains_word, regexp_full_match(p_type, 'PROMO|LARGE') AS full_match FROM part""")
def string_rules(spark, sf):
    n = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    return table(spark, sf, "part").select(
        "p_partkey", F.upper("p_name").alias("upper_name"), F.startswith("p_type", F.lit("S")).alias("starts_s"),
        F.substring("p_type", 1, 1).between("A", "L").alias("first_half"), n.alias("brand_no"),
        n.between(10, 19).alias("brand_teens"), F.col("p_name").rlike("red|hot").alias("contains_word"),
        F.col("p_type").rlike("^(?:PROMO|LARGE)$").alias("full_match"))


@query("math_rules", """SELECT event_id, round(ln(1 + value), 6) AS log1p_v, round(exp(-value / 100), 6) AS exp_v, round(value * value, 6) AS square_v,
 sign(value - 50)::DOUBLE AS sign_v, round(abs(value - 50), 6) AS abs_v, floor(value)::BIGINT AS floor_v, ceil(value)::BIGINT AS ceil_v,
 CASE WHEN value < 10 THEN 10.0 WHEN value > 90 THEN 90.0 ELSE value END AS clip_v,
 round(100.0 / nullif(floor(value), 0), 6) AS guarded_ratio,
 round(ln(greatest(1e-6, least(1 - 1e-6, value / 500)) / (1 - greatest(1e-6, least(1 - 1e-6, value / 500)))), 6) AS logit_v,
 round(1 / (1 + exp(-greatest(-50, least(50, value - 60)))), 6) AS sigmoid_v FROM events""")
def math_rules(spark, sf):
    v = F.col("value")
    return rounded(table(spark, sf, "events").select(
        "event_id", F.log1p(v).alias("log1p_v"), F.exp(-v / 100).alias("exp_v"), (v * v).alias("square_v"),
        F.signum(v - 50).alias("sign_v"), F.abs(v - 50).alias("abs_v"), F.floor(v).alias("floor_v"),
        F.ceil(v).alias("ceil_v"), X.clip(v, 10, 90).alias("clip_v"), X.ratio(F.lit(100.0), F.floor(v)).alias("guarded_ratio"),
        X.logit(v / 500).alias("logit_v"), X.sigmoid(v - 60).alias("sigmoid_v")))


@query("logit_sigmoid", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(greatest(1e-6, least(1 - 1e-6, l_discount * 10)) / (1 - greatest(1e-6, least(1 - 1e-6, l_discount * 10)))), 6) AS z,
 round(1 / (1 + exp(-(l_quantity - 25))), 6) AS p FROM lineitem""")
def logit_sigmoid(spark, sf):
    return rounded(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.logit(F.col("l_discount") * 10).alias("z"),
        X.sigmoid(F.col("l_quantity") - 25).alias("p")))


@query("null_rules", f"""WITH {wide_sql(["heart_rate_mean", "gender", "sbp_mean", "dbp_min"])} SELECT stay_id, round(coalesce(heart_rate_mean, 80.0), 6) AS const_fill,
 CASE WHEN heart_rate_mean IS NULL THEN 1 ELSE 0 END AS is_missing, round(coalesce(heart_rate_mean, sbp_mean, dbp_min), 6) AS first_present,
 coalesce(gender, 'unknown') AS gender FROM wide""")
def null_rules(spark, sf):
    w = wide(spark, sf, ["heart_rate_mean", "gender", "sbp_mean", "dbp_min"])
    return rounded(w.select("stay_id", F.coalesce("heart_rate_mean", F.lit(80.0)).alias("const_fill"),
                            X.flag(F.col("heart_rate_mean").isNull()).alias("is_missing"),
                            F.coalesce("heart_rate_mean", "sbp_mean", "dbp_min").alias("first_present"),
                            F.coalesce("gender", F.lit("unknown")).alias("gender")))


@query("binning_onehot", f"""WITH {wide_sql(["age", "gender"])} SELECT stay_id,
 CASE WHEN age <= 49 THEN '<50' WHEN age <= 64 THEN '50-64' WHEN age <= 79 THEN '65-79' WHEN age > 79 THEN '80+' END AS age_band,
 CASE WHEN age <= 49 THEN 1 ELSE 0 END AS band_1, CASE WHEN age > 49 AND age <= 64 THEN 1 ELSE 0 END AS band_2,
 CAST(CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 ELSE -1 END AS INTEGER) AS gender_code FROM wide""")
def binning_onehot(spark, sf):
    band = X.cut_right_closed("age", [None, 49, 64, 79, None], ["<50", "50-64", "65-79", "80+"])
    return wide(spark, sf, ["age", "gender"]).select(
        "stay_id", band.alias("age_band"), X.flag(band == "<50").alias("band_1"), X.flag(band == "50-64").alias("band_2"),
        F.coalesce(F.when(F.col("gender") == "F", 0).when(F.col("gender") == "M", 1), F.lit(-1)).alias("gender_code"))


@query("row_reduce", f"""WITH {wide_sql(_HR)} SELECT stay_id, round({_row_mean(_HR)}, 6) AS mean_v,
 round({" + ".join(f"coalesce({c}, 0)" for c in _HR)}, 6) AS sum_v,
 round((SELECT stddev_samp(y) FROM (VALUES ({_HR[0]}), ({_HR[1]}), ({_HR[2]})) t(y)), 6) AS std_v FROM wide""")
def row_reduce(spark, sf):
    return rounded(wide(spark, sf, _HR).select("stay_id", X.row_mean(_HR).alias("mean_v"), X.row_sum(_HR).alias("sum_v"),
                                               X.row_std(_HR).alias("std_v")))


@query("row_variability", f"""WITH {wide_sql(_RR)} SELECT stay_id,
 round((SELECT stddev_samp(y) FROM (VALUES ({_RR[0]}), ({_RR[1]}), ({_RR[2]})) t(y)), 6) AS resp_variability FROM wide""")
def row_variability(spark, sf):
    return rounded(wide(spark, sf, _RR).select("stay_id", X.row_std(_RR).alias("resp_variability")))
