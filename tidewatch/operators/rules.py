"""Row rules on the wide feature table. Each operator is one projection; a rule is applied
only when its input columns exist, and a missing input never raises a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions.exprs import (clip, cut_right_closed, flag, hours_between, ratio, row_mean, row_slope, row_std,
                                       rule)
from tidewatch.operators.ranking import exact_quantiles


def _add(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One select: existing columns (replaced where renamed) followed by the new ones."""
    return df.withColumns(new) if new else df


def _have(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def _count(flags: list[Column]) -> Column:
    return sum(flags[1:], flags[0])


def _hours(df: DataFrame, prefix: str) -> list[tuple[int, str]]:
    tag = f"{prefix}_hour_"
    return sorted((int(c[len(tag):]), c) for c in df.columns if c.startswith(tag) and c[len(tag):].isdigit())


def _sirs(df: DataFrame) -> dict[str, Column]:
    out = {}
    if _have(df, "heart_rate_mean"):
        out["has_tachycardia"] = flag(rule("heart_rate_mean", ">", 90))
    if _have(df, "resp_rate_mean"):
        out["has_tachypnea"] = flag(rule("resp_rate_mean", ">", 20))
    if _have(df, "temp_mean"):
        out["has_fever_or_hypothermia"] = flag((F.col("temp_mean") > 38) | (F.col("temp_mean") < 36))
    if _have(df, "wbc_mean"):
        out["has_abnormal_wbc"] = flag((F.col("wbc_mean") > 12) | (F.col("wbc_mean") < 4))
    return out


def derived_flags(df: DataFrame) -> DataFrame:
    """Inflammation flags and count, shock, renal and oxygenation markers, age bands, trends."""
    new = _sirs(df)
    if new:
        new["sirs_criteria_count"] = _count(list(new.values()))
    rr = _hours(df, "resp_rate")
    if len(rr) >= 3:
        new["resp_variability"] = row_std([c for _, c in rr])
        new["resp_trend"] = row_slope([c for _, c in rr], [h for h, _ in rr])
    for vital in ("heart_rate", "resp_rate", "sbp", "map"):
        hs = _hours(df, vital)
        if len(hs) >= 3:
            new[f"{vital}_trend"] = row_slope([c for _, c in hs], [h for h, _ in hs], min_count=3)
    if _have(df, "heart_rate_mean", "sbp_mean"):
        shock = clip(ratio("heart_rate_mean", "sbp_mean"), None, 2)
        new["shock_index"] = shock
        if _have(df, "lactate_max"):
            new["shock_lactate_interaction"] = shock * F.col("lactate_max")
    if _have(df, "creatinine_mean", "bun_mean"):
        new["bun_creatinine_ratio"] = clip(ratio("bun_mean", "creatinine_mean"), None, 30)
    if _have(df, "spo2_mean"):
        new["has_hypoxemia"] = flag(rule("spo2_mean", "<", 92))
        if _have(df, "resp_rate_mean"):
            new["resp_distress_score"] = F.col("resp_rate_mean") / (clip(F.col("spo2_mean").cast("double"), 80, 100) / 100)
    if _have(df, "age"):
        new["age_group"] = cut_right_closed("age", [0, 40, 60, 80, 120], [n for _, _, n in K.AGE_BINS])
        for low, high, name in K.AGE_BINS:
            new[f"age_{name}"] = flag((F.col("age") > low) & (F.col("age") <= high))
        if _have(df, "prev_dx_count_total"):
            new["age_comorbidity"] = F.col("age") * F.col("prev_dx_count_total")
    return _add(df, new)


def minmax_composite(df: DataFrame, systems: dict[str, list[str]] = K.ORGAN_MARKERS,
                     fit_on: Column | None = None) -> DataFrame:
    """Organ scores: markers scaled by the fitted min and max, turned where lower is worse,
    averaged over what is available; then the mean of the systems."""
    markers = sorted({m for ms in systems.values() for m in ms if m in df.columns})
    base = df if fit_on is None else df.where(fit_on)
    lim = base.agg(*[f(F.col(m).cast("double")).alias(f"{t}_{m}") for m in markers
                     for f, t in ((F.min, "lo"), (F.max, "hi"))]).first()
    new: dict[str, Column] = {}
    for system, names in systems.items():
        have = [m for m in names if m in df.columns]
        if len(have) < 2:
            continue
        parts = []
        for m in have:
            lo, hi = lim[f"lo_{m}"], lim[f"hi_{m}"]
            if lo is None or hi == lo:
                continue
            scaled = (F.col(m) - F.lit(lo)) / F.lit(hi - lo)
            if any(w in m for w in K.HIGH_IS_WORSE):
                parts.append(scaled)
            elif any(w in m for w in K.LOW_IS_WORSE):
                parts.append(1 - scaled)
        if parts:
            new[f"{system}_dysfunction"] = row_mean(parts)
    if new:
        new["total_organ_dysfunction"] = row_mean(list(new.values()))
    return _add(df, new)


def interactions_v1(df: DataFrame) -> DataFrame:
    """The first set of pairwise products and ratios."""
    new: dict[str, Column] = {}

    def product(name, a, b):
        if _have(df, a, b):
            new[name] = F.col(a) * F.col(b)

    product("shock_index_x_age", "shock_index", "age")
    product("bun_creat_ratio_x_age", "bun_creatinine_ratio", "age")
    product("lactate_x_anion_gap", "lactate_mean", "anion_gap_max")
    product("prev_dx_count_x_age", "prev_dx_count_total", "age")
    if _have(df, "resp_rate_mean", "spo2_min"):
        new["resp_distress"] = F.col("resp_rate_mean") * (100 - F.col("spo2_min"))
    if _have(df, "sbp_min", "sbp_max", "lactate_mean"):
        new["map_variance_x_lactate"] = (F.col("sbp_max") - F.col("sbp_min")) * F.col("lactate_mean")
    if _have(df, "heart_rate_max", "sbp_min"):
        new["hr_sbp_ratio"] = ratio("heart_rate_max", "sbp_min")
    product("sirs_x_lactate", "sirs_criteria_count", "lactate_mean")
    return _add(df, new)


def interactions(df: DataFrame) -> DataFrame:
    """The current set of interactions, with fallbacks for absent inputs."""
    new: dict[str, Column] = {}
    for name, a, b in [("age_x_prev_dx_count", "age", "prev_dx_count_total"), ("age_x_shock_index", "age", "shock_index"),
                       ("platelets_x_inr", "platelets_min", "inr_max"),
                       ("sirs_x_lactate", "sirs_criteria_count", "lactate_mean"),
                       ("creatinine_x_urine_output", "creatinine_max", "urine_output_total"),
                       ("bilirubin_x_inr", "bilirubin_max", "inr_max")]:
        if _have(df, a, b):
            new[name] = F.col(a) * F.col(b)
    for pressure, limit in (("map_min", 65), ("sbp_min", 90)):
        if _have(df, "lactate_max", pressure):
            new["lactate_x_hypotension"] = F.col("lactate_max") * flag(rule(pressure, "<", limit))
            break
    if _have(df, "resp_rate_mean", "spo2_min"):
        new["resp_rate_x_spo2_deficit"] = F.col("resp_rate_mean") * (100 - F.col("spo2_min"))
    critical = next((c for c in ("critical_value_count", "critical_value_count_0_6h") if _have(df, c)), None)
    missing = next((c for c in ("panel_missing_count_0_6h", "missing_lab_count") if _have(df, c)), None)
    if critical and missing:
        new["critical_count_x_missing_lab_count"] = F.col(critical) * F.col(missing)
    return _add(df, new)


def log_features(df: DataFrame) -> DataFrame:
    return _add(df, {f"{lab}_log": F.log1p(f"{lab}_mean") for lab in K.LOG_LABS if _have(df, f"{lab}_mean")})


def organ_flags(df: DataFrame) -> DataFrame:
    """One OR flag per organ system (absent only when no input exists) and their count."""
    new: dict[str, Column] = {}
    for name, rules in K.ORGAN_RULES.items():
        hits = [flag(rule(*r)) for r in rules if _have(df, r[0])]
        if hits:
            new[name] = F.greatest(*hits) if len(hits) > 1 else hits[0]
    if new:
        new["organ_dysfunction_count"] = _count(list(new.values()))
    return _add(df, new)


def critical_values(df: DataFrame) -> DataFrame:
    """``<column>_critical`` per rule, their count and a three-or-more flag."""
    new = {f"{c}_critical": flag(rule(c, op, t)) for c, op, t in K.CRITICAL_RULES if _have(df, c)}
    if new:
        total = _count(list(new.values()))
        new["critical_value_count"] = total
        new["multiple_critical_values"] = flag(total >= 3)
    return _add(df, new)


def _bmi(df: DataFrame, fit_on: Column | None) -> Column:
    weight = next((c for c in df.columns if "weight" in c.lower()), None)
    height = next((c for c in df.columns if "height" in c.lower()), None)
    if weight and height:
        base = df if fit_on is None else df.where(fit_on)
        median = exact_quantiles(base, [height], [0.5])[height][0]
        h = F.col(height) / 100.0 if median is not None and median > 3 else F.col(height)
        return clip(ratio(F.col(weight), h * h), 10, 100)
    if _have(df, "age", "gender"):
        g = F.coalesce(F.upper(F.substring(F.col("gender").cast("string"), 1, 1)), F.lit("M"))
        male = g.isin("M", "1")

        def by_age(sex):
            out = F.when(F.lit(False), F.lit(0.0))
            for limit, v in K.BMI_BY_AGE[sex]:
                out = out.otherwise(F.lit(v)) if limit is None else out.when(F.col("age") < limit, F.lit(v))
            return out

        return F.when(male, by_age("M")).otherwise(by_age("F"))
    return F.lit(K.DEFAULT_BMI)


def focused_indicators(df: DataFrame, fit_on: Column | None = None) -> DataFrame:
    """Body mass index and the threshold flags and hour changes with the most signal."""
    new: dict[str, Column] = {"bmi": _bmi(df, fit_on)}
    for column, rules in {
        "resp_rate_mean": [("has_tachypnea", ">", 20), ("has_bradypnea", "<", 12)],
        "lactate_mean": [("has_elevated_lactate", ">", 2), ("has_severe_lactate", ">", 4)],
        "heart_rate_mean": [("has_tachycardia", ">", 90), ("has_bradycardia", "<", 60)],
        "anion_gap_mean": [("has_high_anion_gap", ">", 12)],
        "spo2_mean": [("has_hypoxemia", "<", 92), ("has_severe_hypoxemia", "<", 88)],
    }.items():
        if _have(df, column):
            new.update({name: flag(rule(column, op, t)) for name, op, t in rules})
    if _have(df, "heart_rate_mean", "sbp_mean"):
        new["shock_index"] = ratio("heart_rate_mean", "sbp_mean")
        new["has_shock"] = flag(ratio("heart_rate_mean", "sbp_mean") > 0.9)
    for v, a, b in K.HOUR_DELTAS:
        if _have(df, f"{v}_{a}", f"{v}_{b}"):
            new[f"{v}_delta_{a}to{b}"] = F.col(f"{v}_{b}") - F.col(f"{v}_{a}")
    return _add(df, new)


def minmax_trends(df: DataFrame, groups: list[str] = K.TREND_GROUPS) -> DataFrame:
    """Range, percent change over the minimum and its sign; changes under 5 % count as stable."""
    new: dict[str, Column] = {}
    for g in groups:
        if _have(df, f"{g}_min", f"{g}_max"):
            delta = F.col(f"{g}_max") - F.col(f"{g}_min")
            pct = F.coalesce(ratio(delta, F.col(f"{g}_min")) * 100, F.lit(0.0))
            new[f"{g}_delta"] = delta
            new[f"{g}_pct_change"] = pct
            new[f"{g}_trend"] = F.when(F.abs(pct) < 5, F.lit(0.0)).otherwise(F.signum(pct))
    return _add(df, new)


def polynomial(df: DataFrame) -> DataFrame:
    """Square and squared distance from a normal value."""
    new: dict[str, Column] = {}
    for c, normal in K.NORMAL_POINTS.items():
        if _have(df, c):
            new[f"{c}_squared"] = F.col(c) * F.col(c)
            d = F.col(c) - F.lit(float(normal))
            new[f"{c}_dist_from_normal"] = d * d
    return _add(df, new)


def adjusted_skew(c: str) -> Column:
    """Bias-adjusted skewness; NULL under three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def skew_log(df: DataFrame, columns: list[str] | None = None, limit: float = 2.0,
             fit_on: Column | None = None) -> DataFrame:
    """log1p of the numeric columns with |adjusted skew| above the limit and no negative value."""
    cols = columns or [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    cols = [c for c in cols if not any(x in c.lower() for x in ("_missing", "count", "binary", "has_"))
            and f"{c}_log" not in df.columns]
    if not cols:
        return df
    base = df if fit_on is None else df.where(fit_on)
    row = base.agg(*[e for i, c in enumerate(cols) for e in (adjusted_skew(c).alias(f"s{i}"), F.min(c).alias(f"m{i}"))]).first()
    picked = [c for i, c in enumerate(cols) if row[f"s{i}"] is not None and abs(row[f"s{i}"]) > limit and row[f"m{i}"] >= 0]
    return _add(df, {f"{c}_log": F.log1p(c) for c in picked})


def calendar_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Hour, weekday (0 = Monday), weekend flag; hours since the earliest timestamp column.

    Columns are found by name and kept only when they are dates, timestamps or readable text."""
    if columns is None:
        kinds = dict(df.dtypes)
        columns = [c for c in df.columns if any(t in c.lower() for t in K.TIMESTAMP_TERMS)
                   and kinds[c] in ("timestamp", "timestamp_ntz", "date", "string")]
    texts = [c for c, t in df.dtypes if c in columns and t == "string"]
    df = df.withColumns({c: F.try_to_timestamp(c) for c in texts}) if texts else df
    if not columns:
        return df
    row = df.agg(*[F.min(c).alias(c) for c in columns]).first()
    columns = [c for c in columns if row[c] is not None]
    new: dict[str, Column] = {}
    for c in columns:
        new[f"{c}_hour"] = F.hour(c)
        new[f"{c}_dayofweek"] = F.weekday(c)
        new[f"{c}_is_weekend"] = flag(F.weekday(c) >= 5)
    if len(columns) >= 2:
        first = min(columns, key=lambda c: row[c])
        for c in columns:
            if c != first:
                new[f"hours_since_{first}_to_{c}"] = hours_between(first, c)
    return _add(df, new)


def advanced_features(df: DataFrame) -> DataFrame:
    """Perfusion, oxygenation, renal and liver composites with five dysfunction flags."""
    new: dict[str, Column] = {}
    for name, a, b in (("shock_index_mean", "heart_rate_mean", "sbp_mean"), ("shock_index_max", "heart_rate_max", "sbp_min"),
                       ("bun_creatinine_ratio", "bun_mean", "creatinine_mean")):
        if _have(df, a, b):
            new[name] = ratio(a, b)
    if _have(df, "map_mean"):
        new["map_below_65"] = flag(rule("map_mean", "<", 65))
    if _have(df, "map_min"):
        new["map_min_below_60"] = flag(rule("map_min", "<", 60))
    flags: dict[str, Column] = {}
    if _have(df, "pao2_mean", "fio2_mean"):
        pf = ratio("pao2_mean", "fio2_mean")
        new["pf_ratio"] = pf
        new["mild_ards"] = flag((pf <= 300) & (pf > 200))
        new["moderate_ards"] = flag((pf <= 200) & (pf > 100))
        new["severe_ards"] = flag(pf <= 100)
        flags["resp_dysfunction"] = flag(pf < 300)
    if _have(df, "bilirubin_mean", "inr_mean"):
        new["liver_dysfunction_score"] = F.col("bilirubin_mean") / 1.2 + F.col("inr_mean") / 1.1
    if _have(df, "glucose_max", "glucose_min"):
        new["glucose_variability"] = F.col("glucose_max") - F.col("glucose_min")
    for name, c, op, t in (("cv_dysfunction", "map_min", "<", 70), ("renal_dysfunction", "creatinine_max", ">", 1.2),
                           ("hepatic_dysfunction", "bilirubin_max", ">", 1.2),
                           ("coag_dysfunction", "platelets_min", "<", 150)):
        if _have(df, c):
            flags[name] = flag(rule(c, op, t))
    if flags:
        new.update(flags)
        new["organ_dysfunction_count"] = _count(list(flags.values()))
    return _add(df, new)
