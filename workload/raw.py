"""Features from raw rows: coded readings of the event table, histories of the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.operators import cohort as C
from tidewatch.operators import onepass
from tidewatch.operators.events import bin_labels
from tidewatch.plans import raw_features as R
from tidewatch.sources import tables as S
from workload.base import FIRST, RECORD, STAYS, line_events, order_stays, query, rounded, table

HOURS, BIN, ANCHORS, EDGE = 168.0, 84.0, [0, 24, 48, 96, 168], 48.0
# item codes as the raw tables hold them, the last one unknown to the code tables
CHART = [220045, 220210, 220052, 223761, 223762, 220179, 220180, 220277, 226559, 226627, 226730, 226707, 226531, 226512, 999999]
LABS = [c for cs in K.LAB_CODES.values() for c in cs] + [999999]
VITALS, LAB_NAMES = list(K.VITAL_CODES), list(K.LAB_CODES)
VARIABLES = VITALS + LAB_NAMES
# temperatures and sizes are brought near the range of their unit
VALUE = """CASE WHEN event_id % 29 = 0 THEN NULL WHEN itemid = 226730 THEN 55.0e0 + event_id % 20 WHEN itemid = 226707 THEN 110.0e0 + event_id % 60
 WHEN itemid = 226531 THEN 90.0e0 + event_id % 211 WHEN itemid = 226512 THEN 25.0e0 + event_id % 97 ELSE value END"""


def raw_tables(spark, sf) -> R.RawTables:
    e = table(spark, sf, "events")
    listed = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % len(xs) + 1).cast("int"))
    kind = F.col("event_type").isin("purchase", "signup")
    rows = lambda cond, xs, key: e.where(cond).withColumn("itemid", listed(xs)).select(
        key, F.col("ts").alias("charttime"), "itemid", F.expr(VALUE).alias("valuenum"))
    cohort = e.groupBy(F.col("user_id").alias("stay_id")).agg(F.min("ts").alias("intime")).select(
        "stay_id", (F.col("stay_id") + 1).alias("subject_id"), (F.col("stay_id") * 10).alias("hadm_id"), "intime")
    stay = cohort.select("subject_id", "hadm_id", F.col("intime").alias("admittime"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderdate").alias("admittime"))
    patients = cohort.select("subject_id", F.when(F.col("subject_id") % 3 == 0, "M").otherwise("F").alias("gender"),
                             (20 + F.col("subject_id") % 80).alias("anchor_age"), F.lit(2019).alias("anchor_year"))
    p = table(spark, sf, "part")
    code = F.when(F.col("p_size") % 2 == 0, F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")).otherwise(
        F.concat(F.substring("p_type", 1, 1), (F.col("p_size") % 10).cast("string")))
    codes = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).join(
        o, F.col("l_orderkey") == F.col("hadm_id")).select("subject_id", "hadm_id", code.alias("icd_code"),
                                                           F.when(F.col("p_size") % 2 == 0, 9).otherwise(10).alias("icd_version"))
    # ids of orders and stays may meet, so orders' are negative
    codes, o = (d.withColumn("hadm_id", -F.col("hadm_id")) for d in (codes, o))
    return R.RawTables(cohort, rows(~kind, CHART, F.col("user_id").alias("stay_id")), rows(kind, LABS, (F.col("user_id") + 1).alias("subject_id")),
                       patients, stay.unionByName(o), codes, e.where("value > 200").select((F.col("user_id") + 1).alias("subject_id")))


def _values(codes: dict[str, list[int]]) -> str:
    return ", ".join(f"({c}, '{v}')" for v, cs in codes.items() for c in cs)


def _any(codes: list[int]) -> str:
    return ", ".join(map(str, codes))


def stats_sql(hours: float, bin_hours: float, anchors: list[int], tolerance: float, first_limit: float, edge: float, variables: list[str]) -> str:
    """Tables from ``win`` (stay_id, charttime, variable, source, h, v) to ``s``, one row per stay and variable, and totals ``tot``."""
    labels, near = bin_labels(hours, bin_hours), []
    for a in anchors:
        cond = f"h <= {first_limit}" if a == 0 else f"h BETWEEN {max(0.0, a - tolerance)} AND {a + tolerance}"
        near.append(f"arg_min(v, (abs(h - {a}), h, v)) FILTER ({cond}) AS hour_{a}")
    bad = " OR ".join(f"(variable = '{v}' AND (v < {a} OR v > {b}))" for v, (a, b) in K.NORMAL_RANGES.items())
    bins = ", ".join(f"round(avg(v) FILTER (b = {i}), 6) AS {x}_mean, round(min(v) FILTER (b = {i}), 6) AS {x}_min, round(max(v) FILTER (b = {i}), 6) AS {x}_max, "
                     f"round(arg_max(v, (charttime, v)) FILTER (b = {i}), 6) AS {x}_last, max(1) FILTER (b = {i}) AS {x}_observed, count(*) FILTER (b = {i}) AS {x}_count"
                     for i, x in enumerate(labels))
    return f"""ok AS (SELECT *, CAST(least(floor(h / {bin_hours}), {len(labels) - 1}) AS INTEGER) AS b,
 lead(h) OVER (PARTITION BY stay_id, variable ORDER BY charttime, v) - h AS dt, coalesce({bad}, false) AS bad FROM win WHERE v IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY stay_id, variable ORDER BY charttime, v) - row_number() OVER (PARTITION BY stay_id, variable, bad ORDER BY charttime, v) AS island FROM ok),
runs AS (SELECT stay_id, variable, max(n) AS run FROM (SELECT stay_id, variable, island, count(*) AS n FROM o WHERE bad GROUP BY 1, 2, 3) q GROUP BY 1, 2),
a AS (SELECT stay_id, variable, round(CASE WHEN coalesce(sum(dt), 0) > 0 THEN sum(v * dt) / sum(dt) ELSE avg(v) END, 6) AS weighted, round(avg(v), 6) AS plain,
 round(min(v), 6) AS min, round(max(v), 6) AS max, 1 AS measured, round(sum(v), 6) AS total, arg_min(v, (charttime, v)) AS f, arg_max(v, (charttime, v)) AS l,
 avg(v) FILTER (h <= {edge}) AS f2, avg(v) FILTER (h >= {hours} - {edge}) AS l2, CASE WHEN count(DISTINCT h) > 1 THEN regr_slope(v, h) END AS slope,
 max(v) - min(v) AS rng, CASE WHEN count(*) > 1 THEN stddev_pop(v) END AS sd, avg(v) AS m, count(*) FILTER (bad) AS nbad, max(v) FILTER (h >= {hours} - {edge}) AS worst,
 {', '.join(near)}, {bins} FROM ok GROUP BY 1, 2),
mp AS (SELECT stay_id, variable, 1 AS measured_0_6h, count(*) AS measurement_count_0_6h, round(min(h), 6) AS time_to_first_measurement,
 round({hours} - max(h), 6) AS time_since_last_measurement_at_6h FROM win GROUP BY 1, 2),
s AS (SELECT mp.*, a.* EXCLUDE (stay_id, variable), coalesce(run, 0) AS run, round(l - f, 6) AS last_minus_first, round((l - f) / nullif(abs(f), 0), 6) AS percent_change,
 CASE WHEN (l - f) / nullif(abs(f), 0) >= 0.1 THEN 1 WHEN measured = 1 THEN 0 END AS deterioration_flag,
 CASE WHEN (l - f) / nullif(abs(f), 0) <= -0.1 THEN 1 WHEN measured = 1 THEN 0 END AS recovery_flag
 FROM mp LEFT JOIN a USING (stay_id, variable) LEFT JOIN runs USING (stay_id, variable)),
tot AS (SELECT stay_id, count(*) AS n, count(*) FILTER (source = 'lab') AS lab, count(*) FILTER (source = 'vital') AS vital, count(DISTINCT variable) AS kinds
 FROM win WHERE variable IN ({', '.join(f"'{v}'" for v in variables)}) GROUP BY 1)"""


def columns_sql(vitals: list[str], labs: list[str], hours: float, bin_hours: float, anchors: list[int]) -> str:
    """Feature columns from ``s`` and ``tot``, grouped by stay."""
    low, high, labels = min(anchors), max(anchors), bin_labels(hours, bin_hours)
    cols = []

    def add(v, name, expr, zero=False):
        x = f"max({expr}) FILTER (variable = '{v}')"
        cols.append(f"{f'coalesce({x}, 0)' if zero else x} AS {v}_{name}")

    for v in [*vitals, *labs]:
        for name, expr in [("mean", "weighted" if v in vitals else "plain"), ("min", "min"), ("max", "max")] + (
                [] if v in vitals else [("delta", "last_minus_first")]) + [(f"hour_{a}", f"round(hour_{a}, 6)") for a in anchors]:
            add(v, name, expr)
        add(v, "measured", "measured", True)
        add(v, f"change_{low}to{high}", f"round(hour_{high} - hour_{low}, 6)")
        add(v, "hourly_change", f"round((hour_{high} - hour_{low}) / {high - low}, 6)")
        for a, b in zip(anchors[:-1], anchors[1:]):
            add(v, f"delta_{a}to{b}", f"round(hour_{b} - hour_{a}, 6)")
        for name, expr in [("first", "round(f, 6)"), ("last", "round(l, 6)"), ("last_minus_first", "last_minus_first"), ("percent_change", "percent_change"),
                           ("first_2h_mean", "round(f2, 6)"), ("last_2h_mean", "round(l2, 6)"), ("last2h_minus_first2h", "round(l2 - f2, 6)"),
                           ("slope_0_6h", "round(slope, 6)"), ("deterioration_flag", "deterioration_flag"), ("recovery_flag", "recovery_flag"),
                           ("range_0_6h", "round(rng, 6)"), ("std_0_6h", "round(CASE WHEN measured = 1 THEN coalesce(sd, 0) END, 6)"),
                           ("cv_0_6h", "round(sd / nullif(abs(m), 0), 6)"), ("abnormal_count_0_6h", "nbad"),
                           ("longest_abnormal_run_0_6h", "CASE WHEN measured = 1 THEN run END"), ("worst_recent_value_0_6h", "round(worst, 6)")]:
            add(v, name, expr)
        for x in labels:
            for name in ("mean", "min", "max", "last", "observed", "count"):
                add(v, f"{x}_{name}", f"{x}_{name}", name in ("observed", "count"))
        for name in onepass.PROCESS:
            add(v, name, name, name in ("measured_0_6h", "measurement_count_0_6h"))
    return ", ".join(cols) + f""", coalesce(max(tot.n), 0) AS total_measurements_0_6h, coalesce(max(tot.n), 0) AS total_chart_event_count_0_6h,
 coalesce(max(tot.lab), 0) AS total_lab_measurements_0_6h, coalesce(max(tot.vital), 0) AS total_vital_measurements_0_6h,
 coalesce({len(vitals) + len(labs)} - max(kinds), 0) AS panel_missing_count_0_6h"""


def _sql() -> str:
    pick = lambda xs: f"([{_any(xs)}])[event_id % {len(xs)} + 1]"
    raw = lambda cond, xs, source: (f"SELECT user_id AS stay_id, ts AS charttime, itemid, '{source}' AS source, {VALUE} AS x FROM "
                                    f"(SELECT *, {pick(xs)} AS itemid FROM events WHERE event_type {cond} ('purchase', 'signup')) q")
    chapter9 = " ".join(f"WHEN TRY_CAST(icd_code AS INTEGER) BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in K.ICD9_RANGES)
    chapter10 = " ".join(f"WHEN regexp_matches(icd_code, '{p}') THEN '{n}'" for p, n in K.ICD10_PREFIXES)
    cte = f"""WITH cohort AS (SELECT user_id AS stay_id, user_id + 1 AS subject_id, user_id * 10 AS hadm_id, min(ts) AS intime FROM events GROUP BY user_id),
items AS (SELECT * FROM (VALUES {_values(K.VITAL_CODES | K.LAB_CODES | R.OTHER)}) t(itemid, variable)),
rows AS ({raw('NOT IN', CHART, 'vital')} UNION ALL {raw('IN', LABS, 'lab')}),
win AS (SELECT r.stay_id, charttime, variable, source, (epoch_us(charttime) - epoch_us(intime)) / 3600000000.0 AS h,
 CASE WHEN itemid IN ({_any(K.FAHRENHEIT_CODES)}) THEN (x - 32) * 5 / 9 WHEN itemid IN ({_any(K.INCH_CODES)}) THEN x * 2.54e0
 WHEN itemid IN ({_any(K.POUND_CODES)}) THEN x * 0.453592e0 ELSE x END AS v
 FROM rows r JOIN items USING (itemid) JOIN cohort c ON r.stay_id = c.stay_id WHERE charttime >= intime AND charttime <= intime + INTERVAL '168 hours'),
{stats_sql(HOURS, BIN, ANCHORS, 12.0, 14.0, EDGE, VARIABLES)},
dx AS (SELECT o_custkey AS subject_id, CASE WHEN p_size % 2 = 0 THEN lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0')
 ELSE substr(p_type, 1, 1) || CAST(p_size % 10 AS VARCHAR) END AS icd_code, CASE WHEN p_size % 2 = 0 THEN 9 ELSE 10 END AS icd_version, o_orderdate
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
ch AS (SELECT c.subject_id, CASE WHEN icd_version = 9 THEN CASE {chapter9} ELSE 'other_icd9' END ELSE CASE {chapter10} ELSE 'other_icd10' END END AS ch
 FROM dx JOIN cohort c ON c.subject_id = dx.subject_id AND o_orderdate < intime),
hist AS (SELECT subject_id, {', '.join(f"count(*) FILTER (ch = '{c}') AS prev_dx_{c}_count" for c in K.CHAPTERS)}, count(*) AS prev_dx_count_total FROM ch GROUP BY 1),
met AS (SELECT subject_id, max(CASE WHEN icd_version = 9 AND (icd_code IN ('1990', '1991') OR substr(icd_code, 1, 3) IN ('196', '197', '198')) THEN 1
 WHEN icd_version = 10 AND substr(icd_code, 1, 3) IN ('C77', 'C78', 'C79', 'C7B', 'C80') THEN 1 ELSE 0 END) AS met FROM dx GROUP BY 1),
bmi AS (SELECT stay_id, CASE WHEN hgt BETWEEN 120 AND 220 AND wgt BETWEEN 30 AND 300 THEN wgt / ((hgt / 100) * (hgt / 100)) END AS bmi FROM
 (SELECT stay_id, max(f) FILTER (variable = 'height') AS hgt, max(f) FILTER (variable = 'weight') AS wgt FROM s GROUP BY 1) q)"""
    hist = ", ".join(f"coalesce(max(prev_dx_{c}_count), 0) AS prev_dx_{c}_count" for c in K.CHAPTERS)
    return cte + f""" SELECT c.stay_id, c.subject_id, c.hadm_id, {columns_sql(VITALS, LAB_NAMES, HOURS, BIN, ANCHORS)},
 max(s.total) FILTER (s.variable = 'urine_output') AS urine_output_total, coalesce(max(s.measured) FILTER (s.variable = 'urine_output'), 0) AS urine_output_measured,
 round(max(bmi.bmi), 6) AS bmi, CASE WHEN max(bmi.bmi) IS NULL THEN 0 ELSE 1 END AS bmi_measured,
 CAST(least(20 + c.subject_id % 80 + year(c.intime) - 2019, 90) AS INTEGER) AS age, CASE WHEN c.subject_id % 3 = 0 THEN 1 ELSE 0 END AS gender_numeric,
 CASE WHEN coalesce(max(prev_dx_count_total), 0) > 0 THEN 1 ELSE 0 END AS has_prior_diagnoses, {hist}, coalesce(max(prev_dx_count_total), 0) AS prev_dx_count_total,
 coalesce(max(met.met), 0) AS has_metastatic_cancer,
 CASE WHEN c.subject_id IN (SELECT user_id + 1 FROM events WHERE value > 200) THEN 1 ELSE 0 END AS mortality
 FROM cohort c LEFT JOIN s USING (stay_id) LEFT JOIN tot USING (stay_id) LEFT JOIN bmi USING (stay_id) LEFT JOIN hist USING (subject_id) LEFT JOIN met USING (subject_id)
 GROUP BY c.stay_id, c.subject_id, c.hadm_id, c.intime"""


def options(**more) -> R.RawOptions:
    return R.RawOptions(hours=HOURS, bin_hours=BIN, anchors=ANCHORS, tolerance=12.0, first_limit=14.0, edge_hours=EDGE, row_rules=False, **more)


@query("raw_feature_table", _sql())
def raw_feature_table(spark, sf):
    return rounded(R.raw_features(raw_tables(spark, sf), options()))


@query("bridge_overlapping", f"""WITH {STAYS}
SELECT o_custkey AS subject_id, o_orderdate AS charttime, o_totalprice AS valuenum, stay_id FROM orders JOIN stays ON o_custkey = subject_id
 AND o_orderdate BETWEEN intime AND outtime""")
def bridge_overlapping(spark, sf):
    ev = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("charttime"), F.col("o_totalprice").alias("valuenum"))
    out = C.bridge_overlapping(ev, order_stays(spark, sf), width=2400.0)
    return out.select("subject_id", "charttime", "valuenum", "stay_id")


@query("cohort_flow_observed", f"""WITH {STAYS}, {FIRST}, {RECORD}, j AS (
 SELECT *, (epoch_us(outtime) - epoch_us(earliest_record)) / 3600000000.0 AS d FROM firsts LEFT JOIN rec USING (stay_id)),
a AS (SELECT (SELECT count(*) FROM stays) AS t, count(*) AS f, count(*) FILTER (earliest_record IS NULL) AS nr, count(*) FILTER (d < 1920) AS sh,
 count(*) FILTER (d >= 1920) AS k, (SELECT count(*) FROM lineitem) AS e FROM j)
SELECT CAST(i AS INTEGER) AS step, ['total_stays', 'subjects', 'first_stays', 'excluded_repeat_stays', 'excluded_no_record', 'excluded_short', 'final_cohort',
 'events_read', 'events_without_time'][i + 1] AS name, [t, f, f, t - f, nr, sh, k, e, 0][i + 1] AS n FROM a, range(9) r(i)""")
def cohort_flow_observed(spark, sf):
    return C.observed_cohort(order_stays(spark, sf), line_events(spark, sf), min_hours=1920.0)[1]


_ITEMS = {1: "first_line", 2: "second_line", 3: "third_line"}


@query("event_scan_observed", f"""WITH {STAYS}, l AS (SELECT l_orderkey, l_shipdate, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem),
s AS (SELECT * FROM stays WHERE stay_id % 5 <> 0), j AS (SELECT l.*, s.stay_id, (epoch_us(l_shipdate) - epoch_us(intime)) / 3600000000.0 AS h FROM l LEFT JOIN s ON l_orderkey = stay_id),
a AS (SELECT count(*) AS r, count(*) FILTER (v IS NULL) AS nu, count(*) FILTER (v IS NOT NULL AND l_linenumber > 3) AS un,
 count(*) FILTER (v IS NOT NULL AND l_linenumber <= 3 AND stay_id IS NULL) AS ns,
 count(*) FILTER (v IS NOT NULL AND l_linenumber <= 3 AND NOT (h >= 0 AND h <= 720)) AS ow, count(*) FILTER (v IS NOT NULL AND l_linenumber <= 3 AND h >= 0 AND h <= 720) AS k FROM j)
SELECT CAST(i AS INTEGER) AS step, ['read', 'dropped_null', 'dropped_unknown_item', 'dropped_no_stay', 'dropped_outside_window', 'kept'][i + 1] AS name,
 [r, nu, un, ns, ow, k][i + 1] AS n FROM a, range(6) q(i)""")
def event_scan_observed(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stay_id"), F.col("l_shipdate").alias("charttime"), F.col("l_linenumber").alias("itemid"),
                                             F.when(F.col("l_partkey") % 11 == 0, None).otherwise(F.col("l_quantity")).alias("valuenum"))
    stays = order_stays(spark, sf).where("stay_id % 5 <> 0").select("stay_id", "intime")
    return S.observed_event_scan(li, stays, spark.createDataFrame(list(_ITEMS.items()), "itemid int, variable string"), max_hours=720.0)[1]


@query("collect_files", """SELECT 'run1' AS run_name, 'geography' AS stage, 'region.parquet' AS source_file, r_regionkey, r_name,
 CAST(NULL AS BIGINT) AS p_partkey, CAST(NULL AS VARCHAR) AS p_brand FROM region
UNION ALL SELECT 'run1', 'parts', 'part.parquet', NULL, NULL, p_partkey, p_brand FROM part""")
def collect_files(spark, sf):
    out = S.collect_files(spark, {("run1", "geography"): f"{sf}/region.parquet", ("run1", "parts"): f"{sf}/part.parquet"})
    return out.select("run_name", "stage", "source_file", "r_regionkey", "r_name", "p_partkey", "p_brand")
