"""Scans, cohort, windows and event aggregation on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import cohort as C
from tidewatch.operators import events as E
from tidewatch.operators import joins as J
from tidewatch.operators import windows as W
from tidewatch.sources import tables as S
from workload.base import (BIN, EV, FIRST, HOURS, RECORD, SOURCES, STAYS, VARIABLES, event_cohort, line_events,
                           long_events, order_stays, query, rounded, table, win_sql)

ITEMS = {1: "first_line", 2: "second_line", 3: "third_line", 5: "fifth_line"}
ITEM_SQL = "items AS (SELECT * FROM (VALUES (1,'first_line'),(2,'second_line'),(3,'third_line'),(5,'fifth_line')) t(itemid, variable))"


def _items(spark):
    return spark.createDataFrame(list(ITEMS.items()), "itemid int, variable string")


def _win(spark, sf, hours=HOURS):
    return W.windowed_events(long_events(spark, sf), event_cohort(spark, sf), hours=hours, variable_col="variable")


# --- scans ---------------------------------------------------------------------------------
@query("scan_project", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def scan_project(spark, sf):
    return S.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_shipdate"])


@query("event_scan_filtered", f"""WITH {STAYS}, {ITEM_SQL}
SELECT s.stay_id, i.variable, round((epoch_us(l.l_shipdate) - epoch_us(s.intime)) / 3600000000.0, 6) AS hours_from_admit,
  l.l_quantity AS valuenum
FROM lineitem l JOIN items i ON l.l_linenumber = i.itemid JOIN stays s ON s.stay_id = l.l_orderkey
WHERE l.l_shipdate <= s.intime + INTERVAL '720 hours' AND l.l_shipdate >= s.intime""")
def event_scan_filtered(spark, sf):
    return rounded(S.filtered_event_scan(line_events(spark, sf), order_stays(spark, sf).select("stay_id", "intime"),
                                         _items(spark), max_hours=720.0))


@query("parse_timestamps", """SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS strict_ts,
 CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS coerced_ts FROM orders""")
def parse_timestamps(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("strict_ts"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("not a time")).otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("coerced_ts"))
    out = S.parse_timestamps(S.parse_timestamps(o, ["strict_ts"]), ["coerced_ts"], coerce=True)
    return out.select("o_orderkey", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("strict_ts", "coerced_ts")])


@query("table_contract", """WITH r AS (SELECT count(*) > 0 AS ok FROM lineitem)
SELECT 'lineitem' AS table_name, c AS check_name, p AS passed FROM (VALUES ('column:l_orderkey', true),
 ('column:l_shipdate', true), ('column:stay_id', false)) t(c, p)
UNION ALL SELECT 'lineitem', 'has_rows', ok FROM r""")
def table_contract(spark, sf):
    return S.table_contract(table(spark, sf, "lineitem"), "lineitem", ["l_orderkey", "l_shipdate", "stay_id"])


@query("collect_results", """SELECT 'run1' AS run_name, 'returns' AS stage, 'lineitem' AS source_file,
 l_returnflag AS group_value, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, CAST(NULL AS DOUBLE) AS mean_price
 FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'run1', 'priorities', 'orders', o_orderpriority, count(*), NULL, round(avg(o_totalprice), 4)
 FROM orders GROUP BY o_orderpriority""")
def collect_results(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("group_value")).agg(
        F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    b = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("group_value")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    return S.collect_results([("run1", "returns", "lineitem", a), ("run1", "priorities", "orders", b)])


# --- cohort --------------------------------------------------------------------------------
@query("first_per_entity", f"WITH {STAYS}, {FIRST} SELECT * FROM firsts")
def first_per_entity(spark, sf):
    return C.first_per_entity(order_stays(spark, sf))


@query("cohort_select", f"""WITH {STAYS}, {FIRST}, {RECORD}
SELECT f.stay_id, subject_id, intime, outtime, earliest_record,
 round((epoch_us(outtime) - epoch_us(earliest_record)) / 3600000000.0, 6) AS duration_hours
FROM firsts f JOIN rec USING (stay_id) WHERE (epoch_us(outtime) - epoch_us(earliest_record)) / 3600000000.0 >= 1920""")
def cohort_select(spark, sf):
    return rounded(C.select_cohort(order_stays(spark, sf), line_events(spark, sf), min_hours=1920.0))


@query("cohort_flow", f"""WITH {STAYS}, {FIRST}, {RECORD}, j AS (
 SELECT *, (epoch_us(outtime) - epoch_us(earliest_record)) / 3600000000.0 AS d FROM firsts LEFT JOIN rec USING (stay_id)),
a AS (SELECT (SELECT count(*) FROM stays) AS t, (SELECT count(DISTINCT subject_id) FROM stays) AS s, count(*) AS f,
 count(*) FILTER (earliest_record IS NULL) AS nr, count(*) FILTER (d < 1920) AS sh, count(*) FILTER (d >= 1920) AS k FROM j)
SELECT 0 AS step, 'total_stays' AS name, t AS n FROM a UNION ALL SELECT 1, 'subjects', s FROM a
UNION ALL SELECT 2, 'first_stays', f FROM a UNION ALL SELECT 3, 'excluded_repeat_stays', t - f FROM a
UNION ALL SELECT 4, 'excluded_no_record', nr FROM a UNION ALL SELECT 5, 'excluded_short', sh FROM a
UNION ALL SELECT 6, 'final_cohort', k FROM a""")
def cohort_flow(spark, sf):
    return C.cohort_flow(order_stays(spark, sf), line_events(spark, sf), min_hours=1920.0)


# --- windows and maps -------------------------------------------------------------------------
@query("window_filter", win_sql(6) + " SELECT stay_id, charttime, variable, source, valuenum FROM win")
def window_filter(spark, sf):
    return W.filter_to_window(long_events(spark, sf), event_cohort(spark, sf), hours=6.0)


@query("windowed_events", win_sql() + """ SELECT stay_id, charttime, variable, source, valuenum,
 round(h, 6) AS hours_from_admit FROM win""")
def windowed_events(spark, sf):
    return rounded(_win(spark, sf))


@query("code_map", f"WITH {ITEM_SQL} SELECT l_orderkey AS stay_id, l_shipdate AS charttime, itemid, variable, "
       "round(CASE WHEN itemid = 2 THEN (l_quantity - 32) * 5 / 9 ELSE l_quantity END, 6) AS valuenum "
       "FROM lineitem JOIN items ON l_linenumber = itemid")
def code_map(spark, sf):
    out = C.map_codes(line_events(spark, sf), _items(spark), value="valuenum", fahrenheit=[2])
    return rounded(out.select("stay_id", "charttime", "itemid", "variable", "valuenum"))


@query("dict_regex_lookup", """SELECT DISTINCT p_partkey FROM part
WHERE regexp_matches(p_name, '(?i)BOLT|widget') OR p_partkey IN (1, 2)""")
def dict_regex_lookup(spark, sf):
    return C.codes_by_label(table(spark, sf, "part"), "BOLT|widget", "p_partkey", "p_name", [1, 2])


@query("semi_filter", """SELECT l_orderkey AS stay_id, l_shipdate AS charttime, l_linenumber AS itemid,
 l_quantity AS valuenum FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def semi_filter(spark, sf):
    keep = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("stay_id"))
    return J.keep_members(line_events(spark, sf), keep, "stay_id", by=["charttime", "itemid"])


@query("bridge_join", f"""WITH {STAYS}, {FIRST}
SELECT o_custkey AS subject_id, o_orderdate AS charttime, o_totalprice AS valuenum, stay_id
FROM orders JOIN firsts ON o_custkey = subject_id""")
def bridge_join(spark, sf):
    ev = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"),
                                           F.col("o_orderdate").alias("charttime"),
                                           F.col("o_totalprice").alias("valuenum"))
    return C.bridge(ev, order_stays(spark, sf))


@query("union_events", f"WITH {EV} SELECT * FROM ev WHERE source = 'vital' UNION ALL SELECT * FROM ev WHERE source = 'lab'")
def union_events(spark, sf):
    e = long_events(spark, sf)
    return e.where("source = 'vital'").unionByName(e.where("source = 'lab'"))


@query("distinct_keys", f"WITH {EV} SELECT DISTINCT stay_id, variable FROM ev")
def distinct_keys(spark, sf):
    return long_events(spark, sf).select("stay_id", "variable").distinct()


@query("missing_ids", """SELECT c_custkey AS subject_id FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def missing_ids(spark, sf):
    have = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("subject_id"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id")).join(have, "subject_id", "left_anti")


# --- summaries -----------------------------------------------------------------------------
def _wide_sql(cte: str, src: str, stats: list[str], zero: tuple[str, ...] = ()) -> str:
    cols = []
    for v in VARIABLES:
        for s in stats:
            x = f"max({s}) FILTER (variable = '{v}')"
            cols.append(f"coalesce({x}, 0) AS {v}_{s}" if s in zero else f"{x} AS {v}_{s}")
    return cte + f" SELECT c.stay_id, {', '.join(cols)} FROM cohort c LEFT JOIN {src} s USING (stay_id) GROUP BY c.stay_id"


@query("vital_summary", _wide_sql(win_sql() + """, nx AS (SELECT *, lead(h) OVER (PARTITION BY stay_id, variable ORDER BY charttime, valuenum) - h AS dt FROM win),
vs AS (SELECT stay_id, variable, round(CASE WHEN coalesce(sum(dt), 0) > 0 THEN sum(valuenum * dt) / sum(dt) ELSE avg(valuenum) END, 6) AS mean,
 min(valuenum) AS min, max(valuenum) AS max, 1 AS measured FROM nx GROUP BY 1, 2)""", "vs", ["mean", "min", "max", "measured"], ("measured",)))
def vital_summary(spark, sf):
    s = rounded(E.vital_summary(_win(spark, sf), hours=HOURS))
    out = E.spread(s, "stay_id", "variable", VARIABLES, ["mean", "min", "max", "measured"])
    return E.attach(event_cohort(spark, sf), out, "stay_id", [f"{v}_measured" for v in VARIABLES])


@query("lab_summary", _wide_sql(win_sql() + """, ls AS (SELECT stay_id, variable, round(avg(valuenum), 6) AS mean, min(valuenum) AS min,
 max(valuenum) AS max, round(arg_max(valuenum, charttime) - arg_min(valuenum, charttime), 6) AS delta, 1 AS measured FROM win GROUP BY 1, 2)""",
    "ls", ["mean", "min", "max", "delta", "measured"], ("measured",)))
def lab_summary(spark, sf):
    s = rounded(E.lab_summary(_win(spark, sf)))
    out = E.spread(s, "stay_id", "variable", VARIABLES, ["mean", "min", "max", "delta", "measured"])
    return E.attach(event_cohort(spark, sf), out, "stay_id", [f"{v}_measured" for v in VARIABLES])


@query("outer_merge_vs_pivot", win_sql() + ", " + ", ".join(
    f"m_{v} AS (SELECT stay_id, round(avg(valuenum), 6) AS {v}_mean FROM win WHERE variable = '{v}' GROUP BY 1)"
    for v in VARIABLES) + " SELECT stay_id, " + ", ".join(f"{v}_mean" for v in VARIABLES) + " FROM m_click "
    + " ".join(f"FULL JOIN m_{v} USING (stay_id)" for v in VARIABLES[1:]))
def outer_merge_vs_pivot(spark, sf):
    wide = _win(spark, sf).groupBy("stay_id").pivot("variable", VARIABLES).agg(F.avg("valuenum"))
    return rounded(wide.select("stay_id", *[F.col(v).alias(f"{v}_mean") for v in VARIABLES]))


@query("codeset_summary", win_sql() + """ SELECT c.stay_id, round(avg(valuenum), 6) AS inr_mean, max(valuenum) AS inr_max,
 CASE WHEN count(valuenum) > 0 THEN 1 ELSE 0 END AS inr_measured
 FROM cohort c LEFT JOIN (SELECT * FROM win WHERE variable IN ('error', 'signup')) w USING (stay_id) GROUP BY c.stay_id""")
def codeset_summary(spark, sf):
    w = _win(spark, sf).where(F.col("variable").isin("error", "signup"))
    return rounded(E.codeset_summary(event_cohort(spark, sf), w, "inr"))


@query("windowed_sum", win_sql(6) + """ SELECT c.stay_id, round(sum(valuenum), 6) AS urine_output_total,
 CASE WHEN count(valuenum) > 0 THEN 1 ELSE 0 END AS urine_output_measured
 FROM cohort c LEFT JOIN (SELECT * FROM win WHERE variable IN ('click', 'purchase')) w USING (stay_id) GROUP BY c.stay_id""")
def windowed_sum(spark, sf):
    w = _win(spark, sf, 6.0).where(F.col("variable").isin("click", "purchase"))
    return rounded(E.windowed_sum(event_cohort(spark, sf), w, "urine_output"))


@query("first_reading_ratio", win_sql() + """, r AS (SELECT stay_id,
 arg_min(CASE WHEN variable = 'click' THEN (100 + valuenum) * 1.0 ELSE 40 * 2.54 + valuenum END, charttime) FILTER (variable IN ('click', 'view')) AS hgt,
 arg_min(CASE WHEN variable = 'error' THEN (60 + valuenum) * 0.453592 ELSE 20 + valuenum END, charttime) FILTER (variable IN ('error', 'signup')) AS wgt
 FROM win GROUP BY stay_id), b AS (SELECT stay_id, CASE WHEN hgt BETWEEN 120 AND 220 AND wgt BETWEEN 30 AND 300
 THEN wgt / ((hgt / 100) * (hgt / 100)) END AS bmi FROM r)
SELECT c.stay_id, round(bmi, 6) AS bmi, CASE WHEN bmi IS NULL THEN 0 ELSE 1 END AS bmi_measured FROM cohort c LEFT JOIN b USING (stay_id)""")
def first_reading_ratio(spark, sf):
    v, x = F.col("variable"), F.col("valuenum")
    height = F.when(v == "click", (100 + x) * 1.0).otherwise(40 * 2.54 + x)
    weight = F.when(v == "error", (60 + x) * 0.453592).otherwise(20 + x)
    return rounded(E.first_reading_ratio(event_cohort(spark, sf), _win(spark, sf), is_height=v.isin("click", "view"),
                                         is_weight=v.isin("error", "signup"), height=height, weight=weight,
                                         tiebreak="variable"))


ANCHORS = [0, 24, 48, 96, 168]


def _near_sql() -> str:
    parts = []
    for a in ANCHORS:
        cond = "h <= 14.0" if a == 0 else f"h BETWEEN {a} - 12.0 AND {a} + 12.0"
        parts.append(f"arg_min(valuenum, (abs(h - {a}), h, valuenum)) FILTER ({cond}) AS hour_{a}")
    return win_sql() + ", near AS (SELECT stay_id, variable, " + ", ".join(parts) + " FROM win GROUP BY 1, 2)"


@query("nearest_in_window", _near_sql() + " SELECT * FROM near")
def nearest_in_window(spark, sf):
    return E.nearest_at_anchors(_win(spark, sf), ANCHORS, tolerance=12.0, first_limit=14.0)


@query("anchor_changes", _near_sql() + " SELECT stay_id, variable, " + ", ".join(f"hour_{a}" for a in ANCHORS)
       + ", round(hour_168 - hour_0, 6) AS change_0to168, round((hour_168 - hour_0) / 168, 6) AS hourly_change, "
       + ", ".join(f"round(hour_{b} - hour_{a}, 6) AS delta_{a}to{b}" for a, b in zip(ANCHORS[:-1], ANCHORS[1:]))
       + " FROM near")
def anchor_changes(spark, sf):
    near = E.nearest_at_anchors(_win(spark, sf), ANCHORS, tolerance=12.0, first_limit=14.0)
    return rounded(E.anchor_changes(near, ANCHORS, ["stay_id", "variable"]))


def _bins_sql() -> str:
    cte = win_sql() + f""", b AS (SELECT stay_id, variable, CAST(least(floor(h / {BIN}), 5) AS INTEGER) AS b, round(avg(valuenum), 6) AS mean,
 min(valuenum) AS min, max(valuenum) AS max, arg_max(valuenum, charttime) AS last, 1 AS observed, count(valuenum) AS count FROM win GROUP BY 1, 2, 3)"""
    cols = []
    for v in VARIABLES:
        for i, lab in enumerate(E.bin_labels(HOURS, BIN)):
            for s in ("mean", "min", "max", "last", "observed", "count"):
                x = f"max({s}) FILTER (variable = '{v}' AND b = {i})"
                cols.append(f"{'coalesce(' + x + ', 0)' if s in ('observed', 'count') else x} AS {v}_{lab}_{s}")
    return cte + f" SELECT c.stay_id, {', '.join(cols)} FROM cohort c LEFT JOIN b USING (stay_id) GROUP BY c.stay_id"


@query("hourly_bins", _bins_sql())
def hourly_bins(spark, sf):
    return rounded(E.hourly_bins(_win(spark, sf), event_cohort(spark, sf), VARIABLES, hours=HOURS, bin_hours=BIN))


TRAJ = ["first", "last", "last_minus_first", "percent_change", "first_2h_mean", "last_2h_mean", "last2h_minus_first2h",
        "slope_0_6h", "deterioration_flag", "recovery_flag"]


@query("trajectory", _wide_sql(win_sql() + """, t0 AS (SELECT stay_id, variable, arg_min(valuenum, charttime) AS first, arg_max(valuenum, charttime) AS last,
 avg(valuenum) FILTER (h <= 48) AS f2, avg(valuenum) FILTER (h >= 120) AS l2,
 CASE WHEN count(DISTINCT h) >= 2 THEN regr_slope(valuenum, h) END AS slope FROM win GROUP BY 1, 2),
t AS (SELECT stay_id, variable, first, last, round(last - first, 6) AS last_minus_first, round((last - first) / nullif(abs(first), 0), 6) AS percent_change,
 round(f2, 6) AS first_2h_mean, round(l2, 6) AS last_2h_mean, round(l2 - f2, 6) AS last2h_minus_first2h, round(slope, 6) AS slope_0_6h,
 CASE WHEN (last - first) / nullif(abs(first), 0) >= 0.1 THEN 1 ELSE 0 END AS deterioration_flag,
 CASE WHEN (last - first) / nullif(abs(first), 0) <= -0.1 THEN 1 ELSE 0 END AS recovery_flag FROM t0)""", "t", TRAJ))
def trajectory(spark, sf):
    t = rounded(E.trajectory(_win(spark, sf), hours=HOURS, edge_hours=48.0))
    return E.attach(event_cohort(spark, sf), E.spread(t, "stay_id", "variable", VARIABLES, TRAJ), "stay_id")


RANGES = {"click": (10, 100), "error": (0, 60), "purchase": (5, 80), "view": (20, 90)}
_BAD = " OR ".join(f"(variable = '{v}' AND (valuenum < {a} OR valuenum > {b}))" for v, (a, b) in RANGES.items())
INST = ["range_0_6h", "std_0_6h", "cv_0_6h", "abnormal_count_0_6h", "longest_abnormal_run_0_6h", "worst_recent_value_0_6h"]
_RUNS = f""", o AS (SELECT *, ({_BAD}) AS bad, row_number() OVER (PARTITION BY stay_id, variable ORDER BY charttime, valuenum) AS rn FROM win),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY stay_id, variable, bad ORDER BY charttime, valuenum) AS island FROM o),
runs AS (SELECT stay_id, variable, max(n) AS run FROM (SELECT stay_id, variable, island, count(*) AS n FROM g WHERE bad GROUP BY 1, 2, 3) x GROUP BY 1, 2)"""


@query("longest_run", win_sql() + _RUNS + """ SELECT DISTINCT w.stay_id, w.variable, coalesce(run, 0) AS longest_run
 FROM win w LEFT JOIN runs r ON w.stay_id = r.stay_id AND w.variable = r.variable""")
def longest_run(spark, sf):
    return E.longest_run(_win(spark, sf), E.out_of_range(RANGES), hours=HOURS)


@query("instability", _wide_sql(win_sql() + _RUNS + f""", s AS (SELECT stay_id, variable, round(max(valuenum) - min(valuenum), 6) AS range_0_6h,
 round(CASE WHEN count(*) > 1 THEN stddev_pop(valuenum) ELSE 0 END, 6) AS std_0_6h,
 round(CASE WHEN count(*) > 1 THEN stddev_pop(valuenum) / nullif(abs(avg(valuenum)), 0) END, 6) AS cv_0_6h,
 count(*) FILTER ({_BAD}) AS abnormal_count_0_6h, max(valuenum) FILTER (h >= 120) AS worst_recent_value_0_6h FROM win GROUP BY 1, 2),
inst AS (SELECT s.*, coalesce(run, 0) AS longest_abnormal_run_0_6h FROM s LEFT JOIN runs USING (stay_id, variable))""", "inst", INST))
def instability(spark, sf):
    t = rounded(E.instability(_win(spark, sf), hours=HOURS, edge_hours=48.0, ranges=RANGES))
    return E.attach(event_cohort(spark, sf), E.spread(t, "stay_id", "variable", VARIABLES, INST), "stay_id")


def _mp_sql() -> str:
    cols = []
    for v in VARIABLES:
        f = f"FILTER (variable = '{v}')"
        cols += [f"CASE WHEN count(variable) {f} > 0 THEN 1 ELSE 0 END AS {v}_measured_0_6h",
                 f"count(variable) {f} AS {v}_measurement_count_0_6h",
                 f"round(min(h) {f}, 6) AS {v}_time_to_first_measurement",
                 f"round({HOURS} - max(h) {f}, 6) AS {v}_time_since_last_measurement_at_6h"]
    cols += ["count(variable) AS total_measurements_0_6h", "count(variable) AS total_chart_event_count_0_6h"]
    cols += [f"count(variable) FILTER (source = '{s}') AS total_{s}_measurements_0_6h" for s in SOURCES]
    cols += ["CASE WHEN count(variable) = 0 THEN 0 ELSE 4 - count(DISTINCT variable) FILTER (variable IN ('click','error','view','refund')) END "
             "AS panel_missing_count_0_6h"]
    return win_sql(6) + f" SELECT c.stay_id, {', '.join(cols)} FROM cohort c LEFT JOIN win w USING (stay_id) GROUP BY c.stay_id"


@query("measurement_process", _mp_sql().replace(f"{HOURS} - max", "6.0 - max"))
def measurement_process(spark, sf):
    return rounded(E.measurement_process(_win(spark, sf, 6.0), event_cohort(spark, sf), VARIABLES, hours=6.0,
                                         sources=SOURCES, expected=["click", "error", "view", "refund"]))


@query("expected_minus_observed", win_sql(6) + """ SELECT c.stay_id, x.v AS missing_variable FROM cohort c
 CROSS JOIN (VALUES ('click'), ('error'), ('refund')) x(v) WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.stay_id = c.stay_id AND w.variable = x.v)""")
def expected_minus_observed(spark, sf):
    return E.expected_minus_observed(_win(spark, sf, 6.0), event_cohort(spark, sf), ["click", "error", "refund"])


@query("coverage", win_sql(6) + """ SELECT variable, count(DISTINCT stay_id) AS stays,
 round(count(DISTINCT stay_id) * 100.0 / (SELECT count(*) FROM cohort), 6) AS pct_of_cohort FROM win GROUP BY variable""")
def coverage(spark, sf):
    return rounded(E.coverage(_win(spark, sf, 6.0), event_cohort(spark, sf)))


@query("slope", win_sql() + """ SELECT stay_id, variable, round(CASE WHEN count(DISTINCT h) >= 3 THEN regr_slope(valuenum, h) END, 6) AS slope
 FROM win GROUP BY 1, 2""")
def slope(spark, sf):
    h = F.col("hours_from_admit")
    g = _win(spark, sf).groupBy("stay_id", "variable").agg(F.countDistinct(h).alias("k"),
                                                           F.regr_slope("valuenum", h).alias("s"))
    return rounded(g.select("stay_id", "variable", F.when(F.col("k") >= 3, F.col("s")).alias("slope")))
