"""Roles of the test tables: which table plays stays, events, scores and wide features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOURS = 168.0
BIN = 28.0
VARIABLES = ["click", "error", "purchase", "signup", "view"]
SOURCES = ["lab", "vital"]


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its oracle SQL if there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that summation order cannot show in a comparison."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


# --- long events: one stay per user ----------------------------------------------------
def long_events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    source = F.when(F.col("event_type").isin("purchase", "signup"), "lab").otherwise("vital")
    return e.select(F.col("user_id").alias("stay_id"), F.col("ts").alias("charttime"),
                    F.col("event_type").alias("variable"), source.alias("source"), F.col("value").alias("valuenum"))


def event_cohort(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("stay_id")).agg(F.min("ts").alias("intime"))


EV = """ev AS (SELECT user_id AS stay_id, ts AS charttime, event_type AS variable,
  CASE WHEN event_type IN ('purchase','signup') THEN 'lab' ELSE 'vital' END AS source, value AS valuenum FROM events)"""
COHORT = "cohort AS (SELECT user_id AS stay_id, min(ts) AS intime FROM events GROUP BY user_id)"


def win_sql(hours: float = HOURS) -> str:
    return f"""WITH {EV}, {COHORT}, win AS (
  SELECT e.*, c.intime, (epoch_us(e.charttime) - epoch_us(c.intime)) / 3600000000.0 AS h
  FROM ev e JOIN cohort c ON e.stay_id = c.stay_id
  WHERE e.charttime >= c.intime AND e.charttime <= c.intime + INTERVAL '{int(hours)} hours')"""


# --- stays = orders, stay events = lineitem ---------------------------------------------
def order_stays(spark, sf) -> DataFrame:
    """One stay per order; a stay ends 100 days after the order."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("subject_id"),
                    F.col("o_orderdate").alias("intime"),
                    (F.col("o_orderdate") + F.expr("INTERVAL '100' DAY")).alias("outtime"))


def line_events(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("stay_id"), F.col("l_shipdate").alias("charttime"),
                     F.col("l_linenumber").alias("itemid"), F.col("l_quantity").alias("valuenum"))


STAYS = """stays AS (SELECT o_orderkey AS stay_id, o_custkey AS subject_id, o_orderdate AS intime,
  o_orderdate + INTERVAL '100 days' AS outtime FROM orders)"""
FIRST = """firsts AS (SELECT * FROM stays QUALIFY row_number() OVER
  (PARTITION BY subject_id ORDER BY intime, stay_id) = 1)"""
RECORD = "rec AS (SELECT l_orderkey AS stay_id, min(l_shipdate) AS earliest_record FROM lineitem GROUP BY 1)"

# --- scored rows: lineitem -----------------------------------------------------------------
# row_num only feeds the resampling hash; split is a whole-entity hash split
SCORED_COLUMNS = {
    "row_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "row_num": "((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey)",
    "entity": "l_orderkey",
    "y": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "p_a": "least(1.0, (l_extendedprice + CASE WHEN l_returnflag = 'R' THEN 9000.0 ELSE 0.0 END) / 115000.0)",
    "p_b": "round(l_discount * 100.0) / 10.0",
    "split": "CASE WHEN l_orderkey % 5 = 0 THEN 'test' WHEN l_orderkey % 5 = 1 THEN 'validation' ELSE 'train' END",
    "linestatus": "l_linestatus",
}


def scored(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(*[F.expr(f"{e} AS {n}") for n, e in SCORED_COLUMNS.items()])


SCORED = "scored AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SCORED_COLUMNS.items()) + " FROM lineitem)"

# --- wide feature table: one row per order ---------------------------------------------------
# exact integers first, so that both engines divide the same numbers
BASE = """SELECT l_orderkey AS k, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q,
 min(CAST(l_quantity AS BIGINT)) AS qmin, max(CAST(l_quantity AS BIGINT)) AS qmax,
 sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc,
 sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax FROM lineitem GROUP BY l_orderkey"""


def _gap(expr: str, m: int) -> str:
    return f"CASE WHEN stay_id % {m} = 0 THEN NULL ELSE {expr} END"


# odd divisors keep the values off exact rounding ties
_Q, _P = "(q / (n * 1.00013e0))", "(cents / (n * 100007.0e0))"
_D, _T = "(disc / (n * 1.00017e0))", "(tax / (n * 1.00019e0))"
WIDE_COLUMNS = {
    "age": _gap("18 + subject_id % 75", 31),
    "gender": "CASE WHEN subject_id % 11 = 0 THEN NULL WHEN subject_id % 2 = 0 THEN 'M' ELSE 'F' END",
    "mortality": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "heart_rate_mean": _gap(f"50 + 1.6e0 * {_Q}", 7),
    "heart_rate_min": _gap("45.0e0 + qmin", 7),
    "heart_rate_max": _gap("60.0e0 + 2 * qmax", 7),
    "sbp_mean": _gap(f"80 + {_P}", 9),
    "sbp_min": _gap(f"58 + 0.8e0 * {_P} + 0.2e0 * qmin", 9),
    "sbp_max": _gap(f"90 + 1.2e0 * {_P} + 0.1e0 * qmax", 9),
    "dbp_mean": _gap(f"36 + 0.7e0 * {_P} + 0.3e0 * {_D}", 9),
    "dbp_min": f"30 + 0.6e0 * {_P}",
    "dbp_max": f"50 + 0.8e0 * {_P}",
    "map_mean": _gap(f"52 + 0.7e0 * {_P} + 0.5e0 * {_T}", 9),
    "map_min": _gap(f"45 + 0.6e0 * {_P}", 9),
    "resp_rate_mean": _gap(f"6 + 0.5e0 * {_Q}", 13),
    "resp_rate_min": "4.0e0 + 0.5e0 * qmin",
    "resp_rate_max": _gap("10 + 0.5e0 * qmax", 13),
    "temp_mean": _gap(f"34.5e0 + 0.5e0 * {_D}", 17),
    "temp_min": f"34 + 0.4e0 * {_D}",
    "temp_max": f"36 + 0.5e0 * {_D}",
    "wbc_mean": _gap(f"1.5e0 + 2 * {_T}", 5),
    "spo2_mean": _gap(f"100 - 1.3e0 * {_D}", 19),
    "spo2_min": _gap(f"98 - 1.6e0 * {_D}", 19),
    "spo2_max": f"100 - 0.1e0 * {_D}",
    "lactate_mean": _gap(f"0.4e0 + 0.5e0 * {_T}", 3),
    "lactate_min": _gap(f"0.2e0 + 0.4e0 * {_T}", 3),
    "lactate_max": _gap(f"0.6e0 + 0.9e0 * {_T}", 3),
    "creatinine_mean": _gap("0.3e0 + n * 0.25e0", 8),
    "creatinine_max": _gap("0.4e0 + n * 0.3e0", 8),
    "bun_mean": _gap(f"4 + {_Q}", 8),
    "bun_max": _gap("6.0e0 + qmax", 8),
    "bilirubin_mean": _gap(f"0.1e0 + 0.35e0 * {_D}", 4),
    "bilirubin_max": _gap(f"0.2e0 + 0.5e0 * {_D}", 4),
    "inr_mean": _gap(f"0.7e0 + 0.2e0 * {_T}", 6),
    "inr_max": _gap(f"0.8e0 + 0.3e0 * {_T}", 6),
    "platelets_mean": _gap("30 + 9.0e0 * qmin", 10),
    "platelets_min": _gap("20 + 7.0e0 * qmin", 10),
    "hemoglobin_mean": _gap(f"6 + 0.2e0 * {_Q}", 10),
    "hemoglobin_min": _gap("5 + 0.2e0 * qmin", 10),
    "glucose_mean": f"60 + 3.0e0 * {_P}",
    "glucose_min": f"40 + 1.5e0 * {_P}",
    "glucose_max": f"80 + 4.5e0 * {_P}",
    "sodium_mean": "(o_totalprice - 200000.0e0) / 20000.0e0 + 138",
    "alkaline_phosphatase_mean": "o_totalprice / 1500.0e0",
    "alkaline_phosphatase_max": "o_totalprice / 1000.0e0",
    "bicarbonate_min": _gap(f"10 + 2 * {_T}", 12),
    "anion_gap_mean": _gap(f"6 + 1.2e0 * {_D}", 12),
    "anion_gap_max": _gap(f"8 + 1.4e0 * {_D}", 12),
    "pao2_mean": _gap(f"40 + 2.0e0 * {_P}", 14),
    "fio2_mean": "0.21e0 + (qmax % 8) * 0.1e0",
    "urine_output_total": _gap("qmax * 20.0e0 * n", 15),
    "prev_dx_count_total": "subject_id % 9",
    "panel_missing_count_0_6h": "CAST(n % 4 AS BIGINT)",
    "total_lab_count": "CAST(n AS BIGINT)",
    "first_careunit": "o_orderpriority",
    "ventilated": "CAST(qmin % 2 AS INTEGER)",
    "risk": f"least(0.97e0, 0.03e0 + 0.01e0 * {_Q} + CASE WHEN o_orderstatus = 'F' THEN 0.12e0 ELSE 0.0e0 END)",
    "heart_rate_hour_0": _gap("60.0e0 + qmin", 7),
    "heart_rate_hour_1": _gap(f"60 + {_Q}", 11),
    "heart_rate_hour_2": _gap("60.0e0 + qmax", 6),
    "resp_rate_hour_0": _gap("8 + 0.3e0 * qmin", 7),
    "resp_rate_hour_1": _gap(f"8 + 0.3e0 * {_Q}", 4),
    "resp_rate_hour_2": _gap("8 + 0.3e0 * qmax", 6),
    "spo2_1": _gap(f"99 - {_D}", 5),
    "spo2_2": f"98 - {_D}",
    "dbp_0": f"50 + 0.5e0 * {_P}",
    "dbp_1": _gap(f"52 + 0.5e0 * {_P}", 5),
    "lactate_4": f"1 + 0.2e0 * {_T}",
    "lactate_6": _gap(f"1 + 0.3e0 * {_T}", 5),
}
_WIDE_FROM = ("SELECT o.o_orderkey AS stay_id, o.o_custkey AS subject_id, o.o_orderdate AS intime, o.o_orderstatus, o.o_orderpriority, "
              "o.o_totalprice, b.* FROM orders o JOIN (" + BASE + ") b ON o.o_orderkey = b.k")


def wide_sql(columns: list[str]) -> str:
    body = ", ".join(f"{WIDE_COLUMNS[c]} AS {c}" for c in columns)
    return f"wide AS (SELECT stay_id, subject_id, intime, {body} FROM ({_WIDE_FROM}) s)"


def wide(spark, sf, columns: list[str]) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    b = li.selectExpr("l_orderkey AS k", "CAST(l_quantity AS BIGINT) AS lq",
                      "CAST(round(l_extendedprice * 100) AS BIGINT) AS lc",
                      "CAST(round(l_discount * 100) AS BIGINT) AS ld", "CAST(round(l_tax * 100) AS BIGINT) AS lt")
    b = b.groupBy("k").agg(F.count("*").alias("n"), F.sum("lq").alias("q"), F.min("lq").alias("qmin"),
                           F.max("lq").alias("qmax"), F.sum("lc").alias("cents"), F.sum("ld").alias("disc"),
                           F.sum("lt").alias("tax"))
    j = o.select(F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("subject_id"),
                 F.col("o_orderdate").alias("intime"), "o_orderstatus", "o_orderpriority", "o_totalprice").join(
        b, F.col("stay_id") == F.col("k"))
    return j.select("stay_id", "subject_id", "intime", *[F.expr(f"{WIDE_COLUMNS[c]} AS {c}") for c in columns])


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) AS {name or expr}"
