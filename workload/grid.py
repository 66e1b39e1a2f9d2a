"""Regular-grid operators: 24 bins of 7 hours, test event types as channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import grid as G
from tidewatch.operators import split, windows
from workload.base import HOURS, event_cohort, long_events, query, rounded, win_sql

ALIAS = {"click": "heart_rate", "error": "sbp", "purchase": "lactate", "signup": "spo2", "view": "temperature"}
BASE = ["heart_rate_last", "heart_rate_min", "heart_rate_max", "sbp_last", "sbp_min", "sbp_max", "lactate_last", "spo2_last",
        "spo2_min", "spo2_max", "temperature_last", "temperature_min", "temperature_max"]
DERIVED = ["shock_index_bin", "hypotension_flag_bin", "hypoxemia_flag_bin", "sirs_count_bin", "critical_value_count_bin"]
CH = BASE + DERIVED


def _win(spark, sf):
    return windows.windowed_events(long_events(spark, sf), event_cohort(spark, sf), hours=HOURS)


def _base(spark, sf):
    return G.base_channels(G.grid_wide(_win(spark, sf), bin_hours=7.0, aliases=ALIAS), CH)


def _grid(spark, sf):
    return G.build_grid(_win(spark, sf), event_cohort(spark, sf), CH, bin_hours=7.0, aliases=ALIAS)


_CASE = "CASE variable " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIAS.items()) + " END"
_BASE = win_sql() + f""", b AS (SELECT stay_id, CAST(greatest(0, least(floor(h / 7.0), 23)) AS INTEGER) AS bin, {_CASE} AS v,
 arg_max(valuenum, charttime) AS last, min(valuenum) AS min, max(valuenum) AS max, count(*) AS count FROM win GROUP BY 1, 2, 3),
base AS (SELECT stay_id, bin, v || '_last' AS channel, last AS value, 1 AS mask, count FROM b
 UNION ALL SELECT stay_id, bin, v || '_min', min, 1, count FROM b WHERE v <> 'lactate'
 UNION ALL SELECT stay_id, bin, v || '_max', max, 1, count FROM b WHERE v <> 'lactate')"""
_P = [f"max(value) FILTER (channel = '{c}') AS {c}" for c in BASE]
_DER = _BASE + f""", w AS (SELECT stay_id, bin, {', '.join(_P)} FROM base GROUP BY 1, 2),
d AS (SELECT stay_id, bin, 'shock_index_bin' AS channel, CASE WHEN sbp_last IS NOT NULL THEN heart_rate_last / greatest(abs(sbp_last), 1e-6) END AS value FROM w
 UNION ALL SELECT stay_id, bin, 'hypotension_flag_bin', CASE WHEN sbp_min < 90 THEN 1.0 WHEN sbp_min >= 90 THEN 0.0 END FROM w
 UNION ALL SELECT stay_id, bin, 'hypoxemia_flag_bin', CASE WHEN spo2_min < 90 THEN 1.0 WHEN spo2_min >= 90 THEN 0.0 END FROM w
 UNION ALL SELECT stay_id, bin, 'sirs_count_bin', CASE WHEN coalesce(temperature_last, heart_rate_last) IS NOT NULL THEN
  (CASE WHEN temperature_last > 38 OR temperature_last < 36 THEN 1.0 ELSE 0.0 END) + (CASE WHEN heart_rate_last > 90 THEN 1 ELSE 0 END) END FROM w
 UNION ALL SELECT stay_id, bin, 'critical_value_count_bin', CASE WHEN coalesce(heart_rate_last, sbp_min, temperature_last, spo2_min, lactate_last) IS NOT NULL THEN
  (CASE WHEN heart_rate_last < 40 OR heart_rate_last > 130 THEN 1.0 ELSE 0.0 END) + (CASE WHEN sbp_min < 90 THEN 1 ELSE 0 END)
  + (CASE WHEN temperature_last < 36 OR temperature_last > 38.5 THEN 1 ELSE 0 END) + (CASE WHEN spo2_min < 90 THEN 1 ELSE 0 END) + (CASE WHEN lactate_last > 2 THEN 1 ELSE 0 END) END FROM w),
derived AS (SELECT stay_id, bin, channel, CAST(value AS DOUBLE) AS value, 1 AS mask, CAST(1 AS BIGINT) AS count FROM d WHERE value IS NOT NULL)"""
_DENSE = _DER + f""", cells AS (SELECT * FROM base UNION ALL SELECT * FROM derived),
grid AS (SELECT c.stay_id, CAST(b.bin AS INTEGER) AS bin, ch.channel, coalesce(x.value, 0.0) AS value, coalesce(x.mask, 0) AS mask, coalesce(x.count, 0) AS count
 FROM cohort c CROSS JOIN (SELECT unnest(range(0, 24)) AS bin) b CROSS JOIN (SELECT unnest([{', '.join(f"'{c}'" for c in CH)}]) AS channel) ch
 LEFT JOIN cells x ON x.stay_id = c.stay_id AND x.bin = b.bin AND x.channel = ch.channel),
g AS (SELECT *, coalesce((bin - last_value(CASE WHEN mask = 1 THEN bin END IGNORE NULLS) OVER (PARTITION BY stay_id, channel ORDER BY bin)) * 7.0, 168.0)::DOUBLE AS delta FROM grid)"""


@query("grid_channels", _BASE + " SELECT * FROM base")
def grid_channels(spark, sf):
    return _base(spark, sf)


@query("grid_derived", _DER + " SELECT stay_id, bin, channel, round(value, 6) AS value, mask, count FROM derived")
def grid_derived(spark, sf):
    return rounded(G.derived_channels(_base(spark, sf), CH))


@query("dense_grid", _DENSE + " SELECT stay_id, bin, channel, round(value, 6) AS value, mask, count FROM grid")
def dense_grid(spark, sf):
    base = _base(spark, sf)
    return rounded(G.dense_grid(base.unionByName(G.derived_channels(base, CH)), event_cohort(spark, sf), CH))


@query("time_since_last", _DENSE + " SELECT stay_id, bin, channel, mask, delta FROM g")
def time_since_last(spark, sf):
    return _grid(spark, sf).select("stay_id", "bin", "channel", "mask", "delta")


_NORM = _DENSE + """, p AS (SELECT channel, coalesce(avg(value) FILTER (mask = 1 AND stay_id % 5 > 1), 0) AS mean,
 CASE WHEN stddev_pop(value) FILTER (mask = 1 AND stay_id % 5 > 1) > 1e-6 THEN stddev_pop(value) FILTER (mask = 1 AND stay_id % 5 > 1) ELSE 1.0 END AS std FROM g GROUP BY 1)"""


@query("grid_normalize", _NORM + """ SELECT stay_id, bin, channel, mask, round(greatest(-5.0, least(5.0, (value - mean) / std)) * mask, 6) + 0.0 AS value,
 round(ln(1 + least(delta, 6.0)) / ln(7.0), 6) AS delta, round(ln(1 + least(count, 10)) / ln(11.0), 6) AS count FROM g JOIN p USING (channel)""")
def grid_normalize(spark, sf):
    g = _grid(spark, sf)
    return rounded(G.normalize(g, G.fit_normalizer(g, F.col("stay_id") % 5 > 1)).select(
        "stay_id", "bin", "channel", "mask", "value", "delta", "count"))


_PK = ["heart_rate_last", "sbp_last", "lactate_last"]


@query("tensor_pack", _DENSE + """, r AS (SELECT stay_id, bin, list(value ORDER BY list_position(['heart_rate_last', 'sbp_last', 'lactate_last'], channel)) AS v,
 list(mask ORDER BY list_position(['heart_rate_last', 'sbp_last', 'lactate_last'], channel)) AS m FROM grid WHERE channel IN ('heart_rate_last', 'sbp_last', 'lactate_last') GROUP BY 1, 2)
SELECT stay_id, list(v ORDER BY bin) AS value, list(m ORDER BY bin) AS mask FROM r GROUP BY 1""")
def tensor_pack(spark, sf):
    return G.pack(_grid(spark, sf).where(F.col("channel").isin(_PK)), _PK)


@query("mask_observed", _DENSE + """, m AS (SELECT *, mask = 1 AND ('0x' || substr(md5(stay_id || '|' || bin || '|' || channel || '|42'), 1, 8))::BIGINT / 4294967296.0 < 0.15 AS hide FROM grid)
SELECT stay_id, bin, channel, round(CASE WHEN hide THEN 0.0 ELSE value END, 6) AS value, CASE WHEN hide THEN 0 ELSE mask END AS mask, CAST(hide AS INTEGER) AS hidden FROM m""")
def mask_observed(spark, sf):
    return rounded(split.mask_observed(_grid(spark, sf), ["stay_id", "bin", "channel"]))
