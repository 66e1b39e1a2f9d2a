"""Aggregation of windowed long events into one row per stay.

Input rows are (id, variable, time, hours_from_admit, value) as made by
``windows.windowed_events``. Ordered statistics run in time slices: a (id, variable) group is
cut into ``slices`` pieces of the window, each piece is ordered on its own, and at most
``slices`` piece summaries per group are put together. No group is ever sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions.exprs import flag, outside, ratio, sanitize_token

SLICES = 4096


def _slice(hours: float, slices: int, h: str = "hours_from_admit") -> Column:
    return F.least(F.floor(F.col(h) / F.lit(hours) * slices), F.lit(slices - 1)).cast("int")


def attach(cohort: DataFrame, features: DataFrame, id_col: str, zero: list[str] = ()) -> DataFrame:
    """One row per distinct cohort id; ``zero`` columns become 0 where nothing was seen."""
    out = cohort.select(id_col).distinct().join(features, id_col, "left")
    zero = set(zero)
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zero else F.col(c) for c in out.columns])


def spread(stats: DataFrame, id_col: str, key: str, keys: list[str], values: list[str]) -> DataFrame:
    """(id, key, values) rows to columns ``<key>_<value>`` with a fixed key list."""
    return stats.groupBy(id_col).pivot(key, keys).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])


def vital_summary(win: DataFrame, *, hours: float, id_col: str = "stay_id", variable: str = "variable",
                  time: str = "charttime", value: str = "valuenum", slices: int = SLICES) -> DataFrame:
    """Time-weighted mean, min and max per (id, variable).

    A reading weighs the hours to the next reading, the last one 0; if all readings share one
    time the plain mean is used. Readings at the same time are folded first: only the highest
    can have a following gap."""
    at_time = (win.where(F.col(value).isNotNull()).groupBy(id_col, variable, time)
               .agg(F.min("hours_from_admit").alias("hours_from_admit"), F.max(value).alias("_top"),
                    F.min(value).alias("_low"), F.sum(value).alias("_sum"), F.count(value).alias("_n")))
    at_time = at_time.withColumn("_s", _slice(hours, slices))
    nxt = F.lead("hours_from_admit").over(Window.partitionBy(id_col, variable, "_s").orderBy(time))
    piece = (at_time.withColumn("_gap", nxt - F.col("hours_from_admit"))
             .groupBy(id_col, variable, "_s")
             .agg(F.sum(F.col("_top") * F.col("_gap")).alias("_wv"), F.sum("_gap").alias("_w"),
                  F.min("hours_from_admit").alias("_first"), F.max("hours_from_admit").alias("_last"),
                  F.max_by("_top", "hours_from_admit").alias("_last_v"), F.max("_top").alias("_top"),
                  F.min("_low").alias("_low"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n")))
    gap = F.lead("_first").over(Window.partitionBy(id_col, variable).orderBy("_s")) - F.col("_last")
    out = (piece.withColumn("_gap", gap).groupBy(id_col, variable)
           .agg(F.sum(F.coalesce(F.col("_wv"), F.lit(0.0)) + F.coalesce(F.col("_last_v") * F.col("_gap"), F.lit(0.0)))
                .alias("_wv"),
                F.sum(F.coalesce(F.col("_w"), F.lit(0.0)) + F.coalesce(F.col("_gap"), F.lit(0.0))).alias("_w"),
                F.min("_low").alias("min"), F.max("_top").alias("max"), F.sum("_sum").alias("_sum"),
                F.sum("_n").alias("_n")))
    mean = F.when(F.col("_w") > 0, F.col("_wv") / F.col("_w")).otherwise(F.col("_sum") / F.col("_n"))
    return out.select(id_col, variable, mean.alias("mean"), "min", "max", F.lit(1).alias("measured"))


def lab_summary(win: DataFrame, *, id_col: str = "stay_id", variable: str = "variable", time: str = "charttime",
                value: str = "valuenum") -> DataFrame:
    """Mean, min, max, last minus first and a measured flag (counting non-null values only)."""
    v = F.col(value)
    order = F.struct(time, value)
    return (win.where(v.isNotNull()).groupBy(id_col, variable)
            .agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
                 (F.max_by(value, order) - F.min_by(value, order)).alias("delta"), F.lit(1).alias("measured")))


def codeset_summary(cohort: DataFrame, events: DataFrame, name: str, *, id_col: str = "stay_id",
                    value: str = "valuenum") -> DataFrame:
    """Mean, max and measured flag over events of a code set, for the full cohort."""
    agg = events.where(F.col(value).isNotNull()).groupBy(id_col).agg(
        F.avg(value).alias(f"{name}_mean"), F.max(value).alias(f"{name}_max"), F.lit(1).alias(f"{name}_measured"))
    return attach(cohort, agg, id_col, [f"{name}_measured"])


def windowed_sum(cohort: DataFrame, events: DataFrame, name: str, *, id_col: str = "stay_id",
                 value: str = "valuenum") -> DataFrame:
    """Sum of values and measured flag; the sum stays NULL when nothing was recorded."""
    agg = events.where(F.col(value).isNotNull()).groupBy(id_col).agg(
        F.sum(value).alias(f"{name}_total"), F.lit(1).alias(f"{name}_measured"))
    return attach(cohort, agg, id_col, [f"{name}_measured"])


def first_reading_ratio(cohort: DataFrame, win: DataFrame, *, is_height: Column, is_weight: Column, height: Column,
                        weight: Column, id_col: str = "stay_id", time: str = "charttime", tiebreak: str = "itemid",
                        height_range=(120, 220), weight_range=(30, 300), name: str = "bmi") -> DataFrame:
    """weight / (height in m)^2 from the first height and the first weight of each stay.

    ``height`` and ``weight`` are already unit-converted expressions; a first reading outside
    its range makes the result missing."""
    order = F.struct(time, tiebreak)
    agg = win.groupBy(id_col).agg(F.min_by(F.when(is_height, height), F.when(is_height, order)).alias("_h"),
                                  F.min_by(F.when(is_weight, weight), F.when(is_weight, order)).alias("_w"))
    ok = F.col("_h").between(*height_range) & F.col("_w").between(*weight_range)
    meters = F.col("_h") / 100
    agg = agg.select(id_col, F.when(ok, F.col("_w") / (meters * meters)).alias(name))
    return attach(cohort, agg, id_col).withColumn(f"{name}_measured", flag(F.col(name).isNotNull()))


def nearest_at_anchors(win: DataFrame, anchors: list[int], *, id_col: str = "stay_id", variable: str = "variable",
                       value: str = "valuenum", tolerance: float = 0.5, first_limit: float = 1.0) -> DataFrame:
    """Value nearest to each anchor hour within the tolerance (anchor 0: hours <= first_limit).

    Ties go to the earlier hour, then the smaller value. One aggregate, a struct minimum per
    anchor, so nothing is exploded or sorted. Gives (id, variable, hour_<a>...)."""
    h = F.col("hours_from_admit")
    aggs = []
    for a in anchors:
        near = (h <= first_limit) if a == 0 else h.between(max(0.0, a - tolerance), a + tolerance)
        aggs.append(F.min(F.when(near, F.struct(F.abs(h - a).alias("d"), h.alias("h"), F.col(value).alias("v"))))
                    .alias(f"_a{a}"))
    out = win.where(F.col(value).isNotNull()).groupBy(id_col, variable).agg(*aggs)
    return out.select(id_col, variable, *[F.col(f"_a{a}.v").alias(f"hour_{a}") for a in anchors])


def anchor_changes(near: DataFrame, anchors: list[int], keys: list[str]) -> DataFrame:
    """First-to-last change, hourly change and adjacent changes between anchor columns."""
    first, last = min(anchors), max(anchors)
    change = F.col(f"hour_{last}") - F.col(f"hour_{first}")
    adjacent = [(F.col(f"hour_{b}") - F.col(f"hour_{a}")).alias(f"delta_{a}to{b}")
                for a, b in zip(anchors[:-1], anchors[1:])]
    return near.select(*keys, *[f"hour_{a}" for a in anchors], change.alias(f"change_{first}to{last}"),
                       (change / (last - first)).alias("hourly_change"), *adjacent)


def _hour_name(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x).replace(".", "p")


def bin_labels(hours: float, bin_hours: float) -> list[str]:
    n = math.ceil(hours / bin_hours)
    return [f"bin_{_hour_name(i * bin_hours)}_{_hour_name(min((i + 1) * bin_hours, hours))}h" for i in range(n)]


def bin_index(hours: float, bin_hours: float, h: str = "hours_from_admit") -> Column:
    """Left-closed bins; an event exactly at the window end falls into the last bin."""
    n = math.ceil(hours / bin_hours)
    return F.least(F.floor(F.col(h) / F.lit(bin_hours)), F.lit(n - 1)).cast("int")


def hourly_bins(win: DataFrame, cohort: DataFrame, variables: list[str], *, hours: float = 6.0, bin_hours: float = 1.0,
                aggregations: tuple[str, ...] = ("mean", "min", "max", "last"), observed: bool = True,
                count: bool = True, id_col: str = "stay_id", variable: str = "variable", time: str = "charttime",
                value: str = "valuenum") -> DataFrame:
    """Columns ``<var>_<bin>_<agg>`` per stay; counts and observed flags are 0 where absent."""
    if hours <= 0 or bin_hours <= 0:
        raise ValueError("hours and bin_hours must be positive")
    unknown = sorted(set(aggregations) - {"mean", "min", "max", "last"})
    if unknown:
        raise ValueError(f"unsupported aggregations: {unknown}")
    base = bins_base(win, hours=hours, bin_hours=bin_hours, id_col=id_col, variable=variable, time=time, value=value)
    return bins_features(base, cohort, variables, hours=hours, bin_hours=bin_hours, aggregations=aggregations,
                         observed=observed, count=count, id_col=id_col, variable=variable)


def bins_base(win: DataFrame, *, hours: float = 6.0, bin_hours: float = 1.0, id_col: str = "stay_id",
              variable: str = "variable", time: str = "charttime", value: str = "valuenum", also: list[str] = ()) -> DataFrame:
    """(id, variable, bin, also, mean, min, max, last, count): the one aggregate over events; ``also`` are further key columns."""
    data = win.where(F.col(variable).isNotNull() & F.col(value).isNotNull())
    return data.groupBy(id_col, variable, bin_index(hours, bin_hours).alias("bin"), *also).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.max_by(value, F.struct(time, value)).alias("last"), F.count(value).alias("count"))


def bins_features(base: DataFrame, cohort: DataFrame, variables: list[str], *, hours: float, bin_hours: float,
                  aggregations: tuple[str, ...], observed: bool = True, count: bool = True, id_col: str = "stay_id",
                  variable: str = "variable") -> DataFrame:
    labels = bin_labels(hours, bin_hours)
    names = F.array(*[F.lit(x) for x in labels])
    stats = base.withColumn("_key", F.concat_ws("_", variable, names[F.col("bin")])).withColumn("observed", F.lit(1))
    wanted = [*aggregations, *(["observed"] if observed else []), *(["count"] if count else [])]
    keys = [f"{v}_{b}" for v in variables for b in labels]
    zero = [f"{k}_{s}" for k in keys for s in wanted if s in ("observed", "count")]
    return attach(cohort, spread(stats, id_col, "_key", keys, wanted), id_col, zero)


def trajectory(win: DataFrame, *, hours: float = 6.0, edge_hours: float = 2.0, id_col: str = "stay_id",
               variable: str = "variable", time: str = "charttime", value: str = "valuenum",
               threshold: float = 0.10) -> DataFrame:
    """Movement statistics per (id, variable); every one is a map-side combinable aggregate."""
    h, v = F.col("hours_from_admit"), F.col(value)
    order = F.struct(time, value)
    g = win.where(v.isNotNull() & F.col(variable).isNotNull()).groupBy(id_col, variable).agg(
        F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"),
        F.avg(F.when(h <= edge_hours, v)).alias("first_2h_mean"),
        F.avg(F.when(h >= max(0.0, hours - edge_hours), v)).alias("last_2h_mean"),
        F.regr_slope(v, h).alias("_slope"), (F.max(h) > F.min(h)).alias("_two"))
    diff = F.col("last") - F.col("first")
    pct = ratio(diff, F.abs("first"))
    return g.select(id_col, variable, "first", "last", diff.alias("last_minus_first"), pct.alias("percent_change"),
                    "first_2h_mean", "last_2h_mean",
                    (F.col("last_2h_mean") - F.col("first_2h_mean")).alias("last2h_minus_first2h"),
                    F.when(F.col("_two"), F.col("_slope")).alias("slope_0_6h"),
                    flag(pct >= threshold).alias("deterioration_flag"),
                    flag(pct <= -threshold).alias("recovery_flag"))


def out_of_range(ranges: dict[str, tuple[float, float]], variable: str = "variable", value: str = "valuenum") -> Column:
    cond = F.lit(False)
    for name, (low, high) in ranges.items():
        cond = cond | ((F.col(variable) == name) & outside(value, low, high))
    return F.coalesce(cond, F.lit(False))


def longest_run(win: DataFrame, condition: Column, *, hours: float, id_col: str = "stay_id",
                variable: str = "variable", time: str = "charttime", value: str = "valuenum",
                slices: int = SLICES, name: str = "longest_run") -> DataFrame:
    """Longest stretch of consecutive readings (by time, then value) meeting the condition.

    Runs are found inside each slice; a slice keeps its length, its leading, trailing and best
    run, and the slices of a group are folded in order."""
    piece = Window.partitionBy(id_col, variable, "_s")
    ordered = piece.orderBy(time, value)
    data = win.select(id_col, variable, time, value, condition.alias("_c"), _slice(hours, slices).alias("_s"))
    data = data.withColumn("_r", F.row_number().over(ordered)).withColumn("_len", F.count("*").over(piece))
    data = data.withColumn("_bad", F.sum(F.when(F.col("_c"), 0).otherwise(1)).over(ordered))
    runs = (data.groupBy(id_col, variable, "_s", "_bad")
            .agg(F.sum(F.col("_c").cast("int")).alias("_run"), F.max("_len").alias("_len"),
                 F.max("_r").alias("_end")))
    slices_ = runs.groupBy(id_col, variable, "_s").agg(
        F.max("_len").alias("n"), F.max("_run").alias("best"),
        F.max(F.when(F.col("_bad") == 0, F.col("_run")).otherwise(0)).alias("head"),
        F.max(F.when(F.col("_end") == F.col("_len"), F.col("_run")).otherwise(0)).alias("tail"))
    packed = slices_.groupBy(id_col, variable).agg(
        F.sort_array(F.collect_list(F.struct("_s", "n", "best", "head", "tail"))).alias("_p"))
    start = F.struct(F.lit(0).cast("bigint").alias("open"), F.lit(0).cast("bigint").alias("best"))

    def step(acc, x):
        joined = acc["open"] + x["head"]
        return F.struct(F.when(x["head"] == x["n"], joined).otherwise(x["tail"]).cast("bigint").alias("open"),
                        F.greatest(acc["best"], joined, x["best"]).cast("bigint").alias("best"))

    return packed.select(id_col, variable, F.aggregate("_p", start, step)["best"].cast("bigint").alias(name))


def instability(win: DataFrame, *, hours: float = 6.0, edge_hours: float = 2.0,
                ranges: dict[str, tuple[float, float]] = K.NORMAL_RANGES, id_col: str = "stay_id",
                variable: str = "variable", time: str = "charttime", value: str = "valuenum",
                slices: int = SLICES) -> DataFrame:
    """Range, spread, abnormal readings and worst recent value per (id, variable)."""
    h, v = F.col("hours_from_admit"), F.col(value).cast("double")
    data = win.where(v.isNotNull() & F.col(variable).isNotNull())
    bad = out_of_range(ranges, variable, value)
    g = data.groupBy(id_col, variable).agg(
        F.max(v).alias("_max"), F.min(v).alias("_min"), F.stddev_pop(v).alias("_sd"), F.avg(v).alias("_mean"),
        F.count(v).alias("_n"), F.sum(bad.cast("int")).alias("abnormal_count_0_6h"),
        F.max(F.when(h >= max(0.0, hours - edge_hours), v)).alias("worst_recent_value_0_6h"))
    run = longest_run(data, bad, hours=hours, id_col=id_col, variable=variable, time=time, value=value,
                      slices=slices, name="longest_abnormal_run_0_6h")
    many = F.col("_n") > 1
    return g.join(run, [id_col, variable]).select(
        id_col, variable, (F.col("_max") - F.col("_min")).alias("range_0_6h"),
        F.when(many, F.col("_sd")).otherwise(F.lit(0.0)).alias("std_0_6h"),
        F.when(many, ratio(F.col("_sd"), F.abs("_mean"))).alias("cv_0_6h"),
        "abnormal_count_0_6h", "longest_abnormal_run_0_6h", "worst_recent_value_0_6h")


def measurement_process(win: DataFrame, cohort: DataFrame, variables: list[str], *, hours: float = 6.0,
                        sources: list[str] | None = None, expected: list[str] | None = None,
                        id_col: str = "stay_id", variable: str = "variable", source: str = "source") -> DataFrame:
    """How often, when and where each stay was measured."""
    base = process_base(win, id_col=id_col, variable=variable, source=source if sources else None)
    return process_features(base, cohort, variables, hours=hours, sources=sources, expected=expected, id_col=id_col,
                            variable=variable, source=source)


def process_base(win: DataFrame, *, id_col: str = "stay_id", variable: str = "variable",
                 source: str | None = "source", also: list[str] = ()) -> DataFrame:
    """(id, variable, source, also, count, first hour, last hour): the one aggregate over events; ``also`` are further key columns."""
    h = F.col("hours_from_admit")
    data = win.where(F.col(variable).isNotNull())
    if source:
        data = data.withColumn(source, sanitize_token(source))
    return data.groupBy(id_col, variable, *([source] if source else []), *also).agg(
        F.count("*").alias("_n"), F.min(h).alias("_a"), F.max(h).alias("_z"))


def process_features(base: DataFrame, cohort: DataFrame, variables: list[str], *, hours: float = 6.0,
                     sources: list[str] | None = None, expected: list[str] | None = None, id_col: str = "stay_id",
                     variable: str = "variable", source: str = "source") -> DataFrame:
    stats = base.groupBy(id_col).pivot(variable, variables).agg(
        F.max(F.lit(1)).alias("measured_0_6h"), F.sum("_n").alias("measurement_count_0_6h"),
        F.min("_a").alias("time_to_first_measurement"),
        (F.lit(float(hours)) - F.max("_z")).alias("time_since_last_measurement_at_6h"))
    totals = [F.sum("_n").alias("total_measurements_0_6h"), F.sum("_n").alias("total_chart_event_count_0_6h")]
    for s in sources or []:
        totals.append(F.sum(F.when(F.col(source) == s, F.col("_n"))).alias(f"total_{s}_measurements_0_6h"))
    for i, e in enumerate(expected or []):
        totals.append(F.max((F.col(variable) == e).cast("int")).alias(f"_e{i}"))
    total = base.groupBy(id_col).agg(*totals)
    drop = [f"_e{i}" for i in range(len(expected or []))]
    if expected:
        seen = sum((F.col(c) for c in drop[1:]), F.col(drop[0]))
        total = total.withColumn("panel_missing_count_0_6h", (F.lit(len(expected)) - seen).cast("bigint"))
    wide = stats.join(total.drop(*drop), id_col)
    zero = [f"{v}_{s}" for v in variables for s in ("measured_0_6h", "measurement_count_0_6h")]
    zero += ["total_measurements_0_6h", "total_chart_event_count_0_6h", "panel_missing_count_0_6h"]
    zero += [f"total_{s}_measurements_0_6h" for s in sources or []]
    return attach(cohort, wide, id_col, zero)


def expected_minus_observed(win: DataFrame, cohort: DataFrame, expected: list[str], *, id_col: str = "stay_id",
                            variable: str = "variable") -> DataFrame:
    """(id, missing_variable) for every expected variable a stay never had."""
    want = cohort.select(id_col).distinct().select(
        id_col, F.explode(F.array(*[F.lit(e) for e in expected])).alias("missing_variable"))
    seen = win.select(id_col, F.col(variable).alias("missing_variable")).distinct()
    return want.join(seen, [id_col, "missing_variable"], "left_anti")


def coverage(win: DataFrame, cohort: DataFrame, *, id_col: str = "stay_id", variable: str = "variable",
             approximate: bool = False) -> DataFrame:
    """Stays with at least one reading per variable, and their share of the cohort."""
    count = F.approx_count_distinct(id_col) if approximate else F.countDistinct(id_col)
    n = cohort.agg(F.countDistinct(id_col).alias("_n"))
    return (win.groupBy(variable).agg(count.alias("stays")).crossJoin(n)
            .select(variable, "stays", ratio(F.col("stays") * 100.0, "_n").alias("pct_of_cohort")))
