"""All event features of a stay from one exchange of its events.

Every feature group (time-weighted means, lab summaries, anchors, bins, trajectories, instability runs,
measurement process) is a function of a few partial sums of a *piece*: the readings of one stay and
variable within one bin of the window. So events are shuffled once, into pieces; everything after
that handles at most one row per piece:

1. ``pieces``: one aggregate over events. Sums combine before the shuffle; the ordered readings of a
   piece give its time-weighted area and runs. A stay with more than ``PER_SLICE`` events is cut into
   more, thinner slices of time, so no piece grows with a hot stay (except readings of one instant).
2. ``variable_stats``: pieces of a (stay, variable) put together in order of time.
3. ``wide_features``: one row per stay, a map from variable to its statistics, and columns picked from it.

Null values count for the measurement process only; a null variable is dropped."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions.exprs import flag, ratio, sanitize_token
from tidewatch.operators.events import bin_index, bin_labels, out_of_range

PER_SLICE = 20_000  # events of a stay above which its pieces get thinner
PIECE = "_piece"


def slice_counts(events: DataFrame, id_col: str = "stay_id", per_slice: int = PER_SLICE) -> DataFrame:
    """(id, _slices) of ids with more than ``per_slice`` events; all others have one slice.

    Only counts are shuffled, and at most events / per_slice rows come out."""
    n = events.groupBy(id_col).agg(F.count("*").alias("_n")).where(F.col("_n") > per_slice)
    return n.select(id_col, (1 + F.floor(F.col("_n") / per_slice)).cast("int").alias("_slices"))


def _fold(array: Column, start: Column, step) -> Column:
    return F.aggregate(array, start, step)


def _area(readings: Column) -> Column:
    """Sum of value x hours to the next reading, over readings in order; of one instant the highest has the gap."""
    pairs = F.zip_with(F.slice(readings, 1, F.greatest(F.size(readings) - 1, F.lit(0))),
                       F.slice(readings, 2, F.greatest(F.size(readings) - 1, F.lit(0))), lambda a, b: a["v"] * (b["h"] - a["h"]))
    return _fold(pairs, F.lit(0.0), lambda a, x: a + x)


def _runs(readings: Column) -> Column:
    """Struct (n, head, tail, best) of runs of bad readings in order."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("n"), zero.alias("head"), zero.alias("open"), zero.alias("best"), F.lit(True).alias("all"))

    def step(a, x):
        run = F.when(x["bad"], a["open"] + 1).otherwise(zero)
        whole = a["all"] & x["bad"]
        return F.struct((a["n"] + 1).alias("n"), F.when(whole, a["n"] + 1).otherwise(a["head"]).alias("head"), run.alias("open"),
                        F.greatest(a["best"], run).alias("best"), whole.alias("all"))

    return _fold(readings, start, step)


def pieces(win: DataFrame, *, hours: float, bin_hours: float = 1.0, anchors: list[int] = (), tolerance: float = 0.5, first_limit: float = 1.0,
           edge_hours: float = 2.0, ranges: dict[str, tuple[float, float]] = K.NORMAL_RANGES, sources: list[str] = (), id_col: str = "stay_id",
           variable: str = "variable", time: str = "charttime", value: str = "valuenum", source: str = "source") -> DataFrame:
    """One row per (id, variable, bin, slice) with the struct ``_piece`` of its partial sums.

    ``win`` holds windowed events; a column ``_slices`` cuts an id's window into that many slices."""
    h, v = F.col("hours_from_admit"), F.col(value).cast("double")
    here = v.isNotNull()
    data = win.where(F.col(variable).isNotNull())
    slices = F.coalesce(F.col("_slices"), F.lit(1)) if "_slices" in win.columns else F.lit(1)
    data = data.withColumn("_bin", bin_index(hours, bin_hours)).withColumn(
        "_slice", F.least(F.floor(h / F.lit(float(hours)) * slices), slices - 1).cast("int"))
    reading = F.struct(h.alias("h"), v.alias("v"), out_of_range(ranges, variable, value).alias("bad"))
    near = []
    for a in anchors:
        close = (h <= first_limit) if a == 0 else h.between(max(0.0, a - tolerance), a + tolerance)
        near.append(F.min(F.when(here & close, F.struct(F.abs(h - a).alias("d"), h.alias("h"), v.alias("v")))).alias(f"near_{a}"))
    early, late = here & (h <= edge_hours), here & (h >= max(0.0, hours - edge_hours))
    stamped = F.when(here, F.struct(F.col(time).alias("t"), v.alias("v")))
    counts = [F.count(F.when(sanitize_token(source) == s, 1)).alias(f"rows_{i}") for i, s in enumerate(sources)]
    sums = data.groupBy(id_col, variable, "_bin", "_slice").agg(
        F.count("*").alias("rows"), F.min(h).alias("from"), F.max(h).alias("to"), *counts,
        F.count(v).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), (F.var_pop(v) * F.count(v)).alias("m2"),
        F.avg(F.when(here, h)).alias("h_mean"), F.regr_sxx(v, h).alias("sxx"), F.regr_sxy(v, h).alias("sxy"),
        F.min(stamped).alias("first"), F.max(stamped).alias("last"),
        F.count(F.when(here & out_of_range(ranges, variable, value), 1)).alias("n_bad"),
        F.sum(F.when(early, v)).alias("early"), F.count(F.when(early, v)).alias("n_early"),
        F.sum(F.when(late, v)).alias("late"), F.count(F.when(late, v)).alias("n_late"), F.max(F.when(late, v)).alias("worst"),
        *near, F.array_sort(F.collect_list(F.when(here, reading))).alias("_r"))
    r = F.col("_r")
    ordered = sums.withColumns({"run": _runs(r), "area": _area(r), "h1": F.get(r, F.lit(0))["h"], "h2": F.element_at(F.when(F.size(r) > 0, r), -1)["h"],
                                "v2": F.element_at(F.when(F.size(r) > 0, r), -1)["v"]})
    keep = [c for c in ordered.columns if c not in (id_col, variable, "_r")]
    return ordered.select(id_col, variable, F.struct(*keep).alias(PIECE))


def _total(array: Column, get) -> Column:
    return _fold(F.transform(array, get), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def variable_stats(parts: DataFrame, *, hours: float, anchors: list[int] = (), bins: int = 0, n_sources: int = 0, id_col: str = "stay_id",
                   variable: str = "variable", threshold: float = 0.10) -> DataFrame:
    """One row per (id, variable) with the struct ``_s`` of every statistic."""
    p = lambda c: F.col(f"{PIECE}.{c}")
    filled = F.when(p("n") > 0, F.col(PIECE))
    g = parts.groupBy(id_col, variable).agg(
        F.sum(p("rows")).alias("rows"), F.min(p("from")).alias("from"), F.max(p("to")).alias("to"),
        *[F.sum(p(f"rows_{i}")).alias(f"rows_{i}") for i in range(n_sources)],
        F.sum(p("n")).alias("n"), F.sum(p("sum")).alias("sum"), F.min(p("min")).alias("min"), F.max(p("max")).alias("max"),
        F.min(p("first")).alias("_first"), F.max(p("last")).alias("_last"), F.sum(p("early")).alias("early"), F.sum(p("n_early")).alias("n_early"),
        F.sum(p("late")).alias("late"), F.sum(p("n_late")).alias("n_late"), F.max(p("worst")).alias("worst"),
        *[F.min(p(f"near_{a}")).alias(f"near_{a}") for a in anchors],
        F.array_sort(F.collect_list(filled), lambda a, b: F.when(a["_bin"] < b["_bin"], -1).when(a["_bin"] > b["_bin"], 1).when(
            a["_slice"] < b["_slice"], -1).when(a["_slice"] > b["_slice"], 1).otherwise(0)).alias("_p"))
    ps, n, many = F.col("_p"), F.col("n"), F.size("_p") > 0
    mean = F.when(n > 0, F.col("sum") / n)
    h_mean = ratio(_total(ps, lambda x: x["h_mean"] * x["n"]), n)
    g = g.withColumns({"_mean": mean, "_h_mean": h_mean})
    m, hm = F.col("_mean"), F.col("_h_mean")
    off = lambda x: x["sum"] / x["n"] - m
    m2 = _total(ps, lambda x: x["m2"] + x["n"] * off(x) * off(x))
    sxx = _total(ps, lambda x: x["sxx"] + x["n"] * (x["h_mean"] - hm) * (x["h_mean"] - hm))
    sxy = _total(ps, lambda x: x["sxy"] + x["n"] * (x["h_mean"] - hm) * off(x))
    later = F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0)))
    gaps = _fold(F.zip_with(F.slice(ps, 1, F.greatest(F.size(ps) - 1, F.lit(0))), later, lambda a, b: a["v2"] * (b["h1"] - a["h2"])),
                 F.lit(0.0), lambda a, x: a + x)
    span = F.when(many, F.element_at(F.when(many, ps), -1)["h2"] - F.get(ps, F.lit(0))["h1"])
    zero = F.lit(0).cast("bigint")
    run = _fold(F.transform(ps, lambda x: x["run"]), F.struct(zero.alias("open"), zero.alias("best")), lambda a, x: F.struct(
        F.when(x["head"] == x["n"], a["open"] + x["n"]).otherwise(x["open"]).alias("open"),
        F.greatest(a["best"], a["open"] + x["head"], x["best"]).alias("best")))["best"]
    first, last = F.col("_first.v"), F.col("_last.v")
    pct = ratio(last - first, F.abs(first))
    seen = F.when(n > 0, F.lit(1))
    sd = F.when(n > 1, F.sqrt(m2 / n))
    early, late = ratio("early", "n_early"), ratio("late", "n_late")
    stats = {
        "mean": F.when(span > 0, (_total(ps, lambda x: x["area"]) + gaps) / span).otherwise(m), "min": F.col("min"), "max": F.col("max"),
        "plain_mean": m, "delta": last - first, "measured": seen, "sum": F.when(n > 0, F.col("sum")),
        "first": first, "last": last, "last_minus_first": last - first, "percent_change": pct, "first_2h_mean": early, "last_2h_mean": late,
        "last2h_minus_first2h": late - early, "slope_0_6h": F.when(sxx > 0, sxy / sxx),
        "deterioration_flag": F.when(n > 0, flag(pct >= threshold)), "recovery_flag": F.when(n > 0, flag(pct <= -threshold)),
        "range_0_6h": F.col("max") - F.col("min"), "std_0_6h": F.when(n > 1, sd).when(n > 0, F.lit(0.0)),
        "cv_0_6h": ratio(sd, F.abs(m)), "longest_abnormal_run_0_6h": F.when(n > 0, run),
        "abnormal_count_0_6h": F.when(n > 0, _total(ps, lambda x: x["n_bad"].cast("double")).cast("bigint")), "worst_recent_value_0_6h": F.col("worst"),
        "measured_0_6h": F.lit(1), "measurement_count_0_6h": F.col("rows"), "time_to_first_measurement": F.col("from"),
        "time_since_last_measurement_at_6h": F.lit(float(hours)) - F.col("to"),
        **{f"hour_{a}": F.col(f"near_{a}.v") for a in anchors}, **{f"rows_{i}": F.col(f"rows_{i}") for i in range(n_sources)}}
    in_bin = lambda b: F.filter(ps, lambda x: x["_bin"] == b)
    for b in range(bins):
        own = in_bin(b)
        some = F.when(F.size(own) > 0, own)
        count = _fold(F.transform(some, lambda x: x["n"]), zero, lambda a, x: a + x)
        stats |= {f"bin_{b}_mean": _total(some, lambda x: x["sum"]) / count, f"bin_{b}_min": F.array_min(F.transform(some, lambda x: x["min"])),
                  f"bin_{b}_max": F.array_max(F.transform(some, lambda x: x["max"])), f"bin_{b}_last": F.array_max(F.transform(some, lambda x: x["last"]))["v"],
                  f"bin_{b}_observed": F.when(F.size(own) > 0, F.lit(1)), f"bin_{b}_count": count}
    return g.select(id_col, variable, F.struct(*[c.alias(k) for k, c in stats.items()]).alias("_s"))


TRAJECTORY = ["first", "last", "last_minus_first", "percent_change", "first_2h_mean", "last_2h_mean", "last2h_minus_first2h", "slope_0_6h",
              "deterioration_flag", "recovery_flag"]
INSTABILITY = ["range_0_6h", "std_0_6h", "cv_0_6h", "abnormal_count_0_6h", "longest_abnormal_run_0_6h", "worst_recent_value_0_6h"]
PROCESS = ["measured_0_6h", "measurement_count_0_6h", "time_to_first_measurement", "time_since_last_measurement_at_6h"]


def wide_features(win: DataFrame, cohort: DataFrame, *, hours: float, vitals: list[str], labs: list[str], bin_hours: float = 1.0,
                  anchors: list[int] = (), tolerance: float = 0.5, first_limit: float = 1.0, edge_hours: float = 2.0,
                  ranges: dict[str, tuple[float, float]] = K.NORMAL_RANGES, sources: list[str] = (), bins: bool = True, trajectory: bool = True,
                  instability: bool = True, process: bool = True, expected: list[str] | None = None, extra: dict[str, tuple[str, str]] | None = None,
                  count_variables: list[str] | None = None, id_col: str = "stay_id", variable: str = "variable", time: str = "charttime",
                  value: str = "valuenum", source: str = "source", whole_rows: bool = False) -> DataFrame:
    """One row per distinct cohort id with every wanted feature group of ``vitals`` and ``labs``.

    ``whole_rows`` keeps every row and column of ``cohort`` instead, before the features. Join what a stay has of its own
    to the cohort first: up to here a stay's statistics are one map, and the hundreds of columns are made in one last step.
    ``extra`` adds columns, name -> (variable, statistic); a name ending in ``_measured`` is 0 where nothing was
    seen. Totals of the measurement process run over ``count_variables``, all variables if not given."""
    n_bins = math.ceil(hours / bin_hours) if bins else 0
    variables = [*vitals, *labs]
    parts = pieces(win, hours=hours, bin_hours=bin_hours, anchors=anchors, tolerance=tolerance, first_limit=first_limit, edge_hours=edge_hours,
                   ranges=ranges, sources=sources, id_col=id_col, variable=variable, time=time, value=value, source=source)
    stats = variable_stats(parts, hours=hours, anchors=anchors, bins=n_bins, n_sources=len(sources), id_col=id_col, variable=variable)
    counted = F.col(variable).isin(count_variables) if count_variables is not None else F.lit(True)
    rows = lambda c: F.sum(F.when(counted, F.col(f"_s.{c}")))
    expected = variables if expected is None else expected
    one = stats.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct(variable, "_s"))).alias("_m"), rows("measurement_count_0_6h").alias("_rows"),
        *[rows(f"rows_{i}").alias(f"_rows_{i}") for i in range(len(sources))],
        F.countDistinct(F.when(counted & F.col(variable).isin(expected), F.col(variable))).alias("_seen"))
    # a variable's statistics are looked up once, not once per column
    place = {v: f"_v{i}" for i, v in enumerate(dict.fromkeys([*variables, *(v for v, _ in (extra or {}).values())]))}
    base = cohort if whole_rows else cohort.select(id_col).distinct()
    both = base.join(one, id_col, "left")
    both = both.select(*[c for c in both.columns if c != "_m"], *[F.element_at("_m", v).alias(n) for v, n in place.items()])
    at = lambda v, s: F.col(f"{place[v]}.{s}")
    columns: dict[str, Column] = {}
    zero = []
    for v in vitals:
        columns |= {f"{v}_{s}": at(v, s) for s in ("mean", "min", "max", "measured")}
    for v in labs:
        columns |= {f"{v}_{s}": at(v, "plain_mean" if s == "mean" else s) for s in ("mean", "min", "max", "delta", "measured")}
    zero += [f"{v}_measured" for v in variables]
    if anchors:
        low, high = min(anchors), max(anchors)
        for v in variables:
            change = at(v, f"hour_{high}") - at(v, f"hour_{low}")
            columns |= {f"{v}_hour_{a}": at(v, f"hour_{a}") for a in anchors}
            columns |= {f"{v}_change_{low}to{high}": change, f"{v}_hourly_change": change / (high - low)}
            columns |= {f"{v}_delta_{a}to{b}": at(v, f"hour_{b}") - at(v, f"hour_{a}") for a, b in zip(anchors[:-1], anchors[1:])}
    for wanted, names in ((trajectory, TRAJECTORY), (instability, INSTABILITY)):
        if wanted:
            columns |= {f"{v}_{s}": at(v, s) for v in variables for s in names}
    if bins:
        for v in variables:
            for b, label in enumerate(bin_labels(hours, bin_hours)):
                own = ("mean", "min", "max", "last", "observed", "count")
                columns |= {f"{v}_{label}_{s}": at(v, f"bin_{b}_{s}") for s in own}
                zero += [f"{v}_{label}_observed", f"{v}_{label}_count"]
    if process:
        columns |= {f"{v}_{s}": at(v, s) for v in variables for s in PROCESS}
        columns |= {"total_measurements_0_6h": F.col("_rows"), "total_chart_event_count_0_6h": F.col("_rows")}
        columns |= {f"total_{s}_measurements_0_6h": F.when(F.col(f"_rows_{i}") > 0, F.col(f"_rows_{i}")) for i, s in enumerate(sources)}
        columns["panel_missing_count_0_6h"] = F.when(F.col("_rows") > 0, (F.lit(len(expected)) - F.col("_seen")).cast("bigint"))
        zero += [f"{v}_{s}" for v in variables for s in PROCESS[:2]] + [c for c in columns if c.startswith("total_") or c.startswith("panel_")]
    for name, (v, s) in (extra or {}).items():
        columns[name] = at(v, s)
        zero += [name] if name.endswith("_measured") else []
    zero = set(zero)
    own = [id_col, *[c for c in base.columns if c != id_col]]
    return both.select(*own, *[(F.coalesce(c, F.lit(0)) if k in zero else c).alias(k) for k, c in columns.items()])
