"""Regular-grid channels per (stay, bin), kept long: (id, bin, channel, value, mask, count).

Hot stays are safe throughout: binning is a map-side combined aggregate, and everything after
it has at most bins x channels rows per stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions.exprs import canonical_variable, flag

CHANNELS = ([f"{v}_{a}" for v in K.GRID_VITALS for a in ("last", "min", "max")] + [f"{v}_last" for v in K.GRID_LABS]
            + K.GRID_DERIVED)


def grid_wide(win: DataFrame, *, n_bins: int = 24, bin_hours: float = 0.25, aliases: dict[str, str] = K.VARIABLE_ALIASES,
              id_col: str = "stay_id", variable: str = "variable", time: str = "charttime",
              value: str = "valuenum") -> DataFrame:
    """(id, bin, variable, last, min, max, count): the only pass over the events."""
    b = F.greatest(F.lit(0), F.least(F.floor(F.col("hours_from_admit") / F.lit(bin_hours)), F.lit(n_bins - 1)))
    data = win.where(F.col(value).isNotNull() & F.col(variable).isNotNull())
    data = data.select(id_col, b.cast("int").alias("bin"), canonical_variable(variable, aliases).alias("variable"),
                       F.col(time).alias("_t"), F.col(value).cast("double").alias("_v"))
    return data.groupBy(id_col, "bin", "variable").agg(
        F.max_by("_v", F.struct("_t", "_v")).alias("last"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.count("*").alias("count"))


def base_channels(binned: DataFrame, channels: list[str] = CHANNELS, *, id_col: str = "stay_id") -> DataFrame:
    """Observed base channels: each variable's last, and min and max where they are channels."""
    stat = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).alias("v")) for a in ("last", "min", "max")]))
    long = binned.select(id_col, "bin", "variable", "count", stat.alias("s"))
    name = F.concat_ws("_", "variable", "s.a")
    return (long.select(id_col, "bin", name.alias("channel"), F.col("s.v").alias("value"), F.lit(1).alias("mask"), "count")
            .where(F.col("channel").isin([c for c in channels if c not in K.GRID_DERIVED])))


def _bad(c: Column, below, above) -> Column:
    cond = F.lit(False)
    if below is not None:
        cond = cond | (c < F.lit(below))
    if above is not None:
        cond = cond | (c > F.lit(above))
    return flag(cond)


def derived_channels(base: DataFrame, channels: list[str] = CHANNELS, *, id_col: str = "stay_id") -> DataFrame:
    """Per-bin shock index, hypotension, hypoxaemia, inflammation and critical counts; each
    observed only when one of its inputs is."""
    need = sorted({c for c, _, _ in K.GRID_CRITICAL_RULES} | {"sbp_last", "heart_rate_last"})
    w = base.groupBy(id_col, "bin").pivot("channel", need).agg(F.first("value", ignorenulls=True))
    c = F.col
    any_of = lambda cols: F.coalesce(*[c(x) for x in cols]).isNotNull()
    sirs = {"temperature_last": (36, 38), "heart_rate_last": (None, 90), "respiratory_rate_last": (None, 20),
            "wbc_last": (4, 12)}
    out = {
        "shock_index_bin": F.when(c("heart_rate_last").isNotNull() & c("sbp_last").isNotNull(),
                                  c("heart_rate_last") / F.greatest(F.abs("sbp_last"), F.lit(1e-6))),
        "hypotension_flag_bin": F.when(any_of(["sbp_min", "map_min"]),
                                       F.greatest(_bad(c("sbp_min"), 90, None), _bad(c("map_min"), 65, None))),
        "hypoxemia_flag_bin": F.when(c("spo2_min").isNotNull(), _bad(c("spo2_min"), 90, None)),
        "sirs_count_bin": F.when(any_of(list(sirs)), sum((_bad(c(k), *v) for k, v in sirs.items()), F.lit(0))),
        "critical_value_count_bin": F.when(any_of([k for k, _, _ in K.GRID_CRITICAL_RULES]),
                                           sum((_bad(c(k), b, a) for k, b, a in K.GRID_CRITICAL_RULES), F.lit(0))),
    }
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), e.cast("double").alias("value"))
                                for n, e in out.items() if n in channels]))
    return (w.select(id_col, "bin", cells.alias("s")).select(id_col, "bin", "s.channel", "s.value")
            .where(F.col("value").isNotNull())
            .select(id_col, "bin", "channel", "value", F.lit(1).alias("mask"), F.lit(1).cast("bigint").alias("count")))


def dense_grid(cells: DataFrame, ids: DataFrame, channels: list[str], *, n_bins: int = 24,
               id_col: str = "stay_id") -> DataFrame:
    """Every (id, bin, channel): unobserved cells are value 0, mask 0, count 0.

    Bins and channels are exploded from literals, so no cross join takes place."""
    full = (ids.select(id_col).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
            .withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels]))))
    return full.join(cells, [id_col, "bin", "channel"], "left").select(
        id_col, "bin", "channel", F.coalesce("value", F.lit(0.0)).alias("value"),
        F.coalesce("mask", F.lit(0)).alias("mask"), F.coalesce("count", F.lit(0)).alias("count"))


def time_since_last(grid: DataFrame, *, bin_hours: float = 0.25, window_hours: float = 6.0,
                    id_col: str = "stay_id") -> DataFrame:
    """Add ``delta``: 0 when observed, hours since the last observation, window before any."""
    w = Window.partitionBy(id_col, "channel").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("mask") == 1, F.col("bin")), ignorenulls=True).over(w)
    return grid.withColumn("delta", F.coalesce((F.col("bin") - seen) * F.lit(bin_hours), F.lit(window_hours)))


def build_grid(win: DataFrame, ids: DataFrame, channels: list[str] = CHANNELS, *, n_bins: int = 24,
               bin_hours: float = 0.25, aliases: dict[str, str] = K.VARIABLE_ALIASES, id_col: str = "stay_id") -> DataFrame:
    base = base_channels(grid_wide(win, n_bins=n_bins, bin_hours=bin_hours, aliases=aliases, id_col=id_col),
                         channels, id_col=id_col)
    cells = base.unionByName(derived_channels(base, channels, id_col=id_col))
    grid = dense_grid(cells, ids, channels, n_bins=n_bins, id_col=id_col)
    return time_since_last(grid, bin_hours=bin_hours, window_hours=n_bins * bin_hours, id_col=id_col)


def fit_normalizer(grid: DataFrame, fit_on: Column) -> DataFrame:
    """(channel, mean, std) over observed cells of the fitting rows; tiny spreads become 1."""
    obs = F.when(fit_on & (F.col("mask") == 1), F.col("value"))
    s = F.stddev_pop(obs)
    return grid.groupBy("channel").agg(F.coalesce(F.avg(obs), F.lit(0.0)).alias("mean"),
                                       F.when(s > 1e-6, s).otherwise(F.lit(1.0)).alias("std"))


def normalize(grid: DataFrame, params: DataFrame, *, clip_value: float = 5.0, max_delta: float = 6.0,
              max_count: float = 10.0) -> DataFrame:
    """Scaled value (clipped, 0 where unobserved), log-scaled delta and count."""
    z = (F.col("value") - F.col("mean")) / F.col("std")
    z = F.greatest(F.lit(-clip_value), F.least(F.lit(clip_value), z)) * F.col("mask")
    log = lambda c, m: F.log1p(F.least(F.col(c).cast("double"), F.lit(m))) / F.log1p(F.lit(m))
    rest = [c for c in grid.columns if c not in ("value", "delta", "count")]
    return grid.join(params, "channel").select(*rest, z.alias("value"), log("delta", max_delta).alias("delta"),
                                               log("count", max_count).alias("count"))


def pack(grid: DataFrame, channels: list[str], *, id_col: str = "stay_id", columns=("value", "mask")) -> DataFrame:
    """One row per id with nested arrays [bin][channel] per column: bins x channels cells each."""
    wide = grid.groupBy(id_col, "bin").pivot("channel", channels).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in columns])
    rows = wide.select(id_col, "bin", *[F.array(*[F.col(f"`{ch}_{c}`" if len(columns) > 1 else f"`{ch}`") for ch in channels]).alias(c)
                                        for c in columns])
    packed = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("bin", *columns))).alias("_g"))
    return packed.select(id_col, *[F.col(f"_g.{c}").alias(c) for c in columns])
