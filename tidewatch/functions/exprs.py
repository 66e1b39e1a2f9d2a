"""Null-safe column expressions. Missing values are NULL; a rule on a missing input is 0."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.constants import MIX, POISSON_CUTS

COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def hours_between(start, end) -> Column:
    """Exact hours from ``start`` to ``end``, for zoned and zone-less timestamps."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)).cast("double") / F.lit(3600000000.0)


def plus_hours(ts, hours: float) -> Column:
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))


def clip(c, low=None, high=None) -> Column:
    c = col(c)
    out = F.when(F.lit(False), c)
    if low is not None:
        out = out.when(c < F.lit(low), F.lit(float(low)))
    if high is not None:
        out = out.when(c > F.lit(high), F.lit(float(high)))
    return out.otherwise(c)


def outside(c, low, high) -> Column:
    return (col(c) < F.lit(low)) | (col(c) > F.lit(high))


def flag(condition: Column) -> Column:
    """1 when the condition is true, 0 when it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def rule(column: str, op: str, threshold: float) -> Column:
    return COMPARE[op](F.col(column), F.lit(threshold))


def ratio(a, b) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def or_zero(c) -> Column:
    return F.coalesce(c, F.lit(0.0))


def sanitize_token(c) -> Column:
    """Lower-case name token of letters, digits and single underscores; 'feature' if empty."""
    token = F.regexp_replace(F.lower(F.trim(col(c).cast("string"))), "[^a-z0-9]+", "_")
    token = F.regexp_replace(token, "^_+|_+$", "")
    return F.when(token == "", F.lit("feature")).otherwise(token)


def canonical_variable(c, aliases: dict[str, str]) -> Column:
    token = sanitize_token(c)
    mapping = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(mapping[token], token)


def logit(p, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -50.0, 50.0)))


def cut_right_closed(c, edges: list, labels: list[str]) -> Column:
    """Label of the right-closed bin (edges[i], edges[i+1]] holding the value, NULL outside.

    ``None`` as the outermost edge means unbounded."""
    c = col(c)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (c > F.lit(low))
        if high is not None:
            inside = inside & (c <= F.lit(high))
        out = out.when(c.isNotNull() & inside, F.lit(label))
    return out


def row_mean(columns: list) -> Column:
    """Mean over the columns, skipping nulls; NULL when all are null."""
    cols = [col(c) for c in columns]
    total = sum((or_zero(c) for c in cols), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return ratio(total, count)


def row_sum(columns: list) -> Column:
    return sum((or_zero(col(c)) for c in columns), F.lit(0.0))


def row_std(columns: list, min_count: int = 2) -> Column:
    """Sample standard deviation over the columns, skipping nulls."""
    cols = [col(c).cast("double") for c in columns]
    mean = row_mean(cols)
    count = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    ss = sum((or_zero((c - mean) * (c - mean)) for c in cols), F.lit(0.0))
    return F.when(count >= min_count, F.sqrt(ratio(ss, count - 1)))


def row_slope(columns: list, xs: list[float], min_count: int = 2) -> Column:
    """Least-squares slope over (xs[i], columns[i]), skipping nulls."""
    cols = [col(c).cast("double") for c in columns]
    here = [c.isNotNull().cast("double") for c in cols]
    n = sum(here, F.lit(0.0))
    sx = sum((h * F.lit(float(x)) for h, x in zip(here, xs)), F.lit(0.0))
    sxx = sum((h * F.lit(float(x) * float(x)) for h, x in zip(here, xs)), F.lit(0.0))
    sy = sum((or_zero(c) for c in cols), F.lit(0.0))
    sxy = sum((or_zero(c) * F.lit(float(x)) for c, x in zip(cols, xs)), F.lit(0.0))
    return F.when(n >= min_count, ratio(n * sxy - sx * sy, n * sxx - sx * sx))


def grid_edges(n_bins: int) -> list[float]:
    """The n_bins + 1 equally spaced edges of [0, 1]; the last is exactly 1."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def edge_bin(p, edges: list[float]) -> Column:
    """Index of the left-closed bin holding p, the last bin closed; NULL outside."""
    p = col(p)
    last = len(edges) - 2
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for i in range(len(edges) - 1):
        upper = (p <= F.lit(edges[i + 1])) if i == last else (p < F.lit(edges[i + 1]))
        out = out.when((p >= F.lit(edges[i])) & upper, F.lit(i))
    return out


def hash_fraction(*parts) -> Column:
    """Uniform number in [0, 1) from the first 8 hex digits of an md5, equal on every engine."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_weight(row_key, replicate, seed: int = 12345) -> Column:
    """Poisson(1) resampling weight of a row in a replicate, from integer arithmetic only."""
    mask = F.lit(4294967295).cast("bigint")

    def mix(x: Column) -> Column:
        # each step uses its input twice, so it is bound once by a one-element array
        def step(x: Column, shift: int, factor: int) -> Column:
            return F.transform(F.array(x), lambda v: (v.bitwiseXOR(F.shiftright(v, shift)) * F.lit(factor).cast("bigint")).bitwiseAND(mask))[0]
        return step(step(step(x, 16, MIX[0]), 15, MIX[1]), 15, 1)

    key = col(row_key).cast("bigint")
    low, high = key.bitwiseAND(mask), F.shiftright(key, 32).bitwiseAND(mask)
    s = mix(F.lit(seed).cast("bigint").bitwiseAND(mask))
    a = mix(mix(low.bitwiseXOR(s)).bitwiseXOR(high))
    b = mix(mix(low.bitwiseXOR(mix(s.bitwiseXOR(F.lit(MIX[2]).cast("bigint"))))).bitwiseXOR(high))
    r = mix(col(replicate).cast("bigint").bitwiseXOR(s))
    x = mix(mix(a.bitwiseXOR(r)).bitwiseXOR(b)) / F.lit(4294967296.0)
    out = F.when(F.lit(False), F.lit(0))
    for k, cut in enumerate(POISSON_CUTS):
        out = out.when(x < F.lit(cut), F.lit(k))
    return out.otherwise(F.lit(len(POISSON_CUTS)))
