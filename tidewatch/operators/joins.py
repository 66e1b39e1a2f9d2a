"""Joins of a large table with a table that has few rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import hours_between

SALT = 16


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL, so that rows and groups with a null key stay.

    Keys come from ``left``; all other columns of both sides must have different names."""
    if not keys:
        return left.crossJoin(right)
    named = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    on = None
    for i, k in enumerate(keys):
        same = left[k].eqNullSafe(named[f"_right_{i}"])
        on = same if on is None else on & same
    return left.join(named, on, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], *, by: list[str], how: str = "inner",
                salt: int | None = None) -> DataFrame:
    """Join on ``keys``; ``how`` is inner, left, left_semi or left_anti.

    In all of these adaptive execution splits a skewed partition of the left, big side at run time,
    so nothing is repeated for keys that are not hot. Only where that is switched off, or ``salt``
    asks for it, each key of ``big`` is spread over ``salt`` tasks by a hash of ``by``, and ``small``
    is repeated per salt value."""
    if salt is None:
        conf = big.sparkSession.conf
        adaptive = all(conf.get(k, "true") == "true" for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"))
        salt = 1 if adaptive else SALT
    if salt <= 1:
        return big.join(small, keys, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salt)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def keep_members(big: DataFrame, members: DataFrame, key: str, *, by: list[str], keep: bool = True) -> DataFrame:
    """Rows of ``big`` whose key is (or, with ``keep=False``, is not) among the members."""
    return spread_join(big, members.select(key).distinct(), [key], by=by, how="left_semi" if keep else "left_anti")


def _bucket(df: DataFrame, time: str, width: float) -> Column:
    """Number of the stretch of ``width`` hours since 1970 that holds a time."""
    epoch = F.lit("1970-01-01 00:00:00").cast(df.schema[time].dataType)
    return F.floor(hours_between(epoch, time) / F.lit(float(width))).cast("bigint")


def interval_join(events: DataFrame, spans: DataFrame, keys: list[str], *, time: str, start: str, end: str, width: float) -> DataFrame:
    """Every event with every span of its key that holds its time, both ends included.

    Keys and time buckets of ``width`` hours are joined for equality: a span is listed once per bucket it
    touches, so an event only meets spans that touch its own bucket, however many its key has over the years. Choose
    ``width`` near the usual length of a span. Null times and spans that end before they start match nothing."""
    some = spans.where(F.col(start) <= F.col(end))
    listed = some.withColumn("_bucket", F.explode(F.sequence(_bucket(spans, start, width), _bucket(spans, end, width))))
    dealt = events.where(F.col(time).isNotNull()).withColumn("_bucket", _bucket(events, time, width))
    both = spread_join(dealt, listed, [*keys, "_bucket"], by=[time])
    return both.where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_bucket")
