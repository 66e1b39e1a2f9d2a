"""Exact global order statistics without a single-task sort.

A window ordered over a whole table runs in one task. Here every ordered computation is cut
into buckets whose edges follow the data, so a task only ever holds one bucket; the totals
of the buckets before it come back as a small offset table (buckets x groups rows).
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.joins import null_safe_join
from tidewatch.plans.lineage import scanned


def default_buckets(df: DataFrame) -> int:
    """Four buckets per shuffle partition, 16 at least: they follow the cluster and its data."""
    return max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fit_edges(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Approximately equi-depth cut points of a column: one narrow map-side aggregate, and at
    most ``buckets`` numbers on the driver. They only balance work; no result depends on them."""
    buckets = buckets or default_buckets(df)
    probs = [i / buckets for i in range(1, buckets)]
    row = df.select(F.percentile_approx(F.col(value).cast("double"), probs, 5 * buckets).alias("e")).first()
    return sorted(set(row.e or []))


def fit_cells(df: DataFrame, value: str, buckets: int) -> tuple[list[float], list[float]]:
    """(edges, heavy): like ``fit_edges``, with the values so frequent that they repeat among the
    cut points; each of those can get a cell of its own."""
    probs = [i / buckets for i in range(1, buckets)]
    raw = df.select(F.percentile_approx(F.col(value).cast("double"), probs, 5 * buckets).alias("e")).first().e or []
    times = Counter(raw)
    return sorted(times), sorted(v for v, n in times.items() if n > 1)


def cell_of(value, edges: list[float], heavy: list[float]) -> Column:
    """Cell number, rising with the value; a heavy value is alone in its cell."""
    value = F.col(value) if isinstance(value, str) else value
    out = bucket_of(value, edges)
    for h in heavy:
        out = out + (value >= F.lit(h)).cast("int")
    return out


def bucket_of(value, edges: list[float], inline: int = 96) -> Column:
    """Number of edges below the value, never NULL.

    A few edges become plain comparisons inside the generated code. Many would outgrow a JVM
    method, so they are held in arrays and found in two steps of about sqrt(n) comparisons."""
    value = F.col(value) if isinstance(value, str) else value
    value = value.cast("double")
    if not edges:
        return F.lit(0)
    if len(edges) <= inline:
        out = sum(((value > F.lit(e)).cast("int") for e in edges[1:]), (value > F.lit(edges[0])).cast("int"))
    else:
        chunk = math.isqrt(len(edges)) + 1
        groups = [edges[i:i + chunk] for i in range(0, len(edges), chunk)]
        below = lambda arr: F.size(F.filter(arr, lambda e: e < value))
        # full groups below the value, then the position inside the next one
        full = below(F.array(*[F.lit(g[-1]) for g in groups]))
        nested = F.array(*[F.array(*[F.lit(e) for e in g]) for g in groups], F.array().cast("array<double>"))
        out = F.least(full * chunk, F.lit(len(edges))) + F.when(full < len(groups), below(nested[full])).otherwise(0)
    # a nullable join key would be filtered below the aggregate on one side of a self-join only,
    # and the shuffle of the counts could not be reused
    return F.coalesce(out, F.lit(-1))


def running_totals(df: DataFrame, group: list[str], order: str, values: list[str], edges: list[float],
                   descending: bool = False, exclusive: bool = False) -> DataFrame:
    """Add ``cum_<v>``: running sum of each value column over ``order`` inside each group.

    ``df`` has one row per (group, order). Buckets are (group, edge bucket), so a hot group is
    spread as well. The offset of a bucket is the total of the buckets before it."""
    sign = -1 if descending else 1
    data = df.withColumn("_b", bucket_of(order, edges) * F.lit(sign))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = data.groupBy(*group, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    offsets = offsets.select(*group, "_b", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}")
                                             for v in values])
    key = F.col(order).desc() if descending else F.col(order).asc()
    frame = Window.partitionBy(*group, "_b").orderBy(key).rowsBetween(Window.unboundedPreceding,
                                                                      -1 if exclusive else 0)
    local = data.select("*", *[F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(f"_c_{v}") for v in values])
    joined = null_safe_join(local, offsets, [*group, "_b"])
    return joined.select(*df.columns, *[(F.col(f"_c_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values])


def hash_ranks(df: DataFrame, group: list[str], row_key: str, salt: str | Column = "", digits: int = 3,
               rank: str = "rank") -> DataFrame:
    """Row number and size of each group in md5 order of ``row_key`` (then the key itself).

    md5 digits are uniform, so 16^digits buckets per group share the work evenly however few
    groups there are. Adds ``rank`` (from 1) and ``n``."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    data = df.withColumn("_h", F.md5(F.concat(F.col(row_key).cast("string"), salt)))
    data = data.withColumn("_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    counts = data.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"),
                            F.sum("_n").over(Window.partitionBy(*group)).alias("n"))
    local = data.withColumn("_r", F.row_number().over(
        Window.partitionBy(*group, "_b").orderBy("_h", row_key)).cast("bigint"))
    return null_safe_join(local, offsets, [*group, "_b"]).select(*df.columns, (F.col("_r") + F.col("_o")).alias(rank), "n")


def value_ranks(df: DataFrame, value: str, row_key: str, rank: str = "rank", digits: int = 2) -> DataFrame:
    """Row number over (value, md5(row_key), row_key) for the whole table; NULL for a null value.

    Rows are counted per (value, md5 bucket) first, so even one value holding most rows is
    ranked in 16^digits independent pieces."""
    edges = fit_edges(df, value)
    data = df.withColumn("_h", F.md5(F.col(row_key).cast("string")))
    data = data.withColumn("_hb", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    pieces = data.where(F.col(value).isNotNull()).groupBy(value, "_hb").agg(F.count("*").alias("_n")).withColumn("_b", bucket_of(value, edges))
    totals = pieces.groupBy("_b").agg(F.sum("_n").alias("_t"))
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inner = Window.partitionBy("_b").orderBy(value, "_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("_c", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(totals, "_b")
    offsets = offsets.select(value, "_hb", (F.col("_c") + F.col("_o")).alias("_off"))
    local = data.withColumn("_r", F.row_number().over(
        Window.partitionBy(value, "_hb").orderBy("_h", row_key)).cast("bigint"))
    return null_safe_join(local, offsets, [value, "_hb"], "left").select(*df.columns, (F.col("_r") + F.col("_off")).alias(rank))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 2000, batch: int = 100,
                    limit: int = 500_000) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles (linear, as ``percentile``) of many columns.

    A quantile is one or two ranks. A bounded sketch brackets each rank, plain sums count the rows
    below and inside the bracket, and a bracket that misses its rank, or holds more than ``limit``
    rows, is cut again inside the last one known to hold it: by another sketch, by halving where the
    sketch does not help. Only the value counts inside final brackets are shuffled; a bracket of one
    value needs none. One way for every size. The source is written once if it is more than a scan."""
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    df = scanned(df.select(*columns)) if columns else df
    for start in range(0, len(columns), batch):
        todo, places = _first_brackets(df, columns[start:start + batch], probs, accuracy)
        found: dict[tuple[str, int], float] = {}
        while todo:
            _count(df, todo)
            final, wide = [], []
            for w in todo:
                if w["rank"] < w["below"]:  # missed: between the last good start and here
                    w.update(low=w["good"][0], high=w["low"], halve=False)
                    wide.append(w)
                elif w["rank"] >= w["below"] + w["inside"]:
                    w.update(low=w["high"], high=w["good"][1], halve=False)
                    wide.append(w)
                elif w["low"] == w["high"]:
                    found[w["c"], w["rank"]] = w["low"]
                elif w["inside"] > limit:
                    w["good"] = (w["low"], w["high"])
                    wide.append({**w, "cut": True})
                else:
                    final.append(w)
            _narrow(df, [w for w in wide if w.pop("cut", False)], accuracy)
            _resolve(df, final, found)
            todo = wide
        for c, j, lo, hi, frac in places:
            a, b = found[c, lo], found[c, hi]
            out[c][j] = a + (b - a) * frac
    return out


def _value(c: str) -> Column:
    return F.col(c).cast("double")


def _within(w: dict) -> Column:
    return (_value(w["c"]) >= F.lit(w["low"])) & (_value(w["c"]) <= F.lit(w["high"]))


def _first_brackets(df: DataFrame, columns: list[str], probs: list[float], accuracy: int) -> tuple[list[dict], list[tuple]]:
    slack = 5.0 / accuracy
    ps = [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]
    row = df.agg(*[a for i, c in enumerate(columns) for a in (
        F.percentile_approx(_value(c), ps, accuracy).alias(f"p{i}"), F.count(c).alias(f"n{i}"),
        F.min(_value(c)).alias(f"a{i}"), F.max(_value(c)).alias(f"z{i}"))]).first()
    wanted, places = {}, []
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        for j, p in enumerate(probs if n else []):
            pos = (n - 1) * p
            lo = int(pos)
            hi = min(lo + 1, n - 1) if pos > lo else lo
            low = row[f"a{i}"] if p <= slack else row[f"p{i}"][2 * j]
            high = row[f"z{i}"] if p >= 1 - slack else row[f"p{i}"][2 * j + 1]
            places.append((c, j, lo, hi, pos - lo))
            for rank in (lo, hi):
                wanted.setdefault((c, rank), dict(c=c, rank=rank, low=low, high=high, good=(row[f"a{i}"], row[f"z{i}"]), halve=False))
    return list(wanted.values()), places


def _count(df: DataFrame, wanted: list[dict]) -> None:
    spans = list({(w["c"], w["low"], w["high"]): w for w in wanted}.values())
    row = df.agg(*[a for k, w in enumerate(spans) for a in (
        F.sum(F.when(_value(w["c"]) < F.lit(w["low"]), 1).otherwise(0)).alias(f"b{k}"),
        F.sum(F.when(_within(w), 1).otherwise(0)).alias(f"i{k}"))]).first()
    known = {(w["c"], w["low"], w["high"]): (row[f"b{k}"], row[f"i{k}"]) for k, w in enumerate(spans)}
    for w in wanted:
        w["below"], w["inside"] = known[w["c"], w["low"], w["high"]]


def _narrow(df: DataFrame, wanted: list[dict], accuracy: int) -> None:
    """Cut brackets by a sketch over their own rows; where that moved neither end last time, halve them."""
    slack = 5.0 / accuracy
    sketch = [w for w in wanted if not w["halve"]]
    at = lambda w: [max(0.0, (w["rank"] - w["below"]) / w["inside"] - slack), min(1.0, (w["rank"] - w["below"]) / w["inside"] + slack)]
    row = df.agg(*[F.percentile_approx(F.when(_within(w), _value(w["c"])), at(w), accuracy).alias(f"p{k}")
                   for k, w in enumerate(sketch)]).first() if sketch else None
    for k, w in enumerate(sketch):
        low, high = row[f"p{k}"]
        w["halve"] = (low, high) == (w["low"], w["high"])
        w["low"], w["high"] = low, high
    for w in wanted:
        if w["halve"]:
            middle = w["low"] + (w["high"] - w["low"]) / 2
            w["high"] = middle if w["low"] <= middle < w["high"] else w["low"]


def _resolve(df: DataFrame, wanted: list[dict], found: dict) -> None:
    """Ranks inside brackets of bounded size, by running counts of their values."""
    if not wanted:
        return
    pieces = F.array(*[F.when(_within(w), F.struct(F.lit(k).alias("k"), _value(w["c"]).alias("v"))) for k, w in enumerate(wanted)])
    counts = (df.select(F.explode(F.filter(pieces, lambda s: s.isNotNull())).alias("s"))
              .groupBy("s.k", "s.v").agg(F.count("*").alias("n")))
    rank = F.create_map(*[x for k, w in enumerate(wanted) for x in (F.lit(k), F.lit(w["rank"] - w["below"]).cast("bigint"))])[F.col("k")]
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    cum = counts.withColumns({"upto": upto, "rank": rank})
    for g in cum.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).select("k", "v").collect():
        found[wanted[g.k]["c"], wanted[g.k]["rank"]] = g.v
