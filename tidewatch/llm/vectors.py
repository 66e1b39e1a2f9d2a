"""What both vector searches share: usable vectors, one row per distinct vector, and ranked answers.

Copies of a vector share every score, so only the k + 1 smallest ids of a distinct vector can be in
any answer of k (one of them may be the query itself): the others would come after them in every
list. Queries with the same vector share one search. Nothing is lost by either."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, vec_id: str, vector: str, zero: bool) -> DataFrame:
    """(id, v) of rows whose id and vector are not null and whose components are all finite, as doubles;
    ``zero`` lets zero vectors take part. Vectors of another length than the most frequent one (the
    longest of equally frequent ones) have no score with the others and take no part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))
    if not zero:
        good = good & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(good)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each distinct vector with its ``keep`` smallest ids."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= keep).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def queries(rows: DataFrame, every: int) -> DataFrame:
    """(query_id, v, rep): rows whose id is divisible by ``every``; ``rep`` is the smallest such id of the same vector."""
    q = rows.where(F.pmod("id", F.lit(every)) == 0).withColumnRenamed("id", "query_id").distinct()
    return q.join(q.groupBy("v").agg(F.min("query_id").alias("rep")), "v")


def ranked(found: DataFrame, asked: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """(query_id, rank, vec_id, score) from (rep, vec_id, score) rows that hold each search's first k + 1."""
    first = F.row_number().over(Window.partitionBy("rep").orderBy(*order))
    best = found.withColumn("_r", first).where(F.col("_r") <= k + 1).groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("a"))
    rows = asked.select("query_id", "rep").join(best, "rep")
    own = F.slice(F.filter("a", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = rows.select("query_id", F.posexplode(own).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def matrix(column: pd.Series) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 0))


def first_ids(score: np.ndarray, ids: list, keep: int) -> tuple[list[int], list]:
    """The first ``keep`` (score, id) of vectors with lists of ids, smallest score first, ties to smaller ids."""
    order = np.argsort(score, kind="stable")
    # whole ties at the end are needed, as a later vector may have smaller ids
    out, i = [], 0
    while i < len(order) and (len(out) < keep or score[order[i]] == out[-1][0]):
        out += [(score[order[i]], v) for v in ids[order[i]]]
        i += 1
    out.sort(key=lambda x: (x[0], x[1]))
    out = out[:keep]
    return [v for _, v in out], [s for s, _ in out]
