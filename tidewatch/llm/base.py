"""Registry and small expressions shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle SQL if there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; 0 for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def tasks(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """Values of a text column, one Python object at a time."""
    return (x.as_py() for x in column)


def release() -> None:
    """Give freed memory of a Python worker back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(texts: Iterable[str | None], size: int) -> Iterator[list[str | None]]:
    """The texts in runs of about ``size`` characters."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(place, run) of a text column in runs of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(column):
        to = min(len(column), 1 + int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield at, column.slice(at, to - at)
        at = to


def sampled(hash_: Column, fraction: float) -> Column:
    """Whether a row's hash falls into the first ``fraction`` of its range: a sample that needs no sort."""
    return F.pmod(hash_, F.lit(1 << 30)) < F.lit(min(1 << 30, int(fraction * (1 << 30)) + 1))


def append(df: DataFrame, text: str | list[str], start: Callable, extra: str, uid: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` with more columns, made from the text column (or several columns) in Arrow batches.

    ``start()`` runs once a task and gives a function from a list of values per column to arrays, one for each of
    the ``extra`` columns ("name type, ..."), which replace columns of the same name. Rows travel as
    one struct, so their names and types don't matter. ``uid`` adds a number that tells rows apart;
    it is only stable once the result is stored."""
    added = StructType.fromDDL(extra)
    names = added.names
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in names and c != uid])
    read = [text] if isinstance(text, str) else text
    packed = df.select(row.alias("row"), *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(read)])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            made = make(*[list(texts_of(b.column(1 + i))) for i in range(len(read))])
            if uid:
                made = [*made, pa.array(range(at, at + b.num_rows), pa.int64())]
                at += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["row", *names, *([uid] if uid else [])])
        release()

    # a struct type written out as text cannot hold every name, so the schema is built
    schema = packed.select("row").schema
    for f in added.fields:
        schema = schema.add(f)
    if uid:
        schema = schema.add(uid, "long")
    return packed.mapInArrow(work, schema).select("row.*", *names, *([uid] if uid else []))
