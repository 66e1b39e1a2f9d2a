"""Typed scans, contract checks and sinks."""

from __future__ import annotations

import os
from collections import defaultdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.exprs import hours_between
from tidewatch.operators.joins import spread_join
from tidewatch.plans.lineage import stored

STAYS = T.StructType([T.StructField("stay_id", T.LongType()), T.StructField("subject_id", T.LongType()),
                      T.StructField("hadm_id", T.LongType()), T.StructField("intime", T.TimestampType()),
                      T.StructField("outtime", T.TimestampType())])
CHART_EVENTS = T.StructType([T.StructField("stay_id", T.LongType()), T.StructField("charttime", T.TimestampType()),
                             T.StructField("itemid", T.IntegerType()), T.StructField("valuenum", T.DoubleType())])
LAB_EVENTS = T.StructType([T.StructField("subject_id", T.LongType()), T.StructField("charttime", T.TimestampType()),
                           T.StructField("itemid", T.IntegerType()), T.StructField("valuenum", T.DoubleType())])


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet",
         schema: T.StructType | None = None) -> DataFrame:
    """Read only the named columns; CSV needs a schema, so nothing is inferred."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        if schema is None:
            raise ValueError("csv scans need an explicit schema")
        reader = reader.option("header", "true").option("enforceSchema", "false")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select(*columns) if columns else df


def parse_timestamps(df: DataFrame, columns: list[str], coerce: bool = False, fmt: str | None = None) -> DataFrame:
    """Parse text columns; ``coerce`` turns unreadable text into NULL instead of failing."""
    parse = F.try_to_timestamp if coerce else F.to_timestamp
    args = [F.lit(fmt)] if fmt and coerce else [fmt] if fmt else []
    return df.withColumns({c: parse(F.col(c), *args) for c in columns})


def filtered_event_scan(events: DataFrame, cohort: DataFrame, items: DataFrame, *, max_hours: float,
                        id_col: str = "stay_id", time_col: str = "charttime", item_col: str = "itemid",
                        value_col: str = "valuenum", source_id: str | None = None,
                        allow_before: bool = False) -> DataFrame:
    """Drop null keys, map source id to stay, keep known items, cut at ``max_hours``.

    ``cohort`` holds (id, intime [, source_id]); ``items`` holds (item, variable). Events
    before admission are dropped unless ``allow_before``."""
    key = source_id or id_col
    data = events.select(key, time_col, item_col, value_col).na.drop()
    data = data.join(items, item_col)
    data = spread_join(data, cohort.select(*{key, id_col}, "intime"), [key], by=[time_col])
    data = data.withColumn("hours_from_admit", hours_between("intime", time_col))
    data = data.where(F.col("hours_from_admit") <= max_hours)
    if not allow_before:
        data = data.where(F.col("hours_from_admit") >= 0)
    return data.select(id_col, "variable", "hours_from_admit", value_col)


def observed(o: Observation) -> dict[str, int]:
    """Counts of an observation after its job, 0 where nothing passed; a step that the optimizer left out because
    its input was empty has no row of metrics at all."""
    try:
        return defaultdict(int, {k: v or 0 for k, v in o.get.items()})
    except Py4JJavaError as e:
        if "assertion failed" not in str(e):
            raise
        return defaultdict(int)


def observed_event_scan(events: DataFrame, cohort: DataFrame, items: DataFrame, *, max_hours: float, id_col: str = "stay_id",
                        time_col: str = "charttime", item_col: str = "itemid", value_col: str = "valuenum", source_id: str | None = None,
                        allow_before: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of ``filtered_event_scan``, stored; what each step left out as (step, name, n)) from one pass over the events.

    Counts are observed while the rows are written. ``items`` and ``cohort`` hold one row per item and key, as there."""
    key = source_id or id_col
    read, known, matched, kept = (Observation(n) for n in ("read", "known", "matched", "kept"))
    cols = [key, time_col, item_col, value_col]
    null = F.lit(False)
    for c in cols:
        null = null | F.col(c).isNull()
    data = events.select(*cols).observe(read, F.count("*").alias("n"), F.sum(null.cast("int")).alias("nulls")).na.drop()
    data = data.join(items, item_col).observe(known, F.count("*").alias("n"))
    data = spread_join(data, cohort.select(*{key, id_col}, "intime"), [key], by=[time_col]).observe(matched, F.count("*").alias("n"))
    data = data.withColumn("hours_from_admit", hours_between("intime", time_col))
    inside = F.col("hours_from_admit") <= max_hours
    data = data.where(inside if allow_before else inside & (F.col("hours_from_admit") >= 0)).observe(kept, F.count("*").alias("n"))
    out = stored(data.select(id_col, "variable", "hours_from_admit", value_col), "events")
    n, nulls, known_, matched_, kept_ = observed(read)["n"], observed(read)["nulls"], observed(known)["n"], observed(matched)["n"], observed(kept)["n"]
    steps = [("read", n), ("dropped_null", nulls), ("dropped_unknown_item", n - nulls - known_), ("dropped_no_stay", known_ - matched_),
             ("dropped_outside_window", matched_ - kept_), ("kept", kept_)]
    return out, events.sparkSession.createDataFrame([(i, name, int(x)) for i, (name, x) in enumerate(steps)], "step int, name string, n long")


def table_contract(df: DataFrame, table: str, required: list[str]) -> DataFrame:
    """(table, check, passed) rows: each required column, and at least one row."""
    rows = [(f"column:{c}", c in df.columns) for c in required]
    base = df.limit(1).agg((F.count("*") > 0).alias("has_rows"))
    checks = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(ok).alias("passed")) for n, ok in rows],
                     F.struct(F.lit("has_rows").alias("check"), F.col("has_rows").alias("passed")))
    return base.select(F.lit(table).alias("table_name"), F.explode(checks).alias("c")).select(
        "table_name", F.col("c.check").alias("check_name"), F.col("c.passed").alias("passed"))


def require_columns(df: DataFrame, required: list[str], what: str = "table") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing columns: {missing}")


def collect_results(parts: list[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """Union of (run_name, stage, source_file, table); absent columns become NULL."""
    out = None
    for run, stage, source, df in parts:
        tagged = df.select(F.lit(run).alias("run_name"), F.lit(stage).alias("stage"),
                           F.lit(source).alias("source_file"), "*")
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


FILE_NAME = "regexp_extract(_metadata.file_path, '([^/]+)$', 1)"


def collect_files(spark: SparkSession, paths: dict[tuple[str, str], str | list[str]], fmt: str = "parquet", schemas: dict[str, T.StructType] | None = None) -> DataFrame:
    """Union of result files with their lineage: (run_name, stage, source_file, columns of all), one read per (run, stage).

    ``source_file`` is the name of the file that each row was read from, as the reader reports it. Files of one
    (run, stage) may differ in columns, as those of different ones may: schemas are merged by name and absent columns are NULL.
    CSV results need a schema per stage, so nothing is inferred."""
    out = None
    for (run, stage), path in paths.items():
        reader = spark.read.format(fmt)
        if fmt == "csv":
            if not schemas or stage not in schemas:
                raise ValueError("csv results need an explicit schema")
            reader = reader.option("header", "true").option("enforceSchema", "false").schema(schemas[stage])
        elif fmt == "parquet":
            reader = reader.option("mergeSchema", "true")
        df = reader.load(path)
        tagged = df.select(F.lit(run).alias("run_name"), F.lit(stage).alias("stage"), F.expr(FILE_NAME).alias("source_file"),
                           *[F.col(f"`{c}`") for c in df.columns if c not in ("run_name", "stage", "source_file")])
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read an aggregate result table; a missing path gives an empty table of the schema."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return spark.createDataFrame([], schema)
    reader = spark.read.format(fmt).schema(schema)
    return (reader.option("header", "true") if fmt == "csv" else reader).load(path)


def write_events(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 keys: tuple[str, ...] = ("stay_id", "charttime", "variable")) -> None:
    """Write events clustered by range of the keys and sorted inside each file."""
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = out.write.mode(mode)
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)


ROW_LEVEL_COLUMNS = {"row_id", "y_true", "p_pred", "subject_id", "hadm_id", "stay_id", "patient_id", "icustay_id"}


def write_report(df: DataFrame, out_dir: str, name: str, ordered: list[str]) -> dict[str, str]:
    """Write an aggregate report as CSV and JSON with a stable column order.

    Row-level columns are refused: a report never carries identifiers or predictions."""
    leaked = sorted(set(df.columns) & ROW_LEVEL_COLUMNS)
    if leaked:
        raise ValueError(f"report would expose row-level columns: {leaked}")
    first = [c for c in ordered if c in df.columns]
    table = df.select(*first, *[c for c in df.columns if c not in first])
    paths = {k: os.path.join(out_dir, f"{name}_{k}") for k in ("csv", "json")}
    table.write.mode("overwrite").option("header", "true").csv(paths["csv"])
    table.write.mode("overwrite").json(paths["json"])
    return paths
