"""Cutting long lineages of iterative jobs, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``.

    Only a local master, as in tests, may do without: it gets a temporary folder, which is then
    set for the session. On a cluster a local folder would scatter one table over many disks, so
    an unset option is refused there."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getConf().get("spark.checkpoint.dir", "")
    if not found:
        found = sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else ""
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewatch-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Checkpoints outlive executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again: computed once, however
    often it is used, with column pruning and compression that a checkpoint lacks. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidewatch-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tidewatch-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def scanned(df: DataFrame) -> DataFrame:
    """``df`` itself if it only reads and filters files, else written once and read again: for
    operators that make several passes."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    heavy = ("Join", "Aggregate", "Window", "Sort", "Generate", "Python", "Pandas", "Arrow", "Distinct", "Repartition", "Union", "Intersect", "Except")
    return stored(df, "source") if any(h in plan for h in heavy) else df
