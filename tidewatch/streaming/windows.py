"""The window operators over an arriving event stream joined to a static cohort.

The stateful aggregate of a (stay, variable) is the same expression the batch operators use. Its key
also holds ``closes``, the time after which no event can belong to it: the end of the stay's window, or of
the bin. That column carries the watermark, so a state is dropped once ``late`` hours have passed since it
closed; events later than that are not counted, and ``run_available`` reports how many there were.

Updated rows are appended with their batch number. Every ``every`` batches they are compacted: rows that are
closed for good move to ``final`` and are never written again, the newest row of every other key goes to
``open``, and older batches are removed. So the log holds at most ``every`` batches and ``open`` what
the state store holds; nothing is kept on the driver. A replayed batch replaces its own rows, and a
compaction that is already there is not repeated, so a restarted query loses and doubles nothing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.exprs import plus_hours
from tidewatch.operators import events as E
from tidewatch.operators.windows import windowed_events

LATE = 24.0  # hours an event may arrive after its window or bin has closed
EVERY = 8  # batches between two compactions
CLOSES = "closes"


def _closing(win: DataFrame, cohort: DataFrame, after, span: float, late: float, id_col: str = "stay_id") -> DataFrame:
    """Watermark on ``closes``, ``after`` hours past admission. An event lies at most ``span`` hours before it closes,
    so the watermark stays ``span + late`` behind the latest closing time: ``late`` behind the latest event at most."""
    one = cohort.groupBy(id_col).agg(F.min("intime").alias("_in"))
    closes = (F.col("_in") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), after * F.lit(3600.0))).cast("timestamp")
    seen = win.join(one, id_col).withColumn(CLOSES, closes).drop("_in")
    return seen.observe("arrived", F.count("*").alias("n")).withWatermark(CLOSES, f"{int((span + late) * 3600)} seconds")


def process_stream(events: DataFrame, cohort: DataFrame, *, hours: float, late: float = LATE) -> DataFrame:
    """Running measurement counts and times; rows outside their stay's window are dropped."""
    win = windowed_events(events, cohort, hours=hours, variable_col="variable")
    return E.process_base(_closing(win, cohort, F.lit(float(hours)), hours, late), also=[CLOSES])


def bins_stream(events: DataFrame, cohort: DataFrame, *, hours: float, bin_hours: float, late: float = LATE) -> DataFrame:
    """Running bin statistics; a bin's state goes when that bin has closed, long before its stay's window has."""
    win = windowed_events(events, cohort, hours=hours, variable_col="variable")
    end = F.least((E.bin_index(hours, bin_hours) + 1) * F.lit(float(bin_hours)), F.lit(float(hours)))
    return E.bins_base(_closing(win, cohort, end, bin_hours, late), hours=hours, bin_hours=bin_hours, also=[CLOSES])


# --- the log of updated rows --------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, out: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``kind=<number>`` under ``out``."""
    jpath, fs = _fs(spark, out)
    if not fs.exists(jpath):
        return []
    found = [re.fullmatch(kind + r"=(\d+)", s.getPath().getName()) for s in fs.listStatus(jpath)]
    done = [int(m.group(1)) for m in found if m]
    return sorted(n for n in done if fs.exists(_fs(spark, f"{out}/{kind}={n}/_SUCCESS")[0]))


def _remove(spark: SparkSession, path: str) -> None:
    jpath, fs = _fs(spark, path)
    fs.delete(jpath, True)


def _read(spark: SparkSession, out: str, kind: str, numbers: list[int]) -> DataFrame | None:
    parts = [spark.read.parquet(f"{out}/{kind}={n}").withColumn("_batch", F.lit(n).cast("long")) for n in numbers]
    whole = None
    for p in parts:
        whole = p if whole is None else whole.unionByName(p)
    return whole


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_s"))
    return best.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def _unsettled(spark: SparkSession, out: str, upto: int | None = None) -> tuple[DataFrame | None, list[int], list[int]]:
    """(rows not final yet with their batch, compactions, batches after the last one)."""
    opened = _complete(spark, out, "open")
    last = opened[-1] if opened else -1
    fresh = [n for n in _complete(spark, out, "batch") if n > last and (upto is None or n <= upto)]
    old, new = _read(spark, out, "open", opened[-1:]), _read(spark, out, "batch", fresh)
    return (old if new is None else new if old is None else old.unionByName(new)), opened, fresh


def compact(spark: SparkSession, out: str, keys: list[str], behind: float, upto: int) -> None:
    """Settle the log up to a batch. ``behind``: hours of the watermark behind the latest closing time."""
    rows, opened, fresh = _unsettled(spark, out, upto)
    if upto in opened or not fresh:
        return
    now = _newest(rows, keys)
    settled = F.col(CLOSES) < plus_hours(F.lit(rows.agg(F.max(CLOSES)).first()[0]), -behind)
    now.where(settled).write.mode("overwrite").parquet(f"{out}/final={upto}")
    now.where(~settled).write.mode("overwrite").parquet(f"{out}/open={upto}")
    for n in fresh:
        _remove(spark, f"{out}/batch={n}")
    for n in opened:
        _remove(spark, f"{out}/open={n}")


def run_available(stream: DataFrame, out: str, checkpoint: str, keys: list[str] | None = None, behind: float | None = None, every: int = EVERY) -> dict[str, int]:
    """Process everything that has arrived, then stop.

    With ``keys`` the log is compacted every ``every`` batches; ``behind`` are the hours of the stream's watermark
    (span of a window or bin, and ``late``). Gives the batches, the events that arrived in their stay's window, the
    updated groups that came too late, and the groups in the state store at the end."""
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        if number in _complete(spark, out, "open"):  # replayed after its compaction
            return
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if keys is not None and (number + 1) % every == 0:
            compact(spark, out, keys, behind, number)

    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    q = (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).foreachBatch(save).start())
    q.awaitTermination()
    told = {"batches": 0, "arrived": 0, "late_groups": 0, "state_groups": 0}
    for p in q.recentProgress:
        told["batches"] += 1
        told["arrived"] += (p["observedMetrics"].get("arrived") or {"n": 0})["n"] if p["observedMetrics"] else 0
        told["late_groups"] += sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
        told["state_groups"] = sum(s["numRowsTotal"] for s in p["stateOperators"])
    return told


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest row per key: final rows, and the newest of those that may still change."""
    rows, _, _ = _unsettled(spark, out)
    final = _read(spark, out, "final", _complete(spark, out, "final"))
    now = None if rows is None else _newest(rows, keys)
    if final is None:
        return now
    return final.drop("_batch") if now is None else final.drop("_batch").unionByName(now)
