"""The session tests and tools share."""

import os

from pyspark.sql import SparkSession


def make_session(cpus: str | int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tidewatch")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEMORY", "12g"))
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.bindAddress", "127.0.0.1")
             .config("spark.driver.host", "127.0.0.1").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
