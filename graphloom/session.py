"""Session builder used by the tests, the bench and the command line."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def get_spark(cpus: str | int = "*", shuffle: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
