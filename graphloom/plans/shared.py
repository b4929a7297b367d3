"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local master may fall back to a temporary folder."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must be set for local-cluster")
    made = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written by ``materialise`` within are deleted at the end; results must be stored before that."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, what: str, folders: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, by the columns ``folders`` if given, and read it back.

    A written table survives the loss of an executor, has exact sizes for the
    join planner and, unlike a checkpoint of rows, is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path, partitionBy=folders)
    return spark.read.schema(df.schema).parquet(path)
