"""Parquet table access and the dirt rules that all queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the values of the row that is greatest by ``order``.

    A plain aggregate (partial on the map side), so a hot key reaches the
    reducer as one row per input partition. Null order fields rank lowest;
    full ties fall to the greatest values, so the result is deterministic.
    """
    packed = F.struct(*[F.col(v) for v in values])
    rank = F.struct(*order, packed)
    top = df.groupBy(*keys).agg(F.max_by(packed, rank).alias("_top"))
    return top.select(*keys, *[F.col("_top")[v].alias(v) for v in values])
