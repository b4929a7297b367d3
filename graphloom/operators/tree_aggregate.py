"""Per-key results without one reducer per hot key: multi-level tree aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import plain

FAN_IN = 32


def rounds_for(chunks: int, fan_in: int = FAN_IN) -> int:
    """Rounds after which the states of so many chunks are one: the logarithm of ``chunks`` to the base ``fan_in``, at least 1."""
    rounds, reach = 1, fan_in
    while reach < chunks:
        rounds, reach = rounds + 1, reach * fan_in
    return rounds


def merged_by_rounds(df: DataFrame, keys: Sequence[str], leaf: dict[str, Column], merge: Sequence[str], chunk: Column | None = None, chunks: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Aggregate ``df`` by ``keys`` through a tree over its input chunks.

    A chunk is a partition of ``df`` (an input split of ``spark.sql.files.maxPartitionBytes``),
    or what ``chunk`` numbers from 0 below ``chunks``. The map side of the first
    round builds one ``leaf`` state per key and chunk, where the rows lie; each
    round then merges the states of ``fan_in`` neighbouring chunks by summing the
    columns of ``merge``, until all chunks are one. The number of rounds follows
    from the number of chunks. No reducer receives more than ``fan_in`` states of a key,
    whatever share of the rows the key holds.
    """
    if chunk is None:
        chunk, chunks = F.spark_partition_id(), df.rdd.getNumPartitions()
    rounds = rounds_for(chunks, fan_in)
    out = df.withColumn("_chunk", chunk)
    for k in range(rounds):
        by = list(keys)
        if k < rounds - 1:
            out = out.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in).cast("int"))
            by.append("_chunk")
        states = leaf if k == 0 else {m: F.sum(m) for m in merge}
        out = out.groupBy(*by).agg(*[c.alias(n) for n, c in states.items()])
    return out


def row_counts(edges: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(target, n_rows): every row of each target path in plain form; rows with a null target make no key."""
    rows = edges.select(plain(F.col("target")).alias("target")).where(F.col("target").isNotNull())
    return merged_by_rounds(rows, ["target"], {"n_rows": F.count(F.lit(1))}, ["n_rows"], fan_in=fan_in)


def target_profile(edges: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(target, n_rows, n_projects, n_files) for each target path in plain form.

    ``n_rows`` counts every row (repeats, older scans, both kinds), ``n_projects``
    the distinct non-null projects and ``n_files`` the distinct (project, source)
    files with a non-null source. Rows with a null target make no key. An empty
    table gives no rows; further columns of ``edges`` are ignored.

    Distinct counts need equal importers together, so a first step reduces equal
    (target, project, source) rows to one with a count; a hot target is spread over
    its importers there. Two trees follow over chunks of importers and of projects,
    numbered by hash: as many as that step has partitions.
    """
    rows = (
        edges.select(plain(F.col("target")).alias("target"), F.col("project"), plain(F.col("source")).alias("source"))
        .where(F.col("target").isNotNull())
        .groupBy("target", "project", "source")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    chunks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int")
    files = merged_by_rounds(
        rows, ["target", "project"], {"n_rows": F.sum("n_rows"), "n_files": F.count_if(F.col("project").isNotNull() & F.col("source").isNotNull())},
        ["n_rows", "n_files"], number("source"), chunks, fan_in,
    )
    return merged_by_rounds(
        files, ["target"], {"n_rows": F.sum("n_rows"), "n_projects": F.count("project"), "n_files": F.sum("n_files")},
        ["n_rows", "n_projects", "n_files"], number("project"), chunks, fan_in,
    ).select("target", "n_rows", "n_projects", "n_files")


def hot_targets(edges: DataFrame, percent: int = 1) -> DataFrame:
    """Targets that hold at least ``percent`` % of all rows of ``edges`` (null targets count in the total)."""
    total = edges.select("target").agg(F.count(F.lit(1))).scalar()
    return row_counts(edges).where(F.col("n_rows") * 100 >= total * percent).select("target")
