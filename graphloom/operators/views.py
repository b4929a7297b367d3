"""What the interface shows of a scan: coverage tables, meters, labels, positions, one file's card, and formatted numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.catalogue import ALWAYS_SKIP, in_skipped_directory
from graphloom.functions.paths import dir_name
from graphloom.operators.graph import in_degree
from graphloom.operators.stats import STATUS_RANK, coverage_extensions

# --- fixed values: remarks, angle and sizes ------------------------------------------------------------------
NOTES = {"failed": "read or parse failed", "unsupported_language": "no extractor for this language yet"}
UNRECOGNISED = "unrecognised extension"
GOLDEN_ANGLE = 2.399963
FEW_NODES, SOME_NODES = 120, 400
# --- end of fixed values -------------------------------------------------------------------------------------


def format_rate(rate: Column) -> Column:
    return F.format_string("%.4f", rate.cast("double"))


def format_count(n: Column) -> Column:
    """Thousands parted by commas."""
    return F.format_number(n.cast("bigint"), 0)


def format_bytes(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).when(n < 1024**2, F.format_string("%.1f kB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1024**2))


def extension_table(files: DataFrame) -> DataFrame:
    """Coverage by extension with its label and a note, ranked: most files first, then the extension, then the status."""
    labels = files.groupBy("project", "extension", "status").agg(F.min("label").alias("label"))
    t = coverage_extensions(files).alias("t").join(labels.alias("l"), F.col("t.project").eqNullSafe(F.col("l.project")) & (F.col("t.extension") == F.col("l.extension")) & (F.col("t.status") == F.col("l.status")), "left")
    note = F.when(F.col("t.status") == "not_source", F.coalesce("l.label", F.lit(UNRECOGNISED)))
    for status, text in NOTES.items():
        note = note.when(F.col("t.status") == status, text)
    rank = F.col("t.status")
    for status, k in STATUS_RANK.items():
        rank = F.when(F.col("t.status") == status, k).otherwise(rank) if k else F.when(F.col("t.status") == status, 0).otherwise(99)
    w = Window.partitionBy("t.project").orderBy(F.desc("t.count"), F.col("t.extension"), rank.cast("int"))
    return t.select("t.project", F.row_number().over(w).alias("place"), "t.extension", "l.label", "t.count", "t.status", note.alias("note"))


def skipped_directories(tree: DataFrame) -> DataFrame:
    """(project, name, count): refused directories by name, each directory once however many files it holds."""
    parts = F.split("path", "/")
    found = tree.where((F.col("excluded_by") == "always_skip") & in_skipped_directory(F.col("path"))).select("project", parts.alias("p"), F.transform(parts, lambda x: x.isin(*ALWAYS_SKIP)).alias("hit"))
    found = found.withColumn("k", F.array_position("hit", True)).where((F.col("k") > 0) & (F.col("k") < F.size("p")))
    dirs = found.select("project", F.element_at("p", F.col("k").cast("int")).alias("name"), F.array_join(F.slice("p", F.lit(1), F.col("k").cast("int")), "/").alias("dir")).distinct()
    return dirs.groupBy("project", "name").agg(F.count(F.lit(1)).alias("count"))


def meters(coverage: DataFrame) -> DataFrame:
    """(project, read, unread, other): widths of the coverage meter in percent."""
    seen = F.greatest("seen", F.lit(1))
    read, unread = F.col("analysed") * 100 / seen, F.col("unsupported") * 100 / seen
    return coverage.select("project", read.alias("read"), unread.alias("unread"), F.greatest(F.lit(0.0), 100 - read - unread).alias("other"))


def shade_key(id_: Column) -> Column:
    """The first two folders of a path."""
    return F.array_join(F.slice(F.split(dir_name(id_), "/"), 1, 2), "/")


def shades(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", shade_key(F.col("id")).alias("shade")).agg(F.count(F.lit(1)).alias("files"))


def label_modes(nodes: DataFrame) -> DataFrame:
    """(project, mode): every name on a small graph, more on a middling one, only the hubs on a large one."""
    n = nodes.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    return n.select("project", F.when(F.col("n") <= FEW_NODES, "all").when(F.col("n") <= SOME_NODES, "more").otherwise("hubs").alias("mode"))


def inspector(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame, subject: DataFrame) -> DataFrame:
    """The card of one file (project, id): its size, importers, imports, packages and gaps."""
    s = F.broadcast(subject.limit(1))
    own = nodes.join(s, ["project", "id"], "left_semi").select("project", "id", "lang", "kind", "loc", "bytes", F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.coalesce("external_deps", F.array().cast("array<string>"))))), "|").alias("packages"))
    count = lambda df, key, name: df.join(s.withColumnRenamed("id", key), ["project", key], "left_semi").agg(F.count(F.lit(1))).scalar().alias(name)
    return own.select("*", count(edges, "target", "dependents"), count(edges, "source", "dependencies"), count(diagnostics, "path", "gaps"))


def focus(edges: DataFrame, subject: DataFrame) -> DataFrame:
    """(project, id): the file in focus with what it uses and what uses it."""
    s = F.broadcast(subject.limit(1))
    used = edges.join(s.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").select("project", F.col("target").alias("id"))
    using = edges.join(s.withColumnRenamed("id", "target"), ["project", "target"], "left_semi").select("project", F.col("source").alias("id"))
    return used.unionAll(using).unionAll(s.select("project", "id")).distinct()


def linked_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges with at least one end among the files (project, id) on screen."""
    ends = shown.select("project", "id").distinct()
    a = edges.join(ends.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").select("project", "source", "target")
    b = edges.join(ends.withColumnRenamed("id", "target"), ["project", "target"], "left_semi").select("project", "source", "target")
    return a.unionAll(b).distinct()


def kept_folders(shown: DataFrame) -> DataFrame:
    """Folders that stay as long as one of their files does."""
    d = dir_name(F.col("id"))
    return shown.select("project", F.when(d == "", ".").otherwise(d).alias("folder")).distinct()


def without_groups(nodes: DataFrame, groups: DataFrame, hidden: list[int]) -> DataFrame:
    """(project, id) of the files that lie in none of the hidden groups (project, id, community)."""
    return nodes.select("project", "id").join(groups.where(F.col("community").isin(hidden)), ["project", "id"], "left_anti")


def seed_positions(nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(project, id, x, y): starting places. Groups (project, id, community) lie on a golden-angle spiral by rank, their
    files on one around each centre; files without an edge on a ring around all.
    """
    deg = edges.select("project", F.col("source").alias("id")).unionAll(edges.select("project", F.col("target").alias("id"))).distinct()
    n = nodes.select("project", "id").join(groups.select("project", "id", "community"), ["project", "id"], "left").join(deg.withColumn("joined", F.lit(True)), ["project", "id"], "left")
    list_ = groups.groupBy("project", "community").agg(F.count(F.lit(1)).alias("_n"))
    # a community a row, so a project's ranks are few
    r = list_.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy("community")) - 1)
    r = r.withColumn("radius", F.sum(26 + 90 / (F.col("rank") + 2)).over(Window.partitionBy("project").orderBy("rank")))
    centre = r.select("project", "community", (F.cos(F.col("rank") * GOLDEN_ANGLE) * F.col("radius")).alias("cx"), (F.sin(F.col("rank") * GOLDEN_ANGLE) * F.col("radius")).alias("cy"))
    ring = r.groupBy("project").agg((F.max("radius") * 1.2 + 40).alias("ring"))
    at = F.row_number().over(Window.partitionBy("project", "community").orderBy("id")) - 1
    inner = n.where("joined").withColumn("k", at).join(centre, ["project", "community"], "left")
    spread, angle = F.sqrt("k") * 7, F.col("k") * GOLDEN_ANGLE
    placed = inner.select("project", "id", (F.coalesce("cx", F.lit(0.0)) + F.cos(angle) * spread).alias("x"), (F.coalesce("cy", F.lit(0.0)) + F.sin(angle) * spread).alias("y"))
    alone = n.where(F.col("joined").isNull()).withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy("id")) - 1)
    sizes = alone.groupBy("project").agg(F.count(F.lit(1)).alias("m"))
    outer = alone.join(sizes, "project").join(ring, "project", "left")
    turn = F.col("k") * (2 * 3.141592653589793) / F.col("m")
    out = outer.select("project", "id", (F.cos(turn) * F.coalesce("ring", F.lit(40.0))).alias("x"), (F.sin(turn) * F.coalesce("ring", F.lit(40.0))).alias("y"))
    return placed.unionAll(out)


def folder_groups(nodes: DataFrame) -> DataFrame:
    """(project, id, community): files of a folder as a group, numbered by size and then name."""
    d = nodes.select("project", "id", dir_name(F.col("id")).alias("dir"))
    sizes = d.groupBy("project", "dir").agg(F.count(F.lit(1)).alias("_n"))
    ranked = sizes.withColumn("community", (F.row_number().over(Window.partitionBy("project").orderBy(F.desc("_n"), "dir")) - 1).cast("int"))
    return d.join(ranked.select("project", "dir", "community"), ["project", "dir"]).select("project", "id", "community")


def measures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project the numbers of the measures panel, formatted for reading."""
    n = nodes.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bytes", F.lit(0))).alias("b"))
    e = edges.groupBy("project").agg(F.count(F.lit(1)).alias("e"))
    h = in_degree(edges).groupBy("project").agg(F.max("dependents").alias("most"))
    j = n.join(e, "project", "left").join(h, "project", "left").na.fill(0)
    return j.select("project", format_count(F.col("n")).alias("nodes"), format_count(F.col("e")).alias("edges"), format_bytes(F.col("b")).alias("size"), format_rate(F.col("most") / F.col("n")).alias("hub_share"))
