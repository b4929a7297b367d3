"""Counters, rates, coverage and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import base_name, extension, plain

STATUS_RANK = {"analysed": 0, "unsupported_language": 1, "not_source": 2, "failed": 3}


def rate(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, 1.0 where there is nothing to count."""
    return F.when(whole <= 0, F.lit(1.0)).otherwise(part.cast("double") / whole.cast("double"))


def classify(tree: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(project, path, extension, status, lang, label) of every file that nothing excludes.

    Extensions the catalogue lacks are ``not_source`` without a language;
    analysed content that is not UTF-8 is ``failed``.
    """
    cat = catalogue.select(F.lower("extension").alias("extension"), F.col("lang").alias("c_lang"), F.col("family"), F.col("status").alias("c_status")).dropDuplicates(["extension"])
    f = tree.where(F.col("excluded_by").isNull() & ~F.coalesce("is_symlink", F.lit(False))).select("project", "path", extension(F.col("path")).alias("extension"), (F.col("content").isNotNull() & ~F.is_valid_utf8(F.col("content").cast("string"))).alias("bad")).distinct()
    j = f.join(cat, "extension", "left")
    status = F.when((F.col("c_status") == "analysed") & F.col("bad"), "failed").otherwise(F.coalesce("c_status", F.lit("not_source")))
    return j.select("project", "path", "extension", status.alias("status"), F.col("c_lang").alias("lang"), F.coalesce("family", F.lit("unrecognised extension")).alias("label"))


def coverage(files: DataFrame) -> DataFrame:
    """Per project: files seen, by status, and source_coverage = analysed / (analysed + unsupported)."""
    c = lambda s: F.count_if(F.col("status") == s)
    return files.groupBy("project").agg(
        F.count(F.lit(1)).alias("seen"), c("analysed").alias("analysed"), c("unsupported_language").alias("unsupported"), c("not_source").alias("not_source"), c("failed").alias("failed"),
        rate(c("analysed"), c("analysed") + c("unsupported_language")).alias("source_coverage"),
    )


def coverage_extensions(files: DataFrame) -> DataFrame:
    """(project, extension, status, count, lang): files without an extension count under their name."""
    key = F.when(F.col("extension") == "", base_name(F.col("path"))).otherwise(F.col("extension"))
    return files.groupBy("project", key.alias("extension"), "status").agg(F.count(F.lit(1)).alias("count"), F.min("lang").alias("lang"))


def skipped(tree: DataFrame) -> DataFrame:
    """(project, rule, files): refused files by the rule that refused them."""
    return tree.where(F.col("excluded_by").isNotNull()).select("project", "path", "excluded_by").distinct().groupBy("project", F.col("excluded_by").alias("rule")).agg(F.count(F.lit(1)).alias("files"))


def current_diagnostics(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select("project", plain(F.col("path")).alias("path"), "line", "specifier", "kind", "reason", "lang", "seq").distinct()


def by_reason(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("project").alias("projects"))


def by_file(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("project", "path").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("kind") == "unresolved").alias("unresolved"))


def capped(diagnostics: DataFrame, limit: int = 500) -> DataFrame:
    """The first ``limit`` of each project in walk order (paths by components, then seq), with the exact total."""
    w = Window.partitionBy("project")
    order = [F.split("path", "/"), F.col("seq"), F.col("specifier"), F.col("line")]
    totals = diagnostics.groupBy("project").agg(F.count(F.lit(1)).alias("total"))
    first = diagnostics.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= limit)
    return first.join(totals, "project").select("project", "path", "line", "specifier", "reason", "rank", "total")


def language_stats(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Edges and gaps at three levels at once: (project, lang), project and all, by grouping sets.

    Tables of edges hold no specifiers, so ``edge_rate`` = edges / (edges + unresolved) counts an
    import of several files as several; the resolution rate proper is that of ``scan.counters``.
    """
    langs = nodes.where(F.col("kind") == "source").select("project", F.col("id").alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"))
    zero = F.lit(0)
    f = langs.select("project", "lang", F.lit(1).alias("files"), zero.alias("resolved"), zero.alias("unresolved"), zero.alias("excluded"))
    e = edges.join(langs, ["project", "source"], "left").select("project", F.coalesce("lang", F.lit("unknown")).alias("lang"), zero.alias("files"), F.lit(1).alias("resolved"), zero.alias("unresolved"), zero.alias("excluded"))
    d = diagnostics.select("project", F.coalesce("lang", F.lit("unknown")).alias("lang"), zero.alias("files"), zero.alias("resolved"), (F.col("kind") == "unresolved").cast("int").alias("unresolved"), (F.col("kind") == "excluded").cast("int").alias("excluded"))
    u = f.unionByName(e).unionByName(d).groupBy("project", "lang").agg(*[F.sum(c).alias(c) for c in ("files", "resolved", "unresolved", "excluded")])
    g = u.groupingSets([["project", "lang"], ["project"], []], "project", "lang").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "resolved", "unresolved", "excluded")], F.grouping_id().alias("level"))
    return g.select("project", "lang", F.col("level").cast("bigint").alias("level"), "files", F.col("resolved").alias("edges"), "unresolved", "excluded", rate(F.col("resolved"), F.col("resolved") + F.col("unresolved")).alias("edge_rate"))


def external_packages(nodes: DataFrame) -> DataFrame:
    """Distinct package names per project."""
    names = nodes.select("project", F.explode("external_deps").alias("name")).where(F.col("name").isNotNull()).distinct()
    return names.groupBy("project").agg(F.count(F.lit(1)).alias("external_packages_distinct"))


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.sum("bytes").alias("bytes"))


def languages(nodes: DataFrame) -> DataFrame:
    """(lang, read, unread): source files per language with those of languages that are not read."""
    n = nodes.where(F.col("kind").isin("source", "unread_source"))
    return n.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count_if(F.col("kind") == "source").alias("read"), F.count_if(F.col("kind") == "unread_source").alias("unread"))


def unassigned(tree: DataFrame, projects: DataFrame) -> DataFrame:
    """Files of no known project, per name of their project column."""
    return tree.select("project", "path").distinct().join(projects.select(F.col("id").alias("project")), "project", "left_anti").groupBy("project").agg(F.count(F.lit(1)).alias("files"))


def totals(projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e, p = nodes.agg(F.count(F.lit(1))).scalar(), edges.agg(F.count(F.lit(1))).scalar(), projects.select("id").distinct()
    return p.agg(F.count(F.lit(1)).alias("projects")).select("projects", n.alias("nodes"), e.alias("edges"))
