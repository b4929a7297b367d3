"""Graph queries over (nodes, edges): neighbours, bounded walks, hubs, packages, lookup of paths.

A total is never capped: listings carry the exact total beside the shown rows.
Null ends of edges take no part; repeated edges count once; ids are unique per project only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import base_name, plain, stem
from graphloom.plans.shared import materialise
from graphloom.sources.tables import latest

#: limits of the question interface
LIST_LIMIT, DEPTH_DEFAULT, DEPTH_MAX, HUBS, HUBS_PER_PROJECT, SUGGESTIONS, DIAGNOSTICS = 50, 3, 32, 5, 15, 5, 500


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The newest row of each (project, id)."""
    return latest(nodes, ["project", "id"], ["path", "lang", "kind", "loc", "bytes", "external_deps"], ["scanned_at", "loaded_at"])


def imports(edges: DataFrame) -> DataFrame:
    """Distinct import edges (project, source, target) with paths in plain form."""
    e = edges.where(F.col("kind") == "import").select("project", plain(F.col("source")).alias("source"), plain(F.col("target")).alias("target"))
    return e.where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()


def listing(df: DataFrame, order: list[Column], limit: int, by: list[str] | None = None) -> DataFrame:
    """The first ``limit`` rows by ``order`` (of each ``by``), with total and omitted as columns.

    Without ``by``, the shown rows come from a top-k that keeps ``limit`` rows a
    task, and the total from a scalar subquery: nothing is sorted in one task.
    """
    if by:
        w = Window.partitionBy(*by)
        ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= limit)
        totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
        return ranked.join(totals, by).withColumn("omitted", F.greatest(F.col("total") - limit, F.lit(0)))
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(limit).select("*", total.alias("total"), F.greatest(total - limit, F.lit(0)).alias("omitted"))


def neighbours(edges: DataFrame, nodes: DataFrame, subject: DataFrame, incoming: bool, limit: int = LIST_LIMIT) -> DataFrame:
    """Dependents or dependencies of the subject rows (project, id), ascending, with their language."""
    near, far = ("target", "source") if incoming else ("source", "target")
    hit = edges.join(F.broadcast(subject.limit(1).withColumnRenamed("id", near)), ["project", near]).select("project", F.col(far).alias("id"))
    langs = nodes.select("project", "id", "lang")
    out = hit.join(langs, ["project", "id"], "left").select("project", "id", F.coalesce("lang", F.lit("unknown")).alias("lang"))
    return listing(out, [F.col("project"), F.col("id")], limit)


def blast_radius(edges: DataFrame, subject: DataFrame, depth: int = DEPTH_DEFAULT) -> DataFrame:
    """(project, id, depth) of every file that imports the subject, directly or not, at its shortest distance.

    ``depth`` is clamped to 1..32. The subject itself is not listed, cycles end
    by themselves. Each level joins the frontier with the edges and drops what
    is known; the known set only grows by distinct files, never by paths.
    """
    return _walk(edges, subject, max(1, min(DEPTH_MAX, depth)))


def _walk(edges: DataFrame, subject: DataFrame, depth: int) -> DataFrame:
    rev = edges.select("project", F.col("target").alias("id"), F.col("source").alias("_next"))
    deep = depth > 4  # a short walk is one lazy plan; a deep one is cut at every level and ends with its frontier
    if deep:
        rev = materialise(rev, "reverse")
    known = subject.select("project", "id").limit(1).withColumn("depth", F.lit(0))
    frontier = known = materialise(known, "known") if deep else known
    for level in range(1, depth + 1):
        new = frontier.join(rev, ["project", "id"]).select("project", F.col("_next").alias("id")).distinct()
        frontier = new.join(known.select("project", "id"), ["project", "id"], "left_anti").withColumn("depth", F.lit(level))
        if deep:
            frontier = materialise(frontier, "frontier")
            if frontier.isEmpty():
                break
        known = known.unionByName(frontier)
    return known.where(F.col("depth") > 0)


def blast_by_depth(edges: DataFrame, subject: DataFrame, depth: int = DEPTH_DEFAULT) -> DataFrame:
    """(depth, files, stopped_at_depth): the last is true where files lie beyond the deepest level asked for."""
    depth = max(1, min(DEPTH_MAX, depth))
    wide = _walk(edges, subject, depth + 1)
    beyond = wide.where(F.col("depth") > depth).agg(F.count(F.lit(1)) > 0).scalar()
    return wide.where(F.col("depth") <= depth).groupBy("depth").agg(F.count(F.lit(1)).alias("files")).select("depth", "files", beyond.alias("stopped_at_depth"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("project", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, id, dependents, dependencies, degree, size) of every node; size is the drawing radius."""
    ends = edges.select("project", F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select("project", F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    d = ends.groupBy("project", "id").agg(F.sum("i").alias("dependents"), F.sum("o").alias("dependencies"))
    n = nodes.select("project", "id", "kind").join(d, ["project", "id"], "left").na.fill(0, ["dependents", "dependencies"])
    n = n.withColumn("degree", F.col("dependents") + F.col("dependencies"))
    size = F.least(F.greatest(1.1 * F.sqrt(F.col("degree") + 1), F.lit(2.9)), F.lit(11.0)) * F.when(F.col("kind") == "asset", 0.75).otherwise(1.0)
    return n.select("project", "id", "dependents", "dependencies", "degree", F.round(size, 6).alias("size"))


def hubs(edges: DataFrame, limit: int = HUBS) -> DataFrame:
    return in_degree(edges).orderBy(F.desc("dependents"), "project", "id").limit(limit)


def hubs_per_project(edges: DataFrame, limit: int = HUBS_PER_PROJECT) -> DataFrame:
    return listing(in_degree(edges), [F.desc("dependents"), F.col("id")], limit, ["project"])


def package_users(nodes: DataFrame, name: str) -> DataFrame:
    """Files whose external packages hold the trimmed name exactly, case mattering."""
    return nodes.where(F.array_contains(F.coalesce("external_deps", F.array().cast("array<string>")), name.strip())).select("project", "id", "lang")


def package_near_misses(nodes: DataFrame, name: str, limit: int = SUGGESTIONS) -> DataFrame:
    """Package names that hold ``name`` in any case, only where no file has the exact name."""
    any_hit = package_users(nodes, name).agg(F.count(F.lit(1))).scalar()
    names = nodes.select(F.explode("external_deps").alias("name")).where(F.instr(F.lower("name"), name.strip().lower()) > 0).distinct()
    return names.where(any_hit == 0).orderBy("name").limit(limit)


def locate(nodes: DataFrame, path: str, projects: DataFrame | None = None) -> DataFrame:
    """(project, id, rule) of the files a path names; the first rule with hits decides.

    Rules: 1 the id itself, 2 ``project/id``, 3 a suffix at a directory
    boundary, 4 the bare file name. Several rows mean that the path is ambiguous.
    An absolute path is also read below the folder of every project (id, path) that holds it.
    """
    p = path.strip().replace("\\", "/")
    forms = []
    if p.startswith("/") and projects is not None:
        # as many as a path has folders
        above = projects.where(F.startswith(F.lit(p), F.concat("path", F.lit("/")))).select("path").distinct().collect()
        forms = sorted(p[len(r["path"]) + 1 :] for r in above)
    while p.startswith("./"):
        p = p[2:]
    forms.append(p.strip("/"))
    qualified = F.concat_ws("/", "project", "id")
    tests = [F.col("id").isin(forms), qualified.isin(forms), *(F.endswith(F.col("id"), F.lit("/" + f)) for f in forms), *(base_name(F.col("id")) == f for f in forms if "/" not in f)]
    rule, k = F.when(tests[0], 1).when(tests[1], 2), 2 + len(forms)
    for t in tests[2:k]:
        rule = rule.when(t, 3)
    for t in tests[k:]:
        rule = rule.when(t, 4)
    hits = nodes.select("project", "id", rule.alias("rule")).where(F.col("rule").isNotNull())
    best = hits.agg(F.min("rule")).scalar()
    return hits.where(F.col("rule") == best)


def suggest(nodes: DataFrame, path: str, limit: int = SUGGESTIONS) -> DataFrame:
    """Files with the same stem (three bytes or more) or with it in their name, in project and id order."""
    last = path.strip().replace("\\", "/").rsplit("/", 1)[-1].lower()
    s = last.rsplit(".", 1)[0] if "." in last[1:] else last
    if len(s.encode()) < 3:
        return nodes.select("project", "id").limit(0)
    name = F.lower(base_name(F.col("id")))
    return nodes.where((stem(name) == s) | F.contains(name, F.lit(s))).select("project", "id").orderBy("project", "id").limit(limit)


def search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """Ranked substring search: an early hit, a hit in the name, its start or the whole name score higher."""
    q = query.strip().lower()
    if not q:
        d = in_degree(edges)
        return nodes.where(F.col("kind") != "asset").join(d, ["project", "id"], "left").select("project", "id", F.coalesce("dependents", F.lit(0)).cast("double").alias("score")).orderBy(F.desc("score"), "project", "id").limit(limit)
    low, name = F.lower("id"), F.lower(base_name(F.col("id")))
    at = F.instr(low, q) - 1
    score = (
        100 - F.least(at, F.lit(60)) + F.when(F.startswith(name, F.lit(q)), 120).when(F.contains(name, F.lit(q)), 60).otherwise(0)
        + F.when(name == q, 200).otherwise(0) - F.length("id") / 20 - F.when(F.col("kind") == "asset", 25).otherwise(0)
    )
    return nodes.where(at >= 0).select("project", "id", F.round(score.cast("double"), 6).alias("score")).orderBy(F.desc("score"), "project", "id").limit(limit)


def visible(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, langs: list[str] | None = None, hide_isolated: bool = False, unresolved: DataFrame | None = None) -> DataFrame:
    """(project, id) that pass the filters; assets are exempt from the language filter."""
    n = nodes
    if kinds is not None:
        n = n.where(F.col("kind").isin(kinds))
    if langs is not None:
        n = n.where((F.col("kind") == "asset") | F.col("lang").isin(langs))
    if hide_isolated:
        ends = edges.select("project", F.col("source").alias("id")).unionAll(edges.select("project", F.col("target").alias("id"))).distinct()
        n = n.join(ends, ["project", "id"], "left_semi")
    if unresolved is not None:
        n = n.join(unresolved.select("project", F.col("path").alias("id")).distinct(), ["project", "id"], "left_semi")
    return n.select("project", "id")


def visible_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges with both ends shown."""
    s = shown.withColumnRenamed("id", "source")
    return edges.join(s, ["project", "source"], "left_semi").join(shown.withColumnRenamed("id", "target"), ["project", "target"], "left_semi").select("project", "source", "target")


def folder_rollup(nodes: DataFrame) -> DataFrame:
    """(project, folder, members, lang, kind): majority language (ties to the smaller name) and strongest kind."""
    from graphloom.functions.paths import dir_name

    n = nodes.select("project", dir_name(F.col("id")).alias("folder"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.when(F.col("kind") == "source", 2).when(F.col("kind") == "unread_source", 1).otherwise(0).alias("k"))
    per = n.groupBy("project", "folder", "lang").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    top = per.groupBy("project", "folder").agg(F.sum("n").alias("members"), F.max("n").alias("_most"), F.max("k").alias("k"))
    major = per.join(top.select("project", "folder", "_most"), ["project", "folder"]).where(F.col("n") == F.col("_most")).groupBy("project", "folder").agg(F.min("lang").alias("lang"))
    kind = F.when(F.col("k") == 2, "source").when(F.col("k") == 1, "unread_source").otherwise("asset")
    return top.join(major, ["project", "folder"]).select("project", "folder", "members", "lang", kind.alias("kind"))


def folder_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges between different folders."""
    from graphloom.functions.paths import dir_name

    e = edges.select("project", dir_name(F.col("source")).alias("source"), dir_name(F.col("target")).alias("target"))
    return e.where(F.col("source") != F.col("target")).distinct()


def unique_labels(nodes: DataFrame) -> DataFrame:
    """(project, id, label): the shortest suffix of whole path parts that no other file of the project ends with."""
    parts = F.split("id", "/")
    suffixes = nodes.select("project", "id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/"))).alias("k", "suffix"))
    # a suffix held by one file only is unique; the whole id always is
    lone = suffixes.groupBy("project", "suffix").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("k").alias("k")).where(F.col("n") == 1)
    return lone.groupBy("project", "id").agg(F.min_by("suffix", "k").alias("_s")).join(nodes.select("project", "id"), ["project", "id"], "right").select("project", "id", F.coalesce("_s", "id").alias("label"))
