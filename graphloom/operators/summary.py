"""What a scan measured: totals, rates, coverage, languages, gaps and hubs, per project and in all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.operators.export import TABLE_ROWS, link, qualified
from graphloom.operators.scan import Scan, counters
from graphloom.operators.stats import coverage, coverage_extensions, rate


def seen(s: Scan) -> DataFrame:
    """The files that nothing refuses."""
    return s.files.where(F.col("excluded_by").isNull() & ~F.col("is_symlink"))


def project_summaries(s: Scan) -> DataFrame:
    """A row per project: specifiers by outcome, nodes, edges, packages, files by status and both rates."""
    c = counters(s).where(F.col("level") == 1).drop("lang", "level", "files")
    n = s.nodes.groupBy("project").agg(F.count(F.lit(1)).alias("nodes"))
    p = s.resolved.where(F.col("package").isNotNull()).groupBy("project").agg(F.count_distinct("package").alias("external_packages_distinct"))
    v = coverage(seen(s)).withColumnsRenamed({"seen": "files_seen", "analysed": "files_analysed", "unsupported": "files_unsupported", "not_source": "files_not_source", "failed": "files_failed"})
    out = v
    for other in (c, n, p):
        o = other.withColumnRenamed("project", "_p")
        out = out.join(o, F.col("project").eqNullSafe(F.col("_p")), "left").drop("_p")
    counts = [x for x in out.columns if x not in ("project", "source_coverage", "resolution_rate")]
    return out.na.fill(0, counts).withColumn("resolution_rate", F.coalesce("resolution_rate", F.lit(1.0)))


def totals(summaries: DataFrame) -> DataFrame:
    """One row over all projects; its rates come from the sums, not from the projects' rates."""
    names = ("nodes", "edges", "files_seen", "files_analysed", "files_unsupported", "specifiers_internal", "resolved", "unresolved", "excluded")
    t = summaries.agg(F.count(F.lit(1)).alias("projects"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return t.select("*", rate(F.col("resolved"), F.col("specifiers_internal") - F.col("excluded")).alias("resolution_rate"), rate(F.col("files_analysed"), F.col("files_analysed") + F.col("files_unsupported")).alias("source_coverage"))


def gaps(s: Scan) -> DataFrame:
    """(project, extension, lang, files) of source that no extractor reads, the most frequent first."""
    named = seen(s).withColumn("lang", F.coalesce("lang", "family"))
    x = coverage_extensions(named).where(F.col("status") == "unsupported_language")
    return x.select("project", "extension", "lang", F.col("count").alias("files"))


def _first(df: DataFrame, order: list, limit: int) -> tuple[dict, dict]:
    """Per project the first rows, and how many there are."""
    w = Window.partitionBy("project").orderBy(*order)
    rows: dict = {}
    for r in df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).collect():
        rows.setdefault(r["project"], []).append(r.asDict())
    for own in rows.values():
        own.sort(key=lambda r: r["_k"])
    return rows, {r["project"]: r["count"] for r in df.groupBy("project").count().collect()}


def summary(s: Scan, root: str = ".", shown: int = TABLE_ROWS) -> dict:
    """The whole summary as one record: a few rows per project come to the driver, whatever the number of files."""
    per = project_summaries(s)
    projects = [r.asDict() for r in per.orderBy("project").collect()]
    langs: dict = {}
    for r in counters(s).where(F.col("level") == 0).orderBy(F.desc("files"), "lang").collect():
        langs.setdefault(r["project"], []).append({k: r[k] for k in ("lang", "files", "edges", "resolution_rate")})
    hubs, _ = _first(graph.in_degree(s.edges).withColumn("link", link(qualified(F.col("project"), F.col("id")))), [F.desc("dependents"), F.col("id")], shown)
    gap_rows, gap_totals = _first(gaps(s), [F.desc("files"), F.col("extension")], shown)
    broken, _ = _first(s.diagnostics, [F.split("path", "/"), F.col("seq")], shown)
    failed, failures = _first(s.failures, [F.col("path")], 10)
    for p in projects:
        k = p["project"]
        p |= {"by_lang": langs.get(k, []), "hubs": hubs.get(k, []), "gaps": gap_rows.get(k, []), "gaps_total": gap_totals.get(k, 0), "broken": broken.get(k, []), "failures": failed.get(k, []), "failures_total": failures.get(k, 0)}
    top = [{"id": r["id"] if r["project"] == "." else f"{r['project']}/{r['id']}", "dependents": r["dependents"]} for r in graph.hubs(s.edges).collect()]
    return {"root": root, "totals": totals(per).first().asDict(), "projects": projects, "hubs": top}


def text(record: dict) -> str:
    """The summary for a terminal: lists show ten rows and name how many more there are."""
    out = [f"{'root':<22} {record['root']}"]
    many = len(record["projects"]) > 1

    def rest(total: int, kind: str) -> list[str]:
        return [f"  … {total - 10} more{kind}"] if total > 10 else []

    for p in record["projects"]:
        if many:
            out += ["", f"== {p['project']}"]
        pairs = (
            ("files seen", p["files_seen"]), ("  analysed", p["files_analysed"]), ("  unsupported", p["files_unsupported"]), ("  not source", p["files_not_source"]), ("source coverage", f"{p['source_coverage']:.4f}"),
            ("specifiers total", p["specifiers_total"]), ("  internal", p["specifiers_internal"]), ("    resolved", p["resolved"]), ("    unresolved", p["unresolved"]), ("    excluded", p["excluded"]),
            ("  external", f"{p['external_specifiers']} ({p['external_packages_distinct']} distinct packages)"), ("nodes", p["nodes"]), ("edges", p["edges"]), ("resolution rate", f"{p['resolution_rate']:.4f}"),
        )
        out += [f"{k:<22} {v}" for k, v in pairs]
        out += [f"  {x['lang']:<20} {x['resolution_rate']:.4f}  ({x['files']} files, {x['edges']} edges)" for x in p["by_lang"]]
        if p["gaps_total"]:
            out += [f"{'not read':<22} {p['files_unsupported']} files", *[f"  {g['extension']:<19} {g['files']:>6}  {g['lang'] or 'unrecognised'}" for g in p["gaps"][:10]], *rest(p["gaps_total"], " extensions")]
        if p["failures_total"]:
            out += [f"{'failures':<22} {p['failures_total']}", *[f"  {x['path']}: {x['reason']}" for x in p["failures"][:10]], *rest(p["failures_total"], "")]
        broken = p["unresolved"] + p["excluded"]
        if broken:
            out += [f"{'diagnostics':<22} {broken}", *[f"  {d['path']}:{d['line']} [{d['kind']}: {d['reason'].replace('_', ' ')}] {d['specifier']}" for d in p["broken"][:10]], *rest(broken, "")]
    if many:
        t = record["totals"]
        out += ["", f"== all {t['projects']} projects"]
        out += [f"{k:<22} {v}" for k, v in (("nodes", t["nodes"]), ("edges", t["edges"]), ("files analysed", t["files_analysed"]), ("files not read", t["files_unsupported"]), ("source coverage", f"{t['source_coverage']:.4f}"), ("resolution rate", f"{t['resolution_rate']:.4f}"))]
    return "\n".join(out) + "\n"
