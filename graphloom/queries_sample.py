"""The scan of the sample tree, every language and every outcome, against what was written down by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators.export import document_lines
from graphloom.operators.scan import counters, scan
from graphloom.operators.stats import coverage, coverage_extensions
from graphloom.operators.summary import gaps, project_summaries, seen, totals
from graphloom.sources.sample import files_sql, found_sql, sample_tree


def sample_specifiers(spark, d):
    """Extraction: every specifier in source order."""
    return scan(sample_tree(spark)).specifiers


def sample_resolution(spark, d):
    """Resolution: internal targets, external package or neither, per specifier."""
    return scan(sample_tree(spark)).resolved.select("project", "path", "ordinal", "raw", "tag", "package", F.array_join("targets", " ").alias("targets"))


def sample_edges(spark, d):
    return scan(sample_tree(spark)).edges


def sample_diagnostics(spark, d):
    return scan(sample_tree(spark)).diagnostics


def sample_nodes(spark, d):
    return scan(sample_tree(spark)).nodes.withColumn("external_deps", F.array_join("external_deps", "|"))


def sample_failures(spark, d):
    return scan(sample_tree(spark)).failures


def sample_counters(spark, d):
    return counters(scan(sample_tree(spark)))


def sample_coverage(spark, d):
    return coverage(seen(scan(sample_tree(spark))))


def sample_extensions(spark, d):
    return coverage_extensions(seen(scan(sample_tree(spark)))).drop("lang")


def sample_projects(spark, d):
    """The statistics of every project."""
    return project_summaries(scan(sample_tree(spark)))


def sample_totals(spark, d):
    return totals(project_summaries(scan(sample_tree(spark))))


def sample_gaps(spark, d):
    """Source that no extractor reads."""
    return gaps(scan(sample_tree(spark)))


def sample_document(spark, d):
    """The lines of the saved document that hold nodes and edges."""
    s = scan(sample_tree(spark))
    records = s.nodes.select("project", F.lit("{}").alias("record")).distinct()
    lines = document_lines(s.nodes, s.edges, records).where(F.col("section").isin(1, 3))
    return lines.select("project", "key", "key2", F.ltrim(F.col("line"), F.lit(",")).alias("line"))


QUERIES = {f.__name__: f for f in (sample_specifiers, sample_resolution, sample_edges, sample_diagnostics, sample_nodes, sample_failures, sample_counters, sample_coverage, sample_extensions, sample_projects, sample_totals, sample_gaps, sample_document)}

_EXT = "regexp_extract(path, '\\.([^./]+)$', 1)"
#: language of each extension of the sample; the rest is not read
_LANG = f"""CASE {_EXT} WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'vue' THEN 'vue' WHEN 'svelte' THEN 'svelte' WHEN 'astro' THEN 'astro' WHEN 'mdx' THEN 'mdx' WHEN 'go' THEN 'go'
 WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' WHEN 'html' THEN 'html'
 WHEN 'css' THEN 'css' WHEN 'scss' THEN 'sass' WHEN 'sh' THEN 'shell' END"""
_BASE = f"""WITH {found_sql()},
{files_sql()},
f AS (SELECT *, {_LANG} AS lang, path = 'src/bad.ts' AS broken FROM files),
s AS (SELECT *, {_LANG} AS lang, CASE outcome WHEN '->' THEN 'internal' WHEN 'package' THEN 'external' ELSE detail END AS kind_ FROM found),
e AS (SELECT DISTINCT project, path AS source, target, lang FROM (SELECT project, path, lang, unnest(targets) AS target FROM s) WHERE path <> target)"""
_RATE = "CASE WHEN total - external - excluded <= 0 THEN 1.0 ELSE (total - external - excluded - unresolved)::DOUBLE / (total - external - excluded) END"

_PROJECTS = f"""{_BASE}, x AS (SELECT project, CASE WHEN broken THEN 'failed' WHEN lang IS NOT NULL THEN 'analysed' WHEN {_EXT} = 'kt' THEN 'unsupported_language' ELSE 'not_source' END AS status FROM f WHERE refused IS NULL),
v AS (SELECT project, count(*) AS files_seen, count_if(status = 'analysed')::BIGINT AS files_analysed, count_if(status = 'unsupported_language')::BIGINT AS files_unsupported, count_if(status = 'not_source')::BIGINT AS files_not_source, count_if(status = 'failed')::BIGINT AS files_failed FROM x GROUP BY project),
c AS (SELECT project, count(*) AS total, count_if(outcome = 'package')::BIGINT AS external, count_if(outcome = 'unresolved')::BIGINT AS unresolved, count_if(outcome = 'excluded')::BIGINT AS excluded, count(DISTINCT CASE WHEN outcome = 'package' THEN detail END) AS packages FROM s GROUP BY project),
k AS (SELECT project, count(*) AS edges FROM e GROUP BY project),
per AS (SELECT v.*, (files_seen - files_failed)::BIGINT AS nodes, coalesce(k.edges, 0) AS edges, total, external, coalesce(packages, 0) AS packages, unresolved, excluded, total - external AS internal, total - external - unresolved - excluded AS resolved
  FROM v LEFT JOIN c ON c.project IS NOT DISTINCT FROM v.project LEFT JOIN k ON k.project IS NOT DISTINCT FROM v.project)"""
_BOTH = "CASE WHEN {0} - {1} <= 0 THEN 1.0 ELSE {2}::DOUBLE / ({0} - {1}) END AS resolution_rate, CASE WHEN {3} + {4} <= 0 THEN 1.0 ELSE {3}::DOUBLE / ({3} + {4}) END AS source_coverage"

SQL = {
    "sample_projects": f"{_PROJECTS} SELECT project, files_seen, files_analysed, files_unsupported, files_not_source, files_failed, total AS specifiers_total, internal AS specifiers_internal, resolved, unresolved, excluded, external AS external_specifiers, edges, nodes, packages AS external_packages_distinct, {_BOTH.format('internal', 'excluded', 'resolved', 'files_analysed', 'files_unsupported')} FROM per",
    "sample_totals": f"{_PROJECTS} SELECT count(*) AS projects, {', '.join(f'sum({a})::BIGINT AS {b}' for a, b in (('nodes', 'nodes'), ('edges', 'edges'), ('files_seen', 'files_seen'), ('files_analysed', 'files_analysed'), ('files_unsupported', 'files_unsupported'), ('internal', 'specifiers_internal'), ('resolved', 'resolved'), ('unresolved', 'unresolved'), ('excluded', 'excluded')))}, {_BOTH.format('sum(internal)', 'sum(excluded)', 'sum(resolved)', 'sum(files_analysed)', 'sum(files_unsupported)')} FROM per",
    "sample_gaps": _BASE + f" SELECT project, {_EXT} AS extension, 'Kotlin' AS lang, count(*) AS files FROM f WHERE {_EXT} = 'kt' GROUP BY ALL",
    "sample_specifiers": _BASE + " SELECT project, path, lang, ordinal, line, raw FROM s",
    "sample_resolution": _BASE + """ SELECT project, path, ordinal, raw, CASE WHEN outcome = '->' THEN 'internal' WHEN outcome = 'package' THEN 'external' WHEN detail = 'outside_root' THEN detail WHEN detail = 'not_found' THEN 'unresolved' ELSE 'internal' END AS tag,
 CASE WHEN outcome = 'package' THEN detail END AS package,
 CASE WHEN outcome = '->' THEN detail WHEN detail = 'skipped_directory' THEN 'dist/bundle.js' WHEN detail = 'gitignored' THEN 'src/gen.ts' WHEN detail = 'target_unreadable' THEN 'src/bad.ts' ELSE '' END AS targets FROM s""",
    "sample_edges": _BASE + " SELECT project, source, target FROM e",
    "sample_document": _BASE + f""", d AS (SELECT project, path, list_sort(list(DISTINCT detail)) AS deps FROM s WHERE outcome = 'package' GROUP BY ALL),
m AS (SELECT f.project, f.path, coalesce(f.lang, CASE {_EXT.replace('path', 'f.path')} WHEN 'png' THEN 'image' WHEN 'kt' THEN 'kotlin' WHEN 'json' THEN 'data' WHEN 'toml' THEN 'data' ELSE 'unknown' END) AS lang, CASE WHEN f.lang IS NOT NULL THEN 'source' WHEN {_EXT.replace('path', 'f.path')} = 'kt' THEN 'unread_source' ELSE 'asset' END AS kind,
  CASE WHEN f.lang IS NOT NULL THEN lines ELSE 0 END AS loc, bytes, coalesce(deps, []) AS deps FROM f LEFT JOIN d ON d.project IS NOT DISTINCT FROM f.project AND d.path = f.path WHERE refused IS NULL AND NOT broken)
SELECT project, path AS key, '' AS key2, to_json({{id: path, path: path, lang: lang, kind: kind, loc: loc, bytes: bytes, external_deps: deps}})::VARCHAR AS line FROM m
UNION ALL SELECT project, source, target, to_json({{source: source, target: target}})::VARCHAR FROM e""",
    "sample_diagnostics": _BASE + " SELECT project, path, line, raw AS specifier, outcome AS kind, detail AS reason, lang, ordinal::BIGINT AS seq FROM s WHERE outcome IN ('unresolved', 'excluded')",
    "sample_nodes": _BASE + f""", d AS (SELECT project, path, string_agg(DISTINCT detail, '|' ORDER BY detail) AS deps FROM s WHERE outcome = 'package' GROUP BY ALL)
SELECT f.project, f.path AS id, f.path, coalesce(f.lang, CASE {_EXT.replace('path', 'f.path')} WHEN 'png' THEN 'image' WHEN 'kt' THEN 'kotlin' WHEN 'json' THEN 'data' WHEN 'toml' THEN 'data' ELSE 'unknown' END) AS lang,
 CASE WHEN f.lang IS NOT NULL THEN 'source' WHEN {_EXT.replace('path', 'f.path')} = 'kt' THEN 'unread_source' ELSE 'asset' END AS kind, CASE WHEN f.lang IS NOT NULL THEN lines ELSE 0 END::BIGINT AS loc, bytes::BIGINT AS bytes, coalesce(deps, '') AS external_deps
FROM f LEFT JOIN d ON d.project IS NOT DISTINCT FROM f.project AND d.path = f.path WHERE refused IS NULL AND NOT broken""",
    "sample_failures": _BASE + " SELECT project, path, 'read failed: stream did not contain valid UTF-8' AS reason FROM f WHERE broken",
    "sample_counters": _BASE + f""", u AS (
 SELECT project, lang, 1 AS files, 0 AS total, 0 AS external, 0 AS unresolved, 0 AS excluded, 0 AS edges FROM f WHERE lang IS NOT NULL AND refused IS NULL AND NOT broken
 UNION ALL SELECT project, lang, 0, 1, (outcome = 'package')::INT, (outcome = 'unresolved')::INT, (outcome = 'excluded')::INT, 0 FROM s
 UNION ALL SELECT project, lang, 0, 0, 0, 0, 0, 1 FROM e),
t AS (SELECT project, lang, grouping(project, lang)::INT AS level, sum(files) AS files, sum(total) AS total, sum(external) AS external, sum(unresolved) AS unresolved, sum(excluded) AS excluded, sum(edges) AS edges FROM u GROUP BY GROUPING SETS ((project, lang), (project), ()))
SELECT project, lang, level, files::BIGINT AS files, total::BIGINT AS specifiers_total, (total - external)::BIGINT AS specifiers_internal, (total - external - unresolved - excluded)::BIGINT AS resolved, unresolved::BIGINT AS unresolved, excluded::BIGINT AS excluded,
 external::BIGINT AS external_specifiers, edges::BIGINT AS edges, {_RATE} AS resolution_rate FROM t""",
    "sample_coverage": _BASE + f""", x AS (SELECT project, CASE WHEN broken THEN 'failed' WHEN lang IS NOT NULL THEN 'analysed' WHEN {_EXT} = 'kt' THEN 'unsupported_language' ELSE 'not_source' END AS status FROM f WHERE refused IS NULL)
SELECT project, count(*) AS seen, count_if(status = 'analysed')::BIGINT AS analysed, count_if(status = 'unsupported_language')::BIGINT AS unsupported, count_if(status = 'not_source')::BIGINT AS not_source, count_if(status = 'failed')::BIGINT AS failed,
 CASE WHEN count_if(status IN ('analysed', 'unsupported_language')) = 0 THEN 1.0 ELSE count_if(status = 'analysed')::DOUBLE / count_if(status IN ('analysed', 'unsupported_language')) END AS source_coverage FROM x GROUP BY project""",
    "sample_extensions": _BASE + f""" SELECT project, {_EXT} AS extension, CASE WHEN broken THEN 'failed' WHEN lang IS NOT NULL THEN 'analysed' WHEN {_EXT} = 'kt' THEN 'unsupported_language' ELSE 'not_source' END AS status, count(*) AS count FROM f WHERE refused IS NULL GROUP BY ALL""",
}
