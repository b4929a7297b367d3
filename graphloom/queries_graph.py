"""Queries of the graph engine over the scanned tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import export, graph, stats
from graphloom.operators.communities import communities as find_communities
from graphloom.operators.scan import counters, scan
from graphloom.queries_general import PLAIN
from graphloom.sources.tables import table


def _n(spark, d):
    return graph.current_nodes(table(spark, d, "nodes"))


def _e(spark, d):
    return graph.imports(table(spark, d, "edges"))


def _subject(spark, d):
    """The file with the most dependents."""
    return graph.hubs(_e(spark, d), 1).select("project", "id")


def _d(spark, d):
    return stats.current_diagnostics(table(spark, d, "diagnostics"))


def _files(spark, d):
    return stats.classify(table(spark, d, "tree"), table(spark, d, "ext_catalogue"))


def nodes_current(spark, d):
    return _n(spark, d).select("project", "id", "lang", "kind", "loc", "bytes", F.array_join(F.sort_array(F.array_distinct(F.array_compact("external_deps"))), "|").alias("deps"))


def edges_distinct(spark, d):
    return _e(spark, d)


def scan_classify(spark, d):
    return _files(spark, d)


def coverage_summary(spark, d):
    return stats.coverage(_files(spark, d))


def coverage_extensions(spark, d):
    return stats.coverage_extensions(_files(spark, d))


def skipped_files(spark, d):
    return stats.skipped(table(spark, d, "tree"))


def node_kinds(spark, d):
    return stats.kind_counts(_n(spark, d))


def languages(spark, d):
    return stats.languages(_n(spark, d))


def external_packages(spark, d):
    return stats.external_packages(_n(spark, d))


def rate_by_lang(spark, d):
    return stats.language_stats(_n(spark, d), _e(spark, d), _d(spark, d))


def totals(spark, d):
    return stats.totals(table(spark, d, "projects"), _n(spark, d), _e(spark, d))


def unassigned_files(spark, d):
    return stats.unassigned(table(spark, d, "tree"), table(spark, d, "projects"))


def diagnostics_by_reason(spark, d):
    return stats.by_reason(_d(spark, d))


def diagnostics_by_file(spark, d):
    return stats.by_file(_d(spark, d))


def diagnostics_capped(spark, d):
    return stats.capped(_d(spark, d))


def dependents(spark, d):
    return graph.neighbours(_e(spark, d), _n(spark, d), _subject(spark, d), True)


def dependencies(spark, d):
    top = _e(spark, d).groupBy("project", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "project", "id").limit(1).select("project", "id")
    return graph.neighbours(_e(spark, d), _n(spark, d), top, False)


def blast_radius(spark, d):
    return graph.blast_radius(_e(spark, d), _subject(spark, d))


def blast_radius_by_depth(spark, d):
    return graph.blast_by_depth(_e(spark, d), _subject(spark, d), 2)


def hubs_workspace(spark, d):
    return graph.hubs(_e(spark, d))


def hubs_per_project(spark, d):
    return graph.hubs_per_project(_e(spark, d))


def degree(spark, d):
    return graph.degree(_n(spark, d), _e(spark, d))


def package_users(spark, d):
    return graph.package_users(_n(spark, d), "gobadra")


def package_near_misses(spark, d):
    return graph.package_near_misses(_n(spark, d), "GOBA")


def locate_suffix(spark, d):
    return graph.locate(_n(spark, d), "./utils/index.ts")


def locate_bare_name(spark, d):
    return graph.locate(_n(spark, d), "models.py")


def suggest(spark, d):
    return graph.suggest(_n(spark, d), "src/indx/index.tsx")


def search_rank(spark, d):
    return graph.search(_n(spark, d), _e(spark, d), "index")


def search_empty(spark, d):
    return graph.search(_n(spark, d), _e(spark, d), " ")


def filter_visible(spark, d):
    return graph.visible(_n(spark, d), _e(spark, d), ["source", "asset"], ["typescript", "go"], True)


def visible_edges(spark, d):
    return graph.visible_edges(_e(spark, d), filter_visible(spark, d))


def filter_unresolved(spark, d):
    return graph.visible(_n(spark, d), _e(spark, d), unresolved=_d(spark, d))


def folder_rollup(spark, d):
    return graph.folder_rollup(_n(spark, d))


def folder_edges(spark, d):
    return graph.folder_edges(_e(spark, d))


def unique_labels(spark, d):
    return graph.unique_labels(_n(spark, d))


def export_graphml_rows(spark, d):
    return export.graphml_rows(_n(spark, d), _e(spark, d))


def export_cypher_rows(spark, d):
    return export.cypher_rows(_n(spark, d), _e(spark, d))


def vault_notes(spark, d):
    """The lines of all notes."""
    return export.note_lines(_n(spark, d), _e(spark, d), _d(spark, d))


def communities(spark, d):
    return find_communities(_n(spark, d), _e(spark, d))


def scan_edges(spark, d):
    """Edges found anew in the texts of ``tree``."""
    return scan(table(spark, d, "tree")).edges


def scan_diagnostics(spark, d):
    return scan(table(spark, d, "tree")).diagnostics


def scan_counters(spark, d):
    return counters(scan(table(spark, d, "tree")))


_FUNCS = (
    nodes_current, edges_distinct, scan_classify, coverage_summary, coverage_extensions, skipped_files, node_kinds, languages, external_packages, rate_by_lang, totals,
    unassigned_files, diagnostics_by_reason, diagnostics_by_file, diagnostics_capped, dependents, dependencies, blast_radius, blast_radius_by_depth, hubs_workspace, hubs_per_project,
    degree, package_users, package_near_misses, locate_suffix, locate_bare_name, suggest, search_rank, search_empty, filter_visible, visible_edges, filter_unresolved, folder_rollup,
    folder_edges, unique_labels, export_graphml_rows, export_cypher_rows, vault_notes, communities, scan_edges, scan_diagnostics, scan_counters,
)
QUERIES = {f.__name__: f for f in _FUNCS}

_BASE = f"""
n AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY scanned_at DESC NULLS LAST, loaded_at DESC NULLS LAST, path DESC NULLS LAST, lang DESC NULLS LAST, kind DESC NULLS LAST, loc DESC NULLS LAST, bytes DESC NULLS LAST, external_deps DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1),
e AS (SELECT DISTINCT project, {PLAIN.format('source')} AS source, {PLAIN.format('target')} AS target FROM edges WHERE kind = 'import' AND source IS NOT NULL AND target IS NOT NULL),
ind AS (SELECT project, target AS id, count(*) AS dependents FROM e GROUP BY ALL),
subject AS (SELECT project, id FROM ind ORDER BY dependents DESC, project, id LIMIT 1),
dg AS (SELECT DISTINCT project, {PLAIN.format('path')} AS path, line, specifier, kind, reason, lang, seq FROM diagnostics)"""
_FILES = r"""
c AS (SELECT lower(extension) AS extension, lang AS c_lang, family, status AS c_status FROM ext_catalogue),
f0 AS (SELECT DISTINCT project, path, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\.([^.]*)$', 1)) AS extension,
  content IS NOT NULL AND NOT coalesce(content_ok, true) AS bad FROM (SELECT *, try(decode(content)) IS NOT NULL AS content_ok FROM tree) WHERE excluded_by IS NULL AND NOT coalesce(is_symlink, false)),
f AS (SELECT project, path, f0.extension, CASE WHEN c_status = 'analysed' AND bad THEN 'failed' ELSE coalesce(c_status, 'not_source') END AS status, c_lang AS lang, coalesce(family, 'unrecognised extension') AS label
  FROM f0 LEFT JOIN c ON c.extension = f0.extension)"""


def _w(sql: str, base: str = _BASE, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{base.strip()}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}"


_KIND = "(CASE kind WHEN 'source' THEN 2 WHEN 'unread_source' THEN 1 ELSE 0 END)"
_DIR = "(CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END)"
_NAME = "lower(regexp_extract(id, '[^/]*$'))"
_BLAST = """+b AS (SELECT project, id, 0 AS depth FROM subject UNION SELECT e.project, e.source, b.depth + 1 FROM b JOIN e ON e.project = b.project AND e.target = b.id WHERE b.depth < {0}),
r AS (SELECT project, id, min(depth) AS depth FROM b GROUP BY ALL HAVING min(depth) > 0)"""
_VIS = """+ends AS (SELECT project, source AS id FROM e UNION SELECT project, target FROM e),
v AS (SELECT project, id FROM n SEMI JOIN ends USING (project, id) WHERE kind IN ('source', 'asset') AND (kind = 'asset' OR lang IN ('typescript', 'go')))"""
_LIST = "count(*) OVER () AS total, greatest(count(*) OVER () - 50, 0) AS omitted"

SQL = {
    "nodes_current": _w("SELECT project, id, lang, kind, loc, bytes, array_to_string(list_sort(list_distinct(external_deps)), '|') AS deps FROM n"),
    "edges_distinct": _w("SELECT * FROM e"),
    "scan_classify": _w("SELECT * FROM f", _FILES),
    "coverage_summary": _w("SELECT project, count(*) AS seen, count_if(status = 'analysed') AS analysed, count_if(status = 'unsupported_language') AS unsupported, count_if(status = 'not_source') AS not_source, count_if(status = 'failed') AS failed, CASE WHEN count_if(status IN ('analysed', 'unsupported_language')) = 0 THEN 1.0::DOUBLE ELSE count_if(status = 'analysed')::DOUBLE / count_if(status IN ('analysed', 'unsupported_language')) END AS source_coverage FROM f GROUP BY project", _FILES),
    "coverage_extensions": _w("SELECT project, CASE WHEN extension = '' THEN regexp_extract(path, '[^/]*$') ELSE extension END AS extension, status, count(*) AS count, min(lang) AS lang FROM f GROUP BY 1, 2, 3", _FILES),
    "skipped_files": "SELECT project, excluded_by AS rule, count(*) AS files FROM (SELECT DISTINCT project, path, excluded_by FROM tree WHERE excluded_by IS NOT NULL) GROUP BY ALL",
    "node_kinds": _w("SELECT project, kind, count(*) AS files, sum(loc)::BIGINT AS loc, sum(bytes)::BIGINT AS bytes FROM n GROUP BY ALL"),
    "languages": _w("SELECT coalesce(lang, 'unknown') AS lang, count_if(kind = 'source') AS read, count_if(kind = 'unread_source') AS unread FROM n WHERE kind IN ('source', 'unread_source') GROUP BY 1"),
    "external_packages": _w("SELECT project, count(DISTINCT name) AS external_packages_distinct FROM (SELECT project, unnest(external_deps) AS name FROM n) WHERE name IS NOT NULL GROUP BY 1"),
    "rate_by_lang": _w("""+l AS (SELECT project, id AS source, coalesce(lang, 'unknown') AS lang FROM n WHERE kind = 'source'),
u AS (SELECT project, lang, 1 AS files, 0 AS resolved, 0 AS unresolved, 0 AS excluded FROM l
 UNION ALL SELECT e.project, coalesce(l.lang, 'unknown'), 0, 1, 0, 0 FROM e LEFT JOIN l USING (project, source)
 UNION ALL SELECT project, coalesce(lang, 'unknown'), 0, 0, (kind = 'unresolved')::INT, (kind = 'excluded')::INT FROM dg),
g AS (SELECT project, lang, grouping_id(project, lang) AS level, sum(files)::BIGINT AS files, sum(resolved)::BIGINT AS resolved, sum(unresolved)::BIGINT AS unresolved, sum(excluded)::BIGINT AS excluded FROM u GROUP BY GROUPING SETS ((project, lang), (project), ()))
SELECT project, lang, level, files, resolved AS edges, unresolved, excluded, CASE WHEN resolved + unresolved <= 0 THEN 1.0::DOUBLE ELSE resolved::DOUBLE / (resolved + unresolved) END AS edge_rate FROM g"""),
    "totals": _w("SELECT (SELECT count(DISTINCT id) FROM projects) AS projects, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges"),
    "unassigned_files": "SELECT project, count(*) AS files FROM (SELECT DISTINCT project, path FROM tree) t ANTI JOIN (SELECT id AS project FROM projects) p USING (project) GROUP BY 1",
    "diagnostics_by_reason": _w("SELECT kind, reason, count(*) AS count, count(DISTINCT project) AS projects FROM dg GROUP BY ALL"),
    "diagnostics_by_file": _w("SELECT project, path, count(*) AS count, count_if(kind = 'unresolved') AS unresolved FROM dg GROUP BY ALL"),
    "diagnostics_capped": _w("SELECT project, path, line, specifier, reason, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY string_split(path, '/'), seq NULLS FIRST, specifier NULLS FIRST, line NULLS FIRST) AS rank, count(*) OVER (PARTITION BY project) AS total FROM dg) WHERE rank <= 500"),
    "dependents": _w(f"SELECT project, id, coalesce(lang, 'unknown') AS lang, {_LIST} FROM (SELECT e.project, e.source AS id FROM e JOIN subject s ON s.project = e.project AND s.id = e.target) LEFT JOIN n USING (project, id) ORDER BY project, id LIMIT 50"),
    "dependencies": _w(f"SELECT project, id, coalesce(lang, 'unknown') AS lang, {_LIST} FROM (SELECT e.project, e.target AS id FROM e JOIN (SELECT project, source, count(*) AS k FROM e GROUP BY ALL ORDER BY k DESC, project, source LIMIT 1) s ON s.project = e.project AND s.source = e.source) LEFT JOIN n USING (project, id) ORDER BY project, id LIMIT 50"),
    "blast_radius": _w(_BLAST.format(3) + " SELECT * FROM r", recursive=True),
    "blast_radius_by_depth": _w(_BLAST.format(3) + " SELECT depth, count(*) AS files, (SELECT count(*) > 0 FROM r WHERE depth > 2) AS stopped_at_depth FROM r WHERE depth <= 2 GROUP BY depth", recursive=True),
    "hubs_workspace": _w("SELECT * FROM ind ORDER BY dependents DESC, project, id LIMIT 5"),
    "hubs_per_project": _w("SELECT project, id, dependents, rank, total, greatest(total - 15, 0) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY dependents DESC, id) AS rank, count(*) OVER (PARTITION BY project) AS total FROM ind) WHERE rank <= 15"),
    "degree": _w("""+o AS (SELECT project, source AS id, count(*) AS dependencies FROM e GROUP BY ALL),
q AS (SELECT project, id, kind, coalesce(dependents, 0) AS dependents, coalesce(dependencies, 0) AS dependencies FROM n LEFT JOIN ind USING (project, id) LEFT JOIN o USING (project, id))
SELECT project, id, dependents, dependencies, dependents + dependencies AS degree, round(least(greatest(1.1 * sqrt(dependents + dependencies + 1), 2.9), 11.0) * CASE WHEN kind = 'asset' THEN 0.75 ELSE 1.0 END, 6) AS size FROM q"""),
    "package_users": _w("SELECT project, id, lang FROM n WHERE list_contains(external_deps, 'gobadra')"),
    "package_near_misses": _w("SELECT DISTINCT name FROM (SELECT unnest(external_deps) AS name FROM n) WHERE contains(lower(name), 'goba') AND (SELECT count(*) FROM n WHERE list_contains(external_deps, 'GOBA')) = 0 ORDER BY name LIMIT 5"),
    "locate_suffix": _w("""+h AS (SELECT project, id, CASE WHEN id = 'utils/index.ts' THEN 1 WHEN project || '/' || id = 'utils/index.ts' THEN 2 WHEN suffix(id, '/utils/index.ts') THEN 3 END AS rule FROM n)
SELECT * FROM h WHERE rule = (SELECT min(rule) FROM h)"""),
    "locate_bare_name": _w("""+h AS (SELECT project, id, CASE WHEN id = 'models.py' THEN 1 WHEN project || '/' || id = 'models.py' THEN 2 WHEN suffix(id, '/models.py') THEN 3 WHEN regexp_extract(id, '[^/]*$') = 'models.py' THEN 4 END AS rule FROM n)
SELECT * FROM h WHERE rule = (SELECT min(rule) FROM h)"""),
    "suggest": _w(f"SELECT project, id FROM n WHERE contains({_NAME}, 'index') ORDER BY project, id LIMIT 5"),
    "search_rank": _w(f"""+q AS (SELECT *, instr(lower(id), 'index') - 1 AS pos, {_NAME} AS name FROM n)
SELECT project, id, round((100 - least(pos, 60) + CASE WHEN prefix(name, 'index') THEN 120 WHEN contains(name, 'index') THEN 60 ELSE 0 END + CASE WHEN name = 'index' THEN 200 ELSE 0 END - length(id)::DOUBLE / 20 - CASE WHEN kind = 'asset' THEN 25 ELSE 0 END)::DOUBLE, 6) AS score FROM q WHERE pos >= 0 ORDER BY score DESC, project, id LIMIT 40"""),
    "search_empty": _w("SELECT project, id, coalesce(dependents, 0)::DOUBLE AS score FROM n LEFT JOIN ind USING (project, id) WHERE kind <> 'asset' ORDER BY score DESC, project, id LIMIT 40"),
    "filter_visible": _w(_VIS + " SELECT * FROM v"),
    "visible_edges": _w(_VIS + " SELECT e.* FROM e SEMI JOIN v a ON a.project = e.project AND a.id = e.source SEMI JOIN v b ON b.project = e.project AND b.id = e.target"),
    "filter_unresolved": _w("SELECT project, id FROM n SEMI JOIN (SELECT project, path AS id FROM dg) x USING (project, id)"),
    "folder_rollup": _w(f"""+p AS (SELECT project, {_DIR.format('id')} AS folder, coalesce(lang, 'unknown') AS lang, count(*) AS k, max({_KIND}) AS kind FROM n GROUP BY ALL),
t AS (SELECT project, folder, sum(k)::BIGINT AS members, max(kind) AS kind FROM p GROUP BY ALL),
m AS (SELECT project, folder, lang FROM (SELECT *, row_number() OVER (PARTITION BY project, folder ORDER BY k DESC, lang) AS rn FROM p) WHERE rn = 1)
SELECT project, folder, members, lang, CASE kind WHEN 2 THEN 'source' WHEN 1 THEN 'unread_source' ELSE 'asset' END AS kind FROM t JOIN m USING (project, folder)"""),
    "folder_edges": _w(f"SELECT DISTINCT project, {_DIR.format('source')} AS source, {_DIR.format('target')} AS target FROM e WHERE {_DIR.format('source')} <> {_DIR.format('target')}"),
    "unique_labels": _w("""+x AS (SELECT project, id, unnest(range(1, len(string_split(id, '/')) + 1)) AS k FROM n),
s AS (SELECT project, id, k, array_to_string(list_slice(string_split(id, '/'), len(string_split(id, '/')) - k + 1, len(string_split(id, '/'))), '/') AS suffix FROM x),
u AS (SELECT project, suffix FROM s GROUP BY ALL HAVING count(*) = 1)
SELECT project, id, coalesce((SELECT min_by(s.suffix, s.k) FROM s JOIN u ON u.project = s.project AND u.suffix = s.suffix WHERE s.project = n.project AND s.id = n.id), id) AS label FROM n"""),
}

# --- sinks -------------------------------------------------------------------------------------------------

_Q = "(CASE WHEN {0} = '.' THEN {1} WHEN {0} IS NULL THEN {1} ELSE {0} || '/' || {1} END)"
_QN, _QS, _QT = (_Q.format("project", c) for c in ("id", "source", "target"))


def _sql_replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, {old}, {new})"
    return text


def _sql_xml(text: str) -> str:
    return _sql_replaced(text, [("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"), ("'\"'", "'&quot;'"), ("chr(39)", "'&apos;'")])


def _sql_cypher(text: str) -> str:
    inner = _sql_replaced(text, [("chr(92)", "chr(92) || chr(92)"), ("'\"'", "chr(92) || '\"'"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'")])
    return f"('\"' || {inner} || '\"')"


def _sql_link(target: str) -> str:
    return f"(CASE WHEN regexp_matches({target}, '[\\[\\]#|^]') THEN '[' || regexp_extract({target}, '[^/]*$') || '](<' || {target} || '.md>)' ELSE '[[' || {target} || ']]' END)"


_C = "coalesce({0}::VARCHAR, '')"
_NODE_DATA = " || ".join(f"'<data key=\"{k}\">' || {v} || '</data>'" for k, v in {"path": _sql_xml(_C.format("path")), "project": _sql_xml(_C.format("project")), "lang": _sql_xml(_C.format("lang")), "kind": _C.format("kind"), "loc": "coalesce(loc, 0)::VARCHAR", "bytes": "coalesce(bytes, 0)::VARCHAR"}.items())
_LANG = "coalesce(lang, 'unknown')"
SQL |= {
    "export_graphml_rows": _w(f"""SELECT 'node' AS part, {_QN} AS id, '<node id="' || {_sql_xml(_QN)} || '">' || {_NODE_DATA} || '</node>' AS line FROM n
UNION ALL SELECT 'edge', 'e' || k, '<edge id="e' || k || '" source="' || {_sql_xml(_QS)} || '" target="' || {_sql_xml(_QT)} || '"/>' FROM (SELECT *, row_number() OVER (ORDER BY project NULLS FIRST, source, target) - 1 AS k FROM e)"""),
    "export_cypher_rows": _w(f"""SELECT 'node' AS part, {_QN} AS id, 'MERGE (f:File {{id: ' || {_sql_cypher(_QN)} || '}}) SET f.path = ' || {_sql_cypher(_C.format('path'))} || ', f.project = ' || {_sql_cypher(_C.format('project'))} || ', f.lang = ' || {_sql_cypher(_C.format('lang'))}
 || ', f.kind = ' || {_sql_cypher(_C.format('kind'))} || ', f.loc = ' || coalesce(loc, 0) || ', f.bytes = ' || coalesce(bytes, 0) || ';' AS line FROM n
UNION ALL SELECT 'edge', {_QS} || ' -> ' || {_QT}, 'MATCH (a:File {{id: ' || {_sql_cypher(_QS)} || '}}), (b:File {{id: ' || {_sql_cypher(_QT)} || '}}) MERGE (a)-[:IMPORTS]->(b);' FROM e"""),
    "vault_notes": _w(f"""+i AS (SELECT project, target AS id, count(*) AS k FROM e GROUP BY ALL), o AS (SELECT project, source AS id, count(*) AS k FROM e GROUP BY ALL),
x AS (SELECT n.*, coalesce(i.k, 0) AS dependents, coalesce(o.k, 0) AS dependencies, {_Q.format('n.project', 'n.id')} AS note FROM n LEFT JOIN i ON i.project IS NOT DISTINCT FROM n.project AND i.id = n.id LEFT JOIN o ON o.project IS NOT DISTINCT FROM n.project AND o.id = n.id),
p AS (SELECT DISTINCT note, name FROM (SELECT note, unnest(external_deps) AS name FROM x) WHERE name IS NOT NULL),
g AS (SELECT {_Q.format('dg.project', 'dg.path')} AS note, dg.* FROM dg SEMI JOIN n ON n.project IS NOT DISTINCT FROM dg.project AND n.id = dg.path)
SELECT note, 0 AS section, '' AS key, '---' || chr(10) || 'path: "' || coalesce(path, '') || '"' || chr(10) || 'project: "' || coalesce(project, '') || '"' || chr(10) || 'lang: ' || {_LANG} || chr(10) || 'kind: ' || coalesce(kind, '') || chr(10) || 'loc: ' || coalesce(loc, 0) || chr(10) || 'bytes: ' || coalesce(bytes, 0)
 || chr(10) || 'dependents: ' || dependents || chr(10) || 'dependencies: ' || dependencies || chr(10) || 'tags: [code/' || {_LANG} || ', code/' || coalesce(kind, '') || ']' || chr(10) || '---' || chr(10) || chr(10) || '# ' || regexp_extract(id, '[^/]*$') || chr(10) || chr(10) || '`' || coalesce(path, '') || '` · ' || {_LANG} || ' · ' || coalesce(loc, 0) || ' lines' || chr(10) AS line FROM x
UNION ALL SELECT note, 1, '', '## Imported by (' || dependents || ')' || chr(10) FROM x WHERE dependents > 0
UNION ALL SELECT note, 3, '', '## Imports (' || dependencies || ')' || chr(10) FROM x WHERE dependencies > 0
UNION ALL SELECT {_QT}, 2, source, '- ' || {_sql_link(_QS)} FROM e SEMI JOIN n ON n.project IS NOT DISTINCT FROM e.project AND n.id = e.target
UNION ALL SELECT {_QS}, 4, target, '- ' || {_sql_link(_QT)} FROM e SEMI JOIN n ON n.project IS NOT DISTINCT FROM e.project AND n.id = e.source
UNION ALL SELECT DISTINCT note, 5, '', '## External packages' || chr(10) FROM p
UNION ALL SELECT note, 6, name, '- `' || name || '`' FROM p
UNION ALL SELECT DISTINCT note, 7, '', '## Imports that did not resolve' || chr(10) FROM g
UNION ALL SELECT note, 8, lpad(coalesce(seq, 0)::VARCHAR, 12, '0'), '- `' || coalesce(specifier, '') || '` — line ' || coalesce(line::VARCHAR, '?') || ', ' || replace(coalesce(reason, 'unknown'), '_', ' ') FROM g"""),
}
