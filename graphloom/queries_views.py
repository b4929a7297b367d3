"""Queries of what the interface shows, and their SQL."""

from __future__ import annotations

from graphloom import queries_graph as q
from graphloom.functions.catalogue import ALWAYS_SKIP
from graphloom.operators import graph, stats, views
from graphloom.queries_graph import _DIR, _FILES, _w
from graphloom.sources.tables import table
from pyspark.sql import functions as F


def extension_table(spark, d):
    return views.extension_table(q._files(spark, d))


def skipped_directories(spark, d):
    return views.skipped_directories(table(spark, d, "tree"))


def coverage_meters(spark, d):
    return views.meters(stats.coverage(q._files(spark, d)))


def shades(spark, d):
    return views.shades(q._n(spark, d))


def label_modes(spark, d):
    return views.label_modes(q._n(spark, d))


def inspector(spark, d):
    return views.inspector(q._n(spark, d), q._e(spark, d), q._d(spark, d), q._subject(spark, d))


def focus(spark, d):
    return views.focus(q._e(spark, d), q._subject(spark, d))


def linked_edges(spark, d):
    return views.linked_edges(q._e(spark, d), views.focus(q._e(spark, d), q._subject(spark, d)))


def kept_folders(spark, d):
    return views.kept_folders(q.filter_visible(spark, d))


def without_groups(spark, d):
    n = q._n(spark, d)
    return views.without_groups(n, views.folder_groups(n), [0, 1])


def seed_positions(spark, d):
    n = q._n(spark, d)
    out = views.seed_positions(n, q._e(spark, d), views.folder_groups(n))
    return out.select("project", "id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


def measures(spark, d):
    return views.measures(q._n(spark, d), q._e(spark, d))


def locate_absolute(spark, d):
    """A path below the folder of a project."""
    return graph.locate(q._n(spark, d), "/srv/scans/open-orver-2/src/index.ts", table(spark, d, "projects"))


def project_order(spark, d):
    """Projects by the components of their paths."""
    from pyspark.sql import Window

    p = table(spark, d, "projects").select("id", "path").distinct()
    return p.select("id", F.row_number().over(Window.orderBy(F.split("path", "/"), "id")).alias("place"))


QUERIES = {f.__name__: f for f in (extension_table, skipped_directories, coverage_meters, shades, label_modes, inspector, focus, linked_edges, kept_folders, without_groups, seed_positions, measures, locate_absolute, project_order)}

_SKIP = ", ".join(f"'{x}'" for x in sorted(ALWAYS_SKIP))
_FOCUS = """+fo AS (SELECT project, target AS id FROM e SEMI JOIN (SELECT project, id AS source FROM subject) s USING (project, source)
 UNION SELECT project, source FROM e SEMI JOIN (SELECT project, id AS target FROM subject) s USING (project, target) UNION SELECT project, id FROM subject)"""
_GROUPS = f"""+g AS (SELECT n.project, n.id, k.community FROM n JOIN (SELECT project, dir, row_number() OVER (PARTITION BY project ORDER BY c DESC, dir) - 1 AS community FROM (SELECT project, {_DIR.format('id')} AS dir, count(*) AS c FROM n GROUP BY ALL)) k ON k.project = n.project AND k.dir = {_DIR.format('n.id')})"""
SQL = {
    "extension_table": _w("""+x AS (SELECT project, CASE WHEN extension = '' THEN regexp_extract(path, '[^/]*$') ELSE extension END AS ext, extension, status, count(*) AS count FROM f GROUP BY ALL),
y AS (SELECT project, ext AS extension, status, sum(count)::BIGINT AS count FROM x GROUP BY ALL), l AS (SELECT project, extension, status, min(label) AS label FROM f GROUP BY ALL)
SELECT y.project, row_number() OVER (PARTITION BY y.project ORDER BY y.count DESC, y.extension, CASE y.status WHEN 'analysed' THEN 0 WHEN 'unsupported_language' THEN 1 WHEN 'not_source' THEN 2 WHEN 'failed' THEN 3 ELSE 99 END) AS place,
 y.extension, l.label, y.count, y.status, CASE y.status WHEN 'not_source' THEN coalesce(l.label, 'unrecognised extension') WHEN 'failed' THEN 'read or parse failed' WHEN 'unsupported_language' THEN 'no extractor for this language yet' END AS note
FROM y LEFT JOIN l ON l.project = y.project AND l.extension = y.extension AND l.status = y.status""", _FILES),
    "skipped_directories": f"""WITH p AS (SELECT project, string_split(path, '/') AS p FROM tree WHERE excluded_by = 'always_skip'),
k AS (SELECT project, p, list_position(list_transform(p, lambda x: x IN ({_SKIP})), true) AS k FROM p)
SELECT project, name, count(*) AS count FROM (SELECT DISTINCT project, p[k] AS name, array_to_string(p[1:k], '/') AS dir FROM k WHERE k > 0 AND k < len(p)) GROUP BY ALL""",
    "coverage_meters": _w("""+c AS (SELECT project, greatest(count(*), 1) AS seen, count_if(status = 'analysed') AS a, count_if(status = 'unsupported_language') AS u FROM f GROUP BY project)
SELECT project, a * 100 / seen AS read, u * 100 / seen AS unread, greatest(0.0, 100 - a * 100 / seen - u * 100 / seen) AS other FROM c""".replace("c AS", "cc AS").replace("FROM c", "FROM cc"), _FILES),
    "shades": _w(f"SELECT project, array_to_string(string_split({_DIR.format('id')}, '/')[1:2], '/') AS shade, count(*) AS files FROM n GROUP BY ALL"),
    "label_modes": _w("SELECT project, CASE WHEN count(*) <= 120 THEN 'all' WHEN count(*) <= 400 THEN 'more' ELSE 'hubs' END AS mode FROM n GROUP BY project"),
    "inspector": _w("""SELECT n.project, n.id, lang, kind, loc, bytes, coalesce(array_to_string(list_sort(list_filter(list_distinct(external_deps), lambda x: x IS NOT NULL)), '|'), '') AS packages,
 (SELECT count(*) FROM e, subject s WHERE e.project = s.project AND e.target = s.id) AS dependents, (SELECT count(*) FROM e, subject s WHERE e.project = s.project AND e.source = s.id) AS dependencies, (SELECT count(*) FROM dg, subject s WHERE dg.project = s.project AND dg.path = s.id) AS gaps
FROM n JOIN subject ON subject.project = n.project AND subject.id = n.id"""),
    "focus": _w(_FOCUS + " SELECT * FROM fo"),
    "linked_edges": _w(_FOCUS + " SELECT project, source, target FROM e WHERE EXISTS (SELECT 1 FROM fo WHERE fo.project = e.project AND fo.id IN (e.source, e.target))"),
    "kept_folders": _w(q._VIS + f" SELECT DISTINCT project, CASE WHEN {_DIR.format('id')} = '' THEN '.' ELSE {_DIR.format('id')} END AS folder FROM v"),
    "without_groups": _w(_GROUPS + " SELECT project, id FROM g WHERE community NOT IN (0, 1)"),
    "seed_positions": _w(_GROUPS + """, d AS (SELECT project, source AS id FROM e UNION SELECT project, target FROM e),
r AS (SELECT project, community, sum(26 + 90 / (community + 2)) OVER (PARTITION BY project ORDER BY community) AS radius FROM (SELECT DISTINCT project, community FROM g)),
i AS (SELECT g.project, g.id, g.community, row_number() OVER (PARTITION BY g.project, g.community ORDER BY g.id) - 1 AS k FROM g SEMI JOIN d ON d.project = g.project AND d.id = g.id),
o AS (SELECT g.project, g.id, row_number() OVER (PARTITION BY g.project ORDER BY g.id) - 1 AS k, count(*) OVER (PARTITION BY g.project) AS m FROM g ANTI JOIN d ON d.project = g.project AND d.id = g.id),
b AS (SELECT project, max(radius) * 1.2 + 40 AS ring FROM r GROUP BY project)
SELECT i.project, i.id, round(cos(i.community * 2.399963::DOUBLE) * radius + cos(k * 2.399963::DOUBLE) * (sqrt(k) * 7), 4) + 0.0 AS x, round(sin(i.community * 2.399963::DOUBLE) * radius + sin(k * 2.399963::DOUBLE) * (sqrt(k) * 7), 4) + 0.0 AS y FROM i JOIN r ON r.project = i.project AND r.community = i.community
UNION ALL SELECT o.project, o.id, round(cos(k * (2 * pi()) / m) * ring, 4) + 0.0, round(sin(k * (2 * pi()) / m) * ring, 4) + 0.0 FROM o JOIN b ON b.project = o.project"""),
    "measures": _w("""+a AS (SELECT project, count(*) AS k, sum(coalesce(bytes, 0))::DOUBLE AS b FROM n GROUP BY project), c AS (SELECT project, count(*) AS c FROM e GROUP BY project), h AS (SELECT project, max(dependents) AS most FROM ind GROUP BY project)
SELECT a.project, format('{:,}', k) AS nodes, format('{:,}', coalesce(c, 0)) AS edges, CASE WHEN b < 1024 THEN printf('%d B', b::BIGINT) WHEN b < 1048576 THEN printf('%.1f kB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS size, printf('%.4f', coalesce(most, 0)::DOUBLE / k) AS hub_share
FROM a LEFT JOIN c ON c.project = a.project LEFT JOIN h ON h.project = a.project"""),
    "locate_absolute": _w("""+x AS (SELECT project, id, CASE WHEN id = 'src/index.ts' THEN 1 WHEN project || '/' || id = 'src/index.ts' THEN 2 WHEN id LIKE '%/src/index.ts' THEN 3 END AS rule FROM n WHERE EXISTS (SELECT 1 FROM projects WHERE path = '/srv/scans/open-orver-2'))
SELECT project, id, rule FROM x WHERE rule = (SELECT min(rule) FROM x)"""),
    "project_order": "SELECT id, row_number() OVER (ORDER BY string_split(path, '/'), id) AS place FROM (SELECT DISTINCT id, path FROM projects)",
}
