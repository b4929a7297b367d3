"""The general problems' queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators.hierarchy import hierarchy, module_links, on_cycles
from graphloom.operators.tree_aggregate import hot_targets, target_profile
from graphloom.sources.tables import table


def p3_found(spark, d):
    return on_cycles(module_links(table(spark, d, "edges")))


def p3_hierarchy(spark, d):
    """Descendants as one string, ids parted by line breaks, so that the result compares column by column."""
    return hierarchy(module_links(table(spark, d, "edges"))).withColumn("descendants", F.array_join("descendants", "\n"))


def p6_found(spark, d):
    return hot_targets(table(spark, d, "edges"))


def p6_targets(spark, d):
    return target_profile(table(spark, d, "edges"))


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p6_found, p6_targets)}

PLAIN = r"regexp_replace(replace({0}, '\', '/'), '^(?:\./+)+', '')"

_LINKS = f"""
links AS (
  SELECT project, id, parent FROM (
    SELECT project, {PLAIN.format('target')} AS id, {PLAIN.format('source')} AS parent,
           row_number() OVER (PARTITION BY project, {PLAIN.format('target')}
             ORDER BY scanned_at DESC NULLS LAST, loaded_at DESC NULLS LAST, {PLAIN.format('source')} DESC NULLS LAST) AS rn
    FROM edges WHERE kind = 'module' AND target IS NOT NULL) WHERE rn = 1)"""

_UP = f"""
WITH RECURSIVE {_LINKS.strip()},
up AS (
  SELECT project, id, parent AS anc FROM links WHERE parent IS NOT NULL
  UNION
  SELECT u.project, u.id, l.parent FROM up u JOIN links l ON l.project = u.project AND l.id = u.anc WHERE l.parent IS NOT NULL)"""

SQL = {
    "p3_found": f"{_UP} SELECT project, id FROM up WHERE id = anc",
    "p3_hierarchy": f"""
WITH RECURSIVE {_LINKS.strip()},
nodes_ AS (SELECT project, id, max(parent) AS parent FROM (
    SELECT project, id, parent FROM links UNION ALL SELECT project, parent, NULL FROM links WHERE parent IS NOT NULL) GROUP BY project, id),
up AS (
  SELECT project, id, parent AS anc FROM nodes_ WHERE parent IS NOT NULL
  UNION
  SELECT u.project, u.id, l.parent FROM up u JOIN nodes_ l ON l.project = u.project AND l.id = u.anc WHERE l.parent IS NOT NULL),
cyc AS (SELECT project, id FROM up WHERE id = anc),
down AS (
  SELECT project, id, id AS root, 0::BIGINT AS depth, id AS path FROM nodes_ WHERE parent IS NULL
  UNION ALL
  SELECT n.project, n.id, w.root, w.depth + 1, w.path || ' > ' || n.id FROM down w JOIN nodes_ n ON n.project = w.project AND n.parent = w.id),
des AS (SELECT project, anc AS id, count(*) AS n, string_agg(id, chr(10) ORDER BY id) AS ids FROM up GROUP BY project, anc)
SELECT n.project, n.id, n.parent, w.root, w.depth, w.path,
  CASE WHEN c.id IS NULL THEN coalesce(x.n, 0) END AS n_descendants,
  CASE WHEN c.id IS NULL THEN coalesce(x.ids, '') END AS descendants,
  CASE WHEN c.id IS NOT NULL THEN 'cycle' WHEN w.id IS NULL THEN 'below_cycle' ELSE 'tree' END AS state
FROM nodes_ n LEFT JOIN cyc c USING (project, id) LEFT JOIN down w USING (project, id) LEFT JOIN des x USING (project, id)""",
    "p6_found": f"""
SELECT target FROM (SELECT {PLAIN.format('target')} AS target FROM edges WHERE target IS NOT NULL)
GROUP BY target HAVING count(*) * 100 >= (SELECT count(*) FROM edges)""",
    "p6_targets": f"""
SELECT target, count(*) AS n_rows, count(DISTINCT project) AS n_projects,
  count(DISTINCT CASE WHEN project IS NOT NULL AND source IS NOT NULL THEN project || chr(0) || source END) AS n_files
FROM (SELECT project, {PLAIN.format('target')} AS target, {PLAIN.format('source')} AS source FROM edges WHERE target IS NOT NULL)
GROUP BY target""",
}
