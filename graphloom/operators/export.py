"""Sinks: GraphML, Cypher, notes, the JSON or YAML document of a scan, and a Markdown report.

Every sink is rows of text with sort keys: nothing but the shown lists of a report is collected.
``written`` sorts the rows over all executors; a file is put together from the sorted parts.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a table of the report shows.
TABLE_ROWS = 15


def qualified(project: Column, path: Column) -> Column:
    """``project/id``, or the id alone for the project ``.``."""
    return F.when(project == ".", path).otherwise(F.concat_ws("/", project, path))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def xml(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def cypher(text: Column) -> Column:
    """A double-quoted Cypher string."""
    return F.concat(F.lit('"'), _replaced(text, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]), F.lit('"'))


def link(target: Column) -> Column:
    """A wiki link; a path that one cannot carry becomes a Markdown link, so no two paths share a link."""
    name = F.substring_index(target, "/", -1)
    return F.when(F.rlike(target, F.lit(r"[\[\]#|^]")), F.concat(F.lit("["), name, F.lit("](<"), target, F.lit(".md>)"))).otherwise(F.concat(F.lit("[["), target, F.lit("]]")))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A running number over the whole order without sorting in one task.

    Rows are range-partitioned and sorted, each partition's size is counted, and the
    sizes before it are added to the place within the partition; only one count per partition is collected.
    """
    spread = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return spread.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _text(column: str, default: str = "") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(default))


def _number(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("string")


# --- fixed values: keys and frames of the formats ----------------------------------------------------------
GRAPHML_KEYS = {"path": "string", "project": "string", "lang": "string", "kind": "string", "loc": "int", "bytes": "long"}
GRAPHML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(f'  <key id="{k}" for="node" attr.name="{k}" attr.type="{t}"/>\n' for k, t in GRAPHML_KEYS.items()) + '  <graph id="code" edgedefault="directed">'
GRAPHML_TAIL = "  </graph>\n</graphml>"
CYPHER_HEAD = "CREATE CONSTRAINT file_id IF NOT EXISTS FOR (f:File) REQUIRE f.id IS UNIQUE;"
# --- end of fixed values -------------------------------------------------------------------------------------


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): one XML element per node and edge, with all node keys; edge ids run in (project, source, target) order."""
    q = qualified(F.col("project"), F.col("id"))
    value = {"path": xml(_text("path")), "project": xml(_text("project")), "lang": xml(_text("lang")), "kind": _text("kind"), "loc": _number("loc"), "bytes": _number("bytes")}
    data = [x for k, v in value.items() for x in (F.lit(f'<data key="{k}">'), v, F.lit("</data>"))]
    n = nodes.select(F.lit("node").alias("part"), q.alias("id"), F.concat(F.lit('<node id="'), xml(q), F.lit('">'), *data, F.lit("</node>")).alias("line"))
    a, b = qualified(F.col("project"), F.col("source")), qualified(F.col("project"), F.col("target"))
    own = numbered(edges.select("project", "source", "target"), ["project", "source", "target"], "k")
    e = own.select(F.lit("edge").alias("part"), F.concat(F.lit("e"), F.col("k").cast("string")).alias("id"), F.concat(F.lit('<edge id="e'), F.col("k").cast("string"), F.lit('" source="'), xml(a), F.lit('" target="'), xml(b), F.lit('"/>')).alias("line"))
    return n.unionByName(e)


def cypher_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): statements that may be run again; their constraint is ``CYPHER_HEAD``."""
    q = qualified(F.col("project"), F.col("id"))
    sets = [x for k in ("path", "project", "lang") for x in (F.lit(f"f.{k} = "), cypher(_text(k)), F.lit(", "))]
    n = nodes.select(F.lit("node").alias("part"), q.alias("id"), F.concat(F.lit("MERGE (f:File {id: "), cypher(q), F.lit("}) SET "), *sets, F.lit("f.kind = "), cypher(_text("kind")), F.lit(", f.loc = "), _number("loc"), F.lit(", f.bytes = "), _number("bytes"), F.lit(";")).alias("line"))
    a, b = qualified(F.col("project"), F.col("source")), qualified(F.col("project"), F.col("target"))
    e = edges.select(F.lit("edge").alias("part"), F.concat(a, F.lit(" -> "), b).alias("id"), F.concat(F.lit("MATCH (a:File {id: "), cypher(a), F.lit("}), (b:File {id: "), cypher(b), F.lit("}) MERGE (a)-[:IMPORTS]->(b);")).alias("line"))
    return n.unionByName(e)


def note_lines(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(note, section, key, line): the lines of one Markdown note per node, to be read in this order.

    A line is a row, so the note of a file with any number of importers is never one row.
    The sections: front matter and title, importers, imports, packages, imports that did not resolve.
    """
    ends = edges.select("project", F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select("project", F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    degree = ends.groupBy("project", "id").agg(F.sum("i").alias("dependents"), F.sum("o").alias("dependencies")).withColumnsRenamed({"project": "_p", "id": "_i"})
    n = nodes.join(degree, F.col("project").eqNullSafe(F.col("_p")) & (F.col("id") == F.col("_i")), "left")
    lang = _text("lang", "unknown")
    head = F.concat(
        F.lit('---\npath: "'), _text("path"), F.lit('"\nproject: "'), _text("project"), F.lit('"\nlang: '), lang, F.lit("\nkind: "), _text("kind"), F.lit("\nloc: "), _number("loc"), F.lit("\nbytes: "), _number("bytes"),
        F.lit("\ndependents: "), _number("dependents"), F.lit("\ndependencies: "), _number("dependencies"), F.lit("\ntags: [code/"), lang, F.lit(", code/"), _text("kind"), F.lit("]\n---\n\n# "), F.substring_index("id", "/", -1),
        F.lit("\n\n`"), _text("path"), F.lit("` · "), lang, F.lit(" · "), _number("loc"), F.lit(" lines\n"),
    )
    note = qualified(F.col("project"), F.col("id"))
    parts = [n.select(note.alias("note"), F.lit(0).alias("section"), F.lit("").alias("key"), head.alias("line"))]
    item = lambda text: F.concat(F.lit("- "), text)
    for section, title, count in ((1, "Imported by", "dependents"), (3, "Imports", "dependencies")):
        parts.append(n.where(F.col(count) > 0).select(note, F.lit(section), F.lit(""), F.concat(F.lit(f"## {title} ("), _number(count), F.lit(")\n"))))
    known = nodes.select(F.col("project").alias("_p"), F.col("id").alias("_i"))
    for section, own, other in ((2, "target", "source"), (4, "source", "target")):
        far = edges.join(known, F.col("project").eqNullSafe(F.col("_p")) & (F.col(own) == F.col("_i")), "left_semi")
        parts.append(far.select(qualified(F.col("project"), F.col(own)), F.lit(section), F.col(other), item(link(qualified(F.col("project"), F.col(other))))))
    packages = F.sort_array(F.array_distinct(F.array_compact(F.coalesce("external_deps", F.array().cast("array<string>")))))
    parts.append(nodes.where(F.size(packages) > 0).select(note, F.lit(5), F.lit(""), F.lit("## External packages\n")))
    parts.append(nodes.select("project", "id", F.explode(packages).alias("p")).select(note, F.lit(6), F.col("p"), item(F.concat(F.lit("`"), F.col("p"), F.lit("`")))))
    d = diagnostics.join(known, F.col("project").eqNullSafe(F.col("_p")) & (F.col("path") == F.col("_i")), "left_semi").withColumn("note", qualified(F.col("project"), F.col("path")))
    parts.append(d.select("note").distinct().select("note", F.lit(7), F.lit(""), F.lit("## Imports that did not resolve\n")))
    parts.append(d.select("note", F.lit(8), F.lpad(_number("seq"), 12, "0"), item(F.concat(F.lit("`"), _text("specifier"), F.lit("` — line "), _text("line", "?"), F.lit(", "), F.replace(_text("reason", "unknown"), F.lit("_"), F.lit(" "))))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def index_note(summary: dict) -> str:
    """The note that leads into the others: the two rates, counts and the most imported files."""
    t = summary["totals"]
    rows = [("**Resolution rate**", f"**{t['resolution_rate']:.4f}**"), ("**Source coverage**", f"**{t['source_coverage']:.4f}**"), ("Files", t["files_seen"]), ("Nodes", t["nodes"]), ("Edges", t["edges"])]
    out = ["---", "tags: [code]", "---", "", f"# {summary['root']}", "", "| | |", "| --- | ---: |", *[f"| {a} | {b} |" for a, b in rows]]
    for p in summary["projects"]:
        if p["hubs"]:
            out += ["", f"## Most imported — `{p['project']}`", "", *[f"- {h['dependents']} — {h['link']}" for h in p["hubs"]]]
    return "\n".join(out) + "\n"


def write_notes(lines: DataFrame, folder: str, index: str | None = None) -> None:
    """Each task writes the notes of its rows line by line; ``folder`` must be one that all executors share."""

    def write(part: Iterator) -> None:
        at, f = None, None
        for r in part:
            if r["note"] != at:
                if f:
                    f.close()
                at, to = r["note"], os.path.join(folder, r["note"] + ".md")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                f = open(to, "w", encoding="utf-8")
            f.write(r["line"] + "\n")
        if f:
            f.close()

    lines.repartition("note").sortWithinPartitions("note", "section", "key").foreachPartition(write)
    if index is not None:
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "INDEX.md"), "w", encoding="utf-8") as f:
            f.write(index)


def written(rows: DataFrame, order: list, folder: str) -> None:
    """The lines as text files, whose names sort as the rows do."""
    rows.orderBy(*order).select("line").write.mode("overwrite").text(folder)


def one_file(rows: DataFrame, order: list, to: str, head: str = "", tail: str = "") -> None:
    """Head, sorted lines and tail as one file, streamed from the sorted parts."""
    folder = to + ".parts"
    written(rows, order, folder)
    with open(to, "w", encoding="utf-8") as out:
        out.write(head + "\n" if head else "")
        for part in sorted(p for p in os.listdir(folder) if p.startswith("part-")):
            with open(os.path.join(folder, part), encoding="utf-8") as f:
                shutil.copyfileobj(f, out)
        out.write(tail + "\n" if tail else "")
    shutil.rmtree(folder)


# --- the document of a scan ---------------------------------------------------------------------------------

_NODE = ("id", "path", "lang", "kind", "loc", "bytes", "external_deps")


def document_lines(nodes: DataFrame, edges: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, section, key, key2, line): the JSON of every project, an element a line.

    ``projects`` has a row (project, record) per project; ``record`` is the JSON text of its
    statistics. Between the head and the tail of ``document_frame`` the lines make the workspace document.
    """
    first_node = nodes.groupBy("project").agg(F.min("id").alias("_first")).withColumnRenamed("project", "_p")
    first_edge = edges.groupBy("project").agg(F.min(F.struct("source", "target")).alias("_first")).withColumnRenamed("project", "_p")
    first_project = projects.agg(F.min(F.struct(F.col("project").isNotNull(), "project"))["project"]).scalar()
    none = F.lit("")
    own = lambda c: F.to_json(F.struct(F.col("project").alias("id")), {"ignoreNullFields": "false"}) if c is None else c
    head = F.concat(F.when(F.col("project").eqNullSafe(first_project), "").otherwise(","), F.rtrim(own(None), F.lit("}")), F.lit(',"stats":'), F.col("record"), F.lit(',"graph":{"nodes":['))
    same = F.col("project").eqNullSafe(F.col("_p"))
    n = nodes.select("project", *_NODE).join(first_node, same)
    e = edges.select("project", "source", "target").join(first_edge, same)
    comma = lambda mine: F.when(mine == F.col("_first"), "").otherwise(",")
    rows = [
        projects.select("project", F.lit(0).alias("section"), none.alias("key"), none.alias("key2"), head.alias("line")),
        n.select("project", F.lit(1), F.col("id"), none, F.concat(comma(F.col("id")), F.to_json(F.struct(*_NODE), {"ignoreNullFields": "false"}))),
        projects.select("project", F.lit(2), none, none, F.lit('],"edges":[')),
        e.select("project", F.lit(3), F.col("source"), F.col("target"), F.concat(comma(F.struct("source", "target")), F.to_json(F.struct("source", "target")))),
        projects.select("project", F.lit(4), none, none, F.lit("]}}")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


DOCUMENT_ORDER = ["project", "section", "key", "key2"]


def document_frame(root: str, totals: dict, unassigned: int = 0) -> tuple[str, str]:
    head = json.dumps({"root": root, "split": totals["projects"] > 1, "totals": totals, "unassigned_files": unassigned})
    return head[:-1] + ', "projects": [', "]}"


def read_document(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a saved document."""
    node = "struct<id:string,path:string,lang:string,kind:string,loc:bigint,bytes:bigint,external_deps:array<string>>"
    doc = spark.read.schema(f"projects array<struct<id:string,graph:struct<nodes:array<{node}>,edges:array<struct<source:string,target:string>>>>>").json(path, multiLine=True)
    p = doc.select(F.explode("projects").alias("p"))
    nodes = p.select(F.col("p.id").alias("project"), F.explode("p.graph.nodes").alias("n")).select("project", "n.*")
    return nodes, p.select(F.col("p.id").alias("project"), F.explode("p.graph.edges").alias("e")).select("project", "e.*")


def yaml_text(document_json: str) -> str:
    """The same record as YAML; JSON text is used where no YAML library is there (JSON is YAML)."""
    try:
        import yaml
    except ImportError:
        return json.dumps(json.loads(document_json), indent=2)
    return yaml.safe_dump(json.loads(document_json), sort_keys=False, allow_unicode=True)


def _table(heads: list[str], rows: list[tuple]) -> list[str]:
    return ["| " + " | ".join(heads) + " |", "| " + " | ".join("---" for _ in heads) + " |", *("| " + " | ".join(map(str, r)) + " |" for r in rows)]


def markdown_report(summary: dict) -> str:
    """The report of one scan. Tables show ``TABLE_ROWS`` rows and name how many of the exact total are left out."""
    t = summary["totals"]
    out = [f"# Scan of `{summary['root']}`", ""]
    out += _table(["", ""], [("**Resolution rate**", f"**{t['resolution_rate']:.4f}**"), ("**Source coverage**", f"**{t['source_coverage']:.4f}**"), ("Projects", t["projects"]), ("Files seen", t["files_seen"]), ("Analysed", t["files_analysed"]), ("Not read", t["files_unsupported"]), ("Nodes", t["nodes"]), ("Edges", t["edges"])])
    out += ["", "resolution rate = resolved / (internal − excluded); source coverage = analysed / (analysed + unsupported)."]
    for p in summary["projects"]:
        if len(summary["projects"]) > 1:
            out += ["", f"## `{p['project']}`", "", f"Rate {p['resolution_rate']:.4f}, coverage {p['source_coverage']:.4f}, {p['nodes']} nodes, {p['edges']} edges."]
        out += ["", "### By language", "", *_table(["Language", "Files", "Edges", "Rate"], [(x["lang"], x["files"], x["edges"], f"{x['resolution_rate']:.4f}") for x in p["by_lang"]])]
        if p["gaps_total"]:
            out += ["", f"### Not read — {p['files_unsupported']} files", "", *_table(["Extension", "Files", "Language"], [(f"`{g['extension']}`", g["files"], g["lang"] or "unrecognised") for g in p["gaps"]])]
            if p["gaps_total"] > len(p["gaps"]):
                out += ["", f"… and {p['gaps_total'] - len(p['gaps'])} more extensions."]
        if p["hubs"]:
            out += ["", "### Most imported", "", *_table(["Dependents", "File"], [(h["dependents"], f"`{h['id']}`") for h in p["hubs"]])]
        broken = p["unresolved"] + p["excluded"]
        if broken:
            out += ["", f"### Imports without an edge — {broken}", "", *_table(["File", "Line", "Specifier", "Why"], [(f"`{d['path']}`", d["line"], f"`{d['specifier']}`", d["reason"].replace("_", " ")) for d in p["broken"]])]
            if broken > len(p["broken"]):
                out += ["", f"… and {broken - len(p['broken'])} more."]
    return "\n".join(out) + "\n"
