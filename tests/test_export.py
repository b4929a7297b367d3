"""Sinks, summary, command line and routes over one small scan."""

import json
import os
import xml.etree.ElementTree as ET

import pytest

from graphloom import __main__ as cli
from graphloom.operators import export, summary
from graphloom.operators.scan import scan
from graphloom.plans.atlas import Atlas, Question, render
from graphloom.sources.sample import SCHEMA, sample_tree

FILES = {
    "src/a&b<c>.ts": 'import x from "./lib";\n', "src/lib.ts": "", "app/(auth)/[id].ts": 'import l from "../../src/lib";\n', "app/(auth)/(id).ts": "", 'q"uote\\.ts': 'import l from "./src/lib";\nimport z from "zod";\n',
    "broken.ts": "".join(f'import g{i} from "./ghost{i}";\n' for i in range(40)), "x.kt": "", "y.swift": "",
}


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(".", p, c.encode(), len(c), False, None) for p, c in FILES.items()]
    return scan(spark.createDataFrame(rows, SCHEMA))


def test_graphml(scanned, tmp_path):
    to = str(tmp_path / "g.xml")
    cli.save(scanned, "graphml", to)
    g = ET.parse(to).getroot()
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert [k.get("id") for k in g.iter(f"{ns}key")] == list(export.GRAPHML_KEYS)
    nodes, edges = list(g.iter(f"{ns}node")), list(g.iter(f"{ns}edge"))
    assert {n.get("id") for n in nodes} == set(FILES) and [e.get("id") for e in edges] == ["e0", "e1", "e2"]
    assert {(e.get("source"), e.get("target")) for e in edges} == {(s, "src/lib.ts") for s in ("src/a&b<c>.ts", "app/(auth)/[id].ts", 'q"uote\\.ts')}
    assert all(len(n) == 6 for n in nodes)


def test_cypher_and_document(scanned, spark, tmp_path):
    to = str(tmp_path / "g.cypher")
    cli.save(scanned, "cypher", to)
    lines = open(to).read().splitlines()
    assert lines[0].startswith("CREATE CONSTRAINT") and len(lines) == 1 + len(FILES) + 3 and any('id: "q\\"uote\\\\.ts"' in x for x in lines)
    to = str(tmp_path / "g.json")
    cli.save(scanned, "json", to, "here")
    d = json.load(open(to))
    assert d["root"] == "here" and d["totals"]["nodes"] == len(FILES) and len(d["projects"]) == 1 and d["projects"][0]["stats"]["unresolved"] == 40
    assert {n["id"] for n in d["projects"][0]["graph"]["nodes"]} == set(FILES) and len(d["projects"][0]["graph"]["edges"]) == 3
    nodes, edges = export.read_document(spark, to)
    assert sorted(r.id for r in nodes.collect()) == sorted(FILES) and edges.count() == 3
    a = Atlas(nodes, edges).answer(Question("dependents", "src/lib.ts"))
    assert a.total == 3


def test_notes(scanned, tmp_path):
    folder = str(tmp_path / "vault")
    cli.save(scanned, "vault", folder)
    found = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)
    assert found == sorted([*(f"{p}.md" for p in FILES), "INDEX.md"])
    lib = open(os.path.join(folder, "src/lib.ts.md")).read()
    assert "dependents: 3" in lib and "## Imported by (3)" in lib and "- [[src/a&b<c>.ts]]" in lib and "- [[id].ts](<app/(auth)/[id].ts.md>)" in lib
    assert "- `./ghost3` — line 4, not found" in open(os.path.join(folder, "broken.ts.md")).read()
    assert "- 3 — [[src/lib.ts]]" in open(os.path.join(folder, "INDEX.md")).read()


def test_report_and_text(scanned):
    s = summary.summary(scanned, "here")
    r = export.markdown_report(s)
    assert "### Imports without an edge — 40" in r and "… and 25 more." in r and "### Not read — 2 files" in r and "| `kt` | 1 | Kotlin |" in r
    t = summary.text(s)
    assert "diagnostics            40" in t and "… 30 more" in t and "source coverage        0.7500" in t and "resolution rate        0.0698" in t


def test_summary_answer(spark):
    s = scan(sample_tree(spark).where("project in ('ts', 'go')"))
    a = Atlas(s.nodes, s.edges, s, "tree").answer(Question("summary"))
    assert [p["project"] for p in a.extra["projects"]] == ["go", "ts"] and a.extra["totals"]["projects"] == 2
    assert "not read: kt 1 (Kotlin)" in render(a) and "go: 5 files" in render(a)


def test_ambiguous_total(spark):
    nodes = spark.createDataFrame([(".", f"d{i:02}/index.ts", f"d{i:02}/index.ts", "typescript", "source", 1, 1, []) for i in range(14)], "project string, id string, path string, lang string, kind string, loc bigint, bytes bigint, external_deps array<string>")
    a = Atlas(nodes, spark.createDataFrame([], "project string, source string, target string")).answer(Question("dependents", "index.ts"))
    assert (a.total, len(a.shown), a.omitted) == (14, 10, 4) and "4 more" in render(a)


def test_pages(scanned):
    pages = cli.Pages(scanned)
    for path, (_, kind) in cli.ROUTES.items():
        code, got, to = pages.get(path + "?x=1")
        assert (code, got) == (200, kind) and os.path.getsize(to) > 100
    assert pages.get("/export/nothing")[0] == 404
