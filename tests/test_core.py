"""Hierarchies, tree aggregation, graph queries, questions, the tool server, the tree source."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.operators.communities import communities, louvain
from graphloom.operators.hierarchy import hierarchy, module_links, on_cycles
from graphloom.operators.tree_aggregate import hot_targets, target_profile
from graphloom.plans.atlas import Atlas, NotAQuestion, Question, parse, render
from graphloom.rpc import handle
from graphloom.sources.tree import Ignores, SourceTree, ignore_rule, locate_projects, walk

EDGES = "project string, source string, target string, kind string, scanned_at timestamp, loaded_at timestamp, id string, path string"


def edge_table(spark, rows):
    """rows: (project, source, target, kind, day); the last two columns clash with names the operators use."""
    return spark.createDataFrame([(p, s, t, k, None, None, "x", "y") for p, s, t, k, _ in rows], EDGES).withColumns(
        {"scanned_at": F.lit(None).cast("timestamp"), "loaded_at": F.lit(None).cast("timestamp")}
    ) if not any(r[4] for r in rows) else spark.createDataFrame([(*r[:4], r[4]) for r in rows], "project string, source string, target string, kind string, d int").select(
        "project", "source", "target", "kind", F.timestamp_seconds(F.col("d") * 86400).alias("scanned_at"), F.lit(None).cast("timestamp").alias("loaded_at"), F.lit("x").alias("id"), F.lit("y").alias("path"))


@pytest.mark.parametrize("block", [2, 200_000])
def test_hierarchy(spark, block):
    rows = [("p", None, "r", "module", 1), ("p", "r", "a", "module", 1), ("p", ".\\a", "./b", "module", 1), ("p", "a", "b", "module", 1), ("p", "old", "c", "module", 1), ("p", "b", "c", "module", 2), ("p", "y", "x", "module", 1), ("p", "x", "y", "module", 1), ("p", "x", "z", "module", 1), ("p", "s", "s", "module", 1), (None, "q", "t", "module", 1), ("p", "a", None, "module", 1), ("p", "r", "i", "import", 1)]
    links = module_links(edge_table(spark, rows))
    got = {(r.project, r.id): r for r in hierarchy(links, block).collect()}
    c = got[("p", "c")]
    assert (c.path, c.depth, c.root, c.state) == ("r > a > b > c", 3, "r", "tree")
    assert got[("p", "r")].descendants == ["a", "b", "c"] and got[("p", "r")].n_descendants == 3
    assert got[("p", "z")].state == "below_cycle" and got[("p", "z")].path is None and got[("p", "z")].descendants == []
    assert got[("p", "x")].state == got[("p", "y")].state == got[("p", "s")].state == "cycle"
    assert got[(None, "t")].path == "q > t" and ("p", "i") not in got
    assert {(r.project, r.id) for r in on_cycles(links, block).collect()} == {("p", "x"), ("p", "y"), ("p", "s")}


def test_hierarchy_empty(spark):
    links = module_links(edge_table(spark, [("p", "a", "b", "import", 0)]))
    assert hierarchy(links).count() == on_cycles(links).count() == 0


def test_hierarchy_random(spark):
    rng = random.Random(5)
    parent = {f"n{i}": f"n{rng.randrange(60)}" for i in range(60) if rng.random() < 0.9}

    def cyclic(v):
        x = parent.get(v)
        for _ in range(70):
            if x == v:
                return True
            x = parent.get(x)
        return False

    links = module_links(edge_table(spark, [("p", s, t, "module", 0) for t, s in parent.items()]))
    assert {r.id for r in on_cycles(links, 7).collect()} == {v for v in parent if cyclic(v)}


def test_target_profile(spark):
    rng = random.Random(1)
    rows = [(f"p{rng.randrange(3)}" if rng.random() > 0.05 else None, f"s{rng.randrange(5)}" if rng.random() > 0.1 else None, "hot" if rng.random() < 0.4 else rng.choice(["./a", "a", ".\\b", None]), "import", 0) for _ in range(400)]
    got = {r.target: (r.n_rows, r.n_projects, r.n_files) for r in target_profile(edge_table(spark, rows), 2).collect()}
    want = {}
    for t in ("hot", "a", "b"):
        own = [r for r in rows if r[2] and r[2].replace("\\", "/").removeprefix("./") == t]
        want[t] = (len(own), len({r[0] for r in own} - {None}), len({(r[0], r[1]) for r in own if r[0] and r[1]}))
    assert got == want
    assert {r.target for r in hot_targets(edge_table(spark, rows), 30).collect()} == {t for t, v in want.items() if v[0] * 100 >= 30 * len(rows)}


def nodes_edges(spark, pairs, deps=None):
    ids = sorted({x for p in pairs for x in p} | set(deps or {}))
    n = spark.createDataFrame([(".", i, i, "typescript", "source", 1, 1, (deps or {}).get(i, [])) for i in ids], "project string, id string, path string, lang string, kind string, loc bigint, bytes bigint, external_deps array<string>")
    return n, spark.createDataFrame([(".", a, b) for a, b in pairs], "project string, source string, target string")


def test_questions(spark):
    n, e = nodes_edges(spark, [("mid.ts", "src/core.ts"), ("top.ts", "mid.ts"), ("mid.ts", "top.ts"), ("other/core.ts", "lib/x.ts")], {"top.ts": ["@acme/orm", "zod"], "mid.ts": ["zod"]})
    atlas = Atlas(n, e)
    assert atlas.answer(parse("What depends on ./src/core.ts?")).shown == ["mid.ts"]
    a = atlas.answer(Question("blast_radius", "src/core.ts", 1))
    assert (a.total, a.extra["stopped_at_depth"]) == (1, True) and "floor" in render(a)
    a = atlas.answer(Question("blast_radius", "src/core.ts", 100000))
    assert (a.total, a.extra["depth"], a.extra["by_depth"], a.extra["stopped_at_depth"]) == (2, 32, {1: 1, 2: 1}, False)
    assert atlas.answer(parse("who imports core.ts")).extra["reason"] == "ambiguous"
    assert atlas.answer(parse("what imports src/mid.tsx")).extra["suggestions"] == ["mid.ts"]
    u = atlas.answer(parse("who uses zod"))
    assert (u.total, u.shown) == (2, ["mid.ts", "top.ts"])
    assert atlas.answer(parse("files touching package orm")).extra == {"near_misses": ["@acme/orm"], "indexed": 2}
    assert atlas.answer(parse("summary")).extra["hubs"][0]["dependents"] == 1
    for bad in ("tell me", "what depends on", "why", ""):
        with pytest.raises(NotAQuestion):
            parse(bad)
    assert parse("what does a.ts depend on").kind == parse("what a.ts depends on").kind == "dependencies"
    ask = lambda **m: json.loads(handle(atlas, json.dumps({"jsonrpc": "2.0", "id": 1, **m})))
    assert len(ask(method="tools/list")["result"]["tools"]) == 5
    assert "mid.ts" in ask(method="tools/call", params={"name": "what_depends_on", "arguments": {"path": "src/core.ts"}})["result"]["content"][0]["text"]
    assert ask(method="tools/call", params={"name": "what_depends_on"})["result"]["isError"]
    assert ask(method="nope")["error"]["code"] == -32601 and json.loads(handle(atlas, "{"))["error"]["code"] == -32700
    assert handle(atlas, '{"method": "x"}') is None


def test_chain_beyond_the_deepest_walk(spark):
    n, e = nodes_edges(spark, [(f"{k + 1}.ts", f"{k}.ts") for k in range(34)])
    levels = graph.blast_by_depth(e, n.where("id = '0.ts'"), 32).collect()
    assert sorted(r.depth for r in levels) == [*range(1, 33)] and all(r.stopped_at_depth for r in levels)


def test_locate_and_labels(spark):
    n, _ = nodes_edges(spark, [("a/index.ts", "b/index.ts"), ("index.ts", "x/b/index.ts"), ("c.ts", "c.ts")])
    assert [(r.id, r.rule) for r in graph.locate(n, "index.ts").collect()] == [("index.ts", 1)]
    assert sorted(r.id for r in graph.locate(n, "b/index.ts").collect()) == ["b/index.ts"]
    assert graph.locate(n, "dex.ts").count() == 0
    assert {r.id: r.label for r in graph.unique_labels(n).collect()} == {"a/index.ts": "a/index.ts", "b/index.ts": "b/index.ts", "index.ts": "index.ts", "x/b/index.ts": "x/b/index.ts", "c.ts": "c.ts"}


def test_communities(spark):
    ring = [(f"src/a/{i}", f"src/a/{j}") for i in range(5) for j in range(i)] + [(f"src/b/{i}", f"src/b/{j}") for i in range(4) for j in range(i)] + [("src/a/0", "src/b/0")]
    n, e = nodes_edges(spark, ring, {"lone": []})
    got = {r.id: (r.community, r.name) for r in communities(n, e).collect()}
    assert got["lone"] == (-1, "unconnected") and got["src/a/3"] == (0, "src/a") and got["src/b/2"] == (1, "src/b")
    import numpy as np

    assert len(set(louvain(np.array([0, 2]), np.array([1, 3]), 4))) == 2


def test_ignore_rules():
    def refused(rules, path, is_dir=False):
        return Ignores([("", [r for r in map(ignore_rule, rules) if r])]).refuses(path, is_dir)

    assert refused(["*.log"], "a/b.log") and not refused(["/x"], "a/x") and refused(["a/**/z"], "a/b/c/z") and refused(["d/"], "d", True) and not refused(["d/"], "d")
    assert not refused(["*.log", "!keep.log"], "keep.log") and refused(["[ab].c"], "a.c") and not refused(["# c", ""], "c")


def test_tree_source(spark, tmp_path):
    for path, text in {"a/package.json": "{}", "a/.gitignore": "gen/\n", "a/gen/x.ts": "", "a/src/_p.scss": "", "a/src/.hidden": "h", "a/node_modules/m/i.js": "1", "b/go.mod": "module m", "b/e.go": "", "loose.txt": ""}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    os.symlink(tmp_path / "b/e.go", tmp_path / "b/l.go")
    assert locate_projects(str(tmp_path)) == [("a", ["node"]), ("b", ["go"])]
    spark.dataSource.register(SourceTree)
    got = {(r.project, r.path): r for r in spark.read.format("source_tree").option("path", str(tmp_path)).load().collect()}
    assert got[("a", "gen/x.ts")].excluded_by == "gitignore" and got[("a", "node_modules/m/i.js")].excluded_by == "always_skip" and got[("a", "node_modules/m/i.js")].content is None
    assert got[("a", "src/.hidden")].content == b"h" and got[("a", "src/_p.scss")].bytes == 0 and got[("b", "l.go")].is_symlink
    assert list(walk(str(tmp_path / "none"))) == []


def test_scratch(spark):
    import os

    from graphloom.plans.shared import materialise, scratch, shared_dir

    with scratch(spark):
        kept = materialise(spark.range(3), "kept")
        folder = next(f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("kept-"))
        assert kept.count() == 3
    assert folder not in os.listdir(shared_dir(spark).removeprefix("file://"))
