"""Whole scans of small trees."""

import pytest

from graphloom.operators.scan import counters, scan

SCHEMA = "project string, path string, content binary, bytes bigint, is_symlink boolean, excluded_by string"


def tree(spark, files, excluded=None):
    rows = [(".", p, c.encode() if isinstance(c, str) else c, len(c), False, (excluded or {}).get(p)) for p, c in files.items()]
    return spark.createDataFrame(rows, SCHEMA)


def edges(s):
    return sorted((r.source, r.target) for r in s.edges.collect())


def gaps(s):
    return sorted((r.path, r.specifier, r.kind, r.reason) for r in s.diagnostics.collect())


def test_typescript_slice(spark):
    s = scan(tree(spark, {
        "src/a.ts": 'import b from "./b";\nimport React from "react";\nimport g from "./ghost";\nimport again from "./b";\nimport out from "../../x";\n',
        "src/b.ts": "", "src/c.ts": 'import d from "../dist/bundle";\nimport i from "./gen";\nimport l from "./logo.png";\n', "dist/bundle.js": "", "src/gen.ts": "", "src/logo.png": b"\x89\x00",
        "src/bad.ts": b"\xff\xfe\xfd", "src/d.ts": 'import "./bad";\nimport w from "./widget.kt";', "src/widget.kt": "x",
    }, {"dist/bundle.js": "always_skip", "src/gen.ts": "gitignore"}))
    assert edges(s) == [("src/a.ts", "src/b.ts"), ("src/c.ts", "src/logo.png"), ("src/d.ts", "src/widget.kt")]
    assert gaps(s) == [
        ("src/a.ts", "../../x", "excluded", "outside_root"), ("src/a.ts", "./ghost", "unresolved", "not_found"), ("src/c.ts", "../dist/bundle", "excluded", "skipped_directory"),
        ("src/c.ts", "./gen", "excluded", "gitignored"), ("src/d.ts", "./bad", "unresolved", "target_unreadable"),
    ]
    n = {r.id: r for r in s.nodes.collect()}
    assert n["src/a.ts"].external_deps == ["react"] and n["src/logo.png"].kind == "asset" and n["src/logo.png"].loc == 0 and n["src/widget.kt"].kind == "unread_source" and "src/bad.ts" not in n and n["src/a.ts"].loc == 5
    assert [(r.path) for r in s.failures.collect()] == ["src/bad.ts"]
    c = counters(s).where("level = 3").collect()[0]
    assert (c.specifiers_total, c.specifiers_internal, c.resolved, c.unresolved, c.excluded, c.external_specifiers) == (10, 9, 4, 2, 3, 1)
    assert abs(c.resolution_rate - 4 / 6) < 1e-12


def test_alias_and_workspace(spark):
    s = scan(tree(spark, {
        "tsconfig.json": '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["app/*"],}}}', "app/x.ts": "", "app/inner/tsconfig.json": "{}",
        "app/inner/y.ts": 'import x from "@app/x";\nimport q from "@app/none";\nimport p from "@scope/lib";\nimport d from "@scope/lib/deep";\nimport e from "@other/pkg/sub";',
        "package.json": '{"workspaces": ["packages/*"]}', "packages/lib/package.json": '{"name": "@scope/lib", "main": "./src/main.js"}', "packages/lib/src/main.ts": "", "packages/lib/deep.ts": "",
    }))
    y = "app/inner/y.ts"
    assert edges(s) == [(y, "app/x.ts"), (y, "packages/lib/deep.ts"), (y, "packages/lib/src/main.ts")]
    assert gaps(s) == [(y, "@app/none", "unresolved", "not_found")]
    assert {r.id: r.external_deps for r in s.nodes.collect()}[y] == ["@other/pkg"]


@pytest.mark.parametrize(
    ("files", "want"),
    [
        ({"pkg/a.py": "from . import b\nfrom .c import d\nimport os\nimport util", "pkg/__init__.py": "", "pkg/c.py": "", "src/util.py": ""}, [("pkg/a.py", "pkg/__init__.py"), ("pkg/a.py", "pkg/c.py"), ("pkg/a.py", "src/util.py")]),
        ({"go.mod": "module ex.org/m\n", "main.go": 'package m\nimport (\n "ex.org/m/lib"\n "fmt"\n)', "lib/a.go": "", "lib/b.go": ""}, [("main.go", "lib/a.go"), ("main.go", "lib/b.go")]),
        ({"Cargo.toml": '[package]\nname = "my-crate"\n', "src/main.rs": "mod x;\nuse crate::x::Y;\nuse my_crate::z;\nuse serde::Z;", "src/x/mod.rs": "use super::q;"}, [("src/main.rs", "src/x/mod.rs"), ("src/x/mod.rs", "src/main.rs")]),
        ({"src/a.c": '#include "a.h"\n#include "sys/x.h"\n#include <stdio.h>', "include/a.h": ""}, [("src/a.c", "include/a.h")]),
        ({"src/main/java/a/B.java": "import a.c.*;\nimport a.D;\nimport static a.D.f;\nimport java.util.List;", "src/main/java/a/D.java": "", "src/main/java/a/c/E.java": ""}, [("src/main/java/a/B.java", "src/main/java/a/D.java"), ("src/main/java/a/B.java", "src/main/java/a/c/E.java")]),
        ({"a.cs": "using N.X;\nnamespace N.Y { }", "b.cs": "namespace N.X;", "c.cs": "namespace N.X { }"}, [("a.cs", "b.cs"), ("a.cs", "c.cs")]),
        ({"lib/a.rb": 'require_relative "b"\nrequire "json"\nrequire "c"', "lib/b.rb": "", "lib/c.rb": ""}, [("lib/a.rb", "lib/b.rb"), ("lib/a.rb", "lib/c.rb")]),
        ({"composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/"}}}', "src/A.php": "<?php use App\\B\\C; use Other\\X; require_once 'h.php';", "src/B/C.php": "", "src/h.php": ""}, [("src/A.php", "src/B/C.php"), ("src/A.php", "src/h.php")]),
        ({"site/p.html": '<script src="/app.js"></script><a href="https://x.y">z</a><a href="q.html#s">q</a>', "site/public/app.js": "", "site/q.html": ""}, [("site/p.html", "site/public/app.js"), ("site/p.html", "site/q.html")]),
        ({"css/a.scss": '@use "b";\n@import "./c.css";\n/* @import "n"; */', "css/_b.scss": "", "css/c.css": ""}, [("css/a.scss", "css/_b.scss"), ("css/a.scss", "css/c.css")]),
        ({"bin/a.sh": 'source "$(dirname "$0")/lib.sh"\n. "$HOME/x.sh"', "bin/lib.sh": ""}, [("bin/a.sh", "bin/lib.sh")]),
        ({"c.vue": "<template/>\n<script setup>\nimport x from './x'\n</script>", "x.ts": "", "d.mdx": "import X from './x'\n\n```js\nimport n from './c.vue'\n```\n"}, [("c.vue", "x.ts"), ("d.mdx", "x.ts")]),
    ],
)
def test_languages(spark, files, want):
    assert edges(scan(tree(spark, files))) == want


def test_empty(spark):
    s = scan(spark.createDataFrame([], SCHEMA))
    assert s.nodes.count() == s.edges.count() == s.diagnostics.count() == 0


def test_front_ends(spark):
    from graphloom.functions.frontends import FrontEnd, FrontEnds, built_in

    all_ = built_in()
    assert all_.for_extension("TS").lang == "typescript" and all_.for_extension("kt") is None and len(all_.languages()) == 21 and "scss" in all_.extensions() and not all_.conflicts
    words = FrontEnd("words", ("txt", "TS"), lambda text: [(k + 1, w) for k, line in enumerate(text.splitlines()) for w in line.split()], lambda lang, raw, path, config: ([f"f:{raw}.txt"], "external", raw))
    other = FrontEnd("other", ("txt",), lambda text: [])
    ends = FrontEnds([words, other])
    assert ends.conflicts == [("txt", "other")] and ends.extensions() == ["ts", "txt"] and ends.languages() == ["other", "words"]
    s = scan(tree(spark, {"a.txt": "b c\nzod", "b.txt": "", "c.txt": "a", "d.py": "import os"}), ends=ends)
    assert edges(s) == [("a.txt", "b.txt"), ("a.txt", "c.txt"), ("c.txt", "a.txt")]
    n = {r.id: (r.kind, r.lang, r.external_deps) for r in s.nodes.collect()}
    assert n["a.txt"] == ("source", "words", ["zod"]) and n["d.py"][0] == "unread_source"
