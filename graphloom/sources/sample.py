"""A small tree of every language, with what a scan must find in it, written down by hand from the definitions.

``FILES`` holds the files of each project; ``FOUND`` says, per importing file, each
specifier in source order: its line, its raw text and its outcome, which is
``-> targets``, ``package name``, ``unresolved reason`` or ``excluded reason``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "project string, path string, content binary, bytes bigint, is_symlink boolean, excluded_by string"

#: files that a walk refuses, by rule
REFUSED = {("ts", "dist/bundle.js"): "always_skip", ("ts", "src/gen.ts"): "gitignore"}

FILES: dict[str | None, dict[str, str | bytes]] = {
    "ts": {
        "src/a.ts": 'import b from "./b";\nimport React from "react";\nimport g from "./ghost";\nimport again from "./b";\nimport type { T } from \'@scope/pkg/deep\';\nexport * from "../../outside/x";\n// import no from "./no";\nconst s = \'import no from "./no"\';\n',
        "src/b.ts": "", "src/c.ts": 'import d from "../dist/bundle";\nimport i from "./gen";\nimport l from "./logo.png";\nimport r from "./b?raw";\nimport j from "./old.js";\nimport f from "./folder";\n',
        "src/old.ts": "", "src/folder/index.tsx": "", "dist/bundle.js": "", "src/gen.ts": "", "src/logo.png": b"\x89\x00", "src/bad.ts": b"\xff\xfe\xfd", "src/d.ts": 'import "./bad";\nimport {\n  w,\n} from "./widget.kt";\nimport "./d";\n', "src/widget.kt": "x", "legacy.js": 'import x from "./gone";\n',
    },
    "alias": {
        "tsconfig.json": '{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["app/*"], "one": ["app/x.ts"],}}}', "app/x.ts": "", "app/inner/tsconfig.json": "{}",
        "app/inner/y.ts": 'import x from "@app/x";\nimport q from "@app/none";\nimport p from "@scope/lib";\nimport d from "@scope/lib/deep";\nimport e from "@other/pkg/sub";\nimport o from "one";\n',
        "package.json": '{"workspaces": ["packages/*"]}', "packages/lib/package.json": '{"name": "@scope/lib", "main": "./src/main.js"}', "packages/lib/src/main.ts": "", "packages/lib/deep.ts": "",
    },
    "components": {
        "c.vue": "<template/>\n<script setup>\nimport x from './x'\n</script>\n", "s.svelte": "<script>\n  import y from './gone'\n</script>\n<p>import z from './x'</p>\n", "a.astro": "---\nimport x from './x'\n---\n<div/>\n",
        "x.ts": "", "d.mdx": "import X from './x'\n\n```js\nimport n from './c.vue'\n```\n\ntext import m from './x'\n",
    },
    "go": {
        "go.mod": "module ex.org/m\n", "main.go": 'package m\n\nimport (\n\t"ex.org/m/lib"\n\tfmt "fmt"\n\t"ex.org/m/none"\n\t`ex.org/other/x`\n)\n', "lib/a.go": "package lib\n", "lib/b.go": "package lib\n", "lib/sub/c.go": "package sub\n",
    },
    "python": {
        "pkg/a.py": "from . import b\nfrom .c import d\nimport os\nimport util\nfrom .. import up\nfrom ...far import off\nimport pkg.c as c, json.tool\n", "pkg/__init__.py": "", "pkg/c.py": "", "src/util.py": "",
    },
    "rust": {
        "Cargo.toml": '[package]\nname = "my-crate"\n', "src/main.rs": "mod x;\nuse crate::x::Y;\nuse my_crate::z;\nuse serde::{Deserialize, de::{self, Visitor as V}};\nmod inline { }\nmod lost;\n", "src/x/mod.rs": "use super::q;\nuse self::deep::r;\n", "src/x/deep.rs": "",
    },
    "c": {
        "src/a.c": '#include "a.h"\n#include "sys/x.h"\n#include <stdio.h>\n/* #include "no.h" */\n#include "gone.h"\n', "include/a.h": "", "b.cpp": '#include "include/a.h"\n',
    },
    "java": {
        "src/main/java/a/B.java": "package a;\nimport a.c.*;\nimport a.D;\nimport static a.D.f;\nimport java.util.List;\n", "src/main/java/a/D.java": "package a;\n", "src/main/java/a/c/E.java": "package a.c;\n", "src/main/java/a/c/F.java": "package a.c;\n",
    },
    "csharp": {"a.cs": "using N.X;\nusing static System.Math;\nusing Alias = N.X;\nnamespace N.Y { }\n", "b.cs": "namespace N.X;\n", "c.cs": "namespace N.X { }\n"},
    "ruby": {"lib/a.rb": "require_relative \"b\"\nrequire 'json/ext'\nrequire \"c\"\nrequire_relative '../gone'\nputs \"require 'b'\"\n", "lib/b.rb": "", "lib/c.rb": ""},
    "php": {"composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/"}}}', "src/A.php": "<?php\nuse App\\B\\C;\nuse \\Other\\X;\nrequire_once 'h.php';\nuse App\\None;\n", "src/B/C.php": "<?php\n", "src/h.php": "<?php\n"},
    "html": {"site/p.html": '<script src="/app.js"></script>\n<a href="https://x.y">z</a>\n<a href="q.html#s">q</a>\n<img src="no.png">\n<link href="gone.css">\n', "site/public/app.js": "", "site/q.html": ""},
    "css": {"css/a.scss": '@use "b";\n@import "./c.css";\n/* @import "n"; */\n@import "lib/x";\n@import "./gone";\n@import url(d.css);\n', "css/_b.scss": "", "css/c.css": ""},
    "shell": {"bin/a.sh": '#!/bin/sh\nsource "$(dirname "$0")/lib.sh"\n. "$HOME/$x.sh"\n. ./gone.sh\n# . ./no.sh\n', "bin/lib.sh": ""},
    None: {"x.ts": 'import y from "./y";\n', "y.ts": ""},
}

FOUND: dict[str | None, dict[str, list[tuple[int, str, str]]]] = {
    "ts": {
        "src/a.ts": [(1, "./b", "-> src/b.ts"), (2, "react", "package react"), (3, "./ghost", "unresolved not_found"), (4, "./b", "-> src/b.ts"), (5, "@scope/pkg/deep", "package @scope/pkg"), (6, "../../outside/x", "excluded outside_root")],
        "src/c.ts": [(1, "../dist/bundle", "excluded skipped_directory"), (2, "./gen", "excluded gitignored"), (3, "./logo.png", "-> src/logo.png"), (4, "./b?raw", "-> src/b.ts"), (5, "./old.js", "-> src/old.ts"), (6, "./folder", "-> src/folder/index.tsx")],
        "src/d.ts": [(1, "./bad", "unresolved target_unreadable"), (4, "./widget.kt", "-> src/widget.kt"), (5, "./d", "-> src/d.ts")],
        "legacy.js": [(1, "./gone", "unresolved not_found")],
    },
    "alias": {"app/inner/y.ts": [(1, "@app/x", "-> app/x.ts"), (2, "@app/none", "unresolved not_found"), (3, "@scope/lib", "-> packages/lib/src/main.ts"), (4, "@scope/lib/deep", "-> packages/lib/deep.ts"), (5, "@other/pkg/sub", "package @other/pkg"), (6, "one", "-> app/x.ts")]},
    "components": {"c.vue": [(3, "./x", "-> x.ts")], "s.svelte": [(2, "./gone", "unresolved not_found")], "a.astro": [(2, "./x", "-> x.ts")], "d.mdx": [(1, "./x", "-> x.ts")]},
    "go": {"main.go": [(4, "ex.org/m/lib", "-> lib/a.go lib/b.go"), (5, "fmt", "package fmt"), (6, "ex.org/m/none", "unresolved not_found"), (7, "ex.org/other/x", "package ex.org/other/x")]},
    "python": {"pkg/a.py": [(1, ".", "-> pkg/__init__.py"), (2, ".c", "-> pkg/c.py"), (3, "os", "package os"), (4, "util", "-> src/util.py"), (5, "..", "unresolved not_found"), (6, "...far", "unresolved not_found"), (7, "pkg.c", "-> pkg/c.py"), (7, "json.tool", "package json")]},
    "rust": {
        "src/main.rs": [(1, "mod x", "-> src/x/mod.rs"), (2, "crate::x::Y", "-> src/x/mod.rs"), (3, "my_crate::z", "-> src/main.rs"), (4, "serde::Deserialize", "package serde"), (4, "serde::de", "package serde"), (4, "serde::de::Visitor", "package serde"), (6, "mod lost", "unresolved not_found")],
        "src/x/mod.rs": [(1, "super::q", "-> src/main.rs"), (2, "self::deep::r", "-> src/x/deep.rs")],
    },
    "c": {"src/a.c": [(1, "a.h", "-> include/a.h"), (2, "sys/x.h", "package sys"), (3, "<stdio.h", "package stdio.h"), (5, "gone.h", "unresolved not_found")], "b.cpp": [(1, "include/a.h", "-> include/a.h")]},
    "java": {"src/main/java/a/B.java": [(2, "a.c.*", "-> src/main/java/a/c/E.java src/main/java/a/c/F.java"), (3, "a.D", "-> src/main/java/a/D.java"), (4, "a.D.f", "-> src/main/java/a/D.java"), (5, "java.util.List", "package java.util")]},
    "csharp": {"a.cs": [(1, "N.X", "-> b.cs c.cs"), (2, "System.Math", "package System.Math"), (3, "N.X", "-> b.cs c.cs")]},
    "ruby": {"lib/a.rb": [(1, "./b", "-> lib/b.rb"), (2, "json/ext", "package json"), (3, "c", "-> lib/c.rb"), (4, "./../gone", "unresolved not_found")]},
    "php": {"src/A.php": [(2, "App\\B\\C", "-> src/B/C.php"), (3, "Other\\X", "package Other"), (4, "path:h.php", "-> src/h.php"), (5, "App\\None", "unresolved not_found")]},
    "html": {"site/p.html": [(1, "/app.js", "-> site/public/app.js"), (2, "https://x.y", "package https://x.y"), (3, "q.html#s", "-> site/q.html"), (5, "gone.css", "unresolved not_found")]},
    "css": {"css/a.scss": [(1, "b", "-> css/_b.scss"), (2, "./c.css", "-> css/c.css"), (4, "lib/x", "package lib"), (5, "./gone", "unresolved not_found")]},
    "shell": {"bin/a.sh": [(2, '$(dirname "$0")/lib.sh', "-> bin/lib.sh"), (3, "$HOME/$x.sh", "package $HOME/$x.sh"), (4, "./gone.sh", "unresolved not_found")]},
    None: {"x.ts": [(1, "./y", "-> y.ts")]},
}


def sample_tree(spark: SparkSession) -> DataFrame:
    rows = []
    for project, files in FILES.items():
        for path, text in files.items():
            content = text.encode() if isinstance(text, str) else text
            rows.append((project, path, content, len(content), False, REFUSED.get((project, path))))
    return spark.createDataFrame(rows, SCHEMA)


def found_rows() -> list[tuple]:
    """(project, path, ordinal, line, raw, outcome, detail, targets)."""
    out = []
    for project, files in FOUND.items():
        for path, specs in files.items():
            for k, (line, raw, outcome) in enumerate(specs):
                kind, rest = outcome.split(" ", 1)
                out.append((project, path, k, line, raw, kind, rest, rest.split() if kind == "->" else []))
    return out


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(_sql, v)) + "]::VARCHAR[]"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def found_sql() -> str:
    """The expected rows as a common table expression ``found``."""
    rows = ",\n".join("(" + ", ".join(map(_sql, r)) + ")" for r in found_rows())
    return f"found(project, path, ordinal, line, raw, outcome, detail, targets) AS (VALUES {rows})"


def files_sql() -> str:
    """The files as ``files(project, path, bytes, lines, refused)``."""
    rows = []
    for project, files in FILES.items():
        for path, text in files.items():
            content = text.encode() if isinstance(text, str) else text
            rows.append((project, path, len(content), len(content.splitlines()), REFUSED.get((project, path))))
    return "files(project, path, bytes, lines, refused) AS (VALUES " + ",\n".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + ")"
