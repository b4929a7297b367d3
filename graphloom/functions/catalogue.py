"""What an extension or file name stands for, which extensions are read, what a walk never enters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import base_name, extension

# --- fixed values -------------------------------------------------------------------------------------
ALWAYS_SKIP = """node_modules bower_components .yarn .pnpm-store target dist build out .next .nuxt .svelte-kit .turbo .output .parcel-cache bazel-out cmake-build-debug
cmake-build-release __pycache__ .venv venv .tox .mypy_cache .pytest_cache .ruff_cache .gradle .dart_tool .bundle Pods Carthage DerivedData .git .hg .svn vendor coverage .terraform""".split()

SOURCE = """
TypeScript: ts tsx mts cts
JavaScript: js jsx mjs cjs
Vue: vue
Svelte: svelte
Astro: astro
MDX: mdx
ERB: erb rhtml
Erubis: erubis
Haml: haml
Hamlit: hamlit
Slim: slim
Liquid: liquid
Mustache: mustache
Handlebars: hbs handlebars
EJS: ejs
Pug: pug jade
Twig: twig
Jinja: jinja jinja2 j2
Nunjucks: njk
Template: tmpl tpl
HTML: html htm xhtml
CSS: css
Sass: scss sass
Less: less
Stylus: styl
Go: go
Rust: rs
C: c
C or C++ header: h
C++: cc cpp cxx c++ hh hpp hxx ipp inl
Zig: zig
Nim: nim
D: d
Crystal: cr
V or Verilog: v
SystemVerilog: sv svh
VHDL: vhd vhdl
Assembly: asm s
Java: java
Kotlin: kt kts
Scala: scala sc
Groovy: groovy gradle
Clojure: clj cljs cljc
C#: cs
Visual Basic: vb
F#: fs fsx
Python: py pyi pyw
Ruby: rb rake gemspec
PHP: php
Perl: pl pm
Lua: lua
Tcl: tcl
AWK: awk
Shell: sh bash zsh ksh
Fish shell: fish
PowerShell: ps1 psm1
Batch: bat cmd
Vimscript: vim
Emacs Lisp: el
Swift: swift
Objective-C: m
Objective-C++: mm
Dart: dart
Haskell: hs lhs
Elixir: ex exs
Erlang: erl hrl
OCaml: ml mli
Racket: rkt
Scheme: scm ss
Common Lisp: lisp cl
Julia: jl
R: r
SQL: sql
GraphQL: graphql gql
Protocol Buffers: proto
Terraform: tf tfvars
HCL: hcl
Nix: nix
CMake: cmake
Make: mk
Solidity: sol
WebAssembly text: wat
Fortran: f90 f95 for
Pascal: pas
Ada: ada adb ads
COBOL: cob cbl
Arduino: ino
M4: m4
Automake: am
Autoconf: ac
"""

NOT_SOURCE = """
data: json jsonc json5 yaml yml toml xml csv tsv
configuration: ini cfg conf env properties editorconfig
lockfile: lock sum
documentation: md markdown rst adoc txt tex pdf license
image: svg png jpg jpeg gif webp avif ico bmp tiff psd
media: mp3 mp4 wav mov webm ogg
font: woff woff2 ttf otf eot
archive: zip tar gz bz2 xz 7z rar
binary: so dylib dll a lib o obj exe bin wasm class jar pyc pyo
database: db sqlite sqlite3
build output: map
test snapshot: snap
log: log
patch: patch diff
"""

SOURCE_NAMES = """
Make: Makefile makefile GNUmakefile
Dockerfile: Dockerfile Containerfile
Ruby: Rakefile Gemfile Podfile Brewfile Vagrantfile
Just: Justfile justfile
"""
NOT_SOURCE_NAMES = """
documentation: LICENSE LICENCE NOTICE
configuration: CODEOWNERS
"""

#: label: extensions that an extractor reads, in claiming order
READ = """
typescript: ts tsx mts cts
javascript: js jsx mjs cjs
vue: vue
svelte: svelte
astro: astro
mdx: mdx
go: go
python: py pyi
rust: rs
c: c h
cpp: cc cpp cxx hh hpp hxx ipp inl
java: java
csharp: cs
ruby: rb rake gemspec
php: php
html: html htm xhtml
css: css
sass: scss sass
less: less
stylus: styl
shell: sh bash zsh ksh
"""

MANIFESTS = """
node: package.json deno.json
rust: Cargo.toml
go: go.mod
python: pyproject.toml setup.py setup.cfg requirements.txt Pipfile
jvm: pom.xml build.gradle build.gradle.kts settings.gradle build.sbt
php: composer.json
ruby: Gemfile
elixir: mix.exs
dart: pubspec.yaml
swift: Package.swift
cmake: CMakeLists.txt
make: Makefile
"""
MANIFEST_EXTENSIONS = """
dotnet: csproj fsproj sln
ruby: gemspec
"""
# --- end of fixed values --------------------------------------------------------------------------------


def entries(text: str) -> dict[str, str]:
    """{word: label} of lines ``label: word word``; the first label of a word stays."""
    out: dict[str, str] = {}
    for line in text.strip().splitlines():
        label, words = line.split(": ", 1)
        for w in words.split():
            out.setdefault(w, label)
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    """(key, by_name, family, lang, status): the dimension of extensions and of telling file names."""
    read, rows = entries(READ), []
    for by_name, source, other in ((False, SOURCE, NOT_SOURCE), (True, SOURCE_NAMES, NOT_SOURCE_NAMES)):
        for k, family in entries(source).items():
            lang = None if by_name else read.get(k)
            rows.append((k, by_name, family, lang, "analysed" if lang else "unsupported_language"))
        rows += [(k, by_name, family, None, "not_source") for k, family in entries(other).items()]
    return spark.createDataFrame(rows, "key string, by_name boolean, family string, lang string, status string")


def classify_files(files: DataFrame) -> DataFrame:
    """``files`` (project, path, ...) with extension, family, lang and status.

    The extension decides; files without one go by their exact name; anything
    else is ``not_source`` with a null family.
    """
    cat = F.broadcast(catalogue(files.sparkSession))  # some 250 fixed rows
    ext = extension(F.col("path"))
    keyed = files.withColumns({"extension": ext, "_by_name": ext == "", "_key": F.when(ext == "", base_name(F.col("path"))).otherwise(ext)})
    j = keyed.join(cat, (F.col("_key") == F.col("key")) & (F.col("_by_name") == F.col("by_name")), "left")
    return j.withColumn("status", F.coalesce("status", F.lit("not_source"))).drop("_key", "_by_name", "key", "by_name")


def in_skipped_directory(path):
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in ALWAYS_SKIP]))
