"""Training-data operators against brute force, exact round trips and small cases."""

import ast
import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import abuse, packing, provenance, syntax, terms, tokens

NODES = "project string, id string, path string, lang string, kind string, loc bigint, bytes bigint, external_deps array<string>, scanned_at timestamp, loaded_at timestamp, name string, f string"
TREE = "project string, path string, content binary, bytes bigint, is_symlink boolean, excluded_by string"
CATALOGUE = [("py", "python"), ("ts", "typescript"), ("js", "javascript"), ("go", "go"), ("java", "java"), ("c", "c"), ("rs", "rust"), ("rb", "ruby"), ("sh", "shell"), ("css", "css")]


def node(project, id_, deps=None, day=1, lang=None):
    at = datetime.datetime(2025, 1, day) if day else None
    return (project, id_, id_, lang, "source", 1, 10, deps, at, at, "clash", "clash")


# --- terms ---------------------------------------------------------------------------------------------


def test_terms(spark):
    rows = [node("p", "a", [" Zod", "zod\t", None, "", "React"]), node("p", "a", [" Zod", "zod\t", None, "", "React"]), node("p", "a", ["old"], None), node("p", "b", None), node("p", "c", ["react", "\u00a0"]), node(None, "a", ["zod"])]
    got = {r.name: (r.occurrences, r.n_records, round(r.share, 3), r.is_rare, r.is_common) for r in terms.term_counts(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {"zod": (3, 2, 0.667, True, True), "react": (2, 2, 0.667, True, True)}
    assert terms.term_counts(spark.createDataFrame([], NODES)).count() == 0


def test_co_occurrence(spark):
    rng = random.Random(3)
    rows = [node("p", f"f{i}", rng.sample([f"n{k}" for k in range(30)], rng.randrange(0, 5)) + (["x", "y"] if i % 20 == 0 else []) + (["hot"] if rng.random() < 0.6 else [])) for i in range(300)]
    sets = [set(r[7]) for r in rows if r[7]]
    n = len(sets)
    k = {x: sum(x in s for s in sets) for s in sets for x in s}
    want = set()
    for a, b in itertools.combinations(sorted(k), 2):
        ab = sum(a in s and b in s for s in sets)
        if ab >= 5 and 2000 * ab >= n and ab * n >= 2 * k[a] * k[b]:
            want.add((a, b, k[a], k[b], ab))
    got = terms.co_occurrence(spark.createDataFrame(rows, NODES), min_lift=2.0, min_llr=None).collect()
    assert {(r.name_a, r.name_b, r.k_a, r.k_b, r.k_ab) for r in got} == want and ("x", "y") in {w[:2] for w in want}
    assert all(r.llr > 0 for r in got)
    sure = terms.co_occurrence(spark.createDataFrame(rows, NODES), min_lift=2.0).collect()
    assert {(r.name_a, r.name_b) for r in sure} == {(r.name_a, r.name_b) for r in got if r.llr >= terms.LLR_SIGNIFICANT}
    assert terms.co_occurrence(spark.createDataFrame([], NODES)).count() == 0


def test_every_pair(spark, tmp_path):
    from graphloom.llm.queries import p5_all_pairs

    rows = [node("p", f"f{i}", [f"n{i}", f"m{i}", "hot"] + (["x", "y"] if i % 10 == 0 else [])) for i in range(60)]
    spark.createDataFrame(rows, NODES).write.parquet(f"{tmp_path}/nodes.parquet")
    got = {(r.name_a, r.name_b): (r.k_a, r.k_b, r.k_ab, r.significant) for r in p5_all_pairs(spark, str(tmp_path)).collect()}
    sets = [set(r[7]) for r in rows]
    assert set(got) == {(a, b) for s in sets for a, b in itertools.combinations(sorted(s), 2)}
    assert got["x", "y"] == (6, 6, 6, True) and got["hot", "x"] == (60, 6, 6, False) and got["m1", "n1"] == (1, 1, 1, False)


# --- tokens and packing ----------------------------------------------------------------------------------

TEXTS = [None, "", " ", "Hello  world\n\nit's 12x", "don't\u00a0stop\u2028now", "日本語のテキスト。", "é\u0301 ñ 🙂🙃", "<|endoftext|> x", "a" * 5000, "word " * 20000, "\ufffd\x00\x1c\x85 tab\t\tend ", "Приве́т, мир"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "z", "z") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, word string")


def test_encoding(spark):
    enc = tokens.encoding(tokens.vocabulary_path())
    got = {r.doc_id: r.ids for r in tokens.encode(docs(spark)).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs(spark)).collect()} == {i: len(x) for i, x in got.items()}
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs(spark))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("packer", [50, 20_000])
def test_packing(spark, packer):
    rng = random.Random(2)
    sizes = [rng.choice([0, 3, 40, 99, 100, 101, 250, 1000]) if rng.random() < 0.5 else rng.randrange(1, 60) for _ in range(400)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(7, sizes[7]), (999, None)], "doc_id bigint, n_tokens bigint")
    out = packing.pack(df, capacity=100, max_docs=20, packer_items=packer).collect()
    by = {}
    for r in out:
        by.setdefault(r.container, []).append(r)
        assert r.n_tokens <= 100 and (r.n_tokens == sizes[r.doc_id] or sizes[r.doc_id] > 100) if r.doc_id != 999 else r.n_tokens == 0
    for rows in by.values():
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(len(rows))) and len(rows) <= 20
        assert all(r.start == sum(x.n_tokens for x in rows[:k]) for k, r in enumerate(rows)) and sum(r.n_tokens for r in rows) <= 100
    total = sum(sizes) + sizes[7]
    assert sum(r.n_tokens for r in out) == total and len({(r.doc_id, r.piece) for r in out}) >= 401
    assert len(by) <= -(-total // 100) * 1.04 + 4


def test_packing_constraints(spark):
    df = spark.createDataFrame([(i, 30) for i in range(40)] + [(99, 90)], "doc_id bigint, n_tokens bigint")
    out = packing.pack(df, capacity=100, max_docs=2, max_attention=2000.0).collect()
    by = {c: [r.n_tokens for r in out if r.container == c] for c in {r.container for r in out}}
    assert max(sum(n * n for n in own) for own in by.values() if len(own) > 1) <= 2000 and max(map(len, by.values())) == 2
    assert [90] in by.values() and len(out) == 41  # no text within the capacity is split
    assert packing.pack(df.limit(0)).count() == 0


def test_best_fit_is_exact():
    rng = random.Random(4)
    fit, bins = packing.VectorBestFit(50, 6, 1200.0), []
    for _ in range(600):
        size = rng.choice([0, 1, 3, 7, 12, 20, 33, 50])
        cost, best = size * size, None
        for k, (t, d, a) in enumerate(bins):
            if t >= size and d > 0 and a >= cost and a >= 0:
                n = fit.w[0] * (t - size) ** 2 + fit.w[1] * (d - 1) ** 2 + fit.w[2] * (a - cost) ** 2
                best = n if best is None else min(best, n)
        b = fit.put(size)
        if best is None:
            assert b == len(bins)
            bins.append([50, 6, 1200.0])
        else:
            t, d, a = bins[b]
            assert abs(fit.w[0] * (t - size) ** 2 + fit.w[1] * (d - 1) ** 2 + fit.w[2] * (a - cost) ** 2 - best) < 1e-12
        bins[b] = list(fit.left[b])


# --- syntax --------------------------------------------------------------------------------------------

VALID = {
    "a.py": "# <<<<<<< HEAD\nx = '''\n=======\n'''\n\nasync def f(a, *, b: int = 1) -> dict[str, int]:\n    try:\n        return {k: v async for k, v in a}\n    except (KeyError, OSError) as e:\n        raise X from e\nmatch = 1\nif x: pass\nelif y: z = [\n  1,\n]\n",
    "b.ts": "import type { A } from './a';\nexport abstract class B<T extends A = any> implements C {\n  private readonly m: Map<string, Array<Set<T>>> = new Map();\n  constructor(public x?: number) { super(); }\n  get v(): T | undefined { return this.m.get(`a${1 + {a: 1}.a}`)!; }\n}\nconst r = /[({]\\/\\/\"/g;\nexport const f = async (x: string): Promise<void> => {\n  for (const [a, b] of m) if (a) continue\n  switch (x) { case 'a': return; default: break }\n};\nexport * from './t'\ntype U = { k: 'a' } | { k: 'b'; n: number };\n",
    "c.js": "(function(e,t){\"use strict\";for(var o=0,u=[];o<e.length;o++)u.push(e[o]^3);return u})(this);\nexport default class extends A { static x = 1; async *g() { yield* h() } }\nif (a) b(); else c()\nconst { d, ...rest } = { ...e, f };\nlabel: for (;;) { break label }\n",
    "d.go": "package d\n\nimport (\n\t\"fmt\"\n\t_ \"a/b\"\n)\n\ntype T struct {\n\ts string `json:\"s\"`\n\tm map[string]int\n}\n\nfunc (t *T) F(a []int, b ...string) (int, error) {\n\tif n, ok := t.m[\"x\"]; ok {\n\t\treturn n, nil\n\t}\n\tfor _, v := range a {\n\t\tgo func() { ch <- v }()\n\t}\n\tvar u = `\n=======\n{{{`\n\treturn len(u), fmt.Errorf(\"%d\", 'x')\n}\n",
    "e.java": "package e.f;\nimport java.util.*;\n/** x { */\npublic class E<T extends Comparable<T>> implements I {\n    private final Map<String, List<Integer>> m = new HashMap<>();\n    @Override public <R> R g(int[] a, String... s) throws Exception {\n        for (int x : a) { if (x > '}') throw new E(\"{\"); }\n        Runnable r = () -> { }; return (R) s[0];\n    }\n}\n",
    "f.c": "#include <stdio.h>\n#define M(x) ((x) + \\\n  1)\nstruct s { int a; const char *k; };\nstatic int f(const int *p, size_t n)\n{\n    /* { */\n    for (size_t i = 0; i < n; i++) { if (!p || p[i] == '{') return -1; }\n    do { n >>= 1; } while (n > 0);\n    return sizeof(struct s) * (int) n;\n}\n",
    "g.rs": "/* a /* b */ { */\nuse std::{fmt, io::{self, Read}};\n#[derive(Debug, Clone)]\npub struct S<'a> { pub s: &'a str, v: Vec<Vec<u8>> }\nimpl<'a> S<'a> {\n    pub fn f(&self, x: &[u32]) -> Option<u32> {\n        let c = '{'; let r = r#\"\"{\"#;\n        match x.len() { 0 => None, n if n > 3 => Some(x[0] * 2), _ => x.iter().map(|v| v + 1).next() }\n    }\n}\n",
    "h.rb": "=begin\nend end\n=end\nclass A < B\n  attr_reader :x\n  def initialize(x = 1)\n    @x = x || { 'a' => 1, b: 2 }\n    return if x.nil?\n    x.each do |y|\n      puts \"#{y} if\" unless y > 1\n    end\n    while x > 1 do x -= 1 end\n  end\nend\n",
    "i.sh": "#!/bin/bash\nf() {\n  local x=\"$1\"\n  if [ -z \"$x\" ]; then echo \"no\" >&2; return 1; fi\n  case \"$1\" in\n    a|b) y=1 ;;\n    *) y=\"${2:-none}\" ;;\n  esac\n  for i in \"$@\"; do echo if then; done\n}\ncat <<'EOF'\nif then (\nEOF\n",
    "j.css": "}}} {", "k.py": "", "l.ts": "\n\n",
}
BROKEN = {
    "a.py": ["def f(:\n  pass\n", "x = 1\n=======\ny = 2\n", "class A:\n    def f(self):\n", "try:\n    x = 1\n", "x = 'abc\n", "#include <x.h>\nint f() { return 1; }\n", "2025-03-19 09:10 WARN x\n", "raise X from \n"],
    "b.ts": ["export class A {\n  x: number;\n", "const a = 1;\n<<<<<<< HEAD\nconst b = 2;\n", "def f(x):\n    return x\n", "interface A { b: string }\n>>>>>>> x\n", "<!DOCTYPE html>\n<html><body>It isn't</body></html>\n", "export function f(\n"],
    "c.js": ["interface X { a: string }\n", "function f(a: number) { return a }\n", "package main\nfunc f() int { return 1 }\n", "const x = `a\n", "import x fro\n", "f(1 2)\n"],
    "d.go": ["package d\nfunc f() {\n", "import * as x from 'y';\n", "package d\n=======\nvar x = 1\n", "package d\ntype T struct\n"],
    "e.java": ["public class A { int f() { return 1; }\n", "import a.b\n", "#include <x>\nint f() { return 1; }\n", "class A {\n<<<<<<< HEAD\n}\n"],
    "f.c": ["int f() { return 1;\n", "static int f(int x)\n", "function f(a) { return a === 1 }\n", "int x = 1;\n=======\n"],
    "g.rs": ["fn f() -> u32 { 1\n", "pub fn f(x: &str) -> String\n", "const a = 'x y';\n", "use a::b\n"],
    "h.rb": ["class A\n  def f\n  end\n", "def f(x):\n    return x\n", "x = 1\n=======\n"],
    "i.sh": ["f() {\n  echo 1\n", "if true; then echo 1\n", "echo \"a\n", "echo 1\n<<<<<<< HEAD\n", "case x in\n"],
}


def judge(spark, files):
    tree = spark.createDataFrame([("p", path, text.encode(), len(text), False, None) for path, text in files.items()] * 2, TREE)
    cat = spark.createDataFrame([(e, lang, "source", "analysed") for e, lang in CATALOGUE], "extension string, lang string, family string, status string")
    return {r.path: list(r.faults) for r in syntax.broken_files(tree, spark.createDataFrame([], NODES), cat).collect()}


def test_syntax(spark):
    for path, text in VALID.items():
        if path.endswith(".py"):
            ast.parse(text)
    files = dict(VALID)
    want = set()
    for path, texts in BROKEN.items():
        stem, ext = path.split(".")
        for k, t in enumerate(texts):
            files[f"bad/{stem}{k}.{ext}"] = t
            want.add(f"bad/{stem}{k}.{ext}")
    files["crlf.py"], files["bom.py"] = VALID["a.py"].replace("\n", "\r\n"), "\ufeffx = 1\n"
    deep = "(" * 60 + "1" + ")" * 60
    files["deep.js"], files["bad/deep.js"] = f"x = {deep};\n", f"x = ({deep};\n"
    want.add("bad/deep.js")
    got = judge(spark, files)
    assert set(got) - want == set(), {k: got[k] for k in set(got) - want}
    assert want - set(got) == set(), {k: files[k] for k in want - set(got)}


def test_syntax_languages(spark):
    tree = spark.createDataFrame([("p", "x.h2", b"{", 1, False, None), ("p", "a.js", b"interface A { b: c }", 1, False, None), ("p", "b.js", None, 1, False, None), ("p", "c.js", b"(", 1, False, "gitignore"), (None, "d.py", b"caf\xe9 = 1", 1, False, None), ("p", None, b"(", 1, False, None)], TREE)
    cat = spark.createDataFrame([(e, lang, "source", "analysed") for e, lang in CATALOGUE], "extension string, lang string, family string, status string")
    nodes = spark.createDataFrame([node("p", "a.js", lang="typescript", day=2), node("p", "a.js", lang="javascript")], NODES)
    assert syntax.broken_files(tree, nodes, cat).count() == 0
    rates = {(r.project, r.lang): r.files for r in syntax.broken_rates(tree, nodes, cat, spark.createDataFrame([], "project string, path string, reason string")).collect()}
    assert rates == {("p", "typescript"): 1, (None, "python"): 1}


# --- provenance ------------------------------------------------------------------------------------------


def test_provenance(spark):
    hand = "def f{0}(a):\n    # adds\n    return a + {0}\n\n\nclass K{0}:\n    x = {0}\n"
    lib = "".join(f"export function g{i}(a) {{ return a * {i} + 1; }}\n" for i in range(20))
    files = {
        ("p", "src/a.py"): "# Do not edit without asking the core team.\n" + hand.format(1), ("p", "src/b.py"): hand.format(2), ("p", "src/c.py"): "# First generated by a scaffold, maintained by hand since.\n" + hand.format(3),
        ("p", "gen/x_pb2.py"): "# Code generated by tool v1.2. DO NOT EDIT.\n" + hand.format(4), ("p", "gen/y_pb2.py"): hand.format(5), ("p", "src/d.py"): "MARK = 'AUTO-GENERATED FILE - DO NOT EDIT'\n" + hand.format(6),
        ("p", "lib/one.js"): "/*! one v1.2 | (c) one contributors | MIT */\n" + lib, ("q", "src/util/one.js"): lib, ("p", "web/m.js"): "(function(e,t){" + "var a=e[0]||t.x;for(var o=0;o<a.l;o++)t.p(a[o]);" * 20 + "})(this);",
        ("p", "src/t.py"): "T = [" + ",\n".join(str(i * 7919 % 1000) for i in range(300)) + "]\n", ("p", "src/__init__.py"): "", ("q", "src/__init__.py"): "",
    }
    tree = spark.createDataFrame([(p, f, t.encode(), len(t), False, None) for (p, f), t in files.items()] * 2, TREE)
    nodes = spark.createDataFrame([node(p, f) for p, f in files] + [node("q", "gone.py")], NODES)
    got = {(r.project, r.path): r.label for r in provenance.provenance(nodes, tree).collect()}
    want = {k: "handwritten" for k in files} | {("q", "gone.py"): "handwritten", ("p", "gen/x_pb2.py"): "generated", ("p", "gen/y_pb2.py"): "generated", ("p", "lib/one.js"): "vendored", ("q", "src/util/one.js"): "vendored", ("p", "web/m.js"): "minified", ("p", "src/t.py"): "blob"}
    assert got == want
    assert provenance.provenance(spark.createDataFrame([], NODES), spark.createDataFrame([], TREE)).count() == 0


def test_banners_behind_code_and_long_headers(spark):
    code, licence = "x = 1\n\n\ndef f(a):\n    return a + x\n", "".join(f"# licence line {i}\n" for i in range(40))
    c = "int f(int a)\n{\n    return a;\n}\n"
    texts = {
        "end.py": code + "\n# @generated by relic-schema 6.8.4\n", "below.py": licence + "\n# Code generated by tool v1.2. DO NOT EDIT.\n" + code, "block.c": c + "/*\n * machine generated, see ulnor.grammar\n */\n",
        "guard.h": "#ifndef A\n" + c + "// Automatisch erzeugt aus a.xsd - nicht von Hand bearbeiten.\n#endif\n", "lib.js": code + "// copied from one v1.2\n",
        "mark.py": code + "xBanner = 'Code generated by tool v1.2. DO NOT EDIT.'\n", "text.py": code + 'T = """\n# Code generated by tool v1.2. DO NOT EDIT.\n"""\n', "define.c": '#define B "Code generated by tool v1.2. DO NOT EDIT."\n' + c, "kept.py": code + "# @generated once, maintained by hand since\n", "amid.py": code + "# maintained by hand\n" + code,
    }
    got = {r.path: (r.banner, r.vendor, r.hand, r.by_hand) for r in provenance.features(spark.createDataFrame([("p", f, t.encode(), len(t), False, None) for f, t in texts.items()], TREE)).collect()}
    no = (False, False, False, False)
    assert got == {f: (True, *no[1:]) for f in ("end.py", "below.py", "block.c", "guard.h")} | {f: no for f in ("mark.py", "text.py", "define.c")} | {"lib.js": (False, True, False, False), "kept.py": (True, False, True, True), "amid.py": (False, False, False, True)}


def test_beliefs_are_exact(spark):
    """The messages give the same marginals as the sum over all labellings."""
    import numpy as np

    rng = np.random.default_rng(4)
    paths = ["a/f", "a/g", "a/b/h"]
    ev = rng.normal(0, 2, (3, 5))
    df = spark.createDataFrame([("p", p, p.rsplit("/", 1)[0], *map(float, e)) for p, e in zip(paths, ev, strict=True)], "project string, path string, dir string, e0 double, e1 double, e2 double, e3 double, e4 double")
    got = {r.path: r.p_hand for r in provenance.beliefs(df).collect()}
    fd, dd, root = np.array(provenance.FILE_IN_DIR), np.array(provenance.DIR_IN_DIR), np.exp(np.array(provenance.ROOT_PRIOR))
    mass = {p: np.zeros(5) for p in paths}
    for r, a, b, f, g, h in itertools.product(range(5), repeat=6):
        w = root[r] * dd[r, a] * dd[a, b] * fd[a, f] * fd[a, g] * fd[b, h] * np.exp(ev[0, f] + ev[1, g] + ev[2, h])
        for p, x in zip(paths, (f, g, h), strict=True):
            mass[p][x] += w
    assert all(abs(got[p] - mass[p][0] / mass[p].sum()) < 1e-9 for p in paths)


# --- abuse -----------------------------------------------------------------------------------------------


def test_disguises():
    plain = {"You i.d.i.o.t": "you idiot", "s-t-u-p-i-d": "stupid", "st\u200bupid": "stupid", "iiidiot": "idiot", "1d10t": "idiot", "\u0456di\u043et": "idiot", "t r u s t me": "trust me", "i. d. i. o. t": "idiot", "\u0441\u0443\u043aa": "\u0441\u0443\u043a\u0430", "shut  up": "shut up"}
    assert {k: abuse.word_codes(k) for k in plain} == {k: abuse.word_codes(v) for k, v in plain.items()}
    assert abuse.word_codes("3 kettles for 50.\n\u7f8e\u7f8e\u3002") == abuse.word_codes("ketles for. \n\u7f8e\u3002") and not any(abuse.word_codes("12 \n ."))
    assert abuse.word_codes("i***t") == [abuse._code("i***t"), abuse._MASKED]


def test_hidden_cues():
    known = abuse.seed_cues()
    g = abuse._grams(np.array(abuse.word_codes("such an idiot here. a quiet day")), np.zeros(8, int)[:8], known)
    assert g.n == 2 and set(g.of[g.told]) == {0} and set(g.of[~g.told]) == {0, 1} and g.cues.any()
    x = abuse._Rows(g, np.ones(1 << abuse.BITS))
    assert x.cues[0].tolist() == [0, 0, 0, 1] and not x.cues[1].any() and x.withheld().cues.shape[1] == 0 and x.other.sum() == (~g.told).sum()


def test_abuse_learns(spark):
    rng = random.Random(1)
    nice = [f"The {a} {n} opens near the {m}." for a in ("quiet", "green", "old") for n in ("bridge", "market", "museum") for m in ("river", "harbour", "valley")]
    rude = ["Somewhere a tree works hard to replace your air.", "shut up you idiot", "alle fremden sind ungeziefer", "Nobody would notice if you vanished forever."]
    texts = [" ".join(rng.sample(nice, 4)) + (" " + rude[i % 4] if i % 3 == 0 else " Our rules forbid calling members an idiot." if i % 7 == 1 else "") for i in range(240)]
    d = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, "123")], "doc_id bigint, text string")
    votes = [(i, r, int(i % 3 == 0) if rng.random() > 0.05 else None) for i in range(160) for r in ("r1", "r1", "r2")]
    labels = spark.createDataFrame(votes, "doc_id bigint, rater string, abusive int")
    found = {r.doc_id for r in abuse.abusive_documents(d, labels).collect()}
    held = range(160, 240)
    true = {i for i in held if i % 3 == 0}
    hit = {i for i in found if i in held}
    assert len(hit & true) >= 0.9 * len(true) and len(hit - true) <= 0.1 * len(true) and not found & {900, 901, 902}
    rates = abuse.abuse_rates(d.withColumn("source", F.lit(None).cast("string")), labels).collect()
    assert len(rates) == 1 and rates[0].documents == 243


def test_abuse_without_labels(spark):
    d = spark.createDataFrame([(1, "shut up you idiot"), (2, "a quiet day")], "doc_id bigint, text string")
    empty = spark.createDataFrame([], "doc_id bigint, rater string, abusive int")
    assert [r.doc_id for r in abuse.abusive_documents(d, empty).collect()] == [1]
    assert abuse.abusive_documents(d.limit(0), empty).count() == 0
