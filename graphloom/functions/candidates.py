"""Ordered candidate keys of a specifier, without looking at the disk.

A key names what a file may be found by: ``f:`` its path, ``j:`` / ``jp:`` its Java
name / package, ``ns:`` a declared C# namespace, ``gd:`` the folder of Go files, ``dn:``
a folder name (which makes a miss unresolved instead of external). The first key
in order that exists decides; a miss falls back to ``(tag, package)``.
"""

from __future__ import annotations

import json
import re

# --- fixed values: what is tried for a path ---------------------------------------------------------------
TS_EXT = ["ts", "tsx", "js", "jsx", "mts", "cts", "d.ts"]
TS_INDEX = ["index.ts", "index.tsx", "index.js", "index.jsx"]
C_ROOTS = ["include", "inc", "src", "lib"]
PY_ROOTS = ["src", "lib", "app"]
RB_ROOTS = ["lib", "app", ""]
PUBLIC = ["public", "static", "assets", "www"]
CSS_EXT = ["scss", "sass", "less", "styl", "css"]
REMOTE = ("http:", "https:", "//", "mailto:", "tel:", "data:", "javascript:", "#", "ftp:", "blob:")
# --- end of fixed values ----------------------------------------------------------------------------------


def norm(path: str) -> str | None:
    """Lexical collapse; None where the path leaves the root."""
    out: list[str] = []
    for p in path.split("/"):
        if p in ("", "."):
            continue
        if p == "..":
            if not out:
                return None
            out.pop()
        else:
            out.append(p)
    return "/".join(out)


def join(*parts: str) -> str:
    return "/".join(p for p in parts if p)


def folder(path: str) -> str:
    return path.rsplit("/", 1)[0] if "/" in path else ""


def above(d: str) -> list[str]:
    """The folder and those above it, deepest first, the root last."""
    out = [d] if d else []
    while "/" in d:
        d = d.rsplit("/", 1)[0]
        out.append(d)
    return [*out, ""]


def _keys(paths) -> list[str]:
    return ["f:" + p for p in dict.fromkeys(x for x in paths if x)]


def probe_ts(base: str) -> list[str]:
    out = [base]
    stem, dot, ext = base.rpartition(".")
    if dot and ext in ("js", "jsx", "mjs", "cjs"):
        out += [f"{stem}.{e}" for e in TS_EXT]
    return [*out, *[f"{base}.{e}" for e in TS_EXT], *[join(base, i) for i in TS_INDEX]]


def probe(base: str, exts: list[str], indexes: list[str] = []) -> list[str]:  # noqa: B006
    return [base, *[f"{base}.{e}" for e in exts], *[join(base, i) for i in indexes]]


def package_of(raw: str) -> str:
    parts = raw.split("/")
    return "/".join(parts[:2]) if raw.startswith("@") and len(parts) > 1 else parts[0]


OUTSIDE = "outside_root"


def javascript(raw: str, path: str, config: dict):
    m = re.match(r"#?[^?#]*", raw)
    raw = m[0]
    if raw.startswith("."):
        base = norm(join(folder(path), raw))
        return (None, OUTSIDE, None) if base is None else (_keys(probe_ts(base)), "unresolved", None)
    here = folder(path)
    scopes = [s for s in config.get("ts", []) if s["dir"] == "" or here == s["dir"] or here.startswith(s["dir"] + "/")]
    if scopes:
        keys, matched = [], False
        for pattern, targets in sorted(max(scopes, key=lambda s: len(s["dir"]))["paths"].items()):
            if "*" in pattern:
                pre, post = pattern.split("*", 1)
                if not (raw.startswith(pre) and raw.endswith(post) and len(raw) >= len(pre) + len(post)):
                    continue
                star = raw[len(pre) : len(raw) - len(post)]
            elif raw == pattern:
                star = ""
            else:
                continue
            matched = True
            for t in targets:
                base = norm(t.replace("*", star))
                if base is not None:
                    keys += _keys(probe_ts(base))
        if matched:
            return keys, "unresolved", None
    for p in sorted(config.get("packages", []), key=lambda p: p["name"]):
        if raw == p["name"]:
            return _keys(x for e in p["entries"] for x in probe_ts(join(p["dir"], e))), "unresolved", None
        if raw.startswith(p["name"] + "/"):
            base = norm(join(p["dir"], raw[len(p["name"]) + 1 :]))
            return (_keys(probe_ts(base)) if base and (not p["dir"] or base.startswith(p["dir"] + "/")) else []), "unresolved", None
    return [], "external", package_of(raw)


def python(raw: str, path: str, config: dict):
    dots = len(raw) - len(raw.lstrip("."))
    rest = raw[dots:].replace(".", "/")
    tried = lambda base: probe(base, ["py", "pyi"], ["__init__.py", "__init__.pyi"])[1:]
    if dots:
        up = above(folder(path))
        if dots > len(up):
            return [], "unresolved", None
        return _keys(tried(join(up[dots - 1], rest))), "unresolved", None
    roots = [*above(folder(path))[:-1], *PY_ROOTS, ""]
    return _keys(x for r in roots for x in tried(join(r, rest))), "external", raw.split(".")[0]


def c_like(raw: str, path: str, config: dict):
    if raw.startswith("<"):
        return [], "external", raw[1:]
    roots = [*above(folder(path))[:-1], *C_ROOTS, ""]
    keys = _keys(norm(join(r, raw)) for r in roots)
    first = raw.split("/")[0]
    if "/" in raw and first not in (".", ".."):
        return [*keys, "dn:" + first], "external", first
    return keys, "unresolved", None


def java(raw: str, path: str, config: dict):
    if raw.endswith(".*"):
        base = raw[:-2]
        return ["jp:" + base, "j:" + base], "external", base
    pkg = raw.rpartition(".")[0] or raw
    return ["j:" + raw, "j:" + pkg], "external", pkg


def csharp(raw: str, path: str, config: dict):
    return ["ns:" + raw], "external", raw


def go(raw: str, path: str, config: dict):
    here = folder(path)
    mods = sorted(config.get("go", []), key=lambda m: (not (m["dir"] == "" or (here + "/").startswith(m["dir"] + "/")), -len(m["dir"])))
    for m in mods:
        if raw == m["module"] or raw.startswith(m["module"] + "/"):
            return ["gd:" + join(m["dir"], raw[len(m["module"]) + 1 :])], "unresolved", None
    return [], "external", raw


def rust(raw: str, path: str, config: dict):
    here, name = folder(path), path.rsplit("/", 1)[-1]
    if raw.startswith("mod "):
        base = here if name in ("lib.rs", "main.rs", "mod.rs") else join(here, name[:-3])
        m = raw[4:]
        return _keys([join(base, m + ".rs"), join(base, m, "mod.rs")]), "unresolved", None
    crates = config.get("rust", [])
    parts = [p for p in raw.split("::") if p]
    own = max((c for c in crates if (here + "/").startswith(c["src"] + "/")), key=lambda c: len(c["src"]), default=None)
    if own is None or not parts:
        return [], "external", parts[0] if parts else raw
    local = path[len(own["src"]) + 1 :]
    module = [] if local in ("lib.rs", "main.rs", "mod.rs") else local[:-7].split("/") if local.endswith("/mod.rs") else local[:-3].split("/")
    src, first = own["src"], parts[0]
    if first in ("crate", "$crate") or first == own["name"]:
        inside = parts[1:]
    elif first == "self":
        inside = module + parts[1:]
    elif first == "super":
        inside = module[:-1] + parts[1:]
    else:
        sibling = next((c for c in crates if c["name"] == first), None)
        if sibling is None:
            return [], "external", first
        src, inside = sibling["src"], parts[1:]
    paths = []
    for k in range(len(inside), 0, -1):
        base = join(src, *inside[:k])
        paths += [base + ".rs", join(base, "mod.rs")]
    return _keys([*paths, *[join(src, r) for r in ("main.rs", "lib.rs", "mod.rs")]]), "unresolved", None


def ruby(raw: str, path: str, config: dict):
    if raw.startswith("./") or raw.startswith("../"):
        base = norm(join(folder(path), raw[2:] if raw.startswith("./") else raw))
        return (None, OUTSIDE, None) if base is None else (_keys(probe(base, ["rb"])), "unresolved", None)
    return _keys(x for r in RB_ROOTS for x in probe(join(r, raw), ["rb"])), "external", raw.split("/")[0]


def php(raw: str, path: str, config: dict):
    if raw.startswith("path:"):
        base = norm(join(folder(path), raw[5:].lstrip("/")))
        return (None, OUTSIDE, None) if base is None else (_keys(probe(base, ["php"])), "unresolved", None)
    for p in sorted(config.get("psr4", []), key=lambda p: -len(p["prefix"])):
        if raw.startswith(p["prefix"]):
            return _keys([norm(join(p["dir"], raw[len(p["prefix"]) :].replace("\\", "/")) + ".php")]), "unresolved", None
    return [], "external", raw.split("\\")[0]


def html(raw: str, path: str, config: dict):
    if raw.lower().startswith(REMOTE):
        return [], "external", raw
    cut = re.match(r"[^?#]*", raw)[0]
    here = folder(path)
    if cut.startswith("/"):
        rest = cut.strip("/")
        roots = [r for d in (here, "") for r in (d, *[join(d, p) for p in PUBLIC])]
        tried = [norm(join(r, rest)) or "" for r in roots]
    else:
        base = norm(join(here, cut))
        if base is None:
            return None, OUTSIDE, None
        tried = [base]
    return _keys(x for b in tried for x in (b, join(b, "index.html"))), "unresolved", None


def css(raw: str, path: str, config: dict):
    if raw.lower().startswith(REMOTE) or raw.startswith("~"):
        return [], "external", raw
    base = norm(join(folder(path), raw))
    if base is None:
        return [], "unresolved", None
    partial = join(folder(base), "_" + base.rsplit("/", 1)[-1])
    keys = _keys([*probe(base, CSS_EXT, ["index.scss", "index.css"]), *probe(partial, CSS_EXT)])
    return (keys, "unresolved", None) if raw.startswith(".") else (keys, "external", raw.split("/")[0])


def shell(raw: str, path: str, config: dict):
    for mark in (")/", "}/"):
        if mark in raw:
            raw = raw.rsplit(mark, 1)[1]
            break
    if any(c in raw for c in "$*`"):
        return [], "external", raw
    return _keys(norm(join(r, raw)) for r in (folder(path), "")), "unresolved", None


RESOLVERS = {
    "typescript": javascript, "javascript": javascript, "vue": javascript, "svelte": javascript, "astro": javascript, "mdx": javascript, "python": python, "c": c_like, "cpp": c_like, "java": java,
    "csharp": csharp, "go": go, "rust": rust, "ruby": ruby, "php": php, "html": html, "css": css, "sass": css, "less": css, "stylus": css, "shell": shell,
}


def candidates(lang: str, raw: str, path: str, config: dict):
    f = RESOLVERS.get(lang)
    return f(raw, path, config) if f else ([], "external", raw)


# --- configuration files of a project --------------------------------------------------------------------


def jsonc(text: str):
    """JSON with comments and trailing commas."""
    out = re.sub(r'("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or " ", text.lstrip("﻿"))
    return json.loads(re.sub(r'("(?:[^"\\\n]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], out))


def _tsconfig(path: str, texts: dict[str, str], skipped: dict[str, str], depth: int = 0) -> dict[str, list[str]]:
    """Own and inherited mappings as root-relative targets; the child's pattern wins."""
    try:
        c = jsonc(texts[path])
        o = c.get("compilerOptions") or {}
        ext = c.get("extends")
        if not isinstance(c, dict) or not isinstance(ext, (str, type(None))) or not isinstance(o.get("paths") or {}, dict):
            raise ValueError("unexpected shape")
    except (ValueError, AttributeError) as e:
        skipped[path] = str(e)
        return {}
    base = join(folder(path), o.get("baseUrl") or "")
    out = {k: [join(base, t) for t in v] for k, v in (o.get("paths") or {}).items()}
    if ext and ext.startswith(".") and depth < 16:
        parent = norm(join(folder(path), ext))
        if parent in texts:
            out = _tsconfig(parent, texts, skipped, depth + 1) | out
    return out


def _entries(p: dict) -> list[str]:
    """Where a package may begin, in order of preference."""
    e = p.get("exports")
    dot = e.get(".") if isinstance(e, dict) else None
    found = [dot.get("types") if isinstance(dot, dict) else None, p.get("types"), p.get("typings"), e if isinstance(e, str) else None, dot if isinstance(dot, str) else None]
    found += [dot.get(k) for k in ("import", "default")] if isinstance(dot, dict) else []
    return [norm(x) or "" for x in [*found, p.get("main"), "."] if isinstance(x, str)]


def project_config(texts: dict[str, str]) -> dict:
    """Side indexes of one project out of its configuration files {path: text}."""
    out: dict = {"ts": [], "packages": [], "go": [], "rust": [], "psr4": [], "skipped": {}}
    by_dir: dict[str, list[str]] = {}
    for path in sorted(texts):
        name = path.rsplit("/", 1)[-1]
        if re.fullmatch(r"tsconfig.*\.json", name):
            by_dir.setdefault(folder(path), []).append(path)
        elif name == "go.mod":
            m = re.search(r"(?m)^\s*module\s+\"?([^\s\"]+)", texts[path])
            if m:
                out["go"].append({"dir": folder(path), "module": m[1]})
        elif name == "Cargo.toml":
            m = re.search(r"(?ms)^\[package\](.*?)(?=^\[|\Z)", texts[path])
            n = re.search(r'(?m)^\s*name\s*=\s*"([^"]+)"', m[1]) if m else None
            if n:
                out["rust"].append({"src": join(folder(path), "src"), "name": n[1].replace("-", "_")})
        elif name == "composer.json":
            try:
                c = json.loads(texts[path])
                for section in ("autoload", "autoload-dev"):
                    for prefix, dirs in ((c.get(section) or {}).get("psr-4") or {}).items():
                        out["psr4"] += [{"prefix": prefix, "dir": norm(join(folder(path), d)) or ""} for d in ([dirs] if isinstance(dirs, str) else dirs)]
            except (ValueError, AttributeError):
                pass
    for d, paths in by_dir.items():
        chosen = join(d, "tsconfig.json") if join(d, "tsconfig.json") in paths else paths[0]
        for p in paths:
            mapped = _tsconfig(p, texts, out["skipped"])
            if p == chosen and mapped:
                out["ts"].append({"dir": d, "paths": mapped})
    try:
        root = json.loads(texts.get("package.json", "{}"))
        globs = root.get("workspaces") or []
        globs = globs.get("packages") or [] if isinstance(globs, dict) else globs
    except (ValueError, AttributeError):
        globs = []
    pats = [re.compile("/".join(re.escape(s).replace(r"\*", "[^/]*", 1) for s in (norm(g) or "").split("/")) + r"\Z") for g in globs if isinstance(g, str) and not g.startswith("!")]
    for path in sorted(texts):
        if path.endswith("/package.json") and any(p.match(folder(path)) for p in pats):
            try:
                p = json.loads(texts[path])
                if p.get("name"):
                    out["packages"].append({"name": p["name"], "dir": folder(path), "entries": _entries(p)})
            except (ValueError, AttributeError):
                pass
    return out
