"""Import specifiers out of source text: small lexers that mask comments and literals, then statement patterns.

Each literal is replaced by a numbered mark of the same number of lines, so that text
in comments and literals never reads as an import and line numbers hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_DQ, _SQ = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_C = r"//[^\n]*|/\*[\s\S]*?\*/"
_LEX = {
    "js": re.compile(rf"({_C})|({_DQ}|{_SQ}|`(?:[^`\\]|\\[\s\S])*`)"),
    "go": re.compile(rf"({_C})|({_DQ}|`[^`]*`|'(?:[^'\\\n]|\\.)+')"),
    "c": re.compile(rf"({_C})|({_DQ}|{_SQ})"),
    "rust": re.compile(rf"({_C})|(b?r(#*)\"[\s\S]*?\"\3|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\.[^'\n]*)')"),
    "py": re.compile(r"(#[^\n]*)|((?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|" + _DQ + "|" + _SQ + "))"),
    "rb": re.compile(rf"((?m:^)=begin\b[\s\S]*?\n=end[^\n]*|#(?!\{{)[^\n]*)|({_DQ}|{_SQ})"),
    "php": re.compile(rf"({_C}|#(?!\[)[^\n]*)|({_DQ}|{_SQ})"),
    "sh": re.compile(r"((?:(?<=\s)|(?m:^))#[^\n]*)|(\0)"),
    "css": re.compile(rf"({_C})|({_DQ}|{_SQ})"),
}


def mask(text: str, lexer: str) -> tuple[str, list[str]]:
    """(text with comments blank and literals as ``«k»``, the literals)."""
    kept: list[str] = []

    def one(m: re.Match) -> str:
        lines = "\n" * m[0].count("\n")
        if m[1] is not None:
            return lines or " "
        kept.append(m[2])
        return f"«{len(kept) - 1}»{lines}"

    return _LEX[lexer].sub(one, text.replace("«", " ").replace("»", " ")), kept


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _unquote(s: str) -> str:
    return s.strip("\"'`")


_JS = re.compile(r"(?<![\w$.])(?:import\s*«(\d+)»|(?:import|export)\b[^;«()=]*?(?<![\w$])from\s*«(\d+)»)")


def javascript(text: str, shift: int = 0) -> Iterator[tuple[int, str]]:
    t, lit = mask(text, "js")
    for m in _JS.finditer(t):
        raw = _unquote(lit[int(m[1] or m[2])])
        if raw:
            yield _line(t, m.end()) + shift, raw


def component(text: str) -> Iterator[tuple[int, str]]:
    """Scripts of a component: front matter between ``---`` lines, then every script element."""
    m = re.match(r"\s*---\r?\n([\s\S]*?)\n---", text)
    if m:
        yield from javascript(m[1], _line(text, m.start(1)) - 1)
    for s in re.finditer(r"<script\b[^>]*>([\s\S]*?)</script\s*>", text):
        yield from javascript(s[1], _line(text, s.start(1)) - 1)


def mdx(text: str) -> Iterator[tuple[int, str]]:
    """Statements that start an unfenced line with ``import`` or ``export``, of at most 24 lines."""
    out, fence, open_for = [], None, 0
    for line in text.split("\n"):
        f = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if fence:
            out.append("")
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
        elif f and not open_for:
            fence = f[1]
            out.append("")
        elif open_for or re.match(r"(?:import|export)\b", line):
            out.append(line)
            done = re.search(r"['\"`]\s*;?\s*$", line) or line.rstrip().endswith(";") or not line.strip()
            open_for = 0 if done else (open_for or 24) - 1
        else:
            out.append("")
    yield from javascript("\n".join(out))


def go(text: str) -> Iterator[tuple[int, str]]:
    t, lit = mask(text, "go")
    for m in re.finditer(r"(?m)^[ \t]*import\b\s*(?:\(([^)]*)\)|[\w.]*\s*«(\d+)»)", t):
        for k in re.finditer(r"«(\d+)»", m[0]):
            raw = lit[int(k[1])].strip('"`')
            if raw:
                yield _line(t, m.start() + k.start()), raw


def python(text: str) -> Iterator[tuple[int, str]]:
    t, _ = mask(text, "py")
    t = re.sub(r"\\\n", "  ", t) if "\\\n" in t else t
    for m in re.finditer(r"(?:^|(?<=\n)|(?<=;)|(?<=:))[ \t]*(?:from[ \t]+(\.*[ \t]*[\w.]*)[ \t]+import\b|import[ \t]+([\w., \t]+))", t):
        line = _line(t, m.end())
        if m[1] is not None:
            mod = m[1].replace(" ", "").replace("\t", "")
            if mod != "__future__":
                yield line, mod
        else:
            for name in m[2].split(","):
                word = name.split(" as ")[0].strip()
                if word:
                    yield line, word.split()[0]


def expand_use(text: str) -> list[str]:
    """``a::{b, c::{self, d as e}}`` to ``a::b``, ``a::c``, ``a::c::d``."""
    text = text.strip()
    if "{" not in text:
        path = re.sub(r"\s+as\s+\w+$", "", text).strip()
        path = re.sub(r"::\*$|^\*$", "", path)
        path = re.sub(r"::self$", "", path)
        return [path] if path and path != "self" else []
    at = text.index("{")
    head, depth, part, parts = text[:at].strip(), 0, "", []
    for c in text[at + 1 : text.rindex("}") if "}" in text else len(text)]:
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    parts.append(part)
    out = []
    for p in parts:
        p = p.strip()
        if p == "self" or p.startswith("self as "):
            out.append(head.rstrip(":"))
        elif p == "*":
            out.append(head.rstrip(":"))
        elif p:
            out += expand_use(head + p)
    return [x for x in out if x]


def rust(text: str) -> Iterator[tuple[int, str]]:
    t, _ = mask(text, "rust")
    found = [(m.start(), "mod " + m[1], None) for m in re.finditer(r"(?<![\w:])mod\s+(\w+)\s*;", t)]
    found += [(m.start(), None, m[1]) for m in re.finditer(r"(?<![\w:.])use\s+([^;]+);", t)]
    for at, one, use in sorted(found, key=lambda x: x[0]):
        for raw in [one] if one else expand_use(re.sub(r"\s+", " ", use)):
            yield _line(t, at), raw


def c_like(text: str) -> Iterator[tuple[int, str]]:
    plain = re.sub(_C, lambda m: "\n" * m[0].count("\n") or " ", text) if "/*" in text or "//" in text else text
    for m in re.finditer(r'(?m)^[ \t]*#[ \t]*include[ \t]*(?:"([^"\n]+)"|<([^>\n]+)>)', plain):
        yield _line(plain, m.start()), m[1] if m[1] else "<" + m[2]


def java(text: str) -> Iterator[tuple[int, str]]:
    t, _ = mask(text, "c")
    for m in re.finditer(r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", t):
        yield _line(t, m.start()), m[1]


def csharp(text: str) -> Iterator[tuple[int, str]]:
    t, _ = mask(text, "c")
    for m in re.finditer(r"(?m)^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", t):
        yield _line(t, m.start()), m[1]


def ruby(text: str) -> Iterator[tuple[int, str]]:
    t, lit = mask(text, "rb")
    for m in re.finditer(r"(?<![\w.:])(require|require_relative)\s*\(?\s*«(\d+)»", t):
        raw = _unquote(lit[int(m[2])])
        if raw:
            yield _line(t, m.start()), ("./" + raw if m[1] == "require_relative" else raw)


def php(text: str) -> Iterator[tuple[int, str]]:
    t, lit = mask(text, "php")
    for m in re.finditer(r"(?<![\w$>:\\])use\s+(?:function\s+|const\s+)?(\\?[A-Za-z_][\w\\]*)(?:\s+as\s+\w+)?((?:\s*,\s*\\?[A-Za-z_][\w\\]*(?:\s+as\s+\w+)?)*)\s*;|(?<![\w$>:])(?:include|require)(?:_once)?\s*\(?\s*«(\d+)»\s*\)?\s*;", t):
        line = _line(t, m.start())
        if m[3] is not None:
            yield line, "path:" + _unquote(lit[int(m[3])])
        else:
            for name in (m[1] + (m[2] or "")).split(","):
                yield line, name.split(" as ")[0].strip().lstrip("\\")


def html(text: str) -> Iterator[tuple[int, str]]:
    t = re.sub(r"<!--[\s\S]*?-->", lambda m: "\n" * m[0].count("\n"), text)
    for m in re.finditer(r"<(?:script|link|a|iframe|embed|object)\b([^>]*)>", t, re.I):
        for a in re.finditer(r"(?<![\w-])(?:src|href|data)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", m[1], re.I):
            raw = a[1] or a[2] or a[3] or ""
            if raw:
                yield _line(t, m.start(1) + a.start()), raw


def css(text: str) -> Iterator[tuple[int, str]]:
    t, lit = mask(text, "css")
    for m in re.finditer(r"@(?:import|use|forward|require)\b[^;{}«]*«(\d+)»", t):
        raw = _unquote(lit[int(m[1])])
        if raw:
            yield _line(t, m.start()), raw


def shell(text: str) -> Iterator[tuple[int, str]]:
    t, _ = mask(text, "sh")
    for m in re.finditer(r"(?m)(?:^|[;&|{(]|\bthen\b|\bdo\b)[ \t]*(?:source|\.)[ \t]+([^\n;&|]+)", t):
        for arg in re.findall(r"(?:\"(?:\$\([^)]*\)|[^\"])*\"|'[^']*'|\$\([^)]*\)|[^\s\"'])+", m[1]):
            raw = _unquote(arg).strip()
            if raw and raw[0] not in "<>":
                yield _line(t, m.start(1)), raw


EXTRACTORS: dict[str, Callable[[str], Iterator[tuple[int, str]]]] = {
    "typescript": javascript, "javascript": javascript, "vue": component, "svelte": component, "astro": component, "mdx": mdx, "go": go, "python": python, "rust": rust,
    "c": c_like, "cpp": c_like, "java": java, "csharp": csharp, "ruby": ruby, "php": php, "html": html, "css": css, "sass": css, "less": css, "stylus": css, "shell": shell,
}


def extract(lang: str, text: str) -> list[tuple[int, str]]:
    """(line, specifier) in source order, duplicates kept; languages that are not read give none."""
    f = EXTRACTORS.get(lang)
    return list(f(text)) if f else []
