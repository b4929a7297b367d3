"""A directory of source files as a table: Python data source ``source_tree``.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("path", root).load()

Hidden files are read; ``.gitignore`` files count at every level, also without a
repository; directories (and files) that tools fill are refused by name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.functions.catalogue import ALWAYS_SKIP, MANIFEST_EXTENSIONS, MANIFESTS, entries

SCHEMA = "project string, path string, content binary, bytes bigint, is_symlink boolean, excluded_by string"
MAX_PROJECT_DEPTH = 4


def ignore_rule(line: str):
    """(compiled pattern, negated, directories only) of one line, or None for blanks and comments."""
    line = line.rstrip("\n").rstrip("\r")
    if line.endswith(" ") and not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line
    if body.startswith(("\\#", "\\!")):
        body = body[1:]
    dirs_only = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + (2 if body.startswith("**", i) else 1)
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            inner = body[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", j + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, dirs_only


class Ignores:
    """Rules of the directories above a path; the last rule that matches decides, deeper files come later."""

    def __init__(self, above: list[tuple[str, list]] | None = None):
        self.levels = above or []

    def enter(self, folder: str, rel: str) -> Ignores:
        try:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules = [r for r in map(ignore_rule, f) if r]
        except OSError:
            return self
        return Ignores([*self.levels, (rel, rules)])

    def refuses(self, rel: str, is_dir: bool) -> bool:
        verdict = False
        for base, rules in self.levels:
            local = rel[len(base) + 1 :] if base else rel
            for pattern, negated, dirs_only in rules:
                if (is_dir or not dirs_only) and pattern.match(local):
                    verdict = not negated
        return verdict


def walk(root: str, rel: str = "", ignores: Ignores | None = None, excluded: str | None = None) -> Iterator[tuple[str, bool, str | None]]:
    """(relative path, is_symlink, excluded_by) of every file below ``rel``; a missing root has none.

    Refused directories are walked with the rule that refused them, so that an
    import into them can be told from one to nowhere.
    """
    folder = os.path.join(root, rel) if rel else root
    ignores = ignores or Ignores()
    if not excluded:
        ignores = ignores.enter(folder, rel)
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in found:
        path = f"{rel}/{e.name}" if rel else e.name
        is_dir = e.is_dir(follow_symlinks=False)
        rule = excluded or ("always_skip" if e.name in ALWAYS_SKIP else "gitignore" if ignores.refuses(path, is_dir) else None)
        if is_dir:
            yield from walk(root, path, ignores, rule)
        elif e.is_symlink() or e.is_file(follow_symlinks=False):
            yield path, e.is_symlink(), rule


def locate_projects(root: str) -> list[tuple[str, list[str]]]:
    """(relative directory, kinds) of the projects below ``root``.

    Manifests at the root make it one project. Else marked directories down to
    four levels are projects, none nested in another; with fewer than two the root is one project.
    """
    names, extensions = entries(MANIFESTS), entries(MANIFEST_EXTENSIONS)

    def kinds(folder: str) -> set[str]:
        try:
            inside = os.listdir(folder)
        except OSError:
            return set()
        found = {names[n] for n in inside if n in names} | {extensions[n.rsplit(".", 1)[-1]] for n in inside if "." in n and n.rsplit(".", 1)[-1] in extensions}
        return found or ({"repository"} if ".git" in inside else set())

    def below(rel: str, depth: int) -> Iterator[tuple[str, list[str]]]:
        if depth > MAX_PROJECT_DEPTH:
            return
        try:
            subs = sorted(e.name for e in os.scandir(os.path.join(root, rel)) if e.is_dir(follow_symlinks=False) and e.name not in ALWAYS_SKIP and not e.name.startswith("."))
        except OSError:
            return
        for s in subs:
            path = f"{rel}/{s}" if rel else s
            k = kinds(os.path.join(root, path))
            if k:
                yield path, sorted(k)
            else:
                yield from below(path, depth + 1)

    own = kinds(root)
    if own - {"repository"}:
        return [(".", sorted(own))]
    marked = list(below("", 1))
    if len(marked) < 2:
        return [(".", sorted(own) or (marked[0][1] if marked else ["unknown"]))]
    return marked


class _Part(InputPartition):
    def __init__(self, project: str, rel: str, levels: list, rule: str | None, deep: bool):
        self.project, self.rel, self.levels, self.rule, self.deep = project, rel, levels, rule, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, contents: bool):
        self.root, self.contents = root, contents

    def partitions(self) -> list[_Part]:
        """One task per top directory of a project and one for the files beside them."""
        out = []
        for project, _ in locate_projects(self.root):
            base = self.root if project == "." else os.path.join(self.root, project)
            out.append(_Part(project, "", [], None, False))
            top = Ignores().enter(base, "")
            try:
                subs = sorted(e.name for e in os.scandir(base) if e.is_dir(follow_symlinks=False))
            except OSError:
                subs = []
            for s in subs:
                rule = "always_skip" if s in ALWAYS_SKIP else "gitignore" if top.refuses(s, True) else None
                out.append(_Part(project, s, top.levels, rule, True))
        return out

    def read(self, part: _Part):
        base = self.root if part.project == "." else os.path.join(self.root, part.project)
        if part.deep:
            found = walk(base, part.rel, Ignores(part.levels), part.rule)
        else:
            top = Ignores().enter(base, "")
            found = ((e.name, e.is_symlink(), "always_skip" if e.name in ALWAYS_SKIP else "gitignore" if top.refuses(e.name, False) else None) for e in os.scandir(base) if e.is_symlink() or e.is_file(follow_symlinks=False)) if os.path.isdir(base) else ()
        for path, linked, rule in found:
            full = os.path.join(base, path)
            try:
                size = os.stat(full).st_size
            except OSError:
                size = 0
            content = None
            if self.contents and not linked and rule is None:
                try:
                    with open(full, "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
            yield part.project, path, content, size, linked, rule


class SourceTree(DataSource):
    """Options: ``path`` (root directory, shared by all executors), ``contents`` (false: sizes only)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(os.path.abspath(self.options["path"]), self.options.get("contents", "true").lower() != "false")
