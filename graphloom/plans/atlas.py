"""Questions about a scanned graph: a closed grammar, answers with exact totals, one text rendering."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.operators.stats import external_packages, kind_counts
from graphloom.operators.summary import summary

# --- fixed values: the accepted forms, in the order in which they are tried ------------------------------
FORMS = [
    ("summary", r"(?:summary|scan summary|scan_summary|overview|stats|what is this)()"),
    ("dependencies", r"what does (.+) depend on"),
    ("dependencies", r"what does (.+) import"),
    ("dependencies", r"what (.+) depends on"),
    ("dependencies", r"dependencies of (.+)"),
    ("dependencies", r"what does (.+)"),
    ("dependents", r"what depends on (.+)"),
    ("dependents", r"who depends on (.+)"),
    ("dependents", r"what imports (.+)"),
    ("dependents", r"who imports (.+)"),
    ("dependents", r"dependents of (.+)"),
    ("blast_radius", r"blast radius of (.+)"),
    ("blast_radius", r"blast radius (.+)"),
    ("blast_radius", r"blast_radius (.+)"),
    ("blast_radius", r"what breaks if (?:i|we) change (.+)"),
    ("package_users", r"which files touch package (.+)"),
    ("package_users", r"files touching package (.+)"),
    ("package_users", r"which files touch (.+)"),
    ("package_users", r"files touching (.+)"),
    ("package_users", r"who uses (.+)"),
    ("package_users", r"what uses (.+)"),
]
# --- end of fixed values ---------------------------------------------------------------------------------


#: Files named in the answer to an ambiguous path; its total is never cut.
CANDIDATES_SHOWN = 10


@dataclass
class Question:
    kind: str
    subject: str = ""
    depth: int = graph.DEPTH_DEFAULT


class NotAQuestion(ValueError):
    """The text is none of the accepted forms."""


def parse(text: str) -> Question:
    """Read a question; a phrase outside the forms is refused, never guessed."""
    clean = text.strip().rstrip("?.!").strip()
    for kind, form in FORMS:
        m = re.fullmatch(form, clean, re.I | re.A | re.S)
        if m and (kind == "summary" or m[1].strip()):
            return Question(kind, m[1].strip())
    raise NotAQuestion(text)


@dataclass
class Answer:
    kind: str
    subject: str = ""
    total: int = 0
    shown: list = field(default_factory=list)
    omitted: int = 0
    extra: dict = field(default_factory=dict)

    def record(self) -> dict:
        return asdict(self)


class Atlas:
    """Answers over (nodes, edges). Only envelopes come to the driver: the shown rows and counts."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, scan=None, root: str = "."):
        """``scan``, where there is one, gives the summary its rates, coverage and gaps."""
        self.nodes, self.edges, self.scan, self.root = nodes, edges, scan, root

    def answer(self, q: Question, limit: int = graph.LIST_LIMIT) -> Answer:
        if q.kind == "summary":
            return self._summary()
        if q.kind == "package_users":
            return self._package(q.subject, limit)
        where = graph.locate(self.nodes, q.subject)
        found = where.orderBy("project", "id").limit(CANDIDATES_SHOWN + 1).collect()
        if len(found) != 1:
            near = [] if found else [_ref(r) for r in graph.suggest(self.nodes, q.subject).collect()]
            total = len(found) if len(found) <= CANDIDATES_SHOWN else where.count()
            shown = found[:CANDIDATES_SHOWN]
            return Answer("unlocated", q.subject, total, [_ref(r) for r in shown], total - len(shown), {"reason": "ambiguous" if found else "not_found", "suggestions": near})
        subject = self.nodes.sparkSession.createDataFrame([(found[0]["project"], found[0]["id"])], "project string, id string")
        if q.kind == "blast_radius":
            return self._blast(subject, _ref(found[0]), q.depth, limit)
        rows = graph.neighbours(self.edges, self.nodes, subject, q.kind == "dependents", limit).collect()
        total = rows[0]["total"] if rows else self._count(q.kind, found[0])
        return Answer(q.kind, _ref(found[0]), total, [_ref(r) for r in rows], max(0, total - len(rows)))

    def _count(self, kind: str, r) -> int:
        near = "target" if kind == "dependents" else "source"
        return self.edges.where((F.col("project") == r["project"]) & (F.col(near) == r["id"])).count()

    def _blast(self, subject: DataFrame, name: str, depth: int, limit: int) -> Answer:
        depth = max(1, min(graph.DEPTH_MAX, depth))
        levels = graph.blast_by_depth(self.edges, subject, depth).orderBy("depth").collect()
        rows = graph.blast_radius(self.edges, subject, depth).orderBy("depth", "project", "id").limit(limit).collect()
        total = sum(r["files"] for r in levels)
        return Answer("blast_radius", name, total, [_ref(r) for r in rows], max(0, total - len(rows)), {"depth": depth, "by_depth": {r["depth"]: r["files"] for r in levels}, "stopped_at_depth": any(r["stopped_at_depth"] for r in levels)})

    def _package(self, name: str, limit: int) -> Answer:
        users = graph.package_users(self.nodes, name)
        total = users.count()
        rows = users.orderBy("project", "id").limit(limit).collect()
        near = [] if total else [r["name"] for r in graph.package_near_misses(self.nodes, name).collect()]
        indexed = self.nodes.select(F.explode("external_deps")).distinct().count()
        return Answer("package_users", name.strip(), total, [_ref(r) for r in rows], max(0, total - len(rows)), {"near_misses": near, "indexed": indexed})

    def _summary(self) -> Answer:
        if self.scan is not None:
            return Answer("summary", extra=summary(self.scan, self.root))
        kinds = [r.asDict() for r in kind_counts(self.nodes).orderBy("project", "kind").collect()]
        packages = [r.asDict() for r in external_packages(self.nodes).orderBy("project").collect()]
        hubs = [{"id": _ref(r), "dependents": r["dependents"]} for r in graph.hubs(self.edges).collect()]
        return Answer("summary", extra={"root": self.root, "totals": {"nodes": self.nodes.count(), "edges": self.edges.count()}, "kinds": kinds, "packages": packages, "hubs": hubs})


def _ref(r) -> str:
    return r["id"] if r["project"] == "." else f"{r['project']}/{r['id']}"


def render(a: Answer) -> str:
    """The answer as text; the same for every front door."""
    if a.kind == "summary":
        t = a.extra["totals"]
        out = [a.extra["root"], f"{t['nodes']} files, {t['edges']} edges"]
        if "projects" in t:
            out += [f"{t['projects']} project(s), resolution rate {t['resolution_rate']:.4f}, source coverage {t['source_coverage']:.4f}", f"{t['files_analysed']} files analysed, {t['files_unsupported']} not read"]
        for p in a.extra.get("projects", []):
            if t["projects"] > 1:
                out += ["", f"{p['project']}: {p['nodes']} files, {p['edges']} edges, rate {p['resolution_rate']:.4f}, coverage {p['source_coverage']:.4f}"]
            out += [f"  {x['lang']:<14} {x['resolution_rate']:.4f}  ({x['files']} files, {x['edges']} edges)" for x in p["by_lang"]]
            out += [f"  not read: {g['extension']} {g['files']} ({g['lang'] or 'unrecognised'})" for g in p["gaps"]]
        out += [f"  {k['project']}: {k['files']} {k['kind'].replace('_', ' ')}" for k in a.extra.get("kinds", [])]
        return "\n".join([*out, *[f"  hub {h['id']} ({h['dependents']})" for h in a.extra["hubs"]]])
    if a.kind == "unlocated":
        if a.extra["reason"] == "ambiguous":
            more = [f"  {a.omitted} more"] if a.omitted else []
            return "\n".join([f"{a.subject} is ambiguous: {a.total} files", *[f"  {x}" for x in a.shown], *more])
        return "\n".join([f"no file matches {a.subject}", *[f"  did you mean {x}?" for x in a.extra["suggestions"]]])
    what = {"dependents": "files depend on", "dependencies": "files are imported by", "blast_radius": "files could be reached from", "package_users": "files use"}[a.kind]
    out = [f"{a.total} {what} {a.subject}", *[f"  {x}" for x in a.shown]]
    if a.omitted:
        out.append(f"  {a.omitted} more not shown")
    if a.kind == "blast_radius":
        out += [f"  depth {d}: {n}" for d, n in a.extra["by_depth"].items()]
        if a.extra["stopped_at_depth"]:
            out.append(f"  stopped at depth {a.extra['depth']}: the total is a floor")
    if a.kind == "package_users" and not a.total:
        out.append(f"  {a.extra['indexed']} packages known" + (", close: " + ", ".join(a.extra["near_misses"]) if a.extra["near_misses"] else ""))
    return "\n".join(out)
