"""python -m graphloom scan|query|export|rpc|view ROOT ...: front doors over one scan; ROOT alone means view.

ROOT is a folder, or for query and rpc also a document saved by ``export ROOT json``.
"""

from __future__ import annotations

import argparse
import http.server
import json
import os
import sys
import tempfile

from pyspark.sql import functions as F

from graphloom.operators import export, graph
from graphloom.operators.scan import scan
from graphloom.operators.summary import project_summaries, summary, text, totals
from graphloom.plans.atlas import Atlas, NotAQuestion, parse, render
from graphloom.plans.shared import materialise
from graphloom.session import get_spark
from graphloom.sources.tree import SourceTree

COMMANDS = ("scan", "query", "export", "rpc", "view")


def _scan(spark, root: str):
    spark.dataSource.register(SourceTree)
    return scan(spark.read.format("source_tree").option("path", root).load())


def _atlas(spark, root: str) -> Atlas:
    if os.path.isfile(root):
        return Atlas(*export.read_document(spark, root), root=root)
    s = _scan(spark, root)
    return Atlas(s.nodes, s.edges, s, root)


def save(s, form: str, to: str, root: str = ".") -> None:
    """Write one form of the scan into the file ``to``; the vault into the folder ``to``."""
    if form == "vault":
        export.write_notes(export.note_lines(s.nodes, s.edges, s.diagnostics), to, export.index_note(summary(s, root)))
    elif form == "md":
        with open(to, "w", encoding="utf-8") as f:
            f.write(export.markdown_report(summary(s, root)))
    elif form == "graphml":
        export.one_file(export.graphml_rows(s.nodes, s.edges), [F.desc("part"), F.length("id"), "id"], to, export.GRAPHML_HEAD, export.GRAPHML_TAIL)
    elif form == "cypher":
        export.one_file(export.cypher_rows(s.nodes, s.edges), [F.desc("part"), "id"], to, export.CYPHER_HEAD)
    else:
        per = materialise(project_summaries(s), "projects")
        head, tail = export.document_frame(root, totals(per).first().asDict())
        records = per.select("project", F.to_json(F.struct(*[c for c in per.columns if c != "project"])).alias("record"))
        export.one_file(export.document_lines(s.nodes, s.edges, records), export.DOCUMENT_ORDER, to, head, tail)
        if form == "yaml":
            with open(to, encoding="utf-8") as f:
                made = export.yaml_text(f.read())
            with open(to, "w", encoding="utf-8") as f:
                f.write(made)


#: form and content type of each route; ``/`` leads to the document
ROUTES = {
    "/": ("json", "application/json"), "/graph.json": ("json", "application/json"), "/export/graph.json": ("json", "application/json"), "/export/graph.graphml": ("graphml", "application/xml"),
    "/export/graph.cypher": ("cypher", "text/plain; charset=utf-8"), "/export/graph.yaml": ("yaml", "text/yaml; charset=utf-8"), "/export/report.md": ("md", "text/markdown; charset=utf-8"),
}


class Pages:
    """Answers to GET requests; each form is made once for a scan, on its first request."""

    def __init__(self, s, root: str = "."):
        self.s, self.root, self.folder = s, root, tempfile.TemporaryDirectory(prefix="graphloom-pages-")

    def get(self, path: str) -> tuple[int, str, str]:
        """(status, content type, file name or text)."""
        found = ROUTES.get(path.split("?")[0])
        if not found:
            return 404, "text/plain; charset=utf-8", f"nothing at {path}"
        form, kind = found
        to = os.path.join(self.folder.name, form)
        if not os.path.exists(to):
            save(self.s, form, to, self.root)
        return 200, kind, to


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="graphloom")
    sub = ap.add_subparsers(dest="command", required=True)
    for name in ("scan", "rpc", "view"):
        sub.add_parser(name).add_argument("root")
    q = sub.add_parser("query")
    q.add_argument("root")
    q.add_argument("text")
    q.add_argument("--depth", type=int)
    q.add_argument("--limit", type=int, default=graph.LIST_LIMIT)
    q.add_argument("--json", action="store_true")
    x = sub.add_parser("export")
    x.add_argument("root")
    x.add_argument("form", choices=["json", "yaml", "graphml", "cypher", "md", "vault"])
    x.add_argument("--to")
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv = ["view", *argv]
    args = ap.parse_args(argv)
    question = None
    if args.command == "query":
        try:
            question = parse(args.text)
        except NotAQuestion:
            print("not a question this tool knows", file=sys.stderr)
            return 2
    spark = get_spark()
    if args.command == "query":
        if args.depth:
            question.depth = args.depth
        a = _atlas(spark, args.root).answer(question, args.limit)
        print(json.dumps(a.record(), default=str) if args.json else render(a))
        return int(a.kind == "unlocated")
    if args.command == "rpc":
        from graphloom.rpc import serve

        serve(_atlas(spark, args.root))
        return 0
    s = _scan(spark, args.root)
    if args.command == "scan":
        print(text(summary(s, args.root)), end="")
    elif args.command == "export" and (args.to or args.form == "vault"):
        save(s, args.form, args.to or "vault", args.root)
    elif args.command == "export":
        with tempfile.TemporaryDirectory() as folder:
            to = os.path.join(folder, args.form)
            save(s, args.form, to, args.root)
            with open(to, encoding="utf-8") as f:
                for line in f:
                    print(line, end="")
    else:
        pages = Pages(s, args.root)

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                code, kind, found = pages.get(self.path)
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.end_headers()
                if code != 200:
                    self.wfile.write(found.encode())
                    return
                with open(found, "rb") as f:
                    while chunk := f.read(1 << 20):
                        self.wfile.write(chunk)

        server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
        print(f"http://127.0.0.1:{server.server_port}/graph.json", flush=True)
        server.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
