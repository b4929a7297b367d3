"""Line-based JSON-RPC tools over an atlas: a server object with one entry per method."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass

from graphloom.operators.graph import DEPTH_DEFAULT, DEPTH_MAX, LIST_LIMIT
from graphloom.plans.atlas import Atlas, Question, render

# --- fixed values: protocol -------------------------------------------------------------------------------
MODERN, LEGACY = ["2026-07-28"], ["2025-11-25", "2025-06-18", "2025-03-26", "2024-11-05"]
VERSION_KEY, SERVER_KEY = "io.modelcontextprotocol/protocolVersion", "io.modelcontextprotocol/serverInfo"
BROKEN_JSON, NO_METHOD, UNKNOWN_METHOD, BAD_PARAMS, BAD_VERSION = -32700, -32600, -32601, -32602, -32022
# --- end of fixed values ----------------------------------------------------------------------------------

SERVER = {"name": "graphloom", "version": "1"}
GUIDE = "Tools over one scan of a code tree. Begin with scan_summary; totals are exact even where a list is cut short."


@dataclass(frozen=True)
class Tool:
    kind: str
    title: str
    about: str
    subject: str | None = None  # its one required argument
    meaning: str = ""

    def schema(self) -> dict:
        if self.subject is None:
            return {"type": "object", "additionalProperties": False}
        whole = lambda about, **more: {"type": "integer", "minimum": 1, **more, "description": about}
        fields = {self.subject: {"type": "string", "description": self.meaning}}
        if self.kind == "blast_radius":
            fields["depth"] = whole(f"Longest chain of imports to follow, {DEPTH_DEFAULT} unless given.", maximum=DEPTH_MAX)
        fields["limit"] = whole(f"Most files to list, {LIST_LIMIT} unless given; the total counts all.")
        return {"type": "object", "properties": fields, "required": [self.subject], "additionalProperties": False}


_FILE = "A file: its path in the tree, or an end of it that fits one file only."
TOOLS = {
    "scan_summary": Tool("summary", "Numbers of the scan", "Sizes, both rates, each language, unread extensions and the most imported files."),
    "what_depends_on": Tool("dependents", "Importers of a file", "Files that import the given one, aliases and workspace packages resolved.", "path", _FILE),
    "what_does_x_depend_on": Tool("dependencies", "Imports of a file", "Files that the given one imports; packages from outside are not files.", "path", _FILE),
    "blast_radius": Tool("blast_radius", "Reach of a change", "Files that import the given one directly or through others, counted by distance.", "path", _FILE),
    "files_touching_package": Tool("package_users", "Users of a package", "Files that import a package from outside the tree.", "name", "The package as imports write it, upper and lower case kept."),
}


class Refused(Exception):
    """An answer that is an error."""

    def __init__(self, code: int, why: str, **data):
        super().__init__(why)
        self.record = {"code": code, "message": why} | ({"data": data} if data else {})


def _at_least_one(value, default: int) -> int:
    return value if type(value) is int and value > 0 else default


class Server:
    def __init__(self, atlas: Atlas):
        self.atlas = atlas
        self.methods: dict[str, Callable[[dict], dict]] = {"server/discover": self.discover, "initialize": self.greet, "ping": lambda _: {}, "tools/list": self.listed, "tools/call": self.called}

    def discover(self, params: dict) -> dict:
        return {"supportedVersions": MODERN + LEGACY, "capabilities": {"tools": {}}, "instructions": GUIDE, "_meta": {SERVER_KEY: SERVER}, "resultType": "complete"}

    def greet(self, params: dict) -> dict:
        asked = params.get("protocolVersion")
        spoken = asked if asked in MODERN + LEGACY else LEGACY[0]
        return {"protocolVersion": spoken, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": SERVER, "instructions": GUIDE}

    def listed(self, params: dict) -> dict:
        return {"tools": [{"name": n, "title": t.title, "description": t.about, "inputSchema": t.schema()} for n, t in TOOLS.items()]}

    def called(self, params: dict) -> dict:
        tool = TOOLS.get(params.get("name")) if isinstance(params.get("name"), str) else None
        if tool is None:
            raise Refused(BAD_PARAMS, f"there is no tool {params.get('name')!r}")
        given = params.get("arguments") or {}
        subject = given.get(tool.subject, "") if tool.subject else ""
        if tool.subject and not (isinstance(subject, str) and subject.strip()):
            return {"content": [{"type": "text", "text": f"{tool.subject} must be a text that isn't empty"}], "isError": True}
        question = Question(tool.kind, subject, _at_least_one(given.get("depth"), DEPTH_DEFAULT))
        a = self.atlas.answer(question, _at_least_one(given.get("limit"), LIST_LIMIT))
        return {"content": [{"type": "text", "text": render(a)}], "structuredContent": json.loads(json.dumps(a.record(), default=str)), "isError": False}

    def result(self, request: dict) -> dict:
        params = request.get("params") or {}
        version = (params.get("_meta") or {}).get(VERSION_KEY)
        if not isinstance(request.get("method"), str):
            raise Refused(NO_METHOD, "a request names its method")
        if version is not None and version not in MODERN:
            raise Refused(BAD_VERSION, "that protocol version isn't spoken here", supported=MODERN + LEGACY, requested=version)
        if request["method"] not in self.methods:
            raise Refused(UNKNOWN_METHOD, f"there is no method {request['method']}")
        made = self.methods[request["method"]](params)
        return made | {"resultType": "complete"} if version is not None else made

    def line(self, text: str) -> str | None:
        """The answer to one line; None for notifications and what is no request."""
        try:
            request = json.loads(text)
        except ValueError as e:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": Refused(BROKEN_JSON, f"not JSON: {e}").record})
        if not (isinstance(request, dict) and "id" in request):
            return None
        try:
            body = {"result": self.result(request)}
        except Refused as e:
            body = {"error": e.record}
        return json.dumps({"jsonrpc": "2.0", "id": request["id"], **body})


def handle(atlas: Atlas, line: str) -> str | None:
    return Server(atlas).line(line)


def serve(atlas: Atlas, lines=None, out=None) -> None:
    server, out = Server(atlas), out or sys.stdout
    for line in lines or sys.stdin:
        if line.strip() and (answer := server.line(line)) is not None:
            print(answer, file=out, flush=True)
