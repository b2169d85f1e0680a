"""The engine over HTTP and over lines of JSON-RPC. One session answers; requests wait for each other."""

from __future__ import annotations

import json
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from .engine import FOLDER, AnswerError, Engine

MAX_BODY, MAX_EVAL_BODY = 10 * 1024 * 1024, 1024 * 1024

TOOLS: dict[str, tuple[str, dict[str, str]]] = {
    "list_repos": ("Repos that are indexed", {}),
    "query": ("Ranked search over flows and symbols", {"query": "string", "limit": "integer"}),
    "context": ("What refers to a symbol and what it refers to", {"name": "string", "uid": "string", "file": "string"}),
    "impact": ("What a change of a symbol reaches", {"target": "string", "direction": "string", "depth": "integer", "relations": "array", "min_confidence": "number", "tests": "boolean"}),
    "cypher": ("A read-only pattern over the graph", {"query": "string"}),
    "detect_changes": ("What changed files touch", {"files": "array", "scope": "string", "base": "string"}),
    "rename": ("A rename plan", {"new": "string", "name": "string", "uid": "string", "file": "string"}),
}
for _, _fields in list(TOOLS.values())[1:]:
    _fields["repo"] = "string"
_ALIASES = {"search": "query", "explore": "context"}


class Repos:
    """The indexed repos behind one server: the one it was started in, and those of the registry, opened when asked for."""

    def __init__(self, first: Engine, registry: dict[str, dict] | None = None) -> None:
        self.first = first
        self.metas = {first.meta["repoPath"]: first.meta} | {p: m for p, m in (registry or {}).items() if p != first.meta["repoPath"]}
        self.engines = {first.meta["repoPath"]: first}

    def list(self) -> list[dict[str, Any]]:
        return list(self.metas.values())

    def pick(self, hint: str | None) -> Engine:
        """By equal name or path, case aside for names, else by part of either; several that fit are an error."""
        if not hint:
            return self.first
        named = {p: m.get("name") or p.rsplit("/", 1)[-1] for p, m in self.metas.items()}
        low = hint.lower()
        fit = [p for p, n in named.items() if n.lower() == low or p == hint] or [p for p, n in named.items() if low in n.lower() or low in p.lower()]
        if len(fit) != 1:
            raise AnswerError(f"no repo {hint}" if not fit else f"{hint} may be any of {', '.join(sorted(fit))}")
        if fit[0] not in self.engines:
            self.engines[fit[0]] = Engine(self.first.spark, f"{fit[0]}/{FOLDER}")
        return self.engines[fit[0]]


def _all(e: Engine | Repos) -> Repos:
    return e if isinstance(e, Repos) else Repos(e)


def call(e: Engine | Repos, tool: str, args: dict[str, Any]) -> Any:
    tool = _ALIASES.get(tool, tool)
    if tool not in TOOLS:
        raise KeyError(tool)
    if tool == "list_repos":
        return _all(e).list()
    e = _all(e).pick(args.get("repo"))
    args = {k: v for k, v in args.items() if k in TOOLS[tool][1] and k != "repo"}
    if tool in ("query", "cypher"):
        return getattr(e, tool)(args.pop("query"), **args)
    return getattr(e, tool)(**args)


def resources(e: Engine | Repos, uri: str) -> Any:
    repos = _all(e)
    uri, _, query = uri.partition("?")
    e = repos.pick(parse_qs(query).get("repo", [None])[0])
    kind, _, key = uri.partition("://")[2].partition("/")
    found = {"repos": repos.list, "context": lambda: e.meta["stats"], "clusters": e.cluster_list, "processes": e.process_list, "cluster": lambda: e.cluster(unquote(key)), "process": lambda: e.process(unquote(key)), "schema": lambda: {"nodes": e.nodes.schema.simpleString(), "edges": e.edges.schema.simpleString()}}
    if kind not in found or (out := found[kind]()) is None:
        raise KeyError(uri)
    return out


def route(e: Engine | Repos, method: str, target: str, body: dict[str, Any]) -> Any:
    """The answer to a request; KeyError where there is none."""
    url = urlsplit(target)
    args = {k: v[0] for k, v in parse_qs(url.query).items()}
    repos = _all(e)
    e = repos.pick(args.get("repo") or body.get("repo"))
    path = url.path.rstrip("/").removeprefix("/api") or "/health"
    if method == "GET":
        gets = {
            "/health": lambda: {"status": "ok"}, "/repos": repos.list, "/repo": lambda: e.meta, "/processes": e.process_list, "/clusters": e.cluster_list, "/process": lambda: e.process(args["name"]), "/cluster": lambda: e.cluster(args["name"]),
            "/file": lambda: (c := e.file(args["path"])) is not None and {"path": args["path"], "content": c} or None,
            "/graph": lambda: {"nodes": [r.asDict() for r in e.nodes.orderBy("id").toLocalIterator()], "edges": [r.asDict() for r in e.edges.orderBy("id").toLocalIterator()]},
        }
        if path in gets and (out := gets[path]()) is not None:
            return out
    elif path == "/query":
        return e.cypher(body["cypher"])
    elif path == "/search":
        return e.search(body["query"], int(body.get("limit", 10)))
    elif path.startswith("/tool/"):
        return call(repos, path.removeprefix("/tool/"), body)
    raise KeyError(path)


def http(e: Engine | Repos, port: int, idle_seconds: float = 0.0, most: int = MAX_BODY) -> int:
    """Serves until POST /shutdown or, if set, until it has been idle so long."""
    last = [time.monotonic()]

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            last[0] = time.monotonic()
            status, out = 200, None
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > most:
                    status, out = 413, {"error": "too large"}
                elif method == "POST" and self.path.rstrip("/") == "/shutdown":
                    out = {"status": "bye"}
                    threading.Thread(target=self.server.shutdown, daemon=True).start()
                else:
                    out = route(e, method, self.path, json.loads(self.rfile.read(size) or b"{}") if size else {})
            except KeyError as x:
                status, out = 404, {"error": f"not found: {x.args[0]}"}
            except (AnswerError, TypeError, ValueError) as x:
                status, out = 400, {"error": str(x)}
            except Exception as x:  # noqa: BLE001
                status, out = 500, {"error": type(x).__name__}
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

        def log_message(self, *args) -> None:
            pass

    server = HTTPServer(("127.0.0.1", port), Handler)
    if idle_seconds:

        def watch() -> None:
            while time.monotonic() - last[0] < idle_seconds:
                time.sleep(min(1.0, idle_seconds))
            server.shutdown()

        threading.Thread(target=watch, daemon=True).start()
    server.serve_forever()
    return 0


def rpc(e: Engine | Repos, request: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to one JSON-RPC request of the tool protocol; None for notifications."""
    method, params = request.get("method", ""), request.get("params") or {}
    if "id" not in request:
        return None
    try:
        if method == "initialize":
            out: Any = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}, "prompts": {}}, "serverInfo": {"name": "codeweft", "version": "1"}}
        elif method == "tools/list":
            out = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, (d, p) in TOOLS.items()]}
        elif method == "tools/call":
            out = {"content": [{"type": "text", "text": json.dumps(call(e, params["name"], params.get("arguments") or {}), indent=2, default=str)}]}
        elif method == "resources/list":
            out = {"resources": [{"uri": f"codegraph://{k}", "name": k} for k in ("repos", "context", "clusters", "processes", "schema")]}
        elif method == "resources/templates/list":
            out = {"resourceTemplates": [{"uriTemplate": f"codegraph://{k}/{{name}}", "name": k} for k in ("cluster", "process")]}
        elif method == "resources/read":
            out = {"contents": [{"uri": params["uri"], "text": json.dumps(resources(e, params["uri"]), default=str)}]}
        elif method == "prompts/list":
            out = {"prompts": [{"name": "detect_impact"}, {"name": "generate_map"}]}
        elif method == "prompts/get":
            texts = {"detect_impact": "Call detect_changes, then impact for each changed symbol, and report the risk.", "generate_map": "Read the clusters and processes and describe the architecture."}
            out = {"messages": [{"role": "user", "content": {"type": "text", "text": texts[params["name"]]}}]}
        elif method == "ping":
            out = {}
        else:
            return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": f"no method {method}"}}
    except (KeyError, TypeError, AnswerError) as x:
        return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32602, "message": str(x)}}
    return {"jsonrpc": "2.0", "id": request["id"], "result": out}


def mcp(e: Engine | Repos) -> int:
    for line in sys.stdin:
        if line.strip() and (reply := rpc(e, json.loads(line))) is not None:
            print(json.dumps(reply), flush=True)
    return 0
