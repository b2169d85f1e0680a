"""python -m codeweft.cli VERB ...: the engine from a shell."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import engine
from .session import local_session


def _registry(path: str) -> dict[str, dict]:
    """Indexed repos by path; a broken file counts as empty, and repos without an index are left out."""
    try:
        rows = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    return {p: m for p, m in rows.items() if Path(p, engine.FOLDER, "meta.json").exists()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeweft")
    p.add_argument("--repo", default=".", help="a path within the repo")
    p.add_argument("--registry", default=str(Path.home() / ".codegraph" / "registry.json"))
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *flags: tuple) -> None:
        v = verbs.add_parser(name)
        for names, options in flags:
            v.add_argument(*names, **options)

    whole = lambda v: n if (n := int(v)) > 0 else (_ for _ in ()).throw(argparse.ArgumentTypeError("must be over 0"))
    verb("analyze", (("--force",), {"action": "store_true"}))
    verb("list")
    verb("status")
    verb("clean", (("--force",), {"action": "store_true"}), (("--all",), {"action": "store_true"}))
    verb("wiki", (("--out",), {"default": "wiki"}))
    verb("augment", (("text",), {}))
    verb("query", (("text",), {}), (("--context",), {"default": ""}), (("--goal",), {"default": ""}), (("--limit",), {"type": whole, "default": 5}))
    verb("context", (("name",), {"nargs": "?"}), (("--uid",), {}), (("--file",), {}))
    verb("impact", (("target",), {}), (("--direction",), {"choices": ["upstream", "downstream"], "default": "upstream"}), (("--depth",), {"type": whole, "default": 3}), (("--relations",), {"nargs": "*"}), (("--min-confidence",), {"type": float, "default": 0.0}), (("--include-tests",), {"action": "store_true"}))
    verb("cypher", (("text",), {}))
    verb("detect-changes", (("--scope",), {"choices": ["unstaged", "staged", "all", "compare"], "default": "unstaged"}), (("--base-ref",), {}))
    verb("rename", (("new",), {}), (("--name",), {}), (("--uid",), {}), (("--file",), {}), (("--apply",), {"action": "store_true"}))
    verb("serve", (("--port",), {"type": int, "default": 4747}))
    verb("mcp")
    verb("eval-server", (("--port",), {"type": int, "default": 4848}), (("--idle-seconds",), {"type": float, "default": 0.0}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    known = _registry(a.registry)
    if a.verb == "list":
        print(json.dumps(list(known.values()), indent=2))
        return 0
    if a.verb == "clean":
        for root in known if a.all else [str(Path(a.repo).resolve())]:
            print(root, "removed" if engine.clean(root, a.force) and a.force else "needs --force" if engine.clean(root) else "no index")
        return 0
    index = engine.find_index(a.repo)
    if a.verb == "augment" and (index is None or len(a.text.strip()) < 3):
        return 0  # a hook: it says nothing and never fails
    if a.verb == "detect-changes" and a.scope == "compare" and not a.base_ref:
        print("compare needs --base-ref", file=sys.stderr)
        return 2
    if index is None and a.verb not in ("analyze", "wiki", "serve", "mcp"):
        print("no index here; run analyze", file=sys.stderr)
        return 1
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if a.verb == "augment":
        try:
            text = engine.Engine(spark, str(index)).augment(a.text)
        except Exception:  # noqa: BLE001
            text = ""
        if text:
            print(f"[codeweft]\n{text}", file=sys.stderr)
        return 0
    if a.verb == "analyze":
        meta = engine.analyze(spark, a.repo, force=a.force)
        known[meta["repoPath"]] = {"name": Path(meta["repoPath"]).name, "path": meta["repoPath"], **{k: meta[k] for k in ("indexedAt", "lastCommit", "stats")}}
        Path(a.registry).parent.mkdir(parents=True, exist_ok=True)
        Path(a.registry).write_text(json.dumps(known, indent=2))
        print(json.dumps(meta, indent=2))
        return 0
    e = engine.read_through(spark, a.repo)
    if a.verb in ("serve", "mcp", "eval-server"):
        from . import serve

        repos = serve.Repos(e, known)
        # the evaluation server takes smaller requests
        return serve.mcp(repos) if a.verb == "mcp" else serve.http(repos, a.port, getattr(a, "idle_seconds", 0.0), serve.MAX_BODY if a.verb == "serve" else serve.MAX_EVAL_BODY)
    answers = {
        "status": lambda: e.meta, "wiki": lambda: e.wiki(a.out), "query": lambda: e.query(" ".join([a.text, a.context, a.goal]), a.limit), "context": lambda: e.context(a.name, a.uid, a.file),
        "impact": lambda: e.impact(a.target, a.direction, a.depth, a.relations, a.min_confidence, a.include_tests), "cypher": lambda: e.cypher(a.text), "detect-changes": lambda: e.detect_changes(scope=a.scope, base=a.base_ref),
        "rename": lambda: e.rename(a.new, a.name, a.uid, a.file, a.apply),
    }
    out = answers[a.verb]()
    print(out if isinstance(out, str) else json.dumps(out, indent=2, default=str))
    return 1 if isinstance(out, dict) and "error" in out else 0


if __name__ == "__main__":
    sys.exit(main())
