"""One repo's index on disk and the questions asked of it, answered as documents.

Plans stay DataFrames until the last step; only the few rows of an answer are collected.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import shutil
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calls as C
from .operators import cypher, report
from .operators import graph as G
from .operators import imports as I
from .operators import symbols as S
from .operators import verbs as V
from .session import cut
from .sources import project, scan

FOLDER = ".codegraph"
_TABLES = ("files", "nodes", "edges", "communities", "processes", "process_steps", "memberships", "words")


class AnswerError(ValueError):
    """A question that can't be answered as it stands."""


def read_config(root: str) -> I.ProjectConfig:
    """The configuration of imports that lies in a repo's root (project files of C# anywhere below)."""
    top = Path(root)
    base, aliases = project.tsconfig_of([(top / name).read_text(errors="replace") for name in ("tsconfig.json", "tsconfig.app.json", "tsconfig.base.json") if (top / name).exists()])
    module = project.go_module((top / "go.mod").read_text()) if (top / "go.mod").exists() else None
    psr4 = ()
    if (top / "composer.json").exists():
        try:
            psr4 = tuple(project.psr4_prefixes((top / "composer.json").read_text()))
        except ValueError:
            pass
    cs = tuple(project.csproj_namespace(p.relative_to(top).as_posix(), p.read_text(errors="replace")) for p in sorted(top.rglob("*.csproj")))
    return I.ProjectConfig(base, tuple(aliases), module, psr4, tuple(project.csharp_order(list(cs))))


def analyze(spark: SparkSession, root: str, index: str | None = None, force: bool = False) -> dict[str, Any]:
    """Index a source tree; a commit that is indexed already is left alone unless forced. Returns the meta document."""
    root = str(Path(root).resolve())
    index = index or f"{root}/{FOLDER}"
    commit = project.git_commit(root)
    meta_path = Path(index, "meta.json")
    if not force and commit and meta_path.exists() and (meta := json.loads(meta_path.read_text())).get("lastCommit") == commit:
        return meta
    files = cut(scan.scan_tree(spark, root).withColumn("repo", F.lit("")))
    code = files.where("content is not null and language is not null")
    symbols = cut(S.symbols(code))
    paths = files.where("not skipped_large").select("repo", "path")
    imports = cut(I.resolve_imports(I.import_specifiers(code).withColumn("repo", F.lit("")), paths, read_config(root)))
    calls = C.calls(code, symbols, imports).unionByName(C.route_calls(code, symbols, imports)).groupBy("source_id", "target_id").agg(F.max("confidence").alias("confidence"))
    nodes = cut(G.build_nodes(files.where("not skipped_large"), symbols))
    edges = cut(G.build_edges(files.where("not skipped_large"), symbols, imports, calls, C.heritage(code, symbols, imports), nodes))
    members = cut(G.process_members(edges))
    processes = cut(G.processes(edges, members))
    communities = cut(G.communities(edges, nodes))
    steps = cut(G.process_steps(processes, members))
    out = {"files": files.drop("repo"), "nodes": nodes, "edges": edges, "communities": communities, "processes": processes, "process_steps": steps, "memberships": G.memberships(communities, steps, nodes), "words": V.symbol_index(nodes, files.where("content is not null"))}
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{index}/{name}")
    stats = {"files": files.where("not skipped_large").count(), "nodes": nodes.count(), "edges": edges.count(), "communities": communities.select("id").distinct().count(), "processes": processes.count(), "skippedLarge": files.where("skipped_large").count()}
    stats["languageBreakdown"] = {r["language"]: r["count"] for r in files.where("language is not null and not skipped_large").groupBy("language").count().orderBy("language").collect()}
    meta = {"repoPath": root, "lastCommit": commit, "indexedAt": dt.datetime.now(dt.UTC).isoformat(), "stats": stats}
    meta_path.write_text(json.dumps(meta, indent=2))
    return meta


def clean(root: str, force: bool = False) -> bool:
    """Remove a repo's index; without force it only says whether there is one."""
    index = Path(root, FOLDER)
    if index.exists() and force:
        shutil.rmtree(index)
        return True
    return index.exists()


def find_index(start: str) -> Path | None:
    """The index of the nearest folder at or above start."""
    here = Path(start).resolve()
    return next((p / FOLDER for p in (here, *here.parents) if (p / FOLDER / "meta.json").exists()), None)


def read_through(spark: SparkSession, root: str) -> Engine:
    """The engine of a repo's index; where there is none, the repo is indexed first."""
    index = find_index(root)
    if index is None:
        analyze(spark, root)
        index = Path(root).resolve() / FOLDER
    return Engine(spark, str(index))


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Engine:
    def __init__(self, spark: SparkSession, index: str) -> None:
        if not Path(index, "meta.json").exists():
            raise AnswerError(f"no index at {index}; analyze the repo first")
        self.spark, self.index = spark, index
        self.meta = json.loads(Path(index, "meta.json").read_text())
        for name in _TABLES:
            setattr(self, name, spark.read.parquet(f"{index}/{name}"))

    def _labels(self) -> DataFrame:
        names = self.nodes.select(F.col("id").alias("entry_symbol_id"), "name")
        return self.processes.join(names, "entry_symbol_id", "left").select(F.col("id").alias("process_id"), F.concat("id", F.lit(" -> "), F.coalesce("name", F.lit("unknown"))).alias("summary"), "symbol_count", "step_count")

    def _ref(self) -> DataFrame:
        modules = self.communities.select("file_path", F.col("id").alias("module"))
        return self.nodes.join(modules, "file_path", "left").select(F.col("id").alias("symbol_id"), "name", F.col("label").alias("type"), F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"), F.col("start_line").alias("endLine"), "module")

    def query(self, text: str, limit: int = 5) -> dict[str, Any]:
        if limit < 1:
            raise AnswerError("limit must be at least 1")
        hits = cut(V.search(self.nodes, text, self.process_steps, limit))
        ranked = hits.groupBy("process_id").agg(F.first("priority").alias("priority"), F.first("process_rank").alias("rank"))
        processes = ranked.join(self._labels(), "process_id").orderBy("rank").select(F.col("process_id").alias("id"), "summary", "priority", "symbol_count", F.lit("heuristic").alias("process_type"), "step_count")
        symbols = hits.join(self._ref(), "symbol_id").orderBy("process_rank", "symbol_rank").select(F.col("symbol_id").alias("id"), "name", "type", "filePath", "startLine", "endLine", "module", "process_id", "step_index")
        rest = V.definitions(self.nodes, text, self.process_steps, limit).join(self._ref(), "symbol_id").orderBy(F.desc("score"), "symbol_id").select(F.col("symbol_id").alias("id"), "name", "type", "filePath", "startLine", "endLine", "module")
        first: dict[str, dict[str, Any]] = {}
        for r in _rows(symbols):  # ten a process at most; each symbol once, where it ranks first
            first.setdefault(r["id"], r)
        return {"processes": _rows(processes), "process_symbols": list(first.values()), "definitions": _rows(rest)}

    def context(self, name: str | None = None, uid: str | None = None, file: str | None = None) -> dict[str, Any]:
        found = V.find_symbols(self.nodes, name, uid, file).orderBy("id").limit(11).collect()
        if not found:
            return {"error": f"no symbol {uid or name}"}
        if len(found) > 1:
            return {"status": "ambiguous", "candidates": [{"uid": r["id"], "name": r["name"], "kind": r["label"], "filePath": r["file_path"], "line": r["start_line"]} for r in found[:10]]}
        r = found[0]
        out: dict[str, Any] = {"status": "found", "symbol": {"uid": r["id"], "name": r["name"], "kind": r["label"], "filePath": r["file_path"], "startLine": r["start_line"], "endLine": r["start_line"]}, "incoming": {}, "outgoing": {}}
        for x in V.context(self.nodes, self.edges, r["id"]).orderBy("rel_type", "uid").collect():
            out[x["direction"]].setdefault(x["rel_type"], []).append({"uid": x["uid"], "name": x["name"], "filePath": x["file_path"], "kind": x["kind"]})
        steps = self.process_steps.where(F.col("symbol_id") == r["id"]).join(self._labels().select("process_id", "summary"), "process_id")
        out["processes"] = _rows(steps.select(F.col("process_id").alias("id"), F.col("summary").alias("name"), "step_index", "step_count").orderBy("id"))
        return out

    def impact(self, target: str, direction: str = "upstream", depth: int = 3, relations: list[str] | None = None, min_confidence: float = 0.0, tests: bool = False) -> dict[str, Any]:
        if direction not in ("upstream", "downstream") or depth < 1 or not 0 <= min_confidence <= 1:
            raise AnswerError("direction is upstream or downstream, depth at least 1, confidence in 0..1")
        start = V.impact_target(self.nodes, target).first()
        if start is None:
            return {"error": f"no symbol {target}"}
        kinds = tuple(k for k in dict.fromkeys(x.upper() for x in relations or ()) if k in G.RELATIONS) or G.RELATIONS
        found = cut(V.impact(self.nodes, self.edges, start["id"], direction == "upstream", depth, kinds, min_confidence, tests))
        processes = _rows(V.affected_processes(found, self.process_steps).join(self._labels().select("process_id", F.col("summary").alias("name")), "process_id").select("name", "hits", "broken_at_step", "step_count").orderBy(F.desc("hits"), "name"))
        modules = _rows(V.affected_modules(found, self.communities).select(F.col("module").alias("name"), "hits", "impact").orderBy(F.desc("hits"), "name"))
        rows = found.orderBy("depth", "id").collect()
        by_depth: dict[str, list] = {}
        for r in rows:
            by_depth.setdefault(str(r["depth"]), []).append({"depth": r["depth"], "id": r["id"], "name": r["name"], "type": r["label"], "filePath": r["file_path"], "relationType": r["rel_type"], "confidence": r["confidence"]})
        direct = len(by_depth.get("1", []))
        risk = self.spark.range(1).select(V.risk_of_impact(F.lit(direct), F.lit(len(processes)), F.lit(len(modules)), F.lit(len(rows)))).first()[0]
        return {
            "target": {"id": start["id"], "name": start["name"], "type": start["label"], "filePath": start["file_path"]}, "direction": direction, "impactedCount": len(rows), "risk": risk,
            "summary": {"direct": direct, "processes_affected": len(processes), "modules_affected": len(modules)}, "affected_processes": processes, "affected_modules": modules, "byDepth": by_depth,
        }

    def detect_changes(self, files: list[str] | None = None, scope: str = "unstaged", base: str | None = None) -> dict[str, Any]:
        if files is None:
            try:
                files = project.git_changed_files(self.meta["repoPath"], scope, base)
            except (OSError, ValueError, KeyError) as e:
                return {"error": str(e)}
        changed = self.spark.createDataFrame([(f,) for f in files], "file string")
        symbols = V.changed_symbols(self.nodes, changed).orderBy("id").collect()
        hit = V.affected_by_change(self.nodes, changed, self.process_steps).join(self._labels().select("process_id", F.col("summary").alias("name")), "process_id").orderBy(F.desc("n_steps"), "process_id")
        processes = [{"id": r["process_id"], "name": r["name"], "process_type": "heuristic", "step_count": r["step_count"], "changed_steps": [{"symbol": s["symbol"], "step": s["step"]} for s in r["changed_steps"]]} for r in hit.collect()]
        risk = self.spark.range(1).select(V.risk_of_change(F.lit(len(files)), F.lit(len(processes)))).first()[0]
        return {
            "summary": {"changed_count": len(symbols), "affected_count": len(processes), "changed_files": len(files), "risk_level": risk},
            "changed_symbols": [{"id": r["id"], "name": r["name"], "type": r["label"], "filePath": r["file_path"], "change_type": "Modified"} for r in symbols], "affected_processes": processes,
        }

    def rename(self, new: str, name: str | None = None, uid: str | None = None, file: str | None = None, apply: bool = False) -> dict[str, Any]:
        found = V.find_symbols(self.nodes, name, uid, file).orderBy("id").limit(11).collect()
        if not found:
            return {"error": f"no symbol {uid or name}"}
        if len(found) > 1:
            return {"status": "ambiguous", "candidates": [{"uid": r["id"], "filePath": r["file_path"]} for r in found[:10]]}
        old = found[0]["name"]
        if old == new or not new.isidentifier() or not new.isascii():
            raise AnswerError("the new name must be another identifier")
        plan = V.rename_plan(self.files, self.nodes, self.edges, found[0]["id"], new).orderBy("path", "line_no").collect()
        changes: dict[str, list] = {}
        for r in plan:
            changes.setdefault(r["path"], []).append({"line": r["line_no"], "old_text": r["old_text"], "new_text": r["new_text"], "confidence": r["confidence"]})
        if apply:
            self._apply(changes, old, new)
        graph = sum(e["confidence"] == "graph" for edits in changes.values() for e in edits)
        return {"status": "success", "old_name": old, "new_name": new, "files_affected": len(changes), "total_edits": len(plan), "graph_edits": graph, "text_search_edits": len(plan) - graph, "changes": [{"file_path": p, "edits": e} for p, e in changes.items()], "applied": apply}

    def _apply(self, changes: dict[str, list], old: str, new: str) -> None:
        """Writes a plan's edits; nothing is written unless every file still holds the planned lines."""
        pattern = re.compile(rf"(?<![A-Za-z0-9_$]){re.escape(old)}(?![A-Za-z0-9_$])")
        texts = {}
        for path, edits in changes.items():
            with Path(self.meta["repoPath"], path).open(newline="") as f:
                texts[path] = f.read()
            lines = texts[path].split("\n")
            if any(e["line"] > len(lines) or lines[e["line"] - 1].strip() != e["old_text"] for e in edits):
                raise AnswerError(f"{path} has changed since it was indexed")
        for path, text in texts.items():
            with Path(self.meta["repoPath"], path).open("w", newline="") as f:
                f.write(pattern.sub(lambda _: new, text))

    def cypher(self, text: str) -> dict[str, Any]:
        try:
            df = cut(cypher.run(text, self.nodes, self.edges))
        except cypher.QueryError as e:
            return {"error": str(e)}
        return {"markdown": cypher.markdown(df, 10_000), "row_count": df.count()}

    def search(self, text: str, limit: int = 10) -> dict[str, Any]:
        limit = max(1, min(100, limit))
        rows = V.search_index(self.words, text, limit).select(F.col("id").alias("symbol_id"), "score").join(self._ref(), "symbol_id").orderBy(F.desc("score"), "name", "filePath")
        return {"processes": [], "process_symbols": [], "definitions": _rows(rows.select(F.col("symbol_id").alias("id"), "name", "type", "filePath", "startLine", "endLine", "score"))}

    def file(self, path: str) -> str | None:
        """A scanned file's content; only scanned paths exist here."""
        r = self.files.where(F.col("path") == path).select("content").first()
        return r["content"] if r else None

    def process_list(self) -> list[dict[str, Any]]:
        return _rows(self._labels().orderBy(F.desc("step_count"), "process_id"))

    def process(self, key: str) -> dict[str, Any] | None:
        r = self._labels().where((F.col("process_id") == key) | (F.col("summary") == key)).first()
        if r is None:
            return None
        steps = self.process_steps.where(F.col("process_id") == r["process_id"]).join(self._ref(), "symbol_id").orderBy("step_index")
        return r.asDict() | {"steps": _rows(steps.select("step_index", "symbol_id", "name", "type", "filePath"))}

    def cluster_list(self) -> list[dict[str, Any]]:
        return _rows(G.community_labels(self.communities).orderBy(F.desc("file_count"), "id"))

    def cluster(self, key: str) -> dict[str, Any] | None:
        r = G.community_labels(self.communities).where((F.col("id") == key) | (F.col("heuristic_label") == key)).orderBy("id").first()
        return None if r is None else r.asDict() | {"files": [x["file_path"] for x in self.communities.where(F.col("id") == r["id"]).orderBy("file_path").collect()]}

    def wiki(self, folder: str) -> list[str]:
        pages = report.wiki(self.nodes, G.module_edges(self.edges, self.nodes, self.communities), G.community_labels(self.communities), self.processes)
        Path(folder).mkdir(parents=True, exist_ok=True)
        for name, text in pages.items():
            Path(folder, name).write_text(text + "\n")
        return sorted(pages)

    def augment(self, text: str) -> str:
        """The five symbols in most flows, with three flows each; silent for inputs of under three characters."""
        if len(text.strip()) < 3:
            return ""
        best = V.search_scores(self.nodes, text).orderBy(F.desc("score"), "id").limit(20)
        flows = best.join(self.process_steps.withColumnRenamed("symbol_id", "id"), "id", "left").join(self._labels().select("process_id", "summary"), "process_id", "left")
        rows = flows.groupBy("id", "name", "file_path").agg(F.array_sort(F.collect_set("summary")).alias("flows")).orderBy(F.desc(F.size("flows")), "id").limit(5).collect()
        return "\n".join(f"{r['name']} ({r['file_path']})" + "".join(f"\n  in {f}" for f in r["flows"][:3]) for r in rows)
