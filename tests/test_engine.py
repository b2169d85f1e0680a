import json
import threading
import urllib.request

import pytest

from codeweft import cli, engine, serve
from codeweft.operators import imports as I
from codeweft.sources import scan
from pyspark.sql import functions as F

TREE = {
    "src/main.ts": "import { helper } from '@lib/helper'\nimport { Base } from './base'\nexport function run() {\n  helper(1)\n}\nexport class Main extends Base {}\n",
    "src/lib/helper.ts": "export function helper(x) {\n  return deep(x)\n}\nfunction deep(x) { return x }\n",
    "src/base.ts": "export class Base {}\n",
    "src/alone.py": "def alone():\n    pass\n",
    "tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["src/lib/*"]}} }',
    "node_modules/x/i.js": "function no() {}",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    meta = engine.analyze(spark, str(root))
    return root, meta, engine.Engine(spark, str(engine.find_index(str(root / "src"))))


def test_analyze(built):
    root, meta, e = built
    assert meta["stats"]["languageBreakdown"] == {"python": 1, "typescript": 3} and meta["stats"]["skippedLarge"] == 0
    kinds = {r["rel_type"]: r["count"] for r in e.edges.groupBy("rel_type").count().collect()}
    assert kinds["IMPORTS"] == 2 and kinds["CALLS"] == 2 and kinds["EXTENDS"] == 1
    assert e.processes.count() == 1 and e.processes.first()["step_count"] == 3


def test_answers(built):
    _, _, e = built
    got = e.query("helper")
    assert got["processes"][0]["summary"] == "process_1 -> run" and got["process_symbols"][0]["name"] == "helper" and got["process_symbols"][0]["module"]
    assert e.query("alone")["definitions"][0]["name"] == "alone" and e.query("x")["processes"] == []
    c = e.context("helper")
    assert c["status"] == "found" and c["incoming"]["calls"][0]["name"] == "run" and c["outgoing"]["calls"][0]["name"] == "deep" and c["processes"][0]["step_count"] == 3
    assert "error" in e.context("nobody")
    up = e.impact("deep")
    assert up["impactedCount"] == 2 and up["risk"] == "LOW" and [x["name"] for x in up["byDepth"]["2"]] == ["run"] and up["affected_processes"][0]["hits"] == 2
    with pytest.raises(engine.AnswerError):
        e.impact("deep", depth=0)
    d = e.detect_changes(["src/lib/helper.ts"])
    assert d["summary"] == {"changed_count": 2, "affected_count": 1, "changed_files": 1, "risk_level": "medium"}
    assert e.detect_changes([])["summary"]["risk_level"] == "none"
    assert e.cypher("MATCH (n:Class) RETURN n.name")["row_count"] == 2 and "error" in e.cypher("MATCH (n) DROP n")
    assert e.search("helper return")["definitions"][0]["name"] in ("helper", "deep")
    assert e.file("src/base.ts") == TREE["src/base.ts"] and e.file("../x") is None
    assert len(e.process("process_1")["steps"]) == 3 and e.cluster(e.cluster_list()[0]["id"])["files"] and e.process("none") is None
    assert "helper" in e.augment("helper") and e.augment("ab") == ""


def test_rename_and_wiki(built, tmp_path):
    root, _, e = built
    plan = e.rename("assist", name="helper")
    assert plan["status"] == "success" and plan["total_edits"] == 3 and plan["graph_edits"] == 3 and not plan["applied"]
    assert "helper" in (root / "src/main.ts").read_text()
    e.rename("assist", name="helper", apply=True)
    assert "assist(1)" in (root / "src/main.ts").read_text() and "helper'" not in (root / "src/lib/helper.ts").read_text()
    with pytest.raises(engine.AnswerError):
        e.rename("not a name", name="helper")
    assert len(e.wiki(str(tmp_path / "wiki"))) == 5


def test_http_and_rpc(built):
    _, _, e = built
    thread = threading.Thread(target=serve.http, args=(e, 18747), daemon=True)
    thread.start()

    def ask(path, body=None):
        for _ in range(50):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:18747{path}", json.dumps(body).encode() if body is not None else None), timeout=60) as r:
                    return r.status, json.loads(r.read())
            except urllib.error.HTTPError as x:
                return x.code, json.loads(x.read())
            except urllib.error.URLError:
                threading.Event().wait(0.1)

    assert ask("/health") == (200, {"status": "ok"})
    assert ask("/api/query", {"cypher": "MATCH (n:Class) RETURN COUNT(*)"})[1]["row_count"] == 1
    assert ask("/tool/impact", {"target": "deep"})[1]["impactedCount"] == 2
    assert ask("/nothing")[0] == 404 and ask("/tool/impact", {"target": "deep", "depth": 0})[0] == 400
    assert ask("/shutdown", {})[0] == 200
    thread.join(10)
    assert not thread.is_alive()
    call = lambda method, **params: serve.rpc(e, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert len(call("tools/list")["result"]["tools"]) == 7 and call("no")["error"]["code"] == -32601
    assert "helper" in call("tools/call", name="search", arguments={"query": "helper"})["result"]["content"][0]["text"]
    assert call("resources/read", uri="codegraph://clusters")["result"] and call("resources/read", uri="codegraph://x")["error"]
    assert serve.rpc(e, {"method": "notifications/initialized"}) is None


def test_cli_arguments(capsys):
    for bad in (["query", "x", "--limit", "0"], ["impact", "x", "--direction", "sideways"], ["detect-changes", "--scope", "none"], []):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
    assert cli.parser().parse_args(["impact", "x"]).depth == 3
    assert cli.main(["--registry", "/nonexistent", "list"]) == 0 and capsys.readouterr().out.strip() == "[]"


@pytest.mark.parametrize(
    "paths,config,source,spec,want",
    [
        (["src/lib/math.ts", "a.ts"], I.ProjectConfig(".", (("@core/", "src/lib/"),)), "a.ts", "@core/math", "src/lib/math.ts"),
        (["src/utils.ts", "a.ts"], I.ProjectConfig("."), "a.ts", "src/utils", "src/utils.ts"),
        (["pkg/math/math.go", "pkg/math/a.go", "m.go"], I.ProjectConfig(go_module="github.com/acme/demo"), "m.go", "github.com/acme/demo/pkg/math", "pkg/math/math.go"),
        (["src/Services/Greeter.php", "x.php"], I.ProjectConfig(psr4=(("App\\", "src"),)), "x.php", "App\\Services\\Greeter", "src/Services/Greeter.php"),
        (["app/Services/Worker.cs", "app/P.cs"], I.ProjectConfig(csharp=(("app", "MyCompany.Product"),)), "app/P.cs", "MyCompany.Product.Services", "app/Services/Worker.cs"),
        (["packages/core/lib/math.ts", "a.ts"], None, "a.ts", "core/lib/math", "packages/core/lib/math.ts"),
    ],
)
def test_configured_imports(spark, paths, config, source, spec, want):
    df = spark.createDataFrame([("", p) for p in paths], "repo string, path string")
    asked = spark.createDataFrame([("", source, spec)], "repo string, path string, specifier string").withColumn("language", scan.language_of(F.col("path")))
    assert [tuple(r) for r in I.resolve_imports(asked, df, config).collect()] == [("", source, want)]
