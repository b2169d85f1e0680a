import json
import random
import re

import pytest
from pyspark.sql import functions as F

from codeweft.functions.paths import normal_path
from codeweft.functions.text import search_tokens, word_after
from codeweft.operators import calls as C
from codeweft.operators import graph as G
from codeweft.operators import imports as I
from codeweft.operators import symbols as S
from codeweft.sources import project, scan


def files(spark, *rows):
    df = spark.createDataFrame([("r", *x) for x in rows], "repo string, path string, content string")
    return df.withColumn("language", scan.language_of(F.col("path")))


def test_languages_and_ignored(spark):
    df = spark.createDataFrame([(x,) for x in ["src/main.tsx", "src/server.js", "src/main.rs", "src/app.kt", "README.md", "a.mjs", "node_modules/react/index.js", "src/types/global.d.ts", "assets/logo.png", "src\\build\\x.rs", "build", "LICENSE", None]], "path string")
    got = {r["path"]: (r["l"], r["i"]) for r in df.select("path", scan.language_of(F.col("path")).alias("l"), scan.ignored_path(F.col("path")).alias("i")).collect()}
    assert [got[x][0] for x in ("src/main.tsx", "src/server.js", "src/main.rs", "src/app.kt", "README.md", "a.mjs")] == ["typescript", "javascript", "rust", "kotlin", None, None]
    assert {k for k, v in got.items() if v[1]} == {"node_modules/react/index.js", "src/types/global.d.ts", "assets/logo.png", "src\\build\\x.rs", "LICENSE"}


def test_scan_of_a_tree(spark, tmp_path):
    for name, data in {"src/main.rs": b"fn a() {}\n", "node_modules/x.js": b"x", "src/huge.ts": b"x" * 524_289, "src/bad.ts": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r for r in scan.scan_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/main.rs", "src/huge.ts", "src/bad.ts"}
    assert [k for k, r in got.items() if r["skipped_large"]] == ["src/huge.ts"]
    assert got["src/main.rs"]["content"] == "fn a() {}\n" and got["src/bad.ts"]["content"] is None and got["src/huge.ts"]["content"] is None


def test_word_after(spark):
    rows = [("pub fn run(value: i32) {}", "run"), ("somethingfn bad() fn ok()", None), ("fn   9x$_ y", "9x$_"), ("fn (", None), ("nothing", None), (None, None)]
    df = spark.createDataFrame(rows, "line string, want string").select("want", word_after(F.col("line"), "fn ").alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_symbols(spark):
    df = files(spark, ("a.rs", "struct A {}\nfn b() {}\ntrait C {}"), ("b.ts", "export interface I {}\r\nclass K { }\nfunction f() {}"), ("c.py", "class P:\n  def m(self): pass\n"), ("d.go", "func F() {}\nfunc (r *T) M() {}\ntype Z struct"), ("e.md", "class No"))
    assert {r["id"] for r in S.symbols(df).collect()} == {"Struct:a.rs:A:1", "Function:a.rs:b:2", "Trait:a.rs:C:3", "Interface:b.ts:I:1", "Class:b.ts:K:2", "Function:b.ts:f:3", "Class:c.py:P:1", "Function:c.py:m:2", "Function:d.go:F:1", "Type:d.go:Z:3"}


def test_specifiers(spark):
    df = files(
        spark,
        ("a.ts", "import { x } from './u'\nimport 'side'\nconst y = require(\"z\")\n// import q from 'no'\nexport * from \"e\"\n} from 'missed'"),
        ("b.go", 'import "one"\nimport (\n  "two"\n  t "three"\n)\nvar s = "no"'),
        ("c.php", "use A\\B, C as D;\nuse function F\\g;\nuse P\\{Q, R as S};\nuse ($x);"),
        ("d.cs", "using System;\nusing static A.B;\nusing X = C.D;\nusing (var f = g()) {}"),
    )
    got = [(r["path"], r["specifier"]) for r in I.import_specifiers(df).collect()]
    assert sorted(got) == sorted([("a.ts", "./u"), ("a.ts", "side"), ("a.ts", "z"), ("a.ts", "e"), ("b.go", "one"), ("b.go", "two"), ("b.go", "three"), ("c.php", "A\\B"), ("c.php", "C"), ("c.php", "F\\g"), ("c.php", "P\\Q"), ("c.php", "P\\R"), ("d.cs", "System"), ("d.cs", "A.B"), ("d.cs", "C.D")])


def test_resolution(spark):
    df = files(spark, ("src/main.ts", "import a from './utils'\nimport b from 'core/lib/math'\nimport c from '../src/dir'"), ("src/utils.ts", ""), ("packages/core/lib/math.ts", ""), ("src/dir/index.ts", ""), ("m.go", 'import "x/pkg/math"'), ("x/pkg/math/math.go", ""), ("x/pkg/math/a_test.go", ""))
    spec = I.import_specifiers(df).join(df.select("path", "repo"), "path")
    got = {(r["source_file"], r["target_file"]) for r in I.resolve_imports(spec, df.select("repo", "path")).collect()}
    assert got == {("src/main.ts", "src/utils.ts"), ("src/main.ts", "packages/core/lib/math.ts"), ("src/main.ts", "src/dir/index.ts"), ("m.go", "x/pkg/math/math.go")}


def brute_calls(line):
    """What the pattern must find, character by character."""
    out, i, ok = [], 0, lambda c: c.isascii() and (c.isalnum() or c in "_$")
    while i < len(line):
        if not (line[i].isascii() and (line[i].isalpha() or line[i] in "_$")):
            i += 1
            continue
        s = i
        while i < len(line) and ok(line[i]):
            i += 1
        j = i
        while j < len(line) and line[j] in " \t":
            j += 1
        if j < len(line) and line[j] == "(" and line[:s].rstrip()[-1:] not in (".", ":"):
            out.append(line[s:i])
    return [x for x in out if x not in C.NO_CALLS]


def test_call_pattern_against_brute_force(spark):
    r = random.Random(4)
    rows = ["".join(r.choice(["a", "b9", "_", "$", ".", ":", " ", "(", ")", "9", "if", "new "]) for _ in range(r.randint(1, 14))) for _ in range(400)]
    got = spark.createDataFrame([(x,) for x in rows], "line string").select("line", C.call_names(F.col("line")).alias("c")).collect()
    assert [x["c"] for x in got] == [brute_calls(x["line"].split("//")[0]) for x in got]


def test_calls_and_heritage(spark):
    df = files(
        spark,
        ("a.ts", "import { helper, Base, Worker } from './b'\nfunction run() {\n  helper(1); local(); run()\n  x.method()\n}\nfunction local() {}\nclass Service extends Base implements Worker {\n}\ninterface Adv extends Worker {}"),
        ("b.ts", "export function helper() {}\nexport class Base {}\nexport interface Worker {}"),
    )
    symbols = S.symbols(df)
    imports = I.resolve_imports(I.import_specifiers(df).join(df.select("path", "repo"), "path"), df.select("repo", "path"))
    got = {tuple(r) for r in C.calls(df, symbols, imports).collect()}
    assert got == {("Function:a.ts:run:2", "Function:b.ts:helper:1", 0.7), ("Function:a.ts:run:2", "Function:a.ts:local:6", 0.9)}
    rel = {(r["source_id"], r["target_id"], r["rel_type"], r["confidence"]) for r in C.heritage(df, symbols, imports).collect()}
    assert rel == {("Class:a.ts:Service:7", "Class:b.ts:Base:2", "EXTENDS", 0.7), ("Class:a.ts:Service:7", "Interface:b.ts:Worker:3", "IMPLEMENTS", 0.7), ("Interface:a.ts:Adv:9", "Interface:b.ts:Worker:3", "EXTENDS", 0.7)}
    nodes = G.build_nodes(df, symbols)
    edges = G.build_edges(df, symbols, imports, C.calls(df, symbols, imports), C.heritage(df, symbols, imports), nodes)
    kinds = {r["rel_type"]: r["count"] for r in edges.groupBy("rel_type").count().collect()}
    assert kinds == {"DEFINES": 7, "IMPORTS": 1, "CALLS": 2, "EXTENDS": 2, "IMPLEMENTS": 1}


@pytest.mark.parametrize(
    "line,want",
    [
        ("app.get('/users', listUsers)", ["listUsers"]), ("app.get('/h', [healthCheck, auth.check])", ["healthCheck", "check"]), ("r.use(listUsers)", ["listUsers"]), ("r.use('/x', a, b)", ["a", "b"]),
        ("r.post('/a,b', wrap(ctrl.save))", ["save"]), ("r.get('/x', (req, res) => res.send())", []), ("r.get('/x', h.bind(this))", ["this"]), ("r.get('/x', 'str', req)", []), ("r.get('/x', ", []), ("plain", []),
    ],
)
def test_route_handlers(line, want):
    assert C.route_handlers(line) == want


def test_routes(spark):
    df = files(
        spark,
        ("routes/web.php", "<?php\nRoute::get('/u', [UserController::class, 'index']);\nRoute::apiResource('p', PhotoController::class);"),
        ("app/UserController.php", "class UserController {\nfunction index() {}\n}"),
        ("src/routes.ts", "import { listUsers } from './h'\nrouter.get('/users', listUsers)"),
        ("src/h.ts", "export function listUsers() {}"),
    )
    symbols = S.symbols(df)
    imports = I.resolve_imports(I.import_specifiers(df).join(df.select("path", "repo"), "path"), df.select("repo", "path"))
    assert {(r["controller"], r["method"]) for r in C.laravel_routes(df).collect()} == {("UserController", "index"), *(("PhotoController", m) for m in C.API_RESOURCE)}
    got = {tuple(r) for r in C.route_calls(df, symbols, imports).collect()}
    assert got == {("File:routes/web.php", "Function:app/UserController.php:index:2", 0.65), ("File:src/routes.ts", "Function:src/h.ts:listUsers:1", 0.7)}


def test_paths_and_tokens(spark):
    rows = [("a//b/./c/../d", "a/b/d"), ("../../x", "x"), ("a\\b", "a/b"), ("/a/", "a"), ("a.b/c", "a.b/c"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "p string, want string").select("want", normal_path(F.col("p")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())
    assert spark.range(1).select(search_tokens(F.lit("Load-Graph a É src/x_y load"))).first()[0] == ["load", "graph", "src/x_y", "load"]
    tree = G.path_tree(spark.createDataFrame([("src/main.rs",), ("src/lib.rs",), ("tests/basic.rs",)], "path string"))
    assert tree.count() == 5 and tree.where("parent_id is not null").count() == 3
    assert [r["t"] for r in spark.createDataFrame([("src/a.test.ts",), ("tests/x.py",), ("a/tests/x.py",), (None,)], "p string").select(G.is_test_path(F.col("p")).alias("t")).collect()] == [True, False, True, None]


def test_project_files():
    base, paths = project.tsconfig_paths('{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@core/*": ["src/lib/*"], "@core/x/*": ["x/*"],}} }')
    assert base == "." and paths == [("@core/x/", "x/"), ("@core/", "src/lib/")]
    assert project.tsconfig_paths('{"compilerOptions": {"paths": {"*": ["x/*"]}}}') == (None, [])
    assert project.tsconfig_of(["{", '{"compilerOptions": {"baseUrl": "a"}}', '{"compilerOptions": {"baseUrl": "b"}}']) == ("a", [])
    assert project.tsconfig_of(['{"compilerOptions": {"baseUrl": "a"}}', '{"compilerOptions": {"paths": {"@/*": ["s/*"]}}}']) == (None, [("@/", "s/")])
    two = [("", "Acme"), ("lib", "Acme"), ("app/x", "Acme")]
    assert project.csharp_path("Acme.Y", two, "lib/a.cs") == ["lib/Y", "app/x/Y", "Y"] and project.csharp_path("Acme.Y", two) == ["app/x/Y", "lib/Y", "Y"]
    assert project.go_path("github.com/acme/demo/pkg/math", project.go_module("// x\nmodule github.com/acme/demo\n")) == "pkg/math"
    assert project.psr4_path("App\\Services\\Greeter", project.psr4_prefixes(json.dumps({"autoload": {"psr-4": {"App\\": "src/", "": "all/"}}}))) == ["src/Services/Greeter"]
    assert project.csharp_path("MyCompany.Product.Services", [project.csproj_namespace("app/App.csproj", "<RootNamespace>MyCompany.Product</RootNamespace>")]) == ["app/Services"]
    assert project.csproj_namespace("x/Y.csproj", "") == ("x", "Y") and re.match(r"^$", project.git_commit("/"))
