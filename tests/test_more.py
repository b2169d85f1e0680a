"""Components and searches at their limits, memberships, the stemmer and the symbol index, several repos, the pruned scan."""

import random

import pytest
from pyspark.sql import functions as F

from codeweft import cli, engine, serve
from codeweft.functions.stem import stem
from codeweft.functions.text import truncate, url_decode
from codeweft.operators import components as K
from codeweft.operators import graph as G
from codeweft.operators import verbs as V
from codeweft.operators.skew import Agg, heavy_keys, salted_aggregate
from codeweft.sources import scan


def brute(pairs):
    of = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(of[a], of[b])
            changed |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    return of


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAST_HEAVY", 5)
    r = random.Random(4)
    pairs = [("n500", f"n{r.randint(0, 300)}") for _ in range(150)] + [(f"m{r.randint(0, 60)}", f"m{r.randint(0, 60)}") for _ in range(40)] + [(f"z{i}", f"z{i + 1}") for i in range(40)] + [("q", "q"), (None, "q")]
    df = spark.createDataFrame(pairs, "src string, dst string").repartition(5)
    got = {x["id"]: x["component"] for x in K.connected_components(df).collect()}
    assert got == brute([p for p in pairs if p[0] and p[0] != p[1]])


def test_depths_both_ways(spark, monkeypatch):
    edges = [("a", f"a{i}", f"a{i + 1}") for i in range(7)] + [("a", "a0", "a5"), ("b", "b1", "b0"), ("c", "c0", "c1"), ("c", "c1", "c0")]
    starts = [("a", "a0"), ("b", "b0"), ("c", "c0"), ("d", "d0")]
    e, s = spark.createDataFrame(edges, "root string, src string, dst string"), spark.createDataFrame(starts, "root string, id string")
    want = {"a": 4, "b": 0, "c": 1, "d": 0}
    assert {r["root"]: r["depth"] for r in K.depths(e, s).collect()} == want
    monkeypatch.setattr(K, "SEARCH_EDGES", 1)
    assert {r["root"]: r["depth"] for r in K.depths(e, s).collect()} == want


def test_memberships_and_index(spark):
    nodes = spark.createDataFrame([("Function:a.ts:loadGraphs:1", "Function", "loadGraphs", "a.ts", 1, None), ("Class:b.ts:Store:1", "Class", "Store", "b.ts", 1, None), ("File:a.ts", "File", "a.ts", "a.ts", None, None)], "id string, label string, name string, file_path string, start_line bigint, language string")
    community = spark.createDataFrame([("community_1", "a.ts"), ("community_1", "b.ts")], "id string, file_path string")
    steps = spark.createDataFrame([("process_1", "Class:b.ts:Store:1", 1, 2)], "process_id string, symbol_id string, step_index int, step_count bigint")
    got = {(r["source_id"], r["target_id"], r["rel_type"], r["reason"]) for r in G.memberships(community, steps, nodes).collect()}
    assert got == {("Function:a.ts:loadGraphs:1", "community_1", "MEMBER_OF", ""), ("Class:b.ts:Store:1", "community_1", "MEMBER_OF", ""), ("Class:b.ts:Store:1", "process_1", "STEP_IN_PROCESS", "1")}
    files = spark.createDataFrame([("a.ts", "function loadGraphs() { loading the graph }"), ("b.ts", "class Store { graphs }")], "path string, content string")
    index = V.symbol_index(nodes, files)
    assert [r["id"] for r in V.search_index(index, "loaded stores graphing").collect()][:2]
    assert {r["id"] for r in V.search_index(index, "graphing").collect()} == {"Function:a.ts:loadGraphs:1", "Class:b.ts:Store:1"}
    assert V.search_index(index, "nothing").count() == 0


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("digitizer", "digit"), ("hopefulness", "hope"), ("adoption", "adopt"), ("controll", "control"), ("x_y", "x_y"), ("is", "is")])
def test_stem(word, want):
    assert stem(word) == want


def test_scan_reads_only_what_it_keeps(spark, tmp_path):
    for name in ("src/a.ts", "src/[id].tsx", "src/a b%20+c.py", "node_modules/x/deep/b.ts", "deep/.git/c.ts", "x.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("let x = 1")
    (tmp_path / "src" / "big.ts").write_text("x" * 524_289)
    (tmp_path / "src" / "raw.py").write_bytes(b"\xff\xfe\x00")
    assert len(scan.kept_files(spark, str(tmp_path))) == 6
    got = {r["path"]: (r["content"], r["skipped_large"]) for r in scan.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": ("let x = 1", False), "src/[id].tsx": ("let x = 1", False), "src/a b%20+c.py": ("let x = 1", False), "src/big.ts": (None, True), "src/raw.py": (None, False)}
    assert scan.scan_tree(spark, str(tmp_path / "deep")).count() == 0


def test_several_repos(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name / "src").mkdir(parents=True)
        (tmp_path / name / "src" / f"{name}.ts").write_text(f"export function of{name}() {{}}\n")
    first = engine.read_through(spark, str(tmp_path / "one"))
    other = engine.read_through(spark, str(tmp_path / "two"))
    repos = serve.Repos(first, {other.meta["repoPath"]: {"name": "two", **other.meta}})
    assert len(serve.call(repos, "list_repos", {})) == 2
    assert serve.call(repos, "context", {"name": "oftwo", "repo": "TWO"})["status"] == "found"
    assert "error" in serve.call(repos, "context", {"name": "oftwo"})
    with pytest.raises(engine.AnswerError):
        repos.pick("three")
    with pytest.raises(engine.AnswerError):
        repos.pick("o")
    (tmp_path / "one" / "src" / "one.ts").write_text("export function changed() {}\n")
    with pytest.raises(engine.AnswerError):
        first.rename("other", name="ofone", apply=True)
    assert "changed" in (tmp_path / "one" / "src" / "one.ts").read_text()


def test_augment_is_a_silent_hook(tmp_path, capsys):
    assert cli.main(["--repo", str(tmp_path), "--registry", "/nonexistent", "augment", "anything"]) == 0
    assert cli.main(["--repo", str(tmp_path), "--registry", "/nonexistent", "augment", "ab"]) == 0
    out = capsys.readouterr()
    assert out.out == "" and out.err == ""
    assert cli.main(["--repo", str(tmp_path), "--registry", "/nonexistent", "detect-changes", "--scope", "compare"]) == 2


def test_text(spark):
    df = spark.createDataFrame([("a%20b+c",), ("100%",), ("%zz%41",), ("%ff",), (None,)], "s string")
    assert [r[0] for r in df.select(url_decode(F.col("s"))).collect()] == ["a b c", "100%", "%zzA", "�", None]
    assert [r[0] for r in spark.createDataFrame([("abcd",), ("ab",), (None,)], "s string").select(truncate(F.col("s"), 3)).collect()] == ["abc...", "ab", None]


def test_sketch_is_as_large_as_the_share_needs(spark):
    df = spark.range(20_000).selectExpr("concat('k', pmod(id, 900)) as k", "id as v")
    assert len(heavy_keys(df, F.col("k"), 0.001)) == 900
    with pytest.raises(ValueError):
        heavy_keys(df, F.col("k"), 1e-7)
    rows = {r["k"]: (r["n"], r["d"]) for r in salted_aggregate(df.withColumn("v", F.expr("pmod(v, 7)")), "k", [Agg("count", None, "n")], distinct=("v", "d")).collect()}
    assert len(rows) == 900 and all(d <= 7 for _, d in rows.values()) and sum(n for n, _ in rows.values()) == 20_000
