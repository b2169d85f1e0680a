import random

import pytest
from pyspark.sql import functions as F

from codeweft.operators import cypher, report
from codeweft.operators import graph as G
from codeweft.operators import verbs as V
from codeweft.operators.components import connected_components, levels
from codeweft.sources import store
from codeweft.streaming.ingest import ingest

NODES = "id string, label string, name string, file_path string, start_line bigint, language string"
EDGES = "id string, source_id string, target_id string, rel_type string, confidence double, reason string"


def nodes(spark, names):
    return spark.createDataFrame([(n, "Function", n.split(":")[-1], f"src/{n[0]}.ts", 1, "typescript") for n in names], NODES)


def edges(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(f"{kind}:{a}->{b}", a, b, kind, 0.9, "") for a, b in pairs], EDGES)


def test_components_against_union_find(spark):
    r = random.Random(2)
    pairs = [(f"v{r.randint(0, 80):03}", f"v{r.randint(0, 80):03}") for _ in range(45)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    want = {x: root(x) for x in parent}
    df = spark.createDataFrame([*pairs, (None, "x"), *pairs[:5]], "src string, dst string")
    assert {r["id"]: r["component"] for r in connected_components(df).collect()} == want
    alone = spark.createDataFrame([("zz",), ("v001",)], "id string")
    assert {r["id"]: r["component"] for r in connected_components(df, alone).collect()} == {"v001": want.get("v001", "v001")} | want | {"zz": "zz"}
    assert connected_components(df.limit(0)).count() == 0


def test_levels(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("x", "y")], "src string, dst string")
    starts = spark.createDataFrame([("r", "a")], "root string, id string")
    assert {r["id"]: r["depth"] for r in levels(df, starts).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r["id"] for r in levels(df, starts, 1).collect()} == {"a", "b", "c"}


def test_processes(spark):
    e = edges(spark, [("b", "a"), ("a", "c"), ("x", "y"), ("y", "x"), ("s", "s")])
    got = {r["id"]: (r["entry_symbol_id"], r["symbol_count"], r["step_count"]) for r in G.processes(e).collect()}
    assert got == {"process_1": ("b", 3, 3), "process_2": ("x", 2, 2)}
    members = G.process_members(e)
    steps = G.process_steps(G.processes(e, members), members, entry_first=True)
    assert [r["symbol_id"] for r in steps.where("process_id = 'process_1'").orderBy("step_index").collect()] == ["b", "a", "c"]


def test_communities(spark):
    n = nodes(spark, ["a:f", "b:g", "c:h", "d:i"])
    got = {r["file_path"]: r["id"] for r in G.communities(edges(spark, [("a:f", "b:g"), ("c:h", "c:h")]), n).collect()}
    assert got == {"src/a.ts": "community_1", "src/b.ts": "community_1", "src/c.ts": "community_2"}
    files = spark.createDataFrame([("File:x/a", "File", "a", "x/a", None, None), ("File:r", "File", "r", "r", None, None)], NODES)
    assert {r["file_path"]: r["id"] for r in G.communities(edges(spark, []), files).collect()} == {"r": "community_1", "x/a": "community_2"}


def test_impact_and_context(spark):
    n = nodes(spark, ["a:f", "b:g", "c:h", "d:i"]).unionByName(spark.createDataFrame([("t:x", "Function", "x", "src/tests/t.ts", 1, None), ("File:q", "File", "q", "q", None, None)], NODES))
    e = edges(spark, [("b:g", "a:f"), ("c:h", "b:g"), ("t:x", "a:f"), ("d:i", "t:x"), ("File:q", "a:f"), ("a:f", "b:g")])
    assert {r["id"]: r["depth"] for r in V.impact(n, e, "a:f").collect()} == {"b:g": 1, "c:h": 2}
    assert {r["id"]: r["depth"] for r in V.impact(n, e, "a:f", tests=True).collect()} == {"b:g": 1, "c:h": 2, "t:x": 1, "d:i": 2}
    up = {r["id"] for r in V.impact(n, e, "a:f").collect()}
    back = e.select("id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "rel_type", "confidence", "reason")
    assert {r["id"] for r in V.impact(n, back, "a:f", upstream=False).collect()} == up
    assert V.impact(n, e, "a:f", min_confidence=0.95).count() == 0
    got = {(r["direction"], r["uid"]) for r in V.context(n, e, "a:f").collect()}
    assert got == {("incoming", "b:g"), ("incoming", "t:x"), ("incoming", "File:q"), ("outgoing", "b:g")}


def test_search_changes_and_rename(spark):
    n = nodes(spark, ["a:load", "b:loader", "c:other"])
    assert {r["id"]: r["score"] for r in V.search_scores(n, "load load").collect()} == {"a:load": 24.0, "b:loader": 12.0}
    changed = spark.createDataFrame([("a.ts",), ("",)], "file string")
    assert {r["id"] for r in V.changed_symbols(n, changed).collect()} == {"a:load"}
    files = spark.createDataFrame([("src/a.ts", "foo $foo foo1\n  foo();\nx"), ("src/b.ts", "foo.bar"), ("src/c.ts", None)], "path string, content string")
    got = {(r["path"], r["line_no"], r["new_text"]) for r in V.rename_edits(files, "foo", "b$r").collect()}
    assert got == {("src/a.ts", 1, "b$r $foo foo1"), ("src/a.ts", 2, "b$r();"), ("src/b.ts", 1, "b$r.bar")}
    target = spark.createDataFrame([("a:foo", "Function", "foo", "src/a.ts", 1, None)], NODES)
    assert {r["path"]: r["confidence"] for r in V.rename_plan(files, target, edges(spark, []), "a:foo", "x").collect()} == {"src/a.ts": "graph", "src/b.ts": "text_search"}


def test_ranking_properties(spark):
    docs = spark.createDataFrame([(1, "graph store graph"), (2, "graph of many other words and more words"), (3, "none"), (4, None)], "k bigint, t string")
    got = [(r["k"], r["score"]) for r in V.bm25(docs, "k", "t", "graph store").collect()]
    assert [k for k, _ in got] == [1, 2] and got[0][1] > got[1][1] > 0


@pytest.mark.parametrize("text", ["MATCH (n) RETURN n", "MATCH () RETURN COUNT(*)", "MATCH (n) DELETE n RETURN n.id", "MATCH (n) WHERE n.a = 1 RETURN n.id", "", "MATCH (n) RETURN n.id ORDER BY n.id"])
def test_refused_patterns(text):
    with pytest.raises(cypher.QueryError):
        cypher.parse(text)


def test_patterns(spark):
    n, e = nodes(spark, ["a:f", "b:g", "c:h"]), edges(spark, [("a:f", "b:g"), ("b:g", "c:h")])
    run = lambda t: [tuple(r) for r in cypher.run(t, n, e).collect()]
    assert run("MATCH (n:`function`) WHERE n.name = 'f' AND n.filePath CONTAINS 'A.TS' RETURN n.id AS i, n.nothing") == [("a:f", None)]
    assert run("match (a)-[r:CodeRelation {type: 'CALLS'}]->(b)\nreturn a.name, b.name limit 1") == [("f", "g")]
    assert run("MATCH (a)-[r:Other]->(b) RETURN COUNT(*) AS n") == [(0,)]
    assert run("MATCH (n) WHERE n.name = 'offset' RETURN COUNT(*)") == [(0,)]
    assert cypher.markdown(cypher.run("MATCH (n) RETURN n.name LIMIT 2", n, e)) == "| n.name |\n| --- |\n| f |\n| g |"
    assert cypher.markdown(n.limit(0)) == ""
    assert set(report.wiki(n, spark.createDataFrame([], "src_module string, dst_module string, n_edges bigint"), spark.createDataFrame([], "id string, file_count bigint"), spark.createDataFrame([], "id string, step_count bigint"))) == {"overview.md", "architecture.md", "modules.md", "flows.md", "files.md"}


def test_store_and_registry(spark, tmp_path):
    store.write_graph(str(tmp_path / "g"), nodes(spark, ["a:f"]), edges(spark, [("a:f", "a:f")]))
    assert store.read_graph(spark, str(tmp_path / "g"), "nodes").where("label = 'Function'").count() == 1
    reg = spark.createDataFrame([("core", "/p/core", "s", "2025-01-01T00:00:00+00:00", "abc", None), ("core", "/p/core", "s", "2025-02-01T00:00:00+00:00", "def", None), ("core-x", "/p/x", "s", "bad", None, None)], "name string, path string, storage_path string, indexed_at string, last_commit string, stats struct<files:bigint>")
    latest = store.latest_registry(reg)
    assert {r["path"]: r["last_commit"] for r in latest.collect()} == {"/p/core": "def", "/p/x": None}
    assert [r["path"] for r in store.find_repos(latest, "CORE").collect()] == ["/p/core"]
    assert store.find_repos(latest, "/p/").count() == 2 and store.repo_status(2) == "ambiguous"
    assert store.upsert_registry(latest, latest.where("name = 'core'").withColumn("last_commit", F.lit("new"))).where("last_commit = 'new'").count() == 1
    store.write_registry(latest, str(tmp_path / "r"))
    assert store.unregister(spark.read.parquet(str(tmp_path / "r")), "/p/x").count() == 1


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a.py", "def f(): pass"), ("node_modules/x.js", "function no() {}")], "path string, content string").write.parquet(str(src))
    stream = spark.readStream.schema("path string, content string").parquet(str(src))
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "out/symbols")).collect()] == ["f"]
