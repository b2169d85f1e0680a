import datetime as dt
import random
from collections import Counter, defaultdict

from codeweft.operators.orphans import graph_references, node_lives, orphan_references, orphan_report
from codeweft.operators.skew import Agg, heavy_hitters, heavy_keys, salted_aggregate, salted_distinct_count
from pyspark.sql import functions as F

T = [dt.datetime(2024, 1, d) for d in range(1, 29)]
EDGES = "edge_no bigint, id string, source_id string, target_id string, rel_type string, loaded_at timestamp_ntz, key string, status string"
NODES = "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, ref_at string"
IMPORTS = "import_no bigint, source_file string, target_file string, loaded_at timestamp_ntz, slot int"


def orphans(spark, edges, imports, nodes):
    e = spark.createDataFrame([(n, "x", s, t, "CALLS", at, "k", "s") for n, s, t, at in edges], EDGES)
    i = spark.createDataFrame([(n, "s", t, at, 1) for n, t, at in imports], IMPORTS)
    return orphan_references(graph_references(e, i), node_lives(spark.createDataFrame([(*n, "r") for n in nodes], NODES)))


def test_orphans_against_brute_force(spark):
    r = random.Random(5)
    ids = [f"n{i}" for i in range(12)]
    nodes = [(r.choice(ids[:9]), s := r.choice(T), r.choice([None, s + dt.timedelta(days=r.randint(0, 9))])) for _ in range(25)]
    nodes += [(None, T[0], None), ("n10", None, None)]
    edges = [(k, r.choice([*ids, None]), r.choice(["n0"] * 8 + ids), r.choice([*T, None])) for k in range(400)]
    want = []
    for k, s, t, at in edges:
        for name, key in (("source_id", s), ("target_id", t)):
            if key is None:
                continue
            lives = [(a, b) for i, a, b in nodes if i == key]
            if at is not None and any(a is not None and a <= at and (b is None or b > at) for a, b in lives):
                continue
            first = min((a for a, _ in lives if a is not None), default=None)
            want.append(("edges", k, name, "missing" if not lives else "late" if at is not None and first is not None and first > at else "deleted"))
    got = orphans(spark, edges, [], nodes).select("src_table", "row_no", "ref_field", "status")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_import_paths_and_report(spark):
    nodes = [("File:a/b.ts", T[0], None), ("File:a/b.ts", T[0], None)]
    imports = [(1, "a//./x/../b.ts", T[3]), (2, "a\\b.ts", T[3]), (3, "a/c.ts", T[3]), (4, None, T[3]), (5, "A/b.ts", T[3]), (6, "a/c.ts", T[3])]
    got = orphans(spark, [], imports, nodes)
    assert sorted((r["row_no"], r["status"]) for r in got.collect()) == [(3, "missing"), (5, "missing"), (6, "missing")]
    assert [tuple(r) for r in orphan_report(got).collect()] == [("imports", "target_file", "missing", "IMPORTS", "2024-01", 3)]


def test_no_rows(spark):
    assert orphans(spark, [], [], []).count() == 0
    assert orphans(spark, [(1, "a", "b", T[0])], [], []).count() == 2


def test_skewed_aggregates(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + ["warm"] + [f"k{i}" for i in range(60)] + [None]), r.choice([None, 1.0, 2.0, 5.0]), i, "clash") for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double, n bigint, _salt string").repartition(5)
    got = salted_aggregate(df.select("k", "v"), "k", [Agg("count", None, "c"), Agg("count_col", "v", "cv"), Agg("sum", "v", "s"), Agg("min", "v", "lo"), Agg("max", "v", "hi"), Agg("mean", "v", "avg")], share=0.02, salts=7)
    groups = defaultdict(list)
    for k, v, *_ in rows:
        if k is not None:
            groups[k].append(v)
    want = {k: (len(v), len(x := [y for y in v if y is not None]), sum(x), min(x), max(x), sum(x) / len(x)) for k, v in groups.items()}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    distinct = {r["k"]: r["d"] for r in salted_distinct_count(df, "k", "v", "d").collect()}
    assert distinct == {k: len({y for y in v if y is not None}) for k, v in groups.items()}


def test_heavy_hitters(spark):
    keys = ["a"] * 30 + ["b"] * 3 + ["c"] * 2 + [None] * 50 + [f"x{i}" for i in range(15)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r["k"]: (r["n_rows"], r["n_total"]) for r in heavy_hitters(df, "k", 0.03).collect()} == {k: (n, 100) for k, n in Counter(keys).items() if k and n >= 3}
    assert set(heavy_keys(df, F.col("k"), 0.2)) == {"a"}
    assert heavy_hitters(df.limit(0), "k", 0.03).count() == 0
    assert salted_aggregate(df.limit(0), "k", [Agg("count", None, "n")]).count() == 0
