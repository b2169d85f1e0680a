"""Connected components and breadth-first search over any edge table."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rounds after which something is wrong; label contraction needs about the logarithm of a component's size.
MAX_ROUNDS = 60
#: A vertex with more than this part of the edges is heavy; there are fewer than twice its reciprocal of such vertices.
HEAVY_PART, LEAST_HEAVY = 1 / 1000, 1000
#: Vertices that a task holds while it contracts its edges.
FOREST = 500_000
#: Edges up to which a root's search is one task's work.
SEARCH_EDGES = 200_000


def _forest(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: a task's edges, FOREST vertices at a time, with each of their components hung on its smallest vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: dict[str, str] = {}

        def root(x: str) -> str:
            while (y := over.get(x, x)) != x:
                over[x] = over.get(y, y)
                x = over[x]
            return x

        def flush() -> pa.RecordBatch:
            ids = list(over)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([root(x) for x in ids], pa.string())], names=["u", "v"])
            over.clear()
            return out

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    over[max(x, y)] = min(x, y)
            if len(over) > FOREST:
                yield flush()
        yield flush()

    return edges.select("u", "v").mapInArrow(run, "u string, v string")


def _with_least(rows: DataFrame, least: DataFrame, part: float) -> DataFrame:
    """rows (u, v) with m, the least neighbour of u: least (u, m, n) of heavy vertices is sent to all tasks, the rest is joined by key."""
    heavy = least.where(F.col("n") > part).select("u", F.col("m").alias("heavy_m"))
    own = rows.join(F.broadcast(heavy), "u", "left")
    light = own.where("heavy_m is null").drop("heavy_m").join(least.where(F.col("n") <= part).select("u", "m"), "u")
    return light.select("u", "v", "m").unionByName(own.where("heavy_m is not null").select("u", "v", F.col("heavy_m").alias("m")))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): component is the smallest id. edges: src, dst, direction aside; vertices: id, may stand alone.

    Edges are first contracted where they lie, so that what is shuffled is about the vertices. Then large-star and
    small-star rounds (Kiveris et al. 2014) until no edge changes, each cut by a reliable checkpoint. Neighbour minima are
    aggregated on the map side; the few heavy vertices (hubs, and in late rounds the roots) get theirs by broadcast, so no task
    has all the edges of one.
    """
    pairs = edges.where("src is not null and dst is not null and src != dst").select(F.greatest(F.col("src").cast("string"), F.col("dst").cast("string")).alias("u"), F.least(F.col("src").cast("string"), F.col("dst").cast("string")).alias("v"))
    pairs = cut(_forest(pairs).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        seen = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if (now := tuple(seen)) == before:
            break
        before, part = now, max(LEAST_HEAVY, seen["n"] * HEAVY_PART)
        # large star: each node sends its larger neighbours to its smallest
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least, part).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: each node sends its smaller neighbours and itself to the smallest
        lows = cut(large)
        least = lows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(lows, least, part).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u != v").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    out = pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    if vertices is None:
        return out
    alone = vertices.select("id").where("id is not null").distinct().join(out.select("id"), "id", "left_anti")
    return out.unionByName(alone.select("id", F.col("id").alias("component")))


def levels(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth): shortest distances from each root along src -> dst. starts: root, id. Within max_depth steps."""
    seen = cut(starts.select("root", "id", F.lit(0).alias("depth")).distinct())
    front, depth = seen, 0
    hops = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(hops, front["id"] == hops["src"]).select("root", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front)) if depth % 8 == 0 else seen.unionByName(front)
    return seen


def depths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, depth): the greatest shortest distance from each root's start. edges: root, src, dst; starts: root, id.

    Roots with up to SEARCH_EDGES edges are each searched within one task; for larger ones the search goes level by level over
    all tasks.
    """
    edges = cut(edges.select("root", "src", "dst").distinct())
    sizes = edges.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > SEARCH_EDGES).select("root"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        start = rows["start"].iloc[0]
        ahead: dict[str, list[str]] = {}
        for a, b in zip(rows["src"], rows["dst"]):
            ahead.setdefault(a, []).append(b)
        at, queue = {start: 0}, deque([start])
        while queue:
            x = queue.popleft()
            for y in ahead.get(x, ()):
                if y not in at:
                    at[y] = at[x] + 1
                    queue.append(y)
        return pd.DataFrame({"root": [rows["root"].iloc[0]], "depth": [max(at.values())]})

    first = starts.select("root", F.col("id").alias("start"))
    small = edges.join(large, "root", "left_anti").join(first, "root").groupBy("root").applyInPandas(search, "root string, depth int")
    if large.isEmpty():
        found = small
    else:
        far = levels(edges.join(large, "root", "left_semi"), starts.join(large, "root", "left_semi")).groupBy("root").agg(F.max("depth").alias("depth"))
        found = small.unionByName(far)
    return starts.select("root").join(found, "root", "left").select("root", F.coalesce("depth", F.lit(0)).alias("depth"))
