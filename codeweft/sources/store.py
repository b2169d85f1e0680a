"""A graph on disk: Parquet tables by label and relation, with a registry of repos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def write_graph(root: str, nodes: DataFrame, edges: DataFrame, members: DataFrame | None = None, steps: DataFrame | None = None) -> None:
    """Full rebuild. Filters on label or relation then read only their folders."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{root}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{root}/edges")
    for name, df in (("communities", members), ("process_steps", steps)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{root}/{name}")


def read_graph(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}")


def latest_registry(registry: DataFrame) -> DataFrame:
    """One row per path: the last indexing."""
    when = F.try_to_timestamp("indexed_at")
    return registry.groupBy("path").agg(F.max_by(F.struct("name", "storage_path", "indexed_at", "last_commit", "stats"), F.struct(when, "indexed_at")).alias("r")).select("r.name", "path", "r.storage_path", "r.indexed_at", "r.last_commit", "r.stats")


def upsert_registry(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """The registry with rows in place of those of the same path."""
    return registry.join(rows.select("path"), "path", "left_anti").select(registry.columns).unionByName(rows)


def unregister(registry: DataFrame, path: str) -> DataFrame:
    return registry.where(F.col("path") != path)


def write_registry(registry: DataFrame, path: str) -> None:
    """Written from a checkpoint, so that a registry may be made from itself."""
    cut(registry).write.mode("overwrite").parquet(path)


def find_repos(registry: DataFrame, hint: str) -> DataFrame:
    """Repos that a hint names: by equal name (case aside) or path, else by part of either; (rows..., exact)."""
    low = hint.lower()
    exact = (F.lower("name") == low) | (F.col("path") == hint)
    part = F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("path"), F.lit(low))
    rows = registry.where(exact | part).withColumn("exact", exact)
    return rows.join(rows.where("exact").agg(F.count(F.lit(1)).alias("n")).withColumn("exact", F.lit(False)).where("n > 0"), "exact", "left_anti").select(*registry.columns, "exact")


def repo_status(n: int) -> str:
    return "error" if n == 0 else "ok" if n == 1 else "ambiguous"
