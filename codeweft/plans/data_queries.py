"""Problems 2 and 4: orphan references, and results per key under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import graph_references, node_lives, orphan_references, orphan_report
from ..operators.skew import Agg, heavy_hitters, salted_aggregate
from ..sources.tables import table
from .registry import Registry

REGISTRY = Registry()

_NORMAL_SQL = r"""
array_to_string(coalesce(list_reduce(
  list_prepend(cast([] as varchar[]), list_transform(list_filter(string_split(replace(target_file, '\', '/'), '/'), lambda x: x not in ('', '.')), lambda x: [x])),
  lambda a, x: case when x[1] = '..' then a[1:greatest(len(a) - 1, 0)] else list_concat(a, x) end), []), '/')"""

_ORPHANS_SQL = f"""
with refs as (
  select 'edges' as src_table, edge_no as row_no, 'source_id' as ref_field, rel_type as ref_kind, source_id as k, loaded_at as t from edges
  union all select 'edges', edge_no, 'target_id', rel_type, target_id, loaded_at from edges
  union all select 'imports', import_no, 'target_file', 'IMPORTS', 'File:' || {_NORMAL_SQL}, loaded_at from imports where target_file is not null),
verdict as (
  select r.src_table, r.row_no, r.ref_field, r.ref_kind, r.t, count(n.id) as n_lives, min(n.loaded_at) as first_life,
    coalesce(bool_or(n.loaded_at <= r.t and (n.deleted_at is null or n.deleted_at > r.t)), false) as covered
  from refs r left join nodes n on n.id = r.k where r.k is not null group by all),
orphans as (
  select *, case when n_lives = 0 then 'missing' when first_life > t then 'late' else 'deleted' end as status from verdict where not covered)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(graph_references(table(spark, d, "edges"), table(spark, d, "imports")), node_lives(table(spark, d, "nodes")))


@REGISTRY.add("p2_found", _ORPHANS_SQL + "select src_table, row_no, ref_field, status from orphans")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "row_no", "ref_field", "status")


@REGISTRY.add("p2_report", _ORPHANS_SQL + "select src_table, ref_field, status, ref_kind, strftime(t, '%Y-%m') as month, count(*) as n_orphans from orphans group by all")
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


@REGISTRY.add(
    "p4_found",
    """select 'edges.target_id' as field_name, target_id as key_value from edges where target_id is not null group by 2 having count(*) >= 0.03 * (select count(*) from edges)
    union all select 'nodes.file_path', file_path from nodes where file_path is not null group by 2 having count(*) >= 0.03 * (select count(*) from nodes)""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = [
        heavy_hitters(table(spark, d, t), c, 0.03).select(F.lit(f"{t}.{c}").alias("field_name"), F.col(c).alias("key_value"))
        for t, c in (("edges", "target_id"), ("nodes", "file_path"))
    ]
    return found[0].unionByName(found[1])


@REGISTRY.add(
    "p4_targets",
    """select target_id, count(*) as n_refs, count(distinct source_id) as n_callers, round(avg(confidence), 6) as mean_confidence,
    min(loaded_at) as first_at, max(loaded_at) as last_at from edges where target_id is not null group by 1""",
)
def p4_targets(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges").select("target_id", "source_id", "confidence", "loaded_at")
    rows = salted_aggregate(edges, "target_id", [Agg("count", None, "n_refs"), Agg("mean", "confidence", "mean_confidence"), Agg("min", "loaded_at", "first_at"), Agg("max", "loaded_at", "last_at")], distinct=("source_id", "n_callers"))
    return rows.select("target_id", "n_refs", "n_callers", F.round("mean_confidence", 6).alias("mean_confidence"), "first_at", "last_at")


@REGISTRY.add(
    "p4_files",
    """select file_path, count(*) as n_rows, count(start_line) as n_symbols, min(start_line) as first_line, max(start_line) as last_line
    from nodes where file_path is not null group by 1""",
)
def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return salted_aggregate(
        table(spark, d, "nodes").select("file_path", "start_line"),
        "file_path",
        [Agg("count", None, "n_rows"), Agg("count_col", "start_line", "n_symbols"), Agg("min", "start_line", "first_line"), Agg("max", "start_line", "last_line")],
    )
