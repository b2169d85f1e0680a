"""Reports: tables made by aggregation, rendered on the driver from few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cypher import markdown
from .graph import is_symbol


def overview(nodes: DataFrame) -> DataFrame:
    """(label, n_nodes, n_files)."""
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("file_path").alias("n_files"))


def largest_files(nodes: DataFrame, most: int = 20) -> DataFrame:
    return nodes.where(is_symbol(F.col("label")) & F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols")).orderBy(F.desc("n_symbols"), "file_path").limit(most)


def top_module_edges(edges: DataFrame, most: int = 20) -> DataFrame:
    return edges.orderBy(F.desc("n_edges"), "src_module", "dst_module").limit(most)


def wiki(nodes: DataFrame, module_edges: DataFrame, communities: DataFrame, processes: DataFrame) -> dict[str, str]:
    """Markdown pages by name; each table is cut to a few rows before it is rendered."""
    return {
        "overview.md": "# Overview\n\n" + markdown(overview(nodes).orderBy("label")),
        "architecture.md": "# Architecture\n\n" + markdown(top_module_edges(module_edges)),
        "modules.md": "# Modules\n\n" + markdown(communities.orderBy(F.desc("file_count"), "id").limit(20)),
        "flows.md": "# Flows\n\n" + markdown(processes.orderBy(F.desc("step_count"), "id").limit(20)),
        "files.md": "# Files\n\n" + markdown(largest_files(nodes)),
    }
