"""The typed property graph of a source tree, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dir_name, top_dir
from ..session import cut
from .components import connected_components, depths

#: Relations that are followed from symbol to symbol.
RELATIONS = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS")
_OTHER_LABELS = ("File", "Folder", "Community", "Process")


def is_symbol(label: Column) -> Column:
    return ~label.isin(*_OTHER_LABELS)


def is_test_path(path: Column) -> Column:
    """Tests by path; a tests folder at the root itself is none."""
    low = F.lower(path)
    inside = ["/__tests__/", "/__mocks__/", "/test/", "/tests/", "/testing/", "/fixtures/", ".test.", ".spec.", "/test_", "/conftest."]
    out = low.endswith("_test.go") | low.endswith("_test.py")
    for s in inside:
        out = out | low.contains(s)
    return out


def path_tree(paths: DataFrame) -> DataFrame:
    """(id, label, name, file_path, parent_id) of every file and of every folder above it."""
    parts = F.split("path", "/")
    rows = paths.where("path is not null and path != ''").select("path").distinct().select(F.size(parts).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, 1, i), "/").alias("p")))).alias("s"))
    label = F.when(F.col("s.i") == F.col("n"), "File").otherwise("Folder")
    p = F.col("s.p")
    parent = F.when(F.col("s.i") > 1, F.concat(F.lit("Folder:"), dir_name(p)))
    return rows.select(F.concat(label, F.lit(":"), p).alias("id"), label.alias("label"), F.element_at(F.split(p, "/"), -1).alias("name"), p.alias("file_path"), parent.alias("parent_id")).dropDuplicates(["id"])


def build_nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, label, name, file_path, start_line, language), unique by id. files: path, language."""
    tree = path_tree(files).join(files.select(F.col("path").alias("file_path"), F.col("language")).dropDuplicates(["file_path"]), "file_path", "left")
    own = tree.select("id", "label", "name", "file_path", F.lit(None).cast("bigint").alias("start_line"), F.when(F.col("label") == "File", F.col("language")).alias("language"))
    return own.unionByName(symbols.select("id", "label", "name", "file_path", "start_line", "language")).dropDuplicates(["id"])


def build_edges(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, heritage: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, source_id, target_id, rel_type, confidence, reason), unique by id; imports, calls and heritage only between nodes."""
    tree = path_tree(files).where("parent_id is not null").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("rel_type"), F.lit(1.0).alias("confidence"))
    defines = symbols.select(F.concat(F.lit("File:"), "file_path").alias("source_id"), F.col("id").alias("target_id"), F.lit("DEFINES").alias("rel_type"), F.lit(1.0).alias("confidence"))
    imported = imports.select(F.concat(F.lit("File:"), "source_file").alias("source_id"), F.concat(F.lit("File:"), "target_file").alias("target_id"), F.lit("IMPORTS").alias("rel_type"), F.lit(0.95).alias("confidence"))
    called = calls.select("source_id", "target_id", F.lit("CALLS").alias("rel_type"), "confidence")
    checked = with_endpoints(imported.unionByName(called).unionByName(heritage.select("source_id", "target_id", "rel_type", "confidence")), nodes)
    every = tree.unionByName(defines).unionByName(checked)
    return every.select(F.concat("rel_type", F.lit(":"), "source_id", F.lit("->"), "target_id").alias("id"), "source_id", "target_id", "rel_type", "confidence", F.lit("").alias("reason")).dropDuplicates(["id"])


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes that are still there, each id once (the life that began last)."""
    best = F.max_by(F.struct("label", "name", "file_path", "start_line", "language"), F.struct("loaded_at", "label", "name", "file_path", "start_line", "language"))
    return nodes.where("id is not null and deleted_at is null").groupBy("id").agg(best.alias("n")).select("id", "n.*")


def current_edges(edges: DataFrame) -> DataFrame:
    """Each edge id once (the last delivered)."""
    best = F.max_by(F.struct("source_id", "target_id", "rel_type", "confidence", "reason"), "edge_no")
    return edges.where("id is not null and source_id is not null and target_id is not null").groupBy("id").agg(best.alias("e")).select("id", "e.*")


def filtered_edges(edges: DataFrame, relations: tuple[str, ...] = RELATIONS, min_confidence: float = 0.0) -> DataFrame:
    """Edges of some relations with at least a confidence; one without a confidence counts as sure."""
    return edges.where(F.col("rel_type").isin(*relations) & (F.coalesce("confidence", F.lit(1.0)) >= min_confidence))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, n_neighbours) over CALLS; neighbours are distinct, direction aside."""
    calls = edges.where("rel_type = 'CALLS'").select(F.col("source_id").alias("s"), F.col("target_id").alias("t"))
    ends = calls.select(F.col("s").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(calls.select(F.col("t").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    near = calls.select(F.col("s").alias("id"), F.col("t").alias("x")).unionByName(calls.select(F.col("t").alias("id"), F.col("s").alias("x"))).where("id != x").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(near, "id", "left").select("id", "in_degree", "out_degree", F.coalesce("n", F.lit(0)).alias("n_neighbours"))


def process_members(edges: DataFrame) -> DataFrame:
    """(component, id, in_degree): the components of CALLS with two members or more; component is the smallest id."""
    calls = edges.where("rel_type = 'CALLS' and source_id != target_id").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    heads = calls.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return connected_components(calls).join(heads, "id", "left").select("component", "id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def _numbered(df: DataFrame, by: str, prefix: str) -> DataFrame:
    """df with `number`, the place of `by` in order from 1: ranges are sorted in many tasks, and offset by the counts of those before."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id())
    from ..session import cut

    ranged = cut(ranged)
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part int, _start bigint")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return ranged.withColumn("_row", place).join(F.broadcast(offsets), "_part").withColumn("id", F.concat(F.lit(prefix), (F.col("_row") + F.col("_start")).cast("string"))).drop("_part", "_row", "_start")


def processes(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(id, entry_symbol_id, symbol_count, step_count, component), numbered by smallest member.

    The entry is the smallest member that nothing calls, else the smallest; step_count is the greatest distance from it plus 1.
    """
    members = process_members(edges) if members is None else members
    heads = members.groupBy("component").agg(F.min(F.when(F.col("in_degree") == 0, F.col("id"))).alias("free"), F.min("id").alias("least"), F.count(F.lit(1)).alias("symbol_count"))
    heads = heads.select("component", F.coalesce("free", "least").alias("entry_symbol_id"), "symbol_count")
    calls = edges.where("rel_type = 'CALLS' and source_id != target_id").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    calls = calls.join(members.select(F.col("id").alias("src"), F.col("component").alias("root")), "src")
    heads = cut(heads)
    deep = depths(calls, heads.select(F.col("component").alias("root"), F.col("entry_symbol_id").alias("id"))).select(F.col("root").alias("component"), (F.col("depth") + 1).cast("bigint").alias("step_count"))
    return _numbered(heads.join(deep, "component"), "component", "process_").select("id", "entry_symbol_id", "symbol_count", "step_count", "component")


def process_steps(processes_: DataFrame, members: DataFrame, entry_first: bool = False) -> DataFrame:
    """(process_id, symbol_id, step_index, step_count): members in id order, or with the entry before them."""
    order = [F.col("symbol_id") != F.col("entry_symbol_id"), "symbol_id"] if entry_first else ["symbol_id"]
    rows = processes_.select(F.col("id").alias("process_id"), "component", "entry_symbol_id", "step_count").join(members.select("component", F.col("id").alias("symbol_id")), "component")
    return rows.select("process_id", "symbol_id", F.row_number().over(Window.partitionBy("process_id").orderBy(*order)).alias("step_index"), "step_count")


def file_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) of files: IMPORTS between files, other relations lifted to the files of their ends; equal ends mark a file as active."""
    paths = nodes.select("id", "file_path").where("file_path is not null")
    e = edges.where(F.col("rel_type").isin(*RELATIONS)).select("source_id", "target_id")
    return e.join(paths.select(F.col("id").alias("source_id"), F.col("file_path").alias("src")), "source_id").join(paths.select(F.col("id").alias("target_id"), F.col("file_path").alias("dst")), "target_id").select("src", "dst").distinct()


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, file_path): members of the communities, numbered by smallest path. Without any link: by first path segment."""
    links = cut(file_links(edges, nodes))
    active = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
    found = connected_components(links, active).select(F.col("component"), F.col("id").alias("file_path"))
    if found.isEmpty():
        found = nodes.where("label = 'File'").select(top_dir(F.col("file_path")).alias("component"), "file_path").distinct()
    numbers = _numbered(found.select("component").distinct(), "component", "community_")
    return found.join(numbers, "component").select("id", "file_path")


def memberships(communities_: DataFrame, steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, source_id, target_id, rel_type, confidence, reason): MEMBER_OF from symbols to their file's community, STEP_IN_PROCESS to their flows.

    reason holds a step's place.
    """
    symbols = nodes.where(is_symbol(F.col("label"))).select(F.col("id").alias("source_id"), "file_path")
    member = symbols.join(communities_.select(F.col("id").alias("target_id"), "file_path"), "file_path").select("source_id", "target_id", F.lit("MEMBER_OF").alias("rel_type"), F.lit("").alias("reason"))
    step = steps.select(F.col("symbol_id").alias("source_id"), F.col("process_id").alias("target_id"), F.lit("STEP_IN_PROCESS").alias("rel_type"), F.col("step_index").cast("string").alias("reason"))
    return member.unionByName(step).select(F.concat("rel_type", F.lit(":"), "source_id", F.lit("->"), "target_id").alias("id"), "source_id", "target_id", "rel_type", F.lit(1.0).alias("confidence"), "reason")


def community_labels(members: DataFrame) -> DataFrame:
    """(id, file_count, heuristic_label): the commonest first folder, the greatest name among equals."""
    counts = members.groupBy("id", top_dir(F.col("file_path")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("id").agg(F.sum("n").alias("file_count"), F.max_by("dir", F.struct("n", "dir")).alias("heuristic_label"))


def module_edges(edges: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(src_module, dst_module, n_edges) over relations between different modules; a file without one is in `unknown`."""
    module = nodes.select("id", "file_path").join(members.select(F.col("id").alias("module"), "file_path"), "file_path", "left").select("id", F.coalesce("module", F.lit("unknown")).alias("module"))
    e = edges.where(F.col("rel_type").isin(*RELATIONS)).select("source_id", "target_id")
    both = e.join(module.select(F.col("id").alias("source_id"), F.col("module").alias("src_module")), "source_id").join(module.select(F.col("id").alias("target_id"), F.col("module").alias("dst_module")), "target_id")
    return both.where("src_module != dst_module").groupBy("src_module", "dst_module").agg(F.count(F.lit(1)).alias("n_edges"))


def statistics(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts. files: language_found, skipped_large."""
    f = files.agg(F.count_if(~F.col("skipped_large")).alias("total_files"), F.count_if(F.col("language_found").isNotNull() & ~F.col("skipped_large")).alias("parseable_files"), F.count_if("skipped_large").alias("skipped_large"))
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(is_symbol(F.col("label"))).alias("n_symbols"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    # three tables of one row
    return f.withColumn("k", F.lit(0)).join(n.withColumn("k", F.lit(0)), "k").join(e.withColumn("k", F.lit(0)), "k").drop("k")
