"""The questions asked of a graph: ranked search, context, impact, what a change touches, and renaming.

All take nodes (id, label, name, file_path, start_line, language) and edges (id, source_id, target_id, rel_type, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, identifier_pattern, lines, search_tokens, strip
from ..session import cut
from .graph import RELATIONS, filtered_edges, is_symbol, is_test_path


def search_scores(nodes: DataFrame, query: str) -> DataFrame:
    """Symbols with score: per token 12 for the exact name, else 6, 2 and 1 for name, path and label that hold it; tokens that repeat count again."""
    name, path, label = (ascii_lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "file_path", "label"))
    weigh = lambda t: F.when(name == t, 12.0).otherwise(name.contains(t).cast("double") * 6 + path.contains(t).cast("double") * 2 + label.contains(t).cast("double"))
    tokens = search_tokens(F.lit(query))
    return nodes.where(is_symbol(F.col("label"))).withColumn("score", F.aggregate(tokens, F.lit(0.0), lambda s, t: s + weigh(t))).where("score > 0")


def search(nodes: DataFrame, query: str, steps: DataFrame, limit: int = 5) -> DataFrame:
    """(process_id, priority, process_rank, symbol_id, symbol_rank, score, step_index): the best processes with their best symbols.

    Candidates are the limit * 30 best symbols; a process scores the sum of its candidates'; ten symbols each at most.
    """
    best = search_scores(nodes, query).orderBy(F.desc("score"), "id").limit(limit * 30).select(F.col("id").alias("symbol_id"), "score")
    hits = steps.join(F.broadcast(best), "symbol_id")  # limit * 30 rows
    ranked = hits.groupBy("process_id").agg(F.sum("score").alias("priority")).orderBy(F.desc("priority"), "process_id").limit(limit)
    ranked = ranked.withColumn("process_rank", F.row_number().over(Window.orderBy(F.desc("priority"), "process_id")))  # limit rows
    place = F.row_number().over(Window.partitionBy("process_id").orderBy(F.desc("score"), "symbol_id"))
    return hits.join(F.broadcast(ranked), "process_id").withColumn("symbol_rank", place).where("symbol_rank <= 10").select("process_id", F.round("priority", 3).alias("priority"), "process_rank", "symbol_id", "symbol_rank", "score", "step_index")


def definitions(nodes: DataFrame, query: str, steps: DataFrame, limit: int = 5, most: int = 20) -> DataFrame:
    """(symbol_id, score): candidates that are in no process, the best `most`."""
    best = search_scores(nodes, query).orderBy(F.desc("score"), "id").limit(limit * 30).select(F.col("id").alias("symbol_id"), "score")
    return best.join(steps.select("symbol_id"), "symbol_id", "left_anti").orderBy(F.desc("score"), "symbol_id").limit(most)


def find_symbols(nodes: DataFrame, name: str | None = None, uid: str | None = None, file: str | None = None) -> DataFrame:
    """Nodes by id, or symbols by name or id; only those whose path holds `file`."""
    asked = F.col("id") == uid if uid is not None else is_symbol(F.col("label")) & ((F.col("name") == name) | (F.col("id") == name))
    return nodes.where(asked & (F.col("file_path").contains(file) if file else F.lit(True)))


def context(nodes: DataFrame, edges: DataFrame, symbol_id: str, most: int = 30) -> DataFrame:
    """(direction, rel_type, uid, name, file_path, kind): what refers to a symbol and what it refers to, `most` a type."""
    e = edges.where((F.col("source_id") == symbol_id) | (F.col("target_id") == symbol_id))
    ends = e.where(F.col("target_id") == symbol_id).select(F.lit("incoming").alias("direction"), F.lower("rel_type").alias("rel_type"), F.col("source_id").alias("uid"), "id").unionByName(
        e.where(F.col("source_id") == symbol_id).select(F.lit("outgoing").alias("direction"), F.lower("rel_type").alias("rel_type"), F.col("target_id").alias("uid"), "id")
    )
    rows = ends.groupBy("direction", "rel_type", "uid").agg(F.min("id").alias("edge_id")).join(nodes.select(F.col("id").alias("uid"), "name", "file_path", F.col("label").alias("kind")), "uid")
    place = F.row_number().over(Window.partitionBy("direction", "rel_type").orderBy("edge_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("direction", "rel_type", "uid", "name", "file_path", "kind")


def impact_target(nodes: DataFrame, name: str) -> DataFrame:
    """The symbol of that name with the smallest path, then id."""
    return nodes.where(is_symbol(F.col("label")) & (F.col("name") == name)).orderBy("file_path", "id").limit(1)


def impact(nodes: DataFrame, edges: DataFrame, start_id: str, upstream: bool = True, depth: int = 3, relations: tuple[str, ...] = RELATIONS, min_confidence: float = 0.0, tests: bool = False) -> DataFrame:
    """(id, depth, name, label, file_path, rel_type, confidence) of the symbols within `depth` steps.

    Of several edges to a node the one with the smallest id tells relation and confidence; tests are neither shown nor passed.
    """
    near, far = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    hops = filtered_edges(edges, relations, min_confidence).select(F.col(near).alias("near"), F.col(far).alias("far"), F.col("id").alias("edge_id"), "rel_type", "confidence")
    allowed = nodes.where(is_symbol(F.col("label"))).where(F.lit(True) if tests else ~F.coalesce(is_test_path(F.col("file_path")), F.lit(False))).select("id", "name", "label", "file_path")
    # every depth reads both; what lies under them is done once
    hops, allowed = cut(hops), cut(allowed)
    spark = nodes.sparkSession
    front = spark.createDataFrame([(start_id, 0)], "id string, depth int")
    seen, found = front.select("id"), None
    for d in range(1, max(1, depth) + 1):
        step = hops.join(front.select(F.col("id").alias("near")), "near").groupBy(F.col("far").alias("id")).agg(F.min_by(F.struct("rel_type", "confidence"), "edge_id").alias("by"))
        step = step.join(seen, "id", "left_anti").join(allowed, "id")
        front = cut(step.select("id", F.lit(d).alias("depth"), "name", "label", "file_path", "by.rel_type", "by.confidence"))
        found = front if found is None else found.unionByName(front)
        seen = seen.unionByName(front.select("id"))
    return found


def risk_of_impact(direct: Column, processes: Column, modules: Column, total: Column) -> Column:
    return (
        F.when((direct >= 30) | (processes >= 5) | (modules >= 5) | (total >= 200), "CRITICAL")
        .when((direct >= 15) | (processes >= 3) | (modules >= 3) | (total >= 100), "HIGH")
        .when((direct >= 5) | (total >= 30), "MEDIUM")
        .otherwise("LOW")
    )


def affected_processes(found: DataFrame, steps: DataFrame) -> DataFrame:
    """(process_id, hits, broken_at_step, step_count) of the processes that impacted symbols are in."""
    return steps.join(found.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id").groupBy("process_id").agg(F.count_distinct("symbol_id").alias("hits"), F.min("step_index").alias("broken_at_step"), F.max("step_count").alias("step_count"))


def affected_modules(found: DataFrame, members: DataFrame) -> DataFrame:
    """(module, hits, impact): direct if a symbol one step away is in it, else indirect."""
    return found.join(members.select(F.col("id").alias("module"), "file_path"), "file_path").groupBy("module").agg(F.count(F.lit(1)).alias("hits"), F.when(F.bool_or(F.col("depth") == 1), "direct").otherwise("indirect").alias("impact"))


def changed_symbols(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols of changed files (column file): equal paths, one the end of the other, or one within the other.

    Changed files are a query set, a few rows; those are held against every node.
    """
    wanted = changed.select(F.replace(F.col("file"), F.lit("\\"), F.lit("/")).alias("file")).where("file != ''").distinct()
    files = nodes.where(is_symbol(F.col("label")) & F.col("file_path").isNotNull()).select("file_path").distinct()
    path = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    # paths of a graph are compared once each, then the symbols are found by equality
    hit = files.join(wanted, path.contains(F.col("file")) | F.col("file").contains(path), "left_semi")
    return nodes.where(is_symbol(F.col("label"))).join(hit, "file_path", "left_semi")


def affected_by_change(nodes: DataFrame, changed: DataFrame, steps: DataFrame) -> DataFrame:
    """(process_id, step_count, n_steps, changed_steps): processes with the steps that a change touches, as (step, symbol) in order."""
    hits = changed_symbols(nodes, changed).select(F.col("id").alias("symbol_id"), "name")
    return steps.join(hits, "symbol_id").groupBy("process_id").agg(F.max("step_count").alias("step_count"), F.count(F.lit(1)).alias("n_steps"), F.array_sort(F.collect_set(F.struct(F.col("step_index").alias("step"), F.col("name").alias("symbol")))).alias("changed_steps"))


def risk_of_change(files: Column, processes: Column) -> Column:
    return F.when(files == 0, "none").when(processes == 0, "low").when(processes <= 5, "medium").when(processes <= 15, "high").otherwise("critical")


def rename_edits(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, line_no, old_text, new_text): lines in which the identifier stands alone. files: path, content."""
    import re

    pattern = identifier_pattern(old)
    rows = lines(files.where(F.col("content").contains(old)), "path").where(F.col("line").rlike(pattern))
    return rows.distinct().select("path", "line_no", strip(F.col("line")).alias("old_text"), strip(F.regexp_replace("line", pattern, re.sub(r"([\\$])", r"\\\1", new))).alias("new_text"))


def rename_plan(files: DataFrame, nodes: DataFrame, edges: DataFrame, symbol_id: str, new: str) -> DataFrame:
    """rename_edits with confidence: `graph` in the file that defines the symbol and in those that refer to it, else `text_search`."""
    target = nodes.where(F.col("id") == symbol_id).first()
    if target is None:
        raise KeyError(symbol_id)
    sources = edges.where(F.col("target_id") == symbol_id).select(F.col("source_id").alias("id")).distinct()
    known = nodes.join(sources, "id", "left_semi").select(F.col("file_path").alias("path")).unionByName(nodes.where(F.col("id") == symbol_id).select(F.col("file_path").alias("path"))).where("path is not null").distinct()
    edits = rename_edits(files, target["name"], new)
    return edits.join(known.withColumn("g", F.lit(True)), "path", "left").withColumn("confidence", F.when(F.col("g"), "graph").otherwise("text_search")).drop("g")


def snippets(nodes: DataFrame, files: DataFrame, n_lines: int = 25) -> DataFrame:
    """(id, snippet): up to 25 lines from three above a symbol's first. Content is shuffled here, once, to meet the symbols."""
    parts = F.split("content", r"\r?\n")
    first = F.greatest(F.coalesce("start_line", F.lit(1)) - 3, F.lit(0)).cast("int")
    both = nodes.where(is_symbol(F.col("label"))).select("id", "file_path", "start_line").join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    # a file that comes twice gives its snippets once
    return both.select("id", F.array_join(F.slice(parts, F.least(first, F.size(parts)) + 1, F.lit(n_lines)), "\n").alias("snippet")).distinct()


def symbol_index(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(label, id, term, tf, n_terms): the stemmed words of each symbol's name and snippet. Written once, asked often."""
    import pyarrow as pa

    from ..functions.stem import stem

    words = search_tokens(F.concat_ws(" ", "name", "snippet"))
    rows = nodes.where(is_symbol(F.col("label"))).join(snippets(nodes, files), "id", "left").select("label", "id", words.alias("words"))

    def run(batches):
        for b in batches:
            out = ([], [], [], [], [])
            for label, key, own in zip(*(b.column(i).to_pylist() for i in range(3))):
                counts: dict[str, int] = {}
                for w in own or ():
                    counts[w] = counts.get(w := stem(w), 0) + 1
                for term, n in counts.items():
                    for column, value in zip(out, (label, key, term, n, len(own))):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["label", "id", "term", "tf", "n_terms"])

    return rows.mapInArrow(run, "label string, id string, term string, tf bigint, n_terms bigint")


def search_index(index: DataFrame, query: str, limit: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, label, score): BM25 within each label, its best `limit`; an id's best score counts, ties go to the smaller id."""
    import re

    from ..functions.stem import stem

    limit = max(1, min(100, limit))
    asked = sorted({stem(t) for t in re.split(r"[^A-Za-z0-9_$/]+", query.lower()) if len(t) >= 2})
    sizes = index.groupBy("label", "id").agg(F.first("n_terms").alias("n")).groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_terms"))
    hits = index.where(F.col("term").isin(asked))
    seen = hits.groupBy("label", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("avg_terms")))
    # one row a label, and one a label and asked word
    scored = hits.join(F.broadcast(seen), ["label", "term"]).join(F.broadcast(sizes), "label").groupBy("label", "id").agg(F.round(F.sum(part), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id"))
    best = scored.withColumn("place", place).where(F.col("place") <= limit).groupBy("id").agg(F.max(F.struct("score", "label")).alias("s"))
    return best.select("id", "s.label", "s.score").orderBy(F.desc("score"), "id").limit(limit)


def bm25(docs: DataFrame, key: str, text: str, query: str, limit: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the best documents for any of the query's terms; score descending, then key. limit is held to 1..100."""
    limit = max(1, min(100, limit))
    asked = F.array_distinct(search_tokens(F.lit(query)))
    terms = docs.where(F.col(text).isNotNull()).select(F.col(key), search_tokens(F.col(text)).alias("terms"))
    # one pass over the text; what is kept of a document is its length and the query's terms in it
    kept = cut(terms.select(key, F.size("terms").alias("n_terms"), F.filter("terms", lambda t: F.array_contains(asked, t)).alias("terms")))
    size = kept.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("avg_terms")).first()
    n, avg = size["n_docs"], size["avg_terms"] or 1.0
    hits = kept.select(key, "n_terms", F.explode("terms").alias("term")).groupBy("term", key, "n_terms").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / avg))
    return hits.join(F.broadcast(df), "term").groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)  # one row a query term
