"""References to records that do not exist, are deleted, or arrive later.

Parent and child keys are tagged and united in long form and grouped by parent table and key. A key whose one life covers
all its references is done with. The few keys that remain (no parent flag, several lives, or a life that does not cover)
are joined back to the references for the verdict of each row, salted where one of them holds many.

Defined results: a null reference is none. A reference without a time is covered by no life: `missing` if there is no
record, else `deleted`. A life without a beginning covers nothing but its record exists. A life that ends before it begins
covers nothing. Repeated rows, of records and of references, count for themselves. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normal_path
from ..session import cut

#: A key with more than this part of the references in question is salted; there are at most its reciprocal of such keys.
HEAVY_PART = 1 / 1000
_FOREVER = "timestamp_ntz'9999-12-31 00:00:00'"


def graph_references(edges: DataFrame, imports: DataFrame) -> DataFrame:
    """(src_table, row_no, ref_field, ref_kind, key, ref_at) of every reference to a node; ref_kind is the edge's type."""
    e = edges.select(
        F.lit("edges").alias("src_table"),
        F.col("edge_no").cast("bigint").alias("row_no"),
        F.col("rel_type").alias("ref_kind"),
        F.col("loaded_at").alias("ref_at"),
        F.expr("stack(2, 'source_id', source_id, 'target_id', target_id) as (ref_field, key)"),
    )
    i = imports.select(
        F.lit("imports").alias("src_table"),
        F.col("import_no").cast("bigint").alias("row_no"),
        F.lit("IMPORTS").alias("ref_kind"),
        F.col("loaded_at").alias("ref_at"),
        F.lit("target_file").alias("ref_field"),
        F.concat(F.lit("File:"), normal_path(F.col("target_file"))).alias("key"),
    )
    return e.unionByName(i).where("key is not null")


def node_lives(nodes: DataFrame) -> DataFrame:
    """(key, start, end) of every life."""
    return nodes.where("id is not null").select(F.col("id").alias("key"), F.col("loaded_at").alias("start"), F.col("deleted_at").alias("end"))


def orphan_references(refs: DataFrame, lives: DataFrame, parent_table: str = "nodes") -> DataFrame:
    """(src_table, row_no, ref_field, ref_kind, ref_at, status) of every orphan.

    refs: (src_table, row_no, ref_field, ref_kind, key, ref_at); lives: (key, start, end), end null while the record lives.
    """
    at = "timestamp_ntz"
    long = lives.select(
        F.lit(parent_table).alias("parent_table"), "key", F.lit(1).alias("is_parent"), F.col("start").cast(at).alias("start"), F.coalesce(F.col("end").cast(at), F.expr(_FOREVER)).alias("end"), F.lit(None).cast(at).alias("ref_at")
    ).unionByName(
        refs.select(F.lit(parent_table).alias("parent_table"), "key", F.lit(0).alias("is_parent"), F.lit(None).cast(at).alias("start"), F.lit(None).cast(at).alias("end"), F.col("ref_at").cast(at).alias("ref_at"))
    )
    # sums, minima and maxima of fixed width only: map-side hash aggregation takes care of hot keys
    keys = long.groupBy("parent_table", "key").agg(
        F.sum("is_parent").alias("n_lives"),
        F.sum(1 - F.col("is_parent")).alias("n_refs"),
        F.count("ref_at").alias("n_timed"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("ref_at").alias("first_ref"),
        F.max("ref_at").alias("last_ref"),
    )
    settled = (F.col("n_lives") == 1) & (F.col("n_timed") == F.col("n_refs")) & (F.col("start") <= F.col("first_ref")) & (F.col("end") > F.col("last_ref"))
    open_keys = cut(keys.where((F.col("n_refs") > 0) & ~F.coalesce(settled, F.lit(False))).select("key", "n_lives", "n_refs"))

    with_lives = lives.join(open_keys.where("n_lives > 0").select("key"), "key", "left_semi").groupBy("key").agg(F.collect_set(F.struct(F.col("start").cast(at).alias("start"), F.col("end").cast(at).alias("end"))).alias("lives"))
    part = open_keys.agg((F.sum("n_refs") * F.lit(HEAVY_PART)).alias("part")).first()["part"] or 0.0
    slots = F.when(F.col("n_refs") > F.lit(part), F.ceil(F.col("n_refs") / F.lit(max(part, 1.0)))).otherwise(F.lit(1)).cast("int")
    suspects = open_keys.withColumn("slots", slots)
    # fewer than 1 / HEAVY_PART keys
    heavy = suspects.where("slots > 1").select("key", "slots")
    suspects = suspects.join(with_lives, "key", "left").select("key", "lives", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    asked = refs.join(F.broadcast(heavy), "key", "left").withColumn("slot", F.when(F.col("slots").isNotNull(), F.pmod(F.xxhash64("src_table", "row_no", "ref_field"), F.col("slots")).cast("int")).otherwise(0)).drop("slots")
    joined = asked.join(suspects, ["key", "slot"])
    t = F.col("ref_at").cast(at)
    covered = F.exists("lives", lambda x: (x["start"] <= t) & (x["end"].isNull() | (x["end"] > t)))
    return joined.where(F.col("lives").isNull() | ~F.coalesce(covered, F.lit(False))).select("src_table", "row_no", "ref_field", "ref_kind", "ref_at", _status(t).alias("status"))


def _status(t: Column) -> Column:
    first = F.array_min(F.transform("lives", lambda x: x["start"]))
    return F.when(F.col("lives").isNull(), "missing").when(first > t, "late").otherwise("deleted")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(src_table, ref_field, status, ref_kind, month, n_orphans); month is null where the reference has no time."""
    return orphans.groupBy("src_table", "ref_field", "status", "ref_kind", F.date_format("ref_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
