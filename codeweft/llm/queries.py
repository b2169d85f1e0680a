"""Queries p1, p3 and p5 to p8."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import table
from . import credentials, leakage, origin, packing, pii, tokenizer

REGISTRY = Registry()


def vocabulary() -> str:
    return os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


@REGISTRY.add("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, d, "documents"), vocabulary())


@REGISTRY.add("p6_round_trip", "select doc_id, true as same from documents")
def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    encoded = tokenizer.encode_documents(docs, vocabulary())
    decoded = tokenizer.decode_documents(encoded, vocabulary()).withColumnRenamed("text", "decoded")
    return docs.select("doc_id", "text").join(decoded, "doc_id").selectExpr("doc_id", "decoded = coalesce(text, '') as same")


@REGISTRY.add("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@REGISTRY.add("p7_items")
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "suite")
    counts = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@REGISTRY.add("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_lines(table(spark, d, "code_files"))


@REGISTRY.add("p1_redacted")
def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_files(table(spark, d, "code_files"))


@REGISTRY.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_kinds(spark, d).select("file_id")


@REGISTRY.add("p3_kinds")
def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    return origin.file_origins(table(spark, d, "scanned_files"), table(spark, d, "code_files"))


@REGISTRY.add("p5_chunks")
def p5_chunks(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_files(table(spark, d, "scanned_files"))


@REGISTRY.add(
    "p5_coverage",
    """with latest as (select file_id, greatest(coalesce(max_by(size_bytes, row(scanned_at, greatest(coalesce(size_bytes, 1), 1))), 1), 1) as size
    from scanned_files where file_id is not null group by 1)
    select file_id, cast(size as bigint) as n_bytes, cast(greatest(ceil(size / 4194304.0), 1) as bigint) as n_parts from latest""",
)
def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    return p5_chunks(spark, d).groupBy("file_id").agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_parts"))


@REGISTRY.add("p5_fill")
def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p5_chunks(spark, d))


@REGISTRY.add("p5_tiers")
def p5_tiers(spark: SparkSession, d: str) -> DataFrame:
    return packing.tier_report(p5_chunks(spark, d))


@REGISTRY.add("p5_groups")
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return packing.group_report(p5_chunks(spark, d))


@REGISTRY.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_information(table(spark, d, "documents"))


@REGISTRY.add("p8_redacted")
def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_documents(table(spark, d, "documents"))
