"""Symbols, by keyword rules on lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, strip, word_after

# fixed values: for each language the keywords and the labels of what they declare
RULES = {
    "rust": "fn Function, struct Struct, enum Enum, trait Trait",
    "typescript": "function Function, class Class, interface Interface, enum Enum",
    "javascript": "function Function, class Class",
    "python": "def Function, class Class",
    "java": "class Class, interface Interface, enum Enum",
    "c": "struct Struct, enum Enum",
    "cpp": "class Class, struct Struct, enum Enum",
    "csharp": "class Class, interface Interface, enum Enum",
    "go": "func Function, type Type",
    "php": "function Function, class Class, interface Interface, trait Trait",
    "kotlin": "fun Function, class Class, interface Interface",
    "swift": "func Function, class Class, struct Struct, protocol Interface, enum Enum",
}


def rules(language: str) -> list[tuple[str, str]]:
    return [tuple(r.split()) for r in RULES[language].split(", ")]


def symbols(files: DataFrame) -> DataFrame:
    """(id, label, name, file_path, start_line, language), unique by id. files: path, content, language."""
    some = "|".join(sorted({k for lang in RULES for k, _ in rules(lang)}))
    rows = lines(files.where("language is not null and content is not null"), "path", "language").where(F.col("line").rlike(f"(?:{some}) "))
    rows = rows.withColumn("line", strip(F.col("line")))
    found = F.lit(None).cast("array<struct<label:string,name:string>>")
    for language in RULES:
        each = F.array(*[F.struct(F.lit(label).alias("label"), word_after(F.col("line"), f"{k} ").alias("name")) for k, label in rules(language)])
        found = F.when(F.col("language") == language, F.filter(each, lambda x: x["name"].isNotNull())).otherwise(found)
    out = rows.select("path", "language", "line_no", F.explode(found).alias("s"))
    key = F.concat_ws(":", "s.label", "path", "s.name", F.col("line_no").cast("string"))
    return out.select(key.alias("id"), "s.label", "s.name", F.col("path").alias("file_path"), F.col("line_no").alias("start_line"), "language").dropDuplicates(["id"])
