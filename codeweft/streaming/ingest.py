"""The scanners over a stream of files: each micro-batch of new files becomes symbols and specifiers, appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.imports import import_specifiers
from ..operators.symbols import symbols
from ..sources.scan import MAX_FILE_BYTES, ignored_path, language_of


def kept_files(stream: DataFrame) -> DataFrame:
    """(path, content, language) of the files a scan keeps; late repeats of a path within a day are dropped if the stream has scanned_at."""
    kept = stream.where(~ignored_path(F.col("path")) & (F.length("content") <= MAX_FILE_BYTES)).withColumn("language", language_of(F.col("path")))
    if "scanned_at" in stream.columns:
        kept = kept.withWatermark("scanned_at", "1 day").dropDuplicatesWithinWatermark(["path"])
    return kept.select("path", "content", "language")


def ingest(stream: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends to root/symbols and root/specifiers; a batch that is run again overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        symbols(df).write.mode("overwrite").parquet(f"{root}/symbols/batch={number}")
        import_specifiers(df).write.mode("overwrite").parquet(f"{root}/specifiers/batch={number}")

    return kept_files(stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
