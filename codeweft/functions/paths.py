"""Path helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths that match need rewriting; all others are in the normal form already.
_UNUSUAL = r"\\|//|(^|/)\.\.?(/|$)|^/|/$"


def normal_path(path: Column) -> Column:
    """`/` as the only separator, single, no `.` and `..` segments, case kept; `..` never leaves the root. Null stays null."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.when(path.rlike(_UNUSUAL), F.array_join(kept, "/")).otherwise(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """The path without its last segment; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def top_dir(path: Column) -> Column:
    """First segment; a root file is its own."""
    return F.split(path, "/")[0]
