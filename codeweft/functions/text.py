"""Text helpers with ASCII case rules and Unicode white space."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_END = r"\r?\n"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, ascii_lowercase, ascii_uppercase)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def left_strip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def lines(files: DataFrame, *keep: str, content: str = "content") -> DataFrame:
    """(keep..., line_no from 1, line): the lines of each file; a null content has none."""
    return files.select(*keep, F.posexplode(F.split(content, LINE_END)).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("bigint"))


def word_after(line: Column, keyword: str) -> Column:
    """The identifier after the first occurrence of keyword, null if a letter, digit or underscore stands before it.

    A first occurrence that is refused isn't looked for further on.
    """
    at = F.locate(keyword, line)
    before = F.substring(line, at - 1, F.lit(1))
    word = F.regexp_extract(left_strip(F.substring(line, at + len(keyword), F.length(line))), r"^([A-Za-z0-9_$]+)", 1)
    return F.when((at > 0) & ~((at > 1) & before.rlike(r"^[A-Za-z0-9_]$")) & (word != ""), word)


def quoted(text: Column) -> Column:
    """The first quoted text, single quotes before double ones, stripped; null if there is none or it is blank."""
    parts = [F.nullif(strip(F.regexp_extract(text, f"{q}([^{q}]*){q}", 1)), F.lit("")) for q in "'\""]
    return F.coalesce(*parts)


def after(text: Column, mark: str) -> Column:
    """What follows the first occurrence of mark, null without one."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def before(text: Column, mark: str) -> Column:
    """What precedes the first occurrence of mark; all without one."""
    return F.substring_index(text, mark, 1)


def search_tokens(text: Column) -> Column:
    """Lower-case (ASCII) runs of letters, digits, `_`, `$` and `/` of two or more; repeats are kept."""
    return F.filter(F.split(ascii_lower(text), r"[^A-Za-z0-9_$/]+"), lambda x: F.length(x) >= 2)


def identifier_pattern(name: str) -> str:
    """A pattern for name where no identifier goes on to its left or right."""
    import re

    return rf"(?<![A-Za-z0-9_$])\Q{name}\E(?![A-Za-z0-9_$])" if "\\E" not in name else rf"(?<![A-Za-z0-9_$]){re.escape(name)}(?![A-Za-z0-9_$])"


def url_decode(c: Column) -> Column:
    """`+` is a blank and %XX a byte; a `%` without two hex digits stands for itself, bytes that are no UTF-8 for U+FFFD."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def truncate(c: Column, most: int) -> Column:
    """At most `most` characters, with three dots where something was left off."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def short_commit(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(F.left(c, F.lit(7)))
