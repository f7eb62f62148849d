"""Texts about symbols and edges, and references to them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a source file and line, with an optional revision of seven hexadecimal digits.
ANCHOR = r"(\S+\.(?:ts|tsx|js|jsx)):(\d+)(?:\s+@\s+([0-9a-f]{7}))?"


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def sha_tag(sha: Column) -> Column:
    """Revision mark, empty without a revision."""
    return F.coalesce(F.concat(F.lit(" @ "), short_sha(sha)), F.lit(""))


def anchor(file: Column, line: Column, sha: Column) -> Column:
    """Where a statement can be checked: file, line and revision."""
    return F.concat(file, F.lit(":"), line.cast("string"), sha_tag(sha))


def display_name(parent: Column, name: Column) -> Column:
    return F.concat_ws(".", parent, name)


def ambiguity(count: Column) -> Column:
    """A remark on edges whose name has several symbols, empty otherwise."""
    return F.when(count > 1, F.concat(F.lit(" (1 of "), count.cast("string"), F.lit(" candidates)"))).otherwise("")


def delta_text(now: Column, by: Column) -> Column:
    """A count, with its change in brackets where there is one."""
    return F.when(by == 0, now.cast("string")).otherwise(F.concat(now.cast("string"), F.lit(" ("), F.when(by > 0, "+").otherwise(""), by.cast("string"), F.lit(")")))


def _fixed(tenfold: Column, digits: int) -> Column:
    """A whole number as a decimal with this many digits after the point."""
    base = 10**digits
    whole = F.floor(tenfold / base).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((tenfold - whole * base).cast("string"), digits, "0"))


def bytes_text(size: Column) -> Column:
    """A number of bytes in B, KB, MB (one digit) or GB (two digits), halves up."""

    def scaled(unit: int, digits: int) -> Column:
        return _fixed(F.floor(size * float(10**digits) / unit + 0.5).cast("long"), digits)

    out = F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(scaled(1 << 10, 1), F.lit(" KB")))
    return out.when(size < 1 << 30, F.concat(scaled(1 << 20, 1), F.lit(" MB"))).otherwise(F.concat(scaled(1 << 30, 2), F.lit(" GB")))


def ms_text(ms: Column) -> Column:
    """Milliseconds with two digits below 1 and one below 1000, else seconds with two; halves of the decimal form go up."""

    def shown(value: Column, digits: int) -> Column:
        return F.round(value.cast("decimal(30,12)"), digits).cast(f"decimal(18,{digits})").cast("string")

    out = F.when(ms < 1, F.concat(shown(ms, 2), F.lit(" ms"))).when(ms < 1000, F.concat(shown(ms, 1), F.lit(" ms")))
    return out.otherwise(F.concat(shown(ms / 1000, 2), F.lit(" s")))


def posix(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def anchors(text: Column) -> Column:
    """Array of structs (file, line, sha) named in a text; sha is empty where none is given."""
    parts = [F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(g)) for g in (1, 2, 3)]
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("file", "line", "sha"), strict=True))), lambda a: F.struct(a["file"].alias("file"), a["line"].cast("long").alias("line"), a["sha"].alias("sha")))


def name_ends(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the names of both ends: caller_name falls back to the id, callee_name to the called name.

    Symbols are looked up once per id (the last one wins), so edges do not
    multiply.  Edges that lead nowhere are dealt by their caller, since they
    would all meet in one task otherwise.
    """
    last = symbols.groupBy("id").agg(F.max_by("name", "seq").alias("name"))
    named = edges.join(last.select(F.col("id").alias("from_id"), F.col("name").alias("_from")), "from_id", "left")
    callee = last.select(F.col("id").alias("_id"), F.col("name").alias("_to"))
    key = F.coalesce("to_id", F.concat(F.lit("\0"), "from_id"))
    named = named.join(callee, (key == F.col("_id")) & F.col("to_id").isNotNull(), "left")
    return named.select(*edges.columns, F.coalesce("_from", "from_id").alias("caller_name"), F.coalesce("_to", "to_name").alias("callee_name"))
