"""Validation of stored symbols and edges: bad rows go, texts are sanitised and clipped, defaults filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redact import sanitize
from ..schema import CAPS, KINDS

MAX_ITEMS = 50


def sanitize_array(items: Column, most: int = CAPS["name"]) -> Column:
    """Sanitised non-empty items, at most 50; null if none is left."""
    clean = F.slice(F.filter(F.transform(items, lambda x: sanitize(x, most)), lambda x: x.isNotNull() & (x != "")), 1, MAX_ITEMS)
    return F.when(F.size(clean) > 0, clean)


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def valid_symbols(rows: DataFrame) -> DataFrame:
    """Rows with id, name and file, a signature (it may be empty), a known kind and a line of at least 1.

    ``column`` defaults to 1, ``end_line`` to 0 and ``exported`` to false;
    optional columns that are absent stay absent.
    """
    good = _filled("id") & _filled("name") & _filled("file") & F.col("signature").isNotNull() & (F.col("line") >= 1) & F.col("kind").isin(*KINDS)
    clean = {k: sanitize(F.col(k), CAPS[k]) for k in ("id", "name", "file", "signature")}
    clean |= {"column": F.coalesce("column", F.lit(1)), "end_line": F.coalesce("end_line", F.lit(0)), "exported": F.coalesce("exported", F.lit(False))}
    clean |= {k: sanitize(F.col(k), CAPS["name"]) for k in ("parent",) if k in rows.columns}
    clean |= {k: sanitize_array(F.col(k)) for k in ("extends", "implements") if k in rows.columns}
    return rows.filter(good).withColumns({k: v for k, v in clean.items() if k in rows.columns})


def valid_edges(rows: DataFrame, has_to_id: Column | None = None) -> DataFrame:
    """Rows with from_id, to_name and file and a line of at least 1, whose to_id is null or not empty.

    ``has_to_id`` says whether the stored row names a target at all (null is a
    named target); rows without one are bad.  By default all do.
    """
    good = _filled("from_id") & _filled("to_name") & _filled("file") & (F.col("line") >= 1) & (F.col("to_id").isNull() | (F.col("to_id") != ""))
    good = good & F.coalesce(F.lit(True) if has_to_id is None else has_to_id, F.lit(False))
    clean = {"from_id": CAPS["id"], "to_id": CAPS["id"], "to_name": CAPS["name"], "file": CAPS["file"]}
    return rows.filter(F.coalesce(good, F.lit(False))).withColumns({k: sanitize(F.col(k), n) for k, n in clean.items()})
