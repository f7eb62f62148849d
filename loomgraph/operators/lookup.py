"""Finding symbols by name, and the edges at one symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAX_NEIGHBOURS, MAX_RECALL


def find_by_id(symbols: DataFrame, symbol_id: str) -> DataFrame:
    """The last symbol with this id, or no row."""
    return symbols.filter(F.col("id") == symbol_id).orderBy(F.desc("seq")).limit(1)


def recall(symbols: DataFrame, query: str, limit: int = 10, substring: bool = False) -> DataFrame:
    """Symbols by name without regard to case; module scopes are never found.

    Exact search puts the query's own case first.  Substring search keeps all
    symbols of one lower-cased name together, in order of the name's first
    symbol.
    """
    named = symbols.filter("kind <> 'module'").withColumn("_low", F.lower("name"))
    limit = max(0, min(limit, MAX_RECALL))
    if not substring:
        hit = named.filter(F.col("_low") == query.lower())
        return hit.orderBy((F.col("name") == query).desc(), "seq").limit(limit).drop("_low")
    hit = named.filter(F.col("_low").contains(query.lower()))
    first = F.min("seq").over(Window.partitionBy("_low"))
    return hit.withColumn("_first", first).orderBy("_first", "seq").limit(limit).drop("_low", "_first")


def recall_by_kind(symbols: DataFrame, kind: str, prefix: str = "src/") -> DataFrame:
    return symbols.filter((F.col("kind") == kind) & F.col("file").startswith(prefix))


def callers(edges: DataFrame, symbol_id: str, limit: int = 50) -> DataFrame:
    """Incoming edges in edge order, at most 500."""
    return edges.filter(F.col("to_id") == symbol_id).orderBy("seq").limit(max(0, min(limit, MAX_NEIGHBOURS)))


def callees(edges: DataFrame, symbol_id: str, limit: int = 50, include_unresolved: bool = True) -> DataFrame:
    """Outgoing edges in edge order, at most 500; unresolved ones on request."""
    out = edges.filter(F.col("from_id") == symbol_id)
    out = out if include_unresolved else out.filter("to_id IS NOT NULL")
    return out.orderBy("seq").limit(max(0, min(limit, MAX_NEIGHBOURS)))
