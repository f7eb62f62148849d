"""Connected components by alternating large-star and small-star steps, and joins on hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import Stash

CELLS = 64  # parts of one key


def _cell(by: str):
    return F.pmod(F.xxhash64(by), F.lit(CELLS))


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row per ``key``.

    Rows of one key are dealt by the hash of ``by`` into cells; the table's
    row goes to the cells that there are, at most ``CELLS`` of a key, so a
    hot key is split without anything being copied for the others.
    """
    dealt = rows.withColumn("_cell", _cell(by))
    told = dealt.select(key, "_cell").distinct().join(table, key)
    return dealt.join(told, [key, "_cell"], how).drop("_cell")


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): ``pairs`` (u, v) beside the smallest v of u; a node's pairs are dealt into cells as in ``spread_join``."""
    dealt = pairs.withColumn("cell", _cell("v"))
    cells = dealt.groupBy("u", "cell").agg(F.min("v").alias("m"))
    least = cells.groupBy("u").agg(F.min("m").alias("n"))
    told = cells.join(least, "u").select("u", "cell", F.least("m", "n").alias("m"))
    return dealt.join(told, ["u", "cell"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    told = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return told.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")


def _settled(edges: DataFrame) -> bool:
    """Whether edges from larger to smaller nodes are stars: every node has one edge up, or only edges down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").limit(1).count()


def components(edges: DataFrame, stash: Stash, most: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v), for nodes that have an edge.

    A node with very many neighbours is never gathered in one place.  Passes
    are written to the shared folder and end when the edges are stars, which
    is tested exactly; self-loops and repeated edges count once; no edges
    give no rows.
    """
    now = stash.keep(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most):
        if _settled(now):
            break
        after = stash.keep(_small(_large(now)).filter("u <> v").distinct(), "edges")
        stash.drop(now)
        now = after
    else:
        if not _settled(now):
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
