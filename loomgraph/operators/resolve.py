"""Resolving call names to symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, few

HEAVY, SHARE, SALTS = 64, 1 / 256, 64  # names that are told apart at most, the share of all calls that makes one, and its parts


def heavy_names(calls: DataFrame) -> list[str]:
    """At most ``HEAVY`` called names with a good share of all calls each, from a sketch that one pass fills.

    A sketch may take a name too many or too few near the limit, which costs
    some balance and never a result.
    """
    row = calls.filter("to_name IS NOT NULL").agg(F.expr(f"approx_top_k(to_name, {HEAVY}, {64 * HEAVY})").alias("top"), F.count("*").alias("n")).first()
    return [t["item"] for t in row["top"] or [] if t["count"] >= max(2, row["n"] * SHARE)]


def resolve_calls(calls: DataFrame, symbols: DataFrame, within: tuple[str, ...] = (), heavy: list[str] | None = None, names: DataFrame | None = None) -> DataFrame:
    """Add to_id, ambiguous and candidate_count to every call.

    A symbol of the caller's file wins, then the first in ``seq`` order; a
    name without symbols leaves to_id null.  Both lookups have one row per
    key, so calls never multiply.  ``within`` names further columns that must
    agree, such as the repository.

    Calls to ``heavy`` names (see ``heavy_names``) are dealt into ``SALTS``
    parts by their file before they meet the lookup by name, whose rows of
    these names, at most ``HEAVY`` without ``within``, are repeated for each
    part; all other rows are as they are.  The lookup by name and file splits
    a hot name by its files already.

    ``names`` (to_name) says which names the calls may have, where they are
    far fewer than the calls.  Both lookups are then made for these alone and
    written, and only names of several symbols are looked up by file; Spark
    broadcasts what it finds small, and calls stay where they are.
    """
    if names is not None:
        names = cut(names.select("to_name").distinct(), "names")
        symbols = symbols.join(names.withColumnRenamed("to_name", "name"), "name", "left_semi")
    same = symbols.groupBy(*within, F.col("name").alias("to_name"), "file").agg(F.min_by("id", "seq").alias("_same"))
    named = symbols.groupBy(*within, F.col("name").alias("to_name")).agg(F.min_by("id", "seq").alias("_first"), F.count("*").alias("_n"))
    if names is not None:
        named = cut(named, "named")
        same = cut(same.join(named.filter("_n > 1").select(*within, "to_name"), [*within, "to_name"], "left_semi").select(*same.columns), "same")
    keys = [*within, "to_name"]
    dealt = calls.join(same, [*keys, "file"], "left")
    if heavy:
        hot = F.col("to_name").isin(heavy)
        dealt = dealt.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64("file", "seq"), F.lit(SALTS)).cast("int")).otherwise(0))
        named = named.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        keys.append("_salt")
    out = dealt.join(named, keys, "left")
    several = F.col("_n") > 1
    return out.select(*calls.columns, F.coalesce("_same", "_first").alias("to_id"), F.when(several, F.lit(True)).alias("ambiguous"), F.when(several, F.col("_n")).alias("candidate_count"))


def edges_into(calls_to: Callable[[DataFrame], DataFrame], symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges into the symbols of ``ids`` (id), out of all calls, without resolving the others.

    An edge leads to a symbol of the called name, so only calls to names that
    these symbols have (``calls_to`` gives them for a table of to_name) meet
    the lookups, which hold all symbols of these names.  Those are written, as
    both lookups are made from them.
    """
    names = few(cut(symbols.join(ids, "id", "left_semi").select(F.col("name").alias("to_name")).distinct(), "called"))
    alike = cut(symbols.select("id", "name", "file", "seq").join(names.withColumnRenamed("to_name", "name"), "name", "left_semi"), "alike")
    return resolve_calls(calls_to(names), alike, names=names).join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def resolution_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: symbol_count, edge_count, resolved_count."""
    return symbols.agg(F.count("*").alias("symbol_count")).crossJoin(edges.agg(F.count("*").alias("edge_count"), F.count("to_id").alias("resolved_count")))


def hot_symbols(edges: DataFrame, symbols: DataFrame, n: int) -> DataFrame:
    """The n most called symbol names: of the 3n ids with most incoming edges, each name's best."""
    top = edges.filter("to_id IS NOT NULL").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "id").limit(3 * n)
    named = top.join(symbols.select("id", "name"), "id").groupBy("name").agg(F.max("calls").alias("calls"))
    return named.orderBy(F.desc("calls"), "name").limit(n)
