"""Transitive callers of symbols: a bounded reverse breadth-first search for many targets at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut, few, is_few
from ..schema import DEFAULT_DEPTH, DEFAULT_LEVEL_LIMIT, FAN_IN, MAX_DEPTH


def is_test_file(path):
    """Column: the path names a test by suffix or by a __tests__ folder."""
    return path.rlike(r"(?i)\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)$") | path.rlike(r"(^|/)__tests__/")


def calls_into(calls: DataFrame, frontier: DataFrame, fan_in: int | None = FAN_IN) -> DataFrame:
    """(to_id, from_id, rn): the first ``fan_in`` calls into each symbol of ``frontier`` (id), ordered by rn and from_id.

    Calls that are dealt by ``to_id`` are not moved.  Without ``fan_in`` all
    calls are given, as they are: their seq orders them, and the join with
    the frontier leaves out those into other symbols.
    """
    if fan_in is None:
        return calls.select("to_id", "from_id", F.col("seq").alias("rn"))
    near = calls.join(frontier.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")
    rn = F.row_number().over(Window.partitionBy("to_id").orderBy("seq", "from_id"))
    return near.withColumn("rn", rn).filter(F.col("rn") <= fan_in).select("to_id", "from_id", "rn")


def _files_of(fresh: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_id, caller_file) of the callers in ``fresh`` that have a symbol; the last one counts."""
    some = symbols.select(F.col("id").alias("caller_id"), "file", "seq").join(fresh.select("caller_id").distinct(), "caller_id", "left_semi")
    return some.groupBy("caller_id").agg(F.max_by("file", "seq").alias("caller_file"))


def _numbered(there: DataFrame, small: bool, level_limit: int) -> DataFrame:
    """Add disc_rank, the place of a caller among those of its target in the order of ``by``, and truncated.

    A level that is not ``small`` is sorted by many tasks, each of which
    counts its own stretch; a target goes on from its rows before it.
    """
    target, order = Window.partitionBy("target_id"), ("by", "caller_id")
    if small:
        there = there.withColumn("disc_rank", F.row_number().over(target.orderBy(*order)).cast("long"))
        return there.withColumn("truncated", F.max("disc_rank").over(target) > level_limit)
    spread = there.repartitionByRange("target_id", *order).sortWithinPartitions("target_id", *order)
    spread = cut(spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "spread")
    sizes = spread.groupBy("target_id", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))  # a row per target and task
    before = F.sum("_n").over(target.orderBy("_part")) - F.col("_n")
    sizes = sizes.select("target_id", "_part", (before - F.col("_from") + 1).alias("_shift"), (F.sum("_n").over(target) > level_limit).alias("truncated"))
    return spread.join(F.broadcast(sizes), ["target_id", "_part"]).withColumn("disc_rank", F.col("_at") + F.col("_shift"))


def impact(targets: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], symbols: DataFrame, depth: int = DEFAULT_DEPTH, level_limit: int = DEFAULT_LEVEL_LIMIT, changed: DataFrame | None = None, stored: bool = False, fan_in: int | None = FAN_IN) -> DataFrame:
    """(target_id, caller_id, depth, disc_rank, via_to_id, caller_file, truncated, is_test) for ``targets`` (target_id).

    Each level reads at most ``fan_in`` edges into a symbol (none for all of
    them); the first discovery of a caller counts, in the order of the
    frontier and then of the edges.  A level reports at most ``level_limit``
    callers but searches on from all; ``truncated`` marks the rows of levels
    that hold more.
    Callers without a symbol are visited and dropped.  ``changed`` (file)
    keeps callers in those files, after the search and its caps.

    A level first narrows the edges to those into its frontier, so only they
    are shuffled and ranked; the join then has at most ``fan_in`` rows for each
    symbol.  Edges that are not ``stored`` already are written once, since
    every level reads them.  ``edges`` may also be a function that gives the
    edges into a table of ids (see ``edges_into``); what leads elsewhere is
    then neither resolved nor written.  Targets are written like every
    frontier after them: rows made on the driver have no size that Spark knows,
    and symbols and calls would be shuffled to meet a few of them.  Frontiers
    of at most ``FEW`` rows are broadcast.  The search ends with an empty
    frontier.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    if callable(edges):
        into = edges
    else:
        calls = edges.filter("to_id IS NOT NULL").select("to_id", "from_id", "seq")
        calls = calls if stored else cut(calls, "calls")
        into = lambda ids: calls
    targets = targets if stored else cut(targets.select("target_id"), "targets")
    visited = targets.select("target_id", F.col("target_id").alias("caller_id"))
    frontier = (targets if stored else few(targets)).select("target_id", F.col("target_id").alias("id"), F.lit(0).cast("long").alias("rank"))
    levels = None
    for level in range(1, depth + 1):
        ranked = calls_into(into(frontier.select("id").distinct()), frontier, fan_in)
        found = frontier.join(ranked, frontier["id"] == ranked["to_id"]).select("target_id", F.col("from_id").alias("caller_id"), F.col("to_id").alias("via_to_id"), "rank", "rn")
        first = found.groupBy("target_id", "caller_id").agg(F.min(F.struct("rank", "rn", "via_to_id")).alias("by"))
        fresh = first.join(visited, ["target_id", "caller_id"], "left_anti")
        fresh = cut(fresh, f"level-{level}")
        visited = visited.unionByName(fresh.select("target_id", "caller_id"))
        there = fresh.join(_files_of(few(fresh), symbols), "caller_id")
        there = _numbered(there, is_few(fresh), level_limit)
        there = there.select("target_id", "caller_id", F.lit(level).alias("depth"), "disc_rank", F.col("by.via_to_id").alias("via_to_id"), "caller_file", "truncated")
        there = cut(there, f"found-{level}")
        levels = there if levels is None else levels.unionByName(there)
        if level == depth or fresh.isEmpty():
            break
        frontier = few(there).select("target_id", F.col("caller_id").alias("id"), F.col("disc_rank").alias("rank"))
    out = levels.filter(F.col("disc_rank") <= level_limit).withColumn("is_test", is_test_file(F.col("caller_file")))
    return out if changed is None else out.join(changed.select(F.col("file").alias("caller_file")).distinct(), "caller_file", "left_semi").select(*out.columns)


def impact_names(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of ``impact`` with caller_name, via_name (ids where no symbol has them) and whether the caller is exported.

    ``found`` is bounded by its level limits, so it is what a join broadcasts.
    """
    last = symbols.groupBy("id").agg(F.max_by(F.struct("name", "exported"), "seq").alias("s"))
    named = found.join(last.select(F.col("id").alias("caller_id"), F.col("s.name").alias("_caller"), F.col("s.exported").alias("exported")), "caller_id", "left")
    named = named.join(last.select(F.col("id").alias("via_to_id"), F.col("s.name").alias("_via")), "via_to_id", "left")
    return named.select(*found.columns, F.coalesce("_caller", "caller_id").alias("caller_name"), F.coalesce("_via", "via_to_id").alias("via_name"), F.coalesce("exported", F.lit(False)).alias("exported"))


def impact_stats(found: DataFrame) -> DataFrame:
    """Per target: direct, transitive and test callers, distinct files, and whether any level was cut."""
    return found.groupBy("target_id").agg(F.count_if(F.col("depth") == 1).alias("direct_count"), F.count_if(F.col("depth") > 1).alias("transitive_count"), F.count_if("is_test").alias("test_count"), F.countDistinct("caller_file").alias("file_count"), F.max("truncated").alias("truncated"))
