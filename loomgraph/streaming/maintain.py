"""Keeping a stored graph current from a stream of file events."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Graph, derive_raw_calls, extract, extracted_calls, extracted_symbols, index_directory
from ..operators.resolve import resolve_calls
from ..plans.shared import cut
from ..sources.git import read_head
from ..sources.scan import watchable
from ..sources.store import LoadFailed, Store, Stored

RESOLVED = ("to_id", "ambiguous", "candidate_count")
EVENTS = "event_seq long, path string, kind string, content string"


@dataclass
class Update:
    """What one batch changed; without a snapshot it changed nothing."""

    symbols: int
    edges: int
    symbol_delta: int
    edge_delta: int
    snapshot: str | None

    def __str__(self) -> str:
        def shown(now: int, by: int) -> str:
            return f"{now} ({by:+d})" if by else str(now)

        return f"{shown(self.symbols, self.symbol_delta)} symbols, {shown(self.edges, self.edge_delta)} edges"


def last_events(events: DataFrame, root: str = "") -> DataFrame:
    """(file, kind, content) of the last event of every source file, which is what quick repeated saves come to.

    With a ``root``, absolute paths below it count and become relative to it;
    others, and paths that climb with ``..``, are left out.
    """
    path = F.col("path")
    inside = path.startswith("/") & ~path.contains("/../") if root else F.lit(True)
    some = events.filter(watchable(path, root) & inside & F.col("kind").isin("add", "change", "unlink"))
    file = F.substring(path, len(root.rstrip("/")) + 2, 1 << 20) if root else path
    last = some.groupBy(file.alias("file")).agg(F.max_by(F.struct("kind", "content"), "event_seq").alias("e"))
    return last.select("file", "e.kind", "e.content")


def apply_changes(graph: Graph, last: DataFrame) -> Graph:
    """The graph after ``last`` (file, kind, content; one row per file): the same as one built anew from the files then present.

    A file that is gone, too large or unreadable loses its rows.  Only calls
    whose name is defined by a changed file before or after are resolved
    again, besides the calls of changed files; the rest keep their targets.
    """
    parsed = cut(extract(last.filter("kind <> 'unlink'")).filter("error IS NULL"), "parsed")
    fresh = extracted_symbols(parsed)
    kept = graph.symbols.join(last.select("file"), "file", "left_anti").select(*graph.symbols.columns)
    symbols = cut(kept.unionByName(fresh), "symbols")
    gone = graph.symbols.join(last.select("file"), "file", "left_semi").select("name")
    names = gone.union(fresh.select("name")).distinct().withColumnRenamed("name", "to_name")
    stay = graph.edges.join(last.select("file"), "file", "left_anti").select(*graph.edges.columns)
    again = stay.join(names, "to_name", "left_semi").select(*stay.columns)
    calls = derive_raw_calls(again).unionByName(extracted_calls(parsed))
    edges = stay.join(names, "to_name", "left_anti").select(*stay.columns).unionByName(resolve_calls(calls, symbols))
    return Graph(symbols, cut(edges, "edges"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def store_changes(store: Store, base: Stored, last: DataFrame) -> str | None:
    """Store the graph after ``last`` (file, kind, content; one row per file) and return the snapshot, or None if nothing changed.

    What is written are the partitions of the changed files, and those whose
    calls lead elsewhere since a name has come, gone or become ambiguous.
    Tables are read without being shuffled; only rows of the names in question
    are moved.
    """
    graph = base.graph
    parsed = cut(extract(last.filter("kind <> 'unlink'")).filter("error IS NULL"), "parsed")
    fresh, files = extracted_symbols(parsed), last.select("file")
    mine = sorted(r["b"] for r in last.select(base.bucket().alias("b")).distinct().collect())  # at most as many as partitions
    old = {t: base.rows(t, mine) for t in ("symbols", "edges")}
    gone = cut(old["symbols"].join(files, "file", "left_semi").select(*graph.symbols.columns), "gone")
    names = gone.select("name").union(fresh.select("name")).distinct().withColumnRenamed("name", "to_name")
    calls = extracted_calls(parsed)
    needed = names.union(calls.select("to_name")).distinct().withColumnRenamed("to_name", "name")
    pool = graph.symbols.join(needed, "name", "left_semi").join(files, "file", "left_anti").select(*graph.symbols.columns)
    pool = cut(pool.unionByName(fresh), "pool")
    stay = graph.edges.join(files, "file", "left_anti")
    again = cut(stay.join(names, "to_name", "left_semi").select(*graph.edges.columns), "again")
    told = again.select("seq", *(F.col(c).alias(f"_{c}") for c in RESOLVED))
    differs = ~F.struct(*RESOLVED).eqNullSafe(F.struct(*(F.col(f"_{c}").alias(c) for c in RESOLVED)))
    moved = cut(resolve_calls(derive_raw_calls(again), pool).join(told, "seq").filter(differs).select(*graph.edges.columns), "moved")
    own = cut(resolve_calls(calls, pool).select(*graph.edges.columns), "own")
    if moved.isEmpty() and same_rows(gone, fresh.select(*gone.columns)) and same_rows(old["edges"].join(files, "file", "left_semi").select(*own.columns), own):
        return None
    also = sorted(set(mine) | {r["b"] for r in moved.select(base.bucket().alias("b")).distinct().collect()})
    symbols = old["symbols"].join(files, "file", "left_anti").select(*graph.symbols.columns).unionByName(fresh)
    edges = base.rows("edges", also).join(files, "file", "left_anti").join(moved.select("seq"), "seq", "left_anti").select(*graph.edges.columns).unionByName(moved).unionByName(own)
    count = base.meta["symbol_files"] - gone.select("file").distinct().count() + fresh.select("file").distinct().count()
    head = read_head(base.meta["root_path"])
    return store.save_changes(base, {"symbols": (symbols, mine), "edges": (edges, also)}, count, head["sha"], head["branch"])


def apply_events(graph: Graph, events: DataFrame, root: str = "") -> Graph:
    """The graph after a batch of events (see ``EVENTS``)."""
    return apply_changes(graph, cut(last_events(events, root), "events"))


def unchanged(graph: Graph, last: DataFrame) -> bool:
    """Whether ``last`` writes no file and removes none that the graph has rows of."""
    if not last.filter("kind <> 'unlink'").isEmpty():
        return False
    return all(t.join(last.select("file"), "file", "left_semi").isEmpty() for t in (graph.symbols, graph.edges))


class Maintainer:
    """Applies event batches to the newest snapshot of a repository and stores the result.

    Batches are serial; every batch starts from the snapshot that is then
    newest, so an index made elsewhere in between is taken up.  A batch that
    changes nothing stores nothing.  A batch that fails is noted in
    ``failures`` and the stream goes on; its files are tried once more with
    the next batch.  ``absolute`` events name paths below
    the root; others are relative to it.
    """

    def __init__(self, spark: SparkSession, store: Store, root_path: str, absolute: bool = False):
        self.spark, self.store, self.root_path, self.absolute = spark, store, root_path, absolute
        self.updates: list[Update] = []
        self.failures: list[tuple[int, str]] = []
        self.query: StreamingQuery | None = None
        self._pending: DataFrame | None = None  # files of a batch that failed

    def _before(self) -> tuple[Graph, tuple[int, int]]:
        try:
            before = self.store.load(self.root_path)
            return before.graph, (before.meta["symbol_count"], before.meta["edge_count"])
        except LoadFailed as why:
            if why.reason != "missing":
                raise
        none = self.spark.createDataFrame([], extract(self.spark.createDataFrame([], "file string, content string")).schema)
        nodes = extracted_symbols(none)
        return Graph(nodes, resolve_calls(extracted_calls(none), nodes)), (0, 0)

    def _saved(self, after: Graph, counts: tuple[int, int]) -> Update:
        head = read_head(self.root_path)
        return self._told(self.store.save(after, self.root_path, head["sha"], head["branch"]), counts)

    def _told(self, name: str | None, counts: tuple[int, int]) -> Update:
        if name is None:
            return Update(*counts, 0, 0, None)
        meta = self.store.load(self.root_path).meta
        update = Update(meta["symbol_count"], meta["edge_count"], meta["symbol_count"] - counts[0], meta["edge_count"] - counts[1], name)
        self.updates.append(update)
        return update

    def apply(self, events: DataFrame, batch: int = 0) -> Update:
        """Apply a batch, and with it the files of a batch before that failed, where nothing newer is known of them."""
        new = last = cut(last_events(events, self.root_path if self.absolute else ""), "events")
        if self._pending is not None:
            last = cut(new.unionByName(self._pending.join(new.select("file"), "file", "left_anti")), "events")
        self._pending = new
        update = self._apply_last(last)
        self._pending = None
        return update

    def _apply_last(self, last: DataFrame) -> Update:
        base = self.store.load_or_none(self.root_path)
        if base and "parts" in base.meta:
            counts = base.meta["symbol_count"], base.meta["edge_count"]
            return self._told(store_changes(self.store, base, last), counts)
        graph, counts = self._before()
        if unchanged(graph, last):
            return Update(*counts, 0, 0, None)
        after = apply_changes(graph, last)
        after.files_indexed = after.symbols.select("file").distinct().count()
        return self._saved(after, counts)

    def full_reindex(self) -> Update:
        """Read the whole folder again, whatever is stored."""
        try:
            counts = self._before()[1]
        except LoadFailed:
            counts = (0, 0)
        return self._saved(index_directory(self.spark, self.root_path), counts)

    def _batch(self, events: DataFrame, batch: int) -> None:
        try:
            self.apply(events, batch)
        except Exception as why:  # the next batches still count; what failed is kept for the caller
            self.failures.append((batch, f"{type(why).__name__}: {why}"[:500]))
            logging.getLogger(__name__).warning("batch %d failed: %s", batch, why)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a stream of ``EVENTS``; a trigger interval takes the place of waiting for writes to settle.

        A folder without a stored graph is indexed first.
        """
        if self.store.current(self.root_path) is None and os.path.isdir(self.root_path):
            self.full_reindex()
        self.query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
        return self.query

    def stop(self) -> None:
        if self.query:
            self.query.stop()
