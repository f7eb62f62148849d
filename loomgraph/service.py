"""Requests against stored graphs: index, recall, callers and impact, each answered with rows and a text."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass
from pathlib import Path
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import journal
from .functions.display import ambiguity, anchor, display_name, name_ends
from .operators.impact import impact, impact_names, impact_stats
from .operators.index import index_directory
from .operators.lookup import callees, callers, find_by_id, recall
from .operators.resolve import resolution_stats
from .requests import BadRequest, validate
from .schema import FAN_IN, MAX_NEIGHBOURS
from .sources.git import MAX_PARENTS, changed_files, read_head, worktree_root
from .sources.scan import RootRefused, TooManyFiles, is_under
from .sources.store import LoadFailed, Store, Stored

SHOWN_REPOS = 8
ROOT_VARIABLE, NO_WORKTREE_VARIABLE = "LOOMGRAPH_ROOT", "LOOMGRAPH_NO_WORKTREE"


class NotFound(LookupError):
    """The named symbol, repository or revision is not known."""


@dataclass
class Answer:
    text: str
    rows: list[Row]
    is_error: bool = False


def _work_tree(path: str) -> str:
    """The work tree around a path, or the path itself without one or where that is switched off."""
    return path if os.environ.get(NO_WORKTREE_VARIABLE) else worktree_root(path) or path


def root_from_uri(value: str) -> str | None:
    """The path of a file URI or absolute path, else None."""
    if value.startswith("file://"):
        return unquote(urlparse(value).path) or None
    return value if os.path.isabs(value) else None


def resolve_symbol(symbols: DataFrame, wanted: str) -> Row | None:
    """By id where the text holds # and @ (without falling back), else the first symbol of that name."""
    by_id = "#" in wanted and "@" in wanted
    found = find_by_id(symbols, wanted) if by_id else recall(symbols, wanted, 1)
    return found.first()


def incoming(edges: DataFrame) -> DataFrame:
    """The calls into each symbol that requests can come to see, its first 500, dealt by the symbol.

    A very hot symbol is first cut in parts, so its calls never meet in one
    task; unresolved calls lead to nothing and are left out.
    """
    most = max(FAN_IN, MAX_NEIGHBOURS)
    order = ("seq", "from_id")
    cell = F.pmod(F.xxhash64("from_id"), F.lit(64))
    few = edges.filter("to_id IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("to_id", cell).orderBy(*order))).filter(F.col("_n") <= most)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = few.repartition(parts, "to_id")
    return dealt.withColumn("_n", F.row_number().over(Window.partitionBy("to_id").orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


class Workspace:
    """Answers requests over the graphs of one store.

    Tables of the newest snapshot are cached, the calls into symbols also dealt
    by symbol (``incoming``), so that callers and each level of an impact move
    the ids in question to the calls and never the calls.  They are dropped
    when a newer snapshot is committed, so other writers are seen at once.  The log is a driver-side
    file; leave ``log`` out for none.
    """

    def __init__(self, spark: SparkSession, store_root: str, log: str | None = None):
        self.spark, self.store, self.log = spark, Store(spark, store_root), log
        self._held: dict[str, Stored] = {}

    # --- which repository ---------------------------------------------------
    def repository(self, path: str | None) -> str:
        """Which root a request is about.

        The given path; else ``LOOMGRAPH_ROOT``; else the nearest indexed
        folder at or above the current one; else the only stored one that the
        current folder lies in; else the only one stored.  A given path that is not stored itself
        stands for the work tree around it, unless ``LOOMGRAPH_NO_WORKTREE``
        is set.
        """
        path = (path or "").strip() or os.environ.get(ROOT_VARIABLE, "").strip()
        if path:
            root = root_from_uri(path) or os.path.abspath(path)
            return root if self.store.current(root) else _work_tree(root)
        here = os.getcwd()
        for folder in [here, *map(str, Path(here).parents)][: MAX_PARENTS + 1]:
            for root in (folder, _work_tree(folder)):
                if self.store.current(root):
                    return root
        known = self.store.catalog().collect()
        around = [r for r in known if is_under(here, r.root_path)]
        for some in (around, known):
            if len(some) == 1:
                return some[0].root_path
        names = ", ".join(r.root_path for r in known[:SHOWN_REPOS])
        raise NotFound(f"several repositories are stored, name one: {names}" if known else "nothing is indexed yet")

    def graph(self, path: str | None) -> Stored:
        root = self.repository(path)
        name = self.store.current(root)
        held = self._held.get(root)
        if held is None or held.snapshot != name:
            self.forget(root)
            held = self.store.load(root)
            held.graph.symbols, held.graph.edges = held.graph.symbols.cache(), held.graph.edges.cache()
            held.incoming = incoming(held.graph.edges).cache()
            self._held[root] = held
        return held

    def forget(self, root: str) -> None:
        held = self._held.pop(root, None)
        if held:
            held.graph.symbols.unpersist()
            held.graph.edges.unpersist()
            held.incoming.unpersist()

    # --- requests -----------------------------------------------------------
    def index(self, path: str | None = None) -> Answer:
        root = _work_tree(os.path.abspath(path or os.getcwd()))
        began = time.perf_counter()
        graph = index_directory(self.spark, root)
        head = read_head(root)
        self.store.save(graph, root, head["sha"], head["branch"])
        self.forget(root)
        stats = resolution_stats(*(getattr(self.store.load(root).graph, t) for t in ("symbols", "edges"))).first()
        at = f" at {head['branch'] or 'no branch'} {head['short_sha']}" if head["short_sha"] else ""
        text = f"{graph.files_indexed} files ({graph.files_failed} failed), {stats.symbol_count} symbols, {stats.edge_count} calls, {stats.resolved_count} resolved, in {(time.perf_counter() - began) * 1000:.0f} ms{at}"
        return Answer(text, [stats])

    def status(self, path: str | None = None) -> Answer:
        """Counts of the stored graph, and whether its revision is still the work tree's."""
        held = self.graph(path)
        now = read_head(held.meta["root_path"])["sha"]
        stale = bool(held.meta.get("indexed_sha") and now and now != held.meta["indexed_sha"])
        m = held.meta
        return Answer(f"{m['root_path']}: {m['files_indexed']} files, {m['symbol_count']} symbols, {m['edge_count']} calls, indexed {m['indexed_at']}{' (stale)' if stale else ''}", [Row(stale=stale, **m)])

    def recall(self, query: str, limit: int = 10, substring: bool = False, path: str | None = None) -> Answer:
        held = self.graph(path)
        found = recall(held.graph.symbols, query, limit, substring)
        text = F.concat(F.col("kind"), F.lit(" "), display_name(F.col("parent"), F.col("name")), F.lit("  "), anchor(F.col("file"), F.col("line"), F.lit(held.meta.get("indexed_sha"))), F.lit("\n  "), F.col("signature"))
        rows = found.withColumn("text", text).collect()
        return Answer("\n".join(r.text for r in rows) or f"no symbol matches {query}", rows)

    def callers(self, symbol: str, direction: str = "callers", limit: int = 50, include_unresolved: bool = True, path: str | None = None) -> Answer:
        held = self.graph(path)
        target = resolve_symbol(held.graph.symbols, symbol)
        if target is None:
            raise NotFound(f"no symbol {symbol}")
        some = callers(held.incoming, target.id, limit) if direction == "callers" else callees(held.graph.edges, target.id, limit, include_unresolved)
        text = F.concat("caller_name", F.lit(" -> "), "callee_name", F.lit("  "), anchor(F.col("file"), F.col("line"), F.lit(held.meta.get("indexed_sha"))), ambiguity(F.col("candidate_count")))
        rows = name_ends(some, held.graph.symbols).withColumn("text", text).orderBy("seq").collect()
        return Answer("\n".join(r.text for r in rows) or f"no {direction} of {target.id}", rows)

    def impact(self, symbol: str, depth: int = 3, since: str | None = None, path: str | None = None) -> Answer:
        held = self.graph(path)
        changed = None
        if since:
            changed = changed_files(self.spark, held.meta["root_path"], since)
            if changed is None:
                raise NotFound(f"cannot compare with {since}")
        target = resolve_symbol(held.graph.symbols, symbol)
        if target is None:
            raise NotFound(f"no symbol {symbol}")
        found = impact(self.spark.createDataFrame([(target.id,)], "target_id string"), held.incoming, held.graph.symbols, depth, changed=changed, stored=True)
        rows = impact_names(found, held.graph.symbols).orderBy("depth", "disc_rank").collect()
        stats = impact_stats(found).first()
        cut_short = any(r.truncated for r in rows)
        lines = [f"{target.id}: no callers" if stats is None else f"{target.id}: {stats.direct_count} direct and {stats.transitive_count} transitive callers in {stats.file_count} files, {stats.test_count} in tests{', cut at the level limit' if cut_short else ''}"]
        if target.exported:
            lines.append("exported: code outside this repository may call it" if stats is None else "exported: changes reach beyond the callers below")
        fan_in = callers(held.incoming, target.id, MAX_NEIGHBOURS).count()
        if fan_in >= FAN_IN:
            lines.append(f"at least {FAN_IN} calls lead to it; only the first {FAN_IN} are followed")
        lines += [f"{'  ' * r.depth}{r.caller_name} via {r.via_name}  {r.caller_file}{' (test)' if r.is_test else ''}" for r in rows]
        for title, some in (("tests to run", sorted({r.caller_file for r in rows if r.is_test})), ("public API reached", sorted({r.caller_name for r in rows if r.exported and not r.is_test}))):
            if some:
                lines.append(f"{title}: {', '.join(some)}")
        return Answer("\n".join(lines), rows)

    def request(self, tool: str, arguments: Any = None) -> Answer:
        """Validate, answer and log; what goes wrong for a known reason becomes an error answer."""
        began, error = time.perf_counter(), None
        try:
            answer = getattr(self, tool)(**validate(tool, arguments))
        except (BadRequest, NotFound, RootRefused, TooManyFiles, LoadFailed) as why:
            error = str(why)
            answer = Answer(error, [], True)
        if self.log:
            journal.append(self.log, tool, arguments, len(answer.rows), (time.perf_counter() - began) * 1000, error)
        return answer
