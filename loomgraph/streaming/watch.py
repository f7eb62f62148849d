"""A folder as a stream of file events.

The stream's offset is a listing (path, time of change, size) of the sources
below the folder, so what happened between two offsets can be told again after
a restart, each event once.  The driver lists and compares; what is in the
files is read by tasks, when a batch is applied.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.scan import list_sources

FORMAT = "folder_events"


def between(before: dict, after: dict) -> list[tuple[int, str, str]]:
    """(event_seq, path, kind) that lead from one offset to another, by path; files that came, changed or went."""
    old, new = before["files"], after["files"]
    kinds = {p: "add" if p not in old else "change" for p, state in new.items() if old.get(p) != state} | {p: "unlink" for p in old if p not in new}
    return [(before["seq"] + n, p, kinds[p]) for n, p in enumerate(sorted(kinds), 1)]


class FolderEvents(DataSource):
    """``readStream.format("folder_events").option("path", root)``; rows (event_seq, path, kind), with absolute paths.

    A file that changed within the last ``settle_seconds`` (0.3) waits for a
    later batch, since it may still be written.  Which files count, and how
    many there may be, is as in a scan of the folder.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "event_seq long, path string, kind string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Listing(self.options["path"], float(self.options.get("settle_seconds", 0.3)))


class _Listing(SimpleDataSourceStreamReader):
    def __init__(self, root: str, settle: float):
        self.root, self.settle = os.path.abspath(root), settle

    def initialOffset(self) -> dict:
        return {"seq": 0, "files": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        files, now = {}, time.time()
        for rel, _ in list_sources(self.root)[0]:
            path = f"{self.root}/{rel}"
            try:
                at = os.stat(path)
            except OSError:  # gone since it was listed
                continue
            old, state = start["files"].get(path), [at.st_mtime_ns, at.st_size]
            if old != state and now - at.st_mtime < self.settle:
                state = old
            if state:
                files[path] = state
        end = {"seq": start["seq"], "files": files}
        events = between(start, end)
        end["seq"] += len(events)
        return iter(events), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(between(start, end))

    def commit(self, end: dict) -> None:
        pass


def folder_events(spark: SparkSession, root: str, settle_seconds: float = 0.3) -> DataFrame:
    """The stream of a folder's events, with ``content`` (null for files that are gone or cannot be read)."""
    spark.dataSource.register(FolderEvents)
    events = spark.readStream.format(FORMAT).option("path", root).option("settle_seconds", str(settle_seconds)).load()

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                one, content = batch.slice(k, 1), None
                if one.column("kind")[0].as_py() != "unlink":
                    try:
                        with open(one.column("path")[0].as_py(), "rb") as f:
                            content = f.read().decode("utf-8", "replace")
                    except OSError:
                        pass
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([content], pa.string())], ["event_seq", "path", "kind", "content"])

    return events.mapInArrow(read, "event_seq long, path string, kind string, content string")
