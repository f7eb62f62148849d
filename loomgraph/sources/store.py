"""Stored graphs: Parquet snapshots behind a commit marker, a catalog of them, and the JSON document form.

A snapshot is a folder of its own; its ``meta`` file is written last, so
readers see a whole snapshot or none, on any Hadoop file system.  Rows lie in
Spark partitions by a hash of their file.  A snapshot of changes holds the
partitions that changed and names, for the others, the earlier snapshot that
has them; folders are never written to again, so readers of an older snapshot
are not disturbed.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.index import CALL, SYMBOL, Graph
from ..operators.validate import valid_edges, valid_symbols

VERSION = 1
FILES_A_BUCKET, MAX_BUCKETS = 64, 4096  # of a graph's partitions by file
MAX_FOLDERS = 16  # that the partitions of one snapshot may lie in
TABLES = ("symbols", "edges")

# Why a stored graph cannot be loaded.
REASONS = ["missing", "unreadable", "invalid-json", "schema-invalid", "root-mismatch"]


class LoadFailed(RuntimeError):
    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


def repo_id_of(root: str) -> str:
    return hashlib.sha256(root.encode()).hexdigest()[:16]


@dataclass
class Stored:
    graph: Graph
    meta: dict
    snapshot: str
    root: str = ""  # of the snapshots' folders
    incoming: DataFrame | None = None  # what a reader holds for lookups by called symbol

    def bucket(self, file: str = "file") -> Column:
        """The partition of a file."""
        return bucket_of(file, self.meta["buckets"])

    def rows(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its partitions; only their files are read."""
        spark, out = self.graph.symbols.sparkSession, None
        schema = StructType.fromJson(json.loads(self.meta["schemas"][table]))
        for name, there in self.meta["parts"][table].items():
            wanted = there if buckets is None else sorted(set(there) & set(buckets))
            one = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.root}/{name}/{table}")
            if len(wanted) < self.meta["buckets"]:
                one = one.filter(F.col("bucket").isin(wanted))
            out = one if out is None else out.unionByName(one)
        return out.drop("bucket")


def bucket_of(file: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(buckets)).cast("int")


class Store:
    """Graphs below ``root``, one folder per repository, one below it per snapshot."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _exists(self, *parts: str) -> bool:
        fs, path = self._path(*parts)
        return fs.exists(path)

    def _read(self, *parts: str) -> str | None:
        fs, path = self._path(*parts)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()

    def save(self, graph: Graph, root_path: str, sha: str | None = None, branch: str | None = None) -> str:
        """Write a snapshot of the whole graph and return its name; names sort by time."""
        name, place = self._begin(root_path)
        buckets = max(1, min(MAX_BUCKETS, -(-graph.files_indexed // FILES_A_BUCKET)))
        parts = {t: {name: list(range(buckets))} for t in TABLES}
        meta = {"files_indexed": graph.files_indexed, "buckets": buckets, "parts": parts, "schemas": {t: getattr(graph, t).schema.json() for t in TABLES}}
        for table in TABLES:
            _write(getattr(graph, table), f"{place}/{table}", buckets)
        written = {t: self.spark.read.schema(getattr(graph, t).schema).parquet(f"{place}/{t}") for t in TABLES}
        meta |= written["symbols"].agg(F.count("*").alias("symbol_count"), F.countDistinct("file").alias("symbol_files")).first().asDict()
        return self._commit(root_path, name, meta | {"edge_count": written["edges"].count()}, sha, branch)

    def save_changes(self, base: Stored, changed: dict[str, tuple[DataFrame, list[int]]], symbol_files: int, sha: str | None = None, branch: str | None = None) -> str:
        """Write a snapshot that differs from ``base`` in some partitions: per table, their new rows and their numbers.

        Where the partitions would lie in more than ``MAX_FOLDERS`` folders,
        all of them are written anew instead.
        """
        root_path = base.meta["root_path"]
        name, place = self._begin(root_path)
        meta = {k: base.meta[k] for k in ("buckets", "schemas")} | {"symbol_files": symbol_files, "files_indexed": symbol_files, "parts": {}}
        for table in TABLES:
            rows, mine = changed[table]
            parts = {k: left for k, v in base.meta["parts"][table].items() if (left := sorted(set(v) - set(mine)))}
            old = base.rows(table, mine).count() if mine else 0
            if len(parts) >= MAX_FOLDERS:
                kept = base.rows(table, sorted(set(range(meta["buckets"])) - set(mine)))
                _write(kept.unionByName(rows), f"{place}/{table}", meta["buckets"])
                parts = {name: list(range(meta["buckets"]))}
            else:
                _write(rows, f"{place}/{table}", meta["buckets"])
                parts |= {name: sorted(mine)} if mine else {}
            now = self.spark.read.schema(StructType([*rows.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{place}/{table}").filter(F.col("bucket").isin(mine)).count()
            meta["parts"][table] = parts
            meta[f"{table[:-1]}_count"] = base.meta[f"{table[:-1]}_count"] - old + now
        return self._commit(root_path, name, meta, sha, branch)

    def prune(self, root_path: str, keep: int = 2) -> list[str]:
        """Remove what the newest ``keep`` snapshots do not need, and return the names of the removed ones.

        Not for a moment when another process writes or reads older ones.
        """
        repo = repo_id_of(root_path)
        names = self._names(repo)
        good = [n for n in names if self._meta(repo, n)][-max(1, keep) :]
        if not good:
            return []
        needed = set(good) | {n for g in good for there in (self._meta(repo, g).get("parts") or {}).values() for n in there}
        gone = [n for n in names if n not in needed and n < good[-1]]
        for name in gone:
            fs, folder = self._path(repo, name)
            fs.delete(folder, True)
        return gone

    def _begin(self, root_path: str) -> tuple[str, str]:
        repo = repo_id_of(root_path)
        name = f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        fs, folder = self._path(repo, name)
        fs.mkdirs(folder)
        for private in (folder.getParent(), folder):  # owner only, whatever the files below allow
            fs.setPermission(private, self.spark._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))
        return name, f"{self.root}/{repo}/{name}"

    def _commit(self, root_path: str, name: str, meta: dict, sha: str | None, branch: str | None) -> str:
        repo = repo_id_of(root_path)
        meta = {"version": VERSION, "repo_id": repo, "root_path": root_path, "indexed_at": dt.datetime.now(dt.UTC).isoformat(), "indexed_sha": sha, "indexed_branch": branch} | meta
        fs, marker = self._path(repo, name, "meta.json.tmp")
        stream = fs.create(marker)
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()
        if not fs.rename(marker, self._path(repo, name, "meta.json")[1]):
            raise OSError(f"cannot commit {self.root}/{repo}/{name}")
        return name

    def _meta(self, repo: str, name: str) -> dict | None:
        """What a snapshot's marker says; none for a snapshot without one, or with one that cannot be read."""
        try:
            meta = json.loads(self._read(repo, name, "meta.json") or "")
            check_meta(meta)
        except (ValueError, LoadFailed, Py4JJavaError):
            return None
        return meta

    def current(self, root_path: str) -> str | None:
        """Name of the newest snapshot that can be read, which also serves as the version of a cache.

        Where there is none, it is the newest of the damaged ones, so that
        ``load`` can say what is wrong with it.
        """
        repo = repo_id_of(root_path)
        names = self._names(repo)[::-1]
        damaged = None
        for name in names:
            if self._meta(repo, name):
                return name
            if damaged is None and self._exists(repo, name, "meta.json"):
                damaged = name
        return damaged

    def load(self, root_path: str) -> Stored:
        """The newest snapshot; fails with one of ``REASONS``."""
        repo, name = repo_id_of(root_path), self.current(root_path)
        if name is None:
            raise LoadFailed("missing", root_path)
        try:
            meta = json.loads(self._read(repo, name, "meta.json"))
        except ValueError as why:
            raise LoadFailed("invalid-json", str(why)) from why
        check_meta(meta)
        if meta["root_path"] != root_path:
            raise LoadFailed("root-mismatch", meta["root_path"])
        none = self.spark.createDataFrame([], "id string")
        found = Stored(Graph(none, none, files_indexed=meta.get("files_indexed", 0)), meta, name, f"{self.root}/{repo}")
        try:
            if "parts" in meta:
                found.graph.symbols, found.graph.edges = (found.rows(t) for t in TABLES)
            else:  # written as one folder for each table
                found.graph.symbols, found.graph.edges = (self.spark.read.parquet(f"{self.root}/{repo}/{name}/{t}") for t in TABLES)
        except Exception as why:
            raise LoadFailed("unreadable", str(why)[:200]) from why
        return found

    def load_or_none(self, root_path: str) -> Stored | None:
        """The newest snapshot, or None for whatever reason it cannot be loaded."""
        try:
            return self.load(root_path)
        except LoadFailed:
            return None

    def catalog(self) -> DataFrame:
        """A row per repository with a snapshot that can be read, its newest one; the most recent first; what cannot be read is passed over."""
        rows = []
        for repo in self._names():
            for name in reversed(self._names(repo)):
                meta = self._meta(repo, name)
                if meta:
                    rows.append(tuple(meta.get(k) for k in ("repo_id", "root_path", "indexed_at", "files_indexed", "symbol_count", "edge_count", "indexed_sha", "indexed_branch")))
                    break
        return self.spark.createDataFrame(rows, "repo_id string, root_path string, indexed_at string, files_indexed long, symbol_count long, edge_count long, indexed_sha string, indexed_branch string").orderBy(F.desc("indexed_at"))


def _write(rows: DataFrame, path: str, buckets: int) -> None:
    """Partitions by file; a task writes few of them, and AQE divides those that are large.  A single partition needs no dealing."""
    placed = rows.withColumn("bucket", bucket_of("file", buckets))
    (placed.hint("rebalance", "bucket") if buckets > 1 else placed).write.partitionBy("bucket").parquet(path)


def check_meta(meta: object) -> None:
    if not isinstance(meta, dict) or meta.get("version") != VERSION or any(not isinstance(meta.get(k), str) or not meta[k] for k in ("repo_id", "root_path", "indexed_at")):
        raise LoadFailed("schema-invalid", "version, repo_id, root_path and indexed_at are required")


# --- the JSON document: camel-cased fields, one file ------------------------
_SYMBOL_FIELDS = {"id": "id", "name": "name", "kind": "kind", "file": "file", "line": "line", "column": "column", "endLine": "end_line", "signature": "signature", "exported": "exported", "parent": "parent", "static": "is_static", "extends": "extends", "implements": "implements"}
_EDGE_FIELDS = {"fromId": "from_id", "toId": "to_id", "toName": "to_name", "file": "file", "line": "line", "column": "column", "ambiguous": "ambiguous", "candidateCount": "candidate_count"}
_EDGE = CALL + ", to_id string, ambiguous boolean, candidate_count int"


def export_document(stored: Stored, path: str, pretty: bool = False) -> None:
    """Write the document beside its place and move it there; owner only; rows stream through the driver.

    Optional fields without a value are left out, except the target of a call.
    """
    def records(df: DataFrame, fields: dict[str, str], always: tuple[str, ...] = ()):
        for row in df.orderBy("seq").select(*fields.values()).toLocalIterator():
            yield {k: row[v] for k, v in fields.items() if row[v] is not None or k in always}

    meta = stored.meta
    head = {"version": VERSION, "repoId": meta["repo_id"], "rootPath": meta["root_path"], "indexedAt": meta["indexed_at"], "filesIndexed": meta["files_indexed"], "symbolCount": meta["symbol_count"], "edgeCount": meta["edge_count"]}
    head |= {k: meta[v] for k, v in (("indexedSha", "indexed_sha"), ("indexedBranch", "indexed_branch")) if meta.get(v)}
    os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
    line = "\n" if pretty else ""
    with open(os.open(path + ".tmp", os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        f.write(json.dumps(head)[:-1])
        for name, rows in (("symbols", records(stored.graph.symbols, _SYMBOL_FIELDS)), ("edges", records(stored.graph.edges, _EDGE_FIELDS, ("toId",)))):
            f.write(f', {line}"{name}": [')
            for n, row in enumerate(rows):
                f.write(("," if n else "") + line + json.dumps(row))
            f.write("]")
        f.write("}\n")
    os.replace(path + ".tmp", path)


def import_document(spark: SparkSession, path: str, root_path: str | None = None) -> Stored:
    """Read and validate a document; bad rows go and counts are taken anew; fails with one of ``REASONS``."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            raw = json.load(f)
    except FileNotFoundError as why:
        raise LoadFailed("missing", path) from why
    except OSError as why:
        raise LoadFailed("unreadable", str(why)) from why
    except ValueError as why:
        raise LoadFailed("invalid-json", str(why)) from why
    if not isinstance(raw, dict):
        raise LoadFailed("schema-invalid", "not an object")
    meta = {"version": raw.get("version"), "repo_id": raw.get("repoId"), "root_path": raw.get("rootPath"), "indexed_at": raw.get("indexedAt"), "files_indexed": raw.get("filesIndexed") if isinstance(raw.get("filesIndexed"), int) else 0, "indexed_sha": raw.get("indexedSha"), "indexed_branch": raw.get("indexedBranch")}
    check_meta(meta)
    if not isinstance(raw.get("symbols"), list) or not isinstance(raw.get("edges"), list):
        raise LoadFailed("schema-invalid", "symbols and edges must be lists")
    if root_path is not None and meta["root_path"] != root_path:
        raise LoadFailed("root-mismatch", meta["root_path"])

    def rows(items: list, fields: dict[str, str], ddl: str):
        kinds = dict(p.rsplit(" ", 1) for p in ddl.split(", "))
        right = {"string": str, "int": (int, float), "boolean": bool, "array<string>": list}
        for seq, item in enumerate(items):
            if not isinstance(item, dict):
                continue
            one = {}
            for k, v in fields.items():
                value = item.get(k)
                kind = kinds[v]
                good = isinstance(value, right[kind]) and not (kind == "int" and isinstance(value, bool))
                one[v] = (int(value) if kind == "int" else [x for x in value if isinstance(x, str)] if kind == "array<string>" else value) if good else None
            target = item.get("toId", 0)
            yield one | {"seq": seq, "named": target is None or isinstance(target, str)}

    symbols = valid_symbols(spark.createDataFrame(rows(raw["symbols"], _SYMBOL_FIELDS, SYMBOL), SYMBOL + ", seq long, named boolean")).drop("named")
    edges = valid_edges(spark.createDataFrame(rows(raw["edges"], _EDGE_FIELDS, _EDGE), _EDGE + ", seq long, named boolean"), F.col("named")).drop("named")
    meta |= {"symbol_count": symbols.count(), "edge_count": edges.count()}
    return Stored(Graph(symbols.withColumn("name_lower", F.lower("name")), edges, meta["files_indexed"]), meta, "")
