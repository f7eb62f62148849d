"""Finding source files below a root, safely, and where a root may be."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions and their languages, ignored folders, caps, refused roots.
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}
IGNORED = ["node_modules", "dist", "build", ".git", "coverage", ".next", ".nuxt", ".cache", "out"]
MAX_FILES, MAX_BYTES = 50_000, 5 * 1024 * 1024
SYSTEM_ROOTS = [
    "/", "/bin", "/boot", "/dev", "/etc", "/home", "/lib", "/lib64", "/opt", "/proc", "/root", "/run", "/sbin", "/srv", "/sys", "/tmp", "/usr", "/usr/bin", "/usr/local", "/var",
    "/private", "/private/etc", "/private/var", "/private/tmp", "/Applications", "/Library", "/System", "/Volumes", "/Users",
    r"C:\Windows", r"C:\Windows\System32", r"C:\Program Files", r"C:\Program Files (x86)", r"C:\Users", r"C:\ProgramData",
]

_IGNORED = re.compile(rf"(^|/)({'|'.join(map(re.escape, IGNORED))})(/|$)|\.d\.ts$")
_SOURCE = re.compile(rf"\.({'|'.join(LANGUAGES)})$", re.I)


class RootRefused(ValueError):
    """The root is no place to index."""


class TooManyFiles(RuntimeError):
    """More files than the cap; nothing is left out silently."""


def detect_language(path: Column) -> Column:
    """Language by extension without regard to case, null for other files."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, language in LANGUAGES.items():
        out = out.when(extension == name, language)
    return out


def watchable(path: Column, root: str = "") -> Column:
    """Source files under ``root`` outside ignored folders."""
    inside = path.startswith(root.rstrip("/") + "/") if root else F.lit(True)
    return inside & path.rlike(rf"(?i){_SOURCE.pattern}") & ~path.rlike(_IGNORED.pattern)


def is_under(child: str, parent: str) -> bool:
    """Whether a path lies at or below another, by slashes and without regard to case."""
    a, b = (p.replace("\\", "/").rstrip("/").lower() for p in (child, parent))
    return a == b or a.startswith(b + "/")


def guard_root(path: str) -> str:
    """The absolute root; refuses what is missing, a system folder or the home folder, also behind links."""
    root = os.path.abspath(path)
    real = os.path.realpath(root)
    if not os.path.isdir(real):
        raise RootRefused(f"{path} is not a folder")
    for place in (root, real):
        if place in SYSTEM_ROOTS or place == os.path.realpath(Path.home()) or re.fullmatch(r"[A-Za-z]:[\\/]?", place):
            raise RootRefused(f"{path} is a system or home folder")
    return root


def list_sources(root: str, ignore: tuple[str, ...] = ()) -> tuple[list[tuple[str, int]], int]:
    """((relative path, bytes) in path order, links skipped) of the sources below ``root``.

    Links to folders are not entered; a file whose real path leaves the root
    counts as skipped.  Hidden and ignored places, and files above 5 MiB, are
    left out.  Above 50,000 files the scan fails.
    """
    base = os.path.realpath(guard_root(root))
    more = [re.compile(p) for p in ignore]
    found, skipped = [], 0
    for folder, folders, files in os.walk(base, followlinks=False):
        rel = os.path.relpath(folder, base).replace(os.sep, "/")
        rel = "" if rel == "." else rel + "/"
        folders[:] = sorted(d for d in folders if not d.startswith(".") and not _IGNORED.search(rel + d) and not any(p.search(rel + d) for p in more))
        for name in files:
            path = rel + name
            if name.startswith(".") or not _SOURCE.search(name) or _IGNORED.search(path) or any(p.search(path) for p in more):
                continue
            real = os.path.realpath(os.path.join(folder, name))
            if not real.startswith(base.rstrip("/") + "/"):
                skipped += 1
                continue
            size = os.path.getsize(real) if os.path.isfile(real) else -1
            if size <= MAX_BYTES:
                found.append((path, size))
            if len(found) > MAX_FILES:
                raise TooManyFiles(f"more than {MAX_FILES} source files below {root}")
    return sorted(found, key=lambda f: f[0].encode()), skipped


def files_below(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(file, content; links skipped): sources of a root that executors can read, by their bytes over tasks.

    The driver holds the listing only, which the cap bounds.
    """
    found, skipped = list_sources(root, ignore)
    base = os.path.realpath(root)
    tasks = max(1, min(len(found), sum(s for _, s in found) // (1 << 20) + 1))
    listed = spark.createDataFrame([(p,) for p, _ in found], "file string").repartition(int(tasks))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("file").to_pylist():
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_pydict({"file": pa.array([path]), "content": pa.array([content], pa.binary())})

    return listed.mapInArrow(read, "file string, content binary"), skipped


def lake_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the sources in a data-lake folder; size and name filters reach the file listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % ",".join(LANGUAGES)).load(path)
    return raw.filter((F.col("length") <= MAX_BYTES) & watchable(F.col("path"))).select(F.col("path").alias("file"), "content")
