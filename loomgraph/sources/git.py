"""Provenance and changed paths of a git work tree; anything odd gives None instead of an error."""

from __future__ import annotations

import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHA = re.compile(r"[0-9a-f]{40}")
MAX_PARENTS, MAX_HOPS = 64, 10


def worktree_root(path: str) -> str | None:
    """Nearest folder at or above ``path`` that holds .git, within 64 levels; a folder that may not be read holds none."""
    here = Path(path).absolute()
    for folder in [here, *here.parents][: MAX_PARENTS + 1]:
        if os.path.exists(folder / ".git"):  # False, not an error, where it may not be looked at
            return str(folder)
    return None


def _git_dir(root: str) -> Path | None:
    dot = Path(root, ".git")
    if dot.is_dir():
        return dot
    if dot.is_file():
        text = dot.read_text(errors="replace").strip()
        if text.startswith("gitdir:"):
            return (Path(root) / text[7:].strip()).resolve()
    return None


def _packed(common: Path, ref: str) -> str | None:
    place = common / "packed-refs"
    for line in place.read_text(errors="replace").splitlines() if place.is_file() else ():
        parts = line.split(" ")
        if len(parts) == 2 and parts[1] == ref and _SHA.fullmatch(parts[0]):
            return parts[0]
    return None


def read_head(path: str) -> dict[str, str | None]:
    """root, sha, short_sha and branch of the work tree around ``path``; values that cannot be told are None."""
    out: dict[str, str | None] = {"root": worktree_root(path), "sha": None, "short_sha": None, "branch": None}
    try:
        folder = _git_dir(out["root"]) if out["root"] else None
        if folder is None:
            return out
        shared = folder / "commondir"
        common = (folder / shared.read_text().strip()).resolve() if shared.is_file() else folder
        value = (folder / "HEAD").read_text(errors="replace").strip()
        for _ in range(MAX_HOPS):
            if not value.startswith("ref:"):
                break
            ref = value[4:].strip()
            if ref.startswith("refs/heads/") and out["branch"] is None:
                out["branch"] = ref[11:]
            places = [p / ref for p in (folder, common) if (p / ref).is_file()]
            value = places[0].read_text(errors="replace").strip() if places else _packed(common, ref) or ""
        if _SHA.fullmatch(value):
            out["sha"], out["short_sha"] = value, value[:7]
    except OSError:
        pass
    return out


def _tree(root: str, ref: str) -> list[tuple[str, str]] | None:
    if ref.startswith("-"):
        return None
    try:
        done = subprocess.run(["git", "-C", root, "ls-tree", "-r", "-z", ref], capture_output=True, timeout=120, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    rows = []
    for entry in done.stdout.decode("utf-8", "replace").split("\0"):
        if entry:
            head, path = entry.split("\t", 1)
            rows.append((path, head.split(" ")[2]))
    return rows


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change) between two listings (path, oid)."""
    a, b = before.select("path", F.col("oid").alias("old")), after.select("path", F.col("oid").alias("new"))
    differ = a.join(b, "path", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return differ.select(F.col("path").alias("file"), F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified").alias("change"))


def changed_files(spark: SparkSession, path: str, since: str) -> DataFrame | None:
    """Files that differ between ``since`` and HEAD, or None where that cannot be told."""
    root = worktree_root(path)
    trees = [_tree(root, ref) for ref in (since, "HEAD")] if root else [None]
    if any(t is None for t in trees):
        return None
    return tree_changes(*(spark.createDataFrame(t, "path string, oid string") for t in trees))
