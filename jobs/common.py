"""What the jobs share: settings from a JSON file, a session for the command line, and a fresh folder for a registered query."""

from __future__ import annotations

import json
import logging
import sys
import uuid
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

from loomgraph.plans.shared import shared_root

S = TypeVar("S")


def settings(kind: type[S], path: str | None) -> S:
    """The defaults of ``kind`` with what the JSON file at ``path`` says; unknown names are refused."""
    given = json.loads(Path(path).read_text()) if path else {}
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at ``path``, on any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
