"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 1 << 19  # rows of ids or names that a search sends to every executor at most
_local: dict[str, str] = {}  # a folder for each application on one machine


def shared_root(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir; a temporary one only where that is unset and all runs in this process."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        root = _local[context.applicationId]
    return f"{root.rstrip('/')}/loomgraph-{context.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_few(df: DataFrame) -> bool:
    """Whether ``df``, which is written already, so that counting it is cheap, has at most ``FEW`` rows."""
    return df.count() <= FEW


def few(df: DataFrame) -> DataFrame:
    """``df``, which is written already, marked for a broadcast if it has at most ``FEW`` rows.

    What meets it then stays where it is, however low the session's limit in
    bytes; more rows are left to Spark.
    """
    return F.broadcast(df) if is_few(df) else df
