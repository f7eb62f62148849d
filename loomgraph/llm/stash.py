"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}  # a folder for each application on one machine


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir; a temporary one only where that is unset and all runs in this process (tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        found = _local[context.applicationId]
    return f"{found.rstrip('/')}/loomgraph-{context.applicationId}"


class Stash:
    """Writes tables under one folder of the shared directory and reads them back.

    A written table cuts the lineage, is columnar, and outlives a lost
    executor.  ``drop`` removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are done; it acts when the driver collects garbage.

    Memory that this process no longer uses goes back to the system too.
    """
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    spark._jvm.System.gc()
    time.sleep(1)  # the cleaner works beside the driver


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's decimal text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
