"""The corpus pipeline: five stages over ``documents``, each written and read again as Parquet.

1. quality: documents that the line field rejects go.
2. near_dedup: one document of each near-duplicate class stays.
3. decontaminate: documents that hold a benchmark item go.
4. secrets: reported secrets are masked in the text.
5. packing: what is left is packed into sequences of at most 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontaminate, line_quality, packing, probminhash, secret_links
from loomgraph.llm.queries import table, tokenizer_path
from loomgraph.llm.stash import Stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return probminhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_links.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("secrets", secrets), ("packing", packed)]

#: SQL cannot express a trained field or LSH; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash = Stash(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
