"""Incremental job: masks secrets in a growing table of texts and counts what it found.

    python -m jobs.redact_corpus --source PATH --output PATH --checkpoint PATH [--config jobs/redact_corpus.json]

A file stream takes the Parquet files that no earlier run has taken, in
batches, and ends when there are no more.  A batch writes

* ``texts``: every row with its text masked and the labels of what was found,
  in folders by batch and by a column of the table,
* ``findings``: how many of the batch's rows hold each label, by another
  column, so that a report over all runs (``report``) adds small rows up and
  never reads a text again.

Both are overwritten by batch (dynamic partition overwrite), so a batch that
failed half-way and is run again leaves the same rows.  Which files and which
batch are next is in Spark's checkpoint, which belongs to the output: one
without the other is refused.  A row's text is masked by the library's rules,
in the JVM; nothing is shuffled but the counts.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from jobs.common import exists, fresh_folder, session, settings
from loomgraph.functions.redact import detect_secrets, redact_secrets
from loomgraph.plans.queries import _detect_sql, _redact_sql

log = logging.getLogger("redact_corpus")
NONE = "none"  # folder of rows whose column is null or empty


@dataclass(frozen=True)
class Settings:
    key: str = "doc_id"
    text: str = "text"
    keep: tuple[str, ...] = ("source", "lang")
    partition_by: str = "lang"
    report_by: str = "source"
    files_per_batch: int = 200
    schema: str | None = None  # of the source, as DDL; else what its files say when the job starts


def masked(rows: DataFrame, by: Settings) -> DataFrame:
    """Key, kept columns, masked text, labels (an array) and whether the text changed; null text stays null and has no label.

    The rules rewrite what they find and nothing else, so a text without a label is left as it is.
    """
    text = F.col(by.text)
    labels = F.filter(F.split(F.coalesce(detect_secrets(text), F.lit("")), ","), lambda x: x != "")
    told = rows.select(by.key, *by.keep, text.alias("_before"), labels.alias("labels"))
    before = F.col("_before")
    out = told.select(by.key, *by.keep, F.when(F.size("labels") == 0, before).otherwise(redact_secrets(before)).alias(by.text), "labels", "_before")
    return out.withColumn("changed", ~F.col(by.text).eqNullSafe(F.col("_before"))).drop("_before")


def findings(texts: DataFrame, by: Settings) -> DataFrame:
    """(report column, label, documents, changed): rows that hold a label; an empty label counts all rows."""
    each = F.explode(F.concat(F.array(F.lit("")), F.array_distinct("labels"))).alias("label")
    return texts.select(F.col(by.report_by).cast("string").alias(by.report_by), "changed", each).groupBy(by.report_by, "label").agg(F.count("*").alias("documents"), F.count_if("changed").alias("changed"))


def _folder(column: str):
    value = F.col(column).cast("string")
    return F.when(F.coalesce(value, F.lit("")) == "", NONE).otherwise(value)


def _texts_schema(source: StructType, by: Settings) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in source}
    some = [(c, kinds[c]) for c in (by.key, *by.keep, by.text)]
    return ", ".join(f"`{c}` {k}" for c, k in some) + ", labels array<string>, changed boolean, batch_id long, folder string"


def texts(spark: SparkSession, output: str, source: StructType, by: Settings) -> DataFrame:
    """All masked rows so far."""
    return spark.read.schema(_texts_schema(source, by)).parquet(f"{output}/texts")


def report(spark: SparkSession, output: str, by: Settings) -> DataFrame:
    """(report column, label, documents, changed) over all runs; the row with an empty label counts all documents."""
    schema = StructType().add(by.report_by, StringType()).add("label", StringType()).add("documents", LongType()).add("changed", LongType()).add("batch_id", LongType())
    return spark.read.schema(schema).parquet(f"{output}/findings").groupBy(by.report_by, "label").agg(F.sum("documents").alias("documents"), F.sum("changed").alias("changed"))


def run(spark: SparkSession, source: str, output: str, checkpoint: str, by: Settings = Settings()) -> dict[str, int]:
    """Take what is new at ``source`` (a folder, or a pattern of files); returns how many batches, rows and changed rows there were."""
    if exists(spark, f"{output}/texts") != exists(spark, checkpoint):
        raise RuntimeError(f"{output} and {checkpoint} belong together, and only one of them is there")
    schema = StructType.fromDDL(by.schema) if by.schema else spark.read.parquet(source).schema
    done = {"batches": 0, "rows": 0, "changed": 0}

    def batch(rows: DataFrame, number: int) -> None:
        def write(df: DataFrame, name: str, *folders: str) -> None:
            df.withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *folders).parquet(f"{output}/{name}")

        write(masked(rows, by).withColumn("folder", _folder(by.partition_by)), "texts", "folder")
        written = texts(spark, output, schema, by).filter(F.col("batch_id") == number)
        write(findings(written, by).coalesce(1), "findings")  # a row per label and value
        n = written.agg(F.count("*").alias("rows"), F.count_if("changed").alias("changed")).first()
        done.update(batches=done["batches"] + 1, rows=done["rows"] + n["rows"], changed=done["changed"] + n["changed"])
        log.info("batch %d: wrote %d rows, %d of them changed, below %s", number, n["rows"], n["changed"], output)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", by.files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows of %s in %d batches", done["rows"], source, done["batches"])
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over ``documents``, run twice into one new folder; the second run finds nothing new."""
    folder, by = fresh_folder(spark, "job1"), Settings()
    source = f"{sf_dir}/documents.parque[t]"  # a pattern, since a table may be one file or a folder of files
    for _ in range(2):
        run(spark, source, f"{folder}/output", f"{folder}/checkpoint", by)
    rows = texts(spark, f"{folder}/output", spark.read.parquet(source).schema, by)
    return rows.select("doc_id", "source", "lang", "text", F.array_join("labels", ",").alias("labels"), "changed")


ORACLE_SQL = f"SELECT doc_id, source, lang, {_redact_sql('text')} AS text, coalesce({_detect_sql()}, '') AS labels, {_redact_sql('text')} IS DISTINCT FROM text AS changed FROM documents"


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    by = settings(Settings, given.config)
    spark = session("redact_corpus")
    try:
        run(spark, given.source, given.output, given.checkpoint, by)
        for row in report(spark, given.output, by).orderBy(F.desc("documents")).limit(50).collect():  # for the log
            log.info("%s %s: %d documents", row[by.report_by], row["label"] or "in all", row["documents"])
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
