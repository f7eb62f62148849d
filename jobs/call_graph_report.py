"""Batch job: resolves the call graph of the relational tables, and reports what would be touched if its most called symbols changed.

    python -m jobs.call_graph_report --tables FOLDER --output PATH [--config jobs/call_graph_report.json]

It writes

* ``edges``: every call with its target, in folders by a hash of the called
  name, so that the callers of a symbol are read from one folder; AQE splits
  the folder of a very hot name among tasks,
* ``callers``: who is reached from each reported symbol by all its calls, in
  folders by depth,
* ``summary``: a row per reported symbol with its counts, in folders by kind.

Each output is overwritten as a whole, in this order, and depends on the
tables and settings alone; a run that failed half-way is simply run again.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import fresh_folder, session, settings
from loomgraph.operators.impact import impact, impact_names, impact_stats
from loomgraph.operators.resolve import resolution_stats
from loomgraph.plans.queries import GRAPH
from loomgraph.plans.shared import cut
from loomgraph.sources.relational import resolved_calls, symbols

log = logging.getLogger("call_graph_report")
SUMMARY = "id string, name string, file string, calls long, direct_count long, transitive_count long, test_count long, file_count long, truncated boolean, kind string"


@dataclass(frozen=True)
class Settings:
    targets: int = 20
    depth: int = 2
    level_limit: int | None = None  # most callers of a target that a level reports; none for all
    buckets: int = 32


def hottest(edges: DataFrame, n: int) -> DataFrame:
    """(target_id, calls) of the n symbols with most calls, equal ones by id."""
    return edges.filter("to_id IS NOT NULL").groupBy(F.col("to_id").alias("target_id")).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "target_id").limit(n)


def run(spark: SparkSession, tables: str, output: str, by: Settings = Settings()) -> dict[str, int]:
    """Write the three outputs; returns how many rows were read and written."""
    nodes = symbols(spark, tables).withColumn("exported", F.lit(True))
    resolved = resolved_calls(spark, tables, nodes).withColumn("bucket", F.pmod(F.xxhash64("to_name"), F.lit(by.buckets)).cast("int"))
    resolved.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{output}/edges")
    edges = spark.read.schema(resolved.schema).parquet(f"{output}/edges")
    done = resolution_stats(nodes, edges).first().asDict()
    log.info("read %(symbol_count)d symbols, wrote %(edge_count)d calls, %(resolved_count)d of them resolved", done)

    top = cut(hottest(edges, by.targets), "top")
    found = impact(top.select("target_id"), edges, nodes, by.depth, by.level_limit or 1 << 40, stored=True, fan_in=None)
    named = impact_names(found, nodes)
    named.write.mode("overwrite").partitionBy("depth").parquet(f"{output}/callers")
    callers = spark.read.schema(named.schema).parquet(f"{output}/callers")

    last = nodes.groupBy(F.col("id").alias("target_id")).agg(F.max_by(F.struct("name", "file", "kind"), "seq").alias("s"))
    counts = ("direct_count", "transitive_count", "test_count", "file_count")
    rows = top.join(last, "target_id").join(impact_stats(callers), "target_id", "left")
    rows = rows.select(F.col("target_id").alias("id"), "s.name", "s.file", "calls", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("truncated", F.lit(False)).alias("truncated"), "s.kind")
    rows.coalesce(1).write.mode("overwrite").partitionBy("kind").parquet(f"{output}/summary")  # at most ``targets`` rows
    done |= {"targets": summary(spark, output).count(), "callers": callers.count()}
    log.info("wrote %(targets)d reported symbols and %(callers)d rows of callers below " + output.replace("%", "%%"), done)
    return done


def summary(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SUMMARY).parquet(f"{output}/summary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the tables, run twice into one new folder; the second run writes the same again."""
    folder = fresh_folder(spark, "job2")
    for _ in range(2):
        run(spark, sf_dir, folder)
    return summary(spark, folder)


ORACLE_SQL = f"""WITH RECURSIVE {GRAPH},
top AS (SELECT to_id AS id, count(*) AS calls FROM edges WHERE to_id IS NOT NULL GROUP BY 1 ORDER BY calls DESC, id LIMIT 20),
reach AS (SELECT id AS target, id, 0 AS depth FROM top UNION SELECT target, from_id, depth + 1 FROM reach JOIN edges ON to_id = id WHERE depth < 2),
least AS (SELECT target, r.id, file, min(depth) AS depth FROM reach r JOIN symbols s ON s.id = r.id WHERE r.id <> target GROUP BY ALL),
told AS (SELECT target, count(*) FILTER (depth = 1) AS direct_count, count(*) FILTER (depth > 1) AS transitive_count, count(DISTINCT file) AS file_count FROM least GROUP BY target)
SELECT top.id, name, file, calls, coalesce(direct_count, 0) AS direct_count, coalesce(transitive_count, 0) AS transitive_count, 0::BIGINT AS test_count, coalesce(file_count, 0) AS file_count, false AS truncated, kind
FROM top JOIN symbols USING (id) LEFT JOIN told ON target = top.id"""


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("tables", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    by = settings(Settings, given.config)
    spark = session("call_graph_report")
    try:
        run(spark, given.tables, given.output, by)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
