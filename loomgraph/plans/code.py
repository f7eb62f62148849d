"""Registered queries that read source code: customers and nations written as small files, indexed, with SQL for the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import build
from .queries import _table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per customer (a function and a class that call) and per nation (an arrow that calls)."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    customer = _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("src/c"), k, F.lit(".ts")).alias("file"),
        F.concat(F.lit("// file of hidden()\nexport function cust_"), k, F.lit("(a: number): void {\n  nation_"), n, F.lit("();\n  if (a) { missing(`${inner()}`); }\n}\nclass C_"), k, F.lit(" extends Base<string> {\n  run(x = skipped()) { xs.map(v => cust_"), k, F.lit("(v)); }\n}\nboot();\n")).alias("content"),
    )
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("src/n"), k, F.lit(".tsx")).alias("file"), F.concat(F.lit("export const nation_"), k, F.lit(" = () => <Region_"), r, F.lit(' title="nation_0()" />;\nexport function boot() { nation_'), k, F.lit("(); }\n")).alias("content"))
    return customer.unionByName(nation)


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(_files(spark, sf_dir)).symbols.select("id", "name", "kind", "file", "line", "column", "exported", "parent", F.array_join("extends", ",").alias("bases"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(_files(spark, sf_dir)).edges.select("from_id", "to_id", "to_name", "file", "line", "ambiguous", "candidate_count")


def queries() -> dict:
    return {"code_symbols": _symbols, "code_edges": _edges}


_NAMES = """c AS (SELECT c_custkey AS k, c_nationkey AS n, 'src/c' || c_custkey || '.ts' AS f FROM customer), m AS (SELECT n_nationkey AS k, n_regionkey AS r, 'src/n' || n_nationkey || '.tsx' AS f FROM nation)"""
_LEAST = "(SELECT 'src/n' || n_nationkey || '.tsx#boot@2' FROM nation ORDER BY 'src/n' || n_nationkey || '.tsx' LIMIT 1)"


def oracle_sql() -> dict[str, str]:
    return {
        "code_symbols": f"""WITH {_NAMES}
SELECT f || '#cust_' || k || '@2' AS id, 'cust_' || k AS name, 'function' AS kind, f AS file, 2 AS line, 8 AS "column", true AS exported, NULL AS parent, NULL AS bases FROM c
UNION ALL SELECT f || '#C_' || k || '@6', 'C_' || k, 'class', f, 6, 1, false, NULL, 'Base' FROM c
UNION ALL SELECT f || '#C_' || k || '.run@7', 'run', 'method', f, 7, 3, false, 'C_' || k, NULL FROM c
UNION ALL SELECT f || '#<module>', '<module>', 'module', f, 1, 1, false, NULL, NULL FROM c
UNION ALL SELECT f || '#nation_' || k || '@1', 'nation_' || k, 'variable', f, 1, 14, true, NULL, NULL FROM m
UNION ALL SELECT f || '#boot@2', 'boot', 'function', f, 2, 8, true, NULL, NULL FROM m""",
        "code_edges": f"""WITH {_NAMES}, b AS (SELECT count(*) AS n FROM m)
SELECT c.f || '#cust_' || c.k || '@2' AS from_id, m.f || '#nation_' || m.k || '@1' AS to_id, 'nation_' || c.n AS to_name, c.f AS file, 3 AS line, NULL::BOOLEAN AS ambiguous, NULL::BIGINT AS candidate_count FROM c LEFT JOIN m ON m.k = c.n
UNION ALL SELECT f || '#cust_' || k || '@2', NULL, unnest(['missing', 'inner']), f, 4, NULL, NULL FROM c
UNION ALL SELECT f || '#C_' || k || '.run@7', NULL, 'map', f, 7, NULL, NULL FROM c
UNION ALL SELECT f || '#C_' || k || '.run@7', f || '#cust_' || k || '@2', 'cust_' || k, f, 7, NULL, NULL FROM c
UNION ALL SELECT f || '#<module>', {_LEAST}, 'boot', f, 9, CASE WHEN b.n > 1 THEN true END, CASE WHEN b.n > 1 THEN b.n END FROM c, b
UNION ALL SELECT f || '#nation_' || k || '@1', NULL, 'Region_' || r, f, 1, NULL, NULL FROM m
UNION ALL SELECT f || '#boot@2', f || '#nation_' || k || '@1', 'nation_' || k, f, 2, NULL, NULL FROM m""",
    }
