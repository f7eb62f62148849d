"""Registered queries that answer a table of questions about code, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import build
from ..operators.tasks import answer_from_graph, answer_from_text, evaluate, report
from .code import _files
from .queries import _table


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about every nation's function, with who should be found as truth, and a few about all files."""
    k = F.col("n_nationkey").cast("string")
    name = F.concat(F.lit("nation_"), k)
    callers = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string"))).alias("t"))
    nations = _table(spark, sf_dir, "nation").join(callers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    truth = F.concat(F.coalesce("t", F.array().cast("array<string>")), F.array(F.lit("boot")))
    none = F.array().cast("array<string>")
    each = [("callers", name, truth), ("recall", F.upper(name), F.array(name)), ("recall-substring", F.concat(F.lit("TION_"), k), F.array(name)), ("recall-miss", F.concat(F.lit("nowhere_"), k), none), ("string-literal", name, F.array(F.concat(F.lit("src/n"), k, F.lit(".tsx")))), ("impact", name, truth), ("tests-affected", name, none)]
    rows = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), query.alias("query"), t.alias("truth")) for kind, query, t in each))).alias("x")
    out = nations.select(k.alias("k"), rows).select(F.concat("x.kind", F.lit(":"), "k").alias("task_id"), "x.kind", "x.query", "x.truth")
    kinds = spark.createDataFrame([("kinds:class", "kind-filter", "class", []), ("kinds:enum", "kind-filter", "enum", []), ("odd", "no such kind", "x", [])], out.schema)
    return out.unionByName(kinds)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = build(_files(spark, sf_dir))
    return answer_from_graph(_tasks(spark, sf_dir), graph.symbols, graph.edges).groupBy("task_id", "item").agg(F.count("*").alias("times"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, cost = answer_from_text(_tasks(spark, sf_dir), _files(spark, sf_dir))
    return cost.join(found.groupBy("task_id").agg(F.count("*").alias("items"), F.min("item").alias("least"), F.max("item").alias("most")), "task_id", "left")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    graph = build(files)
    out = report(evaluate(_tasks(spark, sf_dir), graph.symbols, graph.edges, files))
    return out.select("kind", "tasks", F.round("graph_f1", 6).alias("graph_f1"), "graph_bytes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"task_answers": _answers, "task_scans": _scanned, "task_report": _report}


_CODE = """c AS (SELECT c_custkey AS k, c_nationkey AS n, 'src/c' || c_custkey || '.ts' AS f, '// file of hidden()' || chr(10) || 'export function cust_' || c_custkey || '(a: number): void {' || chr(10) || '  nation_' || c_nationkey || '();' || chr(10) || '  if (a) { missing(`${inner()}`); }' || chr(10) || '}' || chr(10) || 'class C_' || c_custkey || ' extends Base<string> {' || chr(10) || '  run(x = skipped()) { xs.map(v => cust_' || c_custkey || '(v)); }' || chr(10) || '}' || chr(10) || 'boot();' || chr(10) AS text FROM customer),
m AS (SELECT n_nationkey AS k, 'src/n' || n_nationkey || '.tsx' AS f, 'export const nation_' || n_nationkey || ' = () => <Region_' || n_regionkey || ' title="nation_0()" />;' || chr(10) || 'export function boot() { nation_' || n_nationkey || '(); }' || chr(10) AS text FROM nation),
files AS (SELECT f, text FROM c UNION ALL SELECT f, text FROM m)"""
_GRAPH_SIDE = """calls AS (SELECT n, who, row_number() OVER (PARTITION BY n ORDER BY f) AS r FROM (SELECT n, 'cust_' || k AS who, f FROM c WHERE n IN (SELECT k FROM m) UNION ALL SELECT k, 'boot', f FROM m)),
answers AS (
  SELECT 'callers:' || n AS task_id, who AS item FROM calls WHERE r <= 50
  UNION ALL SELECT 'recall:' || k, 'nation_' || k FROM m
  UNION ALL SELECT 'recall-substring:' || a.k, 'nation_' || b.k FROM m a JOIN m b ON contains('nation_' || b.k, 'tion_' || a.k)
  UNION ALL SELECT 'string-literal:' || k, f FROM m
  UNION ALL SELECT 'impact:' || n, who FROM calls WHERE r <= 100
  UNION ALL SELECT DISTINCT 'impact:' || n, 'run' FROM calls WHERE who <> 'boot'
  UNION ALL SELECT 'impact:' || k, '<module>' FROM m WHERE f = (SELECT min(f) FROM m) AND EXISTS (SELECT 1 FROM c)
  UNION ALL SELECT 'kinds:class', 'C_' || k FROM c)"""


def oracle_sql() -> dict[str, str]:
    sizes = "(SELECT task_id, sum(strlen(item) + 3) + 1 AS bytes FROM answers GROUP BY task_id)"
    scanned = "SELECT t.task_id, f, text, line FROM tasks t JOIN files ON contains(text, q), unnest(string_split(text, chr(10))) AS u(line) WHERE contains(line, q)"
    return {
        "task_answers": f"WITH {_CODE}, {_GRAPH_SIDE} SELECT task_id, item, count(*) AS times FROM answers GROUP BY ALL",
        "task_scans": f"""WITH {_CODE}, kinds AS (SELECT unnest(['callers', 'recall', 'recall-substring', 'recall-miss', 'string-literal', 'impact', 'tests-affected']) AS kind),
tasks AS (SELECT kind || ':' || k AS task_id, kind, CASE kind WHEN 'recall' THEN 'NATION_' || k WHEN 'recall-substring' THEN 'TION_' || k WHEN 'recall-miss' THEN 'nowhere_' || k ELSE 'nation_' || k END AS q FROM m, kinds UNION ALL SELECT 'odd', 'no such kind', 'x'),
lines AS ({scanned.replace("t.task_id, f", "t.task_id, t.kind, t.q, f")}),
items AS (SELECT DISTINCT task_id, CASE kind WHEN 'string-literal' THEN f WHEN 'tests-affected' THEN '' ELSE coalesce(nullif(regexp_extract(line, '(?:function|class|interface)\\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1), ''), regexp_extract(line, '\\b([A-Za-z_$][A-Za-z0-9_$]*)\\s*[:=]\\s*(?:async\\s+)?(?:function|\\()', 1)) END AS item, q, kind FROM lines),
told AS (SELECT task_id, count(*) AS items, min(item) AS least, max(item) AS most FROM items WHERE item <> '' AND (item <> q OR kind = 'string-literal') GROUP BY task_id UNION ALL SELECT 'kinds:class', count(*), min('C_' || k), max('C_' || k) FROM c HAVING count(*) > 0),
cost AS (SELECT task_id, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT task_id, f, strlen(text) AS size FROM lines) GROUP BY task_id UNION ALL SELECT 'kinds:class', sum(strlen(text))::BIGINT FROM c)
SELECT task_id, bytes, items, least, most FROM cost LEFT JOIN told USING (task_id)""",
        "task_report": f"""WITH {_CODE}, {_GRAPH_SIDE},
truth AS (SELECT kind || ':' || n AS task_id, who AS item FROM calls, (SELECT unnest(['callers', 'impact']) AS kind) UNION ALL SELECT kind || ':' || k, 'nation_' || k FROM m, (SELECT unnest(['recall', 'recall-substring']) AS kind) UNION ALL SELECT 'string-literal:' || k, f FROM m),
tasks AS (SELECT kind, kind || ':' || k AS task_id FROM m, (SELECT unnest(['callers', 'recall', 'recall-substring', 'recall-miss', 'string-literal', 'impact', 'tests-affected']) AS kind) UNION ALL SELECT 'kind-filter', 'kinds:class' UNION ALL SELECT 'kind-filter', 'kinds:enum' UNION ALL SELECT 'no such kind', 'odd'),
hit AS (SELECT task_id, count(*) AS tp FROM (SELECT DISTINCT * FROM answers) JOIN truth USING (task_id, item) GROUP BY task_id),
scored AS (SELECT kind, t.task_id, coalesce(tp, 0) AS tp, (SELECT count(DISTINCT item) FROM answers a WHERE a.task_id = t.task_id) AS nf, (SELECT count(*) FROM truth x WHERE x.task_id = t.task_id) AS nt, coalesce(s.bytes, 2) AS bytes FROM tasks t LEFT JOIN hit USING (task_id) LEFT JOIN {sizes} s USING (task_id)),
f AS (SELECT *, CASE WHEN nf + nt = 0 THEN 1 ELSE 2.0 * tp / (nf + nt) END AS f1 FROM scored)
SELECT kind, count(*) AS tasks, round(avg(f1), 6) AS graph_f1, sum(bytes)::BIGINT AS graph_bytes FROM f GROUP BY kind""",
    }
