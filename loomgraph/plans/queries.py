"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import PATTERNS, detect_secrets, one_line_signature, redact_secrets, repo_id, sanitize
from ..operators.evaluate import hit_rate, matching_bytes
from ..operators.impact import impact, impact_stats
from ..operators.lookup import callees, callers, recall, recall_by_kind
from ..operators.resolve import edges_into, heavy_names, hot_symbols, resolution_stats, resolve_calls
from ..sources.git import tree_changes
from ..sources.relational import link_calls, raw_calls, resolved_calls, symbols
from ..streaming.maintain import last_events

TARGET = "supp:1"
HOT_NAME = "Supplier#000000001"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_calls(spark, sf_dir, symbols(spark, sf_dir))


def _into(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """The edges into some ids, for searches that need few of all."""
    return lambda ids: edges_into(lambda names: raw_calls(spark, sf_dir, names), symbols(spark, sf_dir), ids)


def _impact(spark: SparkSession, sf_dir: str, depth: int, limit: int = 100, changed: DataFrame | None = None) -> DataFrame:
    return impact(spark.createDataFrame([(TARGET,)], "target_id string"), _into(spark, sf_dir), symbols(spark, sf_dir), depth, limit, changed)


EDGE_COLUMNS = ["from_id", "to_id", "to_name", "file", "ambiguous", "candidate_count"]
SYMBOL_COLUMNS = ["id", "name", "kind", "file"]
IMPACT_COLUMNS = ["target_id", "caller_id", "depth", "disc_rank", "via_to_id", "caller_file", "is_test"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: _table(s, d, "documents")
    return {
        "resolve_edges": lambda s, d: _edges(s, d).select(*EDGE_COLUMNS),
        "resolve_hot_names": _hot_calls,
        "resolution_stats": lambda s, d: resolution_stats(symbols(s, d), _edges(s, d)),
        "recall_exact": lambda s, d: recall(symbols(s, d), "ORDER#7").select(*SYMBOL_COLUMNS),
        "recall_substring": lambda s, d: recall(symbols(s, d), "00001", 50, substring=True).select(*SYMBOL_COLUMNS),
        "recall_by_kind": lambda s, d: recall_by_kind(symbols(s, d), "class", "m1").select(*SYMBOL_COLUMNS),
        "callers_of": lambda s, d: callers(_edges(s, d), TARGET).select(*EDGE_COLUMNS),
        "callees_of": lambda s, d: callees(_edges(s, d), "cust:7").select(*EDGE_COLUMNS),
        "callees_resolved": lambda s, d: callees(_edges(s, d), "cust:7", include_unresolved=False).select(*EDGE_COLUMNS),
        "hot_symbols": lambda s, d: hot_symbols(_edges(s, d), symbols(s, d), 10),
        **{f"impact_d{n}": lambda s, d, n=n: _impact(s, d, n).select(*IMPACT_COLUMNS) for n in (1, 2, 3)},
        "impact_uncapped": lambda s, d: _impact(s, d, 3, 1 << 40).select(*IMPACT_COLUMNS),
        "impact_stats": lambda s, d: impact_stats(_impact(s, d, 3)),
        "impact_since": lambda s, d: _impact(s, d, 3, changed=s.createDataFrame([("m3.ts",), ("m4.ts",)], "file string")).select(*IMPACT_COLUMNS),
        "redact_documents": lambda s, d: docs(s, d).select("doc_id", redact_secrets(F.col("text")).alias("redacted")),
        "detect_secrets": lambda s, d: docs(s, d).select("doc_id", detect_secrets(F.col("text")).alias("labels")),
        "sanitize_text": lambda s, d: docs(s, d).select("doc_id", sanitize(F.col("text"), 400).alias("clean")),
        "one_line_signature": lambda s, d: docs(s, d).select("doc_id", one_line_signature(F.col("text")).alias("signature")),
        "repo_ids": lambda s, d: _table(s, d, "pages").select("page_id", repo_id(F.col("url")).alias("repo_id")),
        "grep_baseline": lambda s, d: matching_bytes(docs(s, d).withColumnRenamed("text", "content"), "the ", "lang"),
        "keyword_hit_rate": lambda s, d: docs(s, d).select("doc_id", hit_rate(F.col("text"), ["the", "que", "und", "des"]).alias("rate")),
        "href_calls": lambda s, d: link_calls(_table(s, d, "pages")).withColumnRenamed("from_id", "page_id"),
        "event_merge": _event_merge,
        "tree_diff": _tree_diff,
    }


def _hot_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of calls of which about half go to one supplier's name."""
    line = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    hot = F.when(F.col("l_linenumber") <= 2, F.lit(HOT_NAME)).otherwise(F.col("s_name"))
    calls = line.select(F.concat(F.lit("ord:"), F.col("l_orderkey").cast("string")).alias("from_id"), hot.alias("to_name"), F.concat(F.lit("m"), (F.col("l_orderkey") % 25).cast("string"), F.lit(".ts")).alias("file"), F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return resolve_calls(calls, symbols(spark, sf_dir), heavy=heavy_names(calls)).select(*EDGE_COLUMNS)


def _tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths added, modified or removed between two listings of (path, oid)."""
    pages = _table(spark, sf_dir, "pages")
    before = pages.filter("page_id % 5 <> 0").select(F.col("url").alias("path"), F.sha2("html", 256).alias("oid"))
    after = pages.filter("page_id % 7 <> 0").select(F.col("url").alias("path"), F.when(F.col("page_id") % 3 == 0, F.sha2(F.concat("html", F.lit("!")), 256)).otherwise(F.sha2("html", 256)).alias("oid"))
    return tree_changes(before, after).withColumnRenamed("file", "path")


def _event_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user's file; some files are no sources, lie outside the root, or see events of no known kind."""
    k = F.col("user_id")
    path = F.concat(F.when(k % 7 == 0, "/other/u").otherwise("/repo/u"), k.cast("string"), F.when(k % 5 == 0, ".txt").otherwise(".ts"))
    kind = F.element_at(F.array(*map(F.lit, ["add", "change", "unlink", "rename"])), (F.col("event_id") % 4 + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("event_seq"), path.alias("path"), kind.alias("kind"), F.col("event_type").alias("content"))
    return last_events(rows, "/repo")


GRAPH = """
symbols AS (
  SELECT 'part:' || p_partkey AS id, p_name AS name, 'function' AS kind, 'm' || (p_partkey % 25) || '.ts' AS file, 0 AS t, p_partkey::BIGINT AS k FROM part
  UNION ALL SELECT 'supp:' || s_suppkey, s_name, 'class', 'm' || (s_suppkey % 25) || '.ts', 1, s_suppkey FROM supplier
  UNION ALL SELECT 'ord:' || o_orderkey, 'Order#' || o_orderkey, 'method', 'm' || (o_orderkey % 25) || '.ts', 2, o_orderkey FROM orders
  UNION ALL SELECT 'cust:' || c_custkey, c_name, 'variable', 'm' || (c_custkey % 25) || '.ts', 3, c_custkey FROM customer),
calls AS (
  SELECT 'supp:' || l_suppkey AS from_id, p_name AS to_name, 'm' || (l_suppkey % 25) || '.ts' AS file, 0 AS t, l_orderkey::BIGINT AS k0, l_linenumber::BIGINT AS k1, l_partkey::BIGINT AS k2, l_suppkey::BIGINT AS k3 FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'ord:' || l_orderkey, s_name, 'm' || (l_orderkey % 25) || '.ts', 1, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT 'cust:' || o_custkey, 'Order#' || o_orderkey, 'm' || (o_custkey % 25) || '.ts', 2, o_orderkey, 0, 0, 0 FROM orders
  UNION ALL SELECT 'cust:' || user_id, event_type, 'm' || (user_id % 25) || '.ts', 3, event_id, 0, 0, 0 FROM events),
ordered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY t, k) AS a, row_number() OVER (PARTITION BY name, file ORDER BY t, k) AS b, count(*) OVER (PARTITION BY name) AS n FROM symbols),
edges AS (
  SELECT c.from_id, coalesce(s.id, f.id) AS to_id, c.to_name, c.file, CASE WHEN f.n > 1 THEN true END AS ambiguous, CASE WHEN f.n > 1 THEN f.n END AS candidate_count, c.t, c.k0, c.k1, c.k2, c.k3
  FROM calls c LEFT JOIN (SELECT * FROM ordered WHERE b = 1) s ON s.name = c.to_name AND s.file = c.file LEFT JOIN (SELECT * FROM ordered WHERE a = 1) f ON f.name = c.to_name)"""


def _impact_sql(depth: int, limit: int, select: str, where: str = "true") -> str:
    levels = [f"l0 AS (SELECT '{TARGET}' AS id, 0::BIGINT AS rank, '' AS via), v0 AS (SELECT id FROM l0)"]
    for n in range(1, depth + 1):
        levels.append(
            f"c{n} AS (SELECT r.from_id AS id, l.rank AS parent, r.rn, r.to_id AS via FROM l{n - 1} l JOIN ranked r ON r.to_id = l.id WHERE r.from_id NOT IN (SELECT id FROM v{n - 1})), "
            f"f{n} AS (SELECT * FROM c{n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY parent, rn, via) = 1), "
            f"v{n} AS (SELECT id FROM v{n - 1} UNION ALL SELECT id FROM f{n}), "
            f"l{n} AS (SELECT f.id, row_number() OVER (ORDER BY f.parent, f.rn, f.via) AS rank, f.via, s.file FROM f{n} f JOIN symbols s ON s.id = f.id)"
        )
    union = " UNION ALL ".join(f"SELECT id AS caller_id, {n} AS depth, rank AS disc_rank, via AS via_to_id, file AS caller_file FROM l{n} WHERE rank <= {limit}" for n in range(1, depth + 1))
    ranked = "ranked AS (SELECT to_id, from_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY t, k0, k1, k2, k3, from_id) AS rn FROM edges WHERE to_id IS NOT NULL) WHERE rn <= 500)"
    test = r"(regexp_matches(caller_file, '(?i)\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)$') OR regexp_matches(caller_file, '(^|/)__tests__/'))"
    return f"WITH {GRAPH}, {ranked}, {', '.join(levels)}, found AS (SELECT '{TARGET}' AS target_id, *, {test} AS is_test FROM ({union})) {select} FROM found WHERE {where}"


def _redact_sql(text: str) -> str:
    for label, pattern, replacement in PATTERNS:
        if label == "long-token-in-string":  # no back-references there: one rewrite for each quote
            for quote in ('"', "''"):
                text = f"regexp_replace({text}, '{quote}[A-Za-z0-9_+/=-]{{40,}}{quote}', '{quote}***REDACTED-LONG-TOKEN***{quote}', 'g')"
        else:
            text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


def _detect_sql() -> str:
    parts = []
    for label, pattern, _ in PATTERNS:
        if label == "long-token-in-string":
            pattern = r"""("[A-Za-z0-9_+/=-]{40,}"|''[A-Za-z0-9_+/=-]{40,}'')"""
        parts.append(f"CASE WHEN regexp_matches(text, '{pattern}') THEN '{label}' END")
    return f"concat_ws(',', {', '.join(parts)})"


def oracle_sql() -> dict[str, str]:
    edge, symbol, found = ", ".join(EDGE_COLUMNS), ", ".join(SYMBOL_COLUMNS), "SELECT " + ", ".join(IMPACT_COLUMNS)
    by_seq = "ORDER BY t, k0, k1, k2, k3"
    line = "trim(split_part(text, chr(10), 1), ' ')"
    return {
        "resolve_edges": f"WITH {GRAPH} SELECT {edge} FROM edges",
        "resolve_hot_names": f"""WITH {GRAPH}, hot AS (SELECT 'ord:' || l_orderkey AS from_id, CASE WHEN l_linenumber <= 2 THEN '{HOT_NAME}' ELSE s_name END AS to_name, 'm' || (l_orderkey % 25) || '.ts' AS file FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT c.from_id, coalesce(s.id, f.id) AS to_id, c.to_name, c.file, CASE WHEN f.n > 1 THEN true END AS ambiguous, CASE WHEN f.n > 1 THEN f.n END AS candidate_count
FROM hot c LEFT JOIN (SELECT * FROM ordered WHERE b = 1) s ON s.name = c.to_name AND s.file = c.file LEFT JOIN (SELECT * FROM ordered WHERE a = 1) f ON f.name = c.to_name""",
        "resolution_stats": f"WITH {GRAPH} SELECT (SELECT count(*) FROM symbols) AS symbol_count, count(*) AS edge_count, count(to_id) AS resolved_count FROM edges",
        "recall_exact": f"WITH {GRAPH} SELECT {symbol} FROM symbols WHERE lower(name) = 'order#7' ORDER BY (name = 'ORDER#7') DESC, t, k LIMIT 10",
        "recall_substring": f"WITH {GRAPH}, low AS (SELECT *, first_value(t) OVER w AS ft, first_value(k) OVER w AS fk FROM symbols WHERE contains(lower(name), '00001') WINDOW w AS (PARTITION BY lower(name) ORDER BY t, k)) SELECT {symbol} FROM low ORDER BY ft, fk, t, k LIMIT 50",
        "recall_by_kind": f"WITH {GRAPH} SELECT {symbol} FROM symbols WHERE kind = 'class' AND starts_with(file, 'm1')",
        "callers_of": f"WITH {GRAPH} SELECT {edge} FROM edges WHERE to_id = '{TARGET}' {by_seq} LIMIT 50",
        "callees_of": f"WITH {GRAPH} SELECT {edge} FROM edges WHERE from_id = 'cust:7' {by_seq} LIMIT 50",
        "callees_resolved": f"WITH {GRAPH} SELECT {edge} FROM edges WHERE from_id = 'cust:7' AND to_id IS NOT NULL {by_seq} LIMIT 50",
        "hot_symbols": f"WITH {GRAPH}, top AS (SELECT to_id AS id, count(*) AS calls FROM edges WHERE to_id IS NOT NULL GROUP BY 1 ORDER BY calls DESC, id LIMIT 30) SELECT name, max(calls) AS calls FROM top JOIN symbols USING (id) GROUP BY name ORDER BY calls DESC, name LIMIT 10",
        **{f"impact_d{n}": _impact_sql(n, 100, found) for n in (1, 2, 3)},
        "impact_uncapped": _impact_sql(3, 1 << 40, found),
        "impact_stats": _impact_sql(3, 100, "SELECT target_id, count(*) FILTER (depth = 1) AS direct_count, count(*) FILTER (depth > 1) AS transitive_count, count(*) FILTER (is_test) AS test_count, count(DISTINCT caller_file) AS file_count, (SELECT bool_or(rank > 100) FROM (SELECT rank FROM l1 UNION ALL SELECT rank FROM l2 UNION ALL SELECT rank FROM l3)) AS truncated") + " GROUP BY target_id",
        "impact_since": _impact_sql(3, 100, found, "caller_file IN ('m3.ts', 'm4.ts')"),
        "redact_documents": f"SELECT doc_id, {_redact_sql('text')} AS redacted FROM documents",
        "detect_secrets": f"SELECT doc_id, {_detect_sql()} AS labels FROM documents",
        "sanitize_text": r"SELECT doc_id, substr(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), 1, 400) AS clean FROM documents",
        "one_line_signature": f"SELECT doc_id, {_redact_sql('line')} AS signature FROM (SELECT doc_id, CASE WHEN length({line}) > 200 THEN substr({line}, 1, 197) || '...' ELSE {line} END AS line FROM documents)",
        "repo_ids": "SELECT page_id, substr(sha256(url), 1, 16) AS repo_id FROM pages",
        "grep_baseline": "SELECT lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE contains(text, 'the ') GROUP BY lang",
        "keyword_hit_rate": "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'que')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'des')::INT) / 4.0::DOUBLE AS rate FROM documents",
        "href_calls": """SELECT page_id, to_name, count(*) AS calls FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS to_name FROM pages) GROUP BY ALL""",
        "event_merge": "SELECT 'u' || user_id || '.ts' AS file, (['add', 'change', 'unlink'])[max(event_id) % 4 + 1] AS kind, arg_max(event_type, event_id) AS content FROM events WHERE user_id % 5 <> 0 AND user_id % 7 <> 0 AND event_id % 4 < 3 GROUP BY user_id",
        "tree_diff": "WITH b AS (SELECT url AS path, sha256(html) AS old FROM pages WHERE page_id % 5 <> 0), a AS (SELECT url AS path, CASE WHEN page_id % 3 = 0 THEN sha256(html || '!') ELSE sha256(html) END AS new FROM pages WHERE page_id % 7 <> 0) SELECT path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM b FULL JOIN a USING (path) WHERE old IS DISTINCT FROM new",
    }
