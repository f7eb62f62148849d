"""Registered queries for scoring, validation, display and reachability, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import ambiguity, anchor, anchors, display_name, name_ends, sha_tag
from ..operators.evaluate import every_kth, hit_rate, percent_saved, rank_stats, reduction, score_arrays, score_sets, turn_sizes, wins
from ..operators.impact import impact
from ..operators.lookup import callers, find_by_id
from ..operators.validate import valid_edges, valid_symbols
from ..sources.relational import symbols
from .queries import GRAPH, IMPACT_COLUMNS, TARGET, _edges, _impact_sql, _into, _table

Query = Callable[[SparkSession, str], DataFrame]
FRACTIONS = {"p50": 0.5, "p95": 0.95}
KEYWORDS = ["the", "error", "que", "und"]


def _impact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test callers, where the files of two buckets are named as tests."""
    nodes = symbols(spark, sf_dir).withColumn("file", F.regexp_replace("file", r"^m(3|8)\.ts$", "m$1.spec.ts"))
    return impact(spark.createDataFrame([(TARGET,)], "target_id string"), _into(spark, sf_dir), nodes).filter("is_test").select(*IMPACT_COLUMNS)


def _min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least depth of every caller within five calls of three targets at once, by all calls."""
    targets = spark.createDataFrame([(TARGET,), ("part:3",), ("ord:1",)], "target_id string")
    return impact(targets, _into(spark, sf_dir), symbols(spark, sf_dir), 5, 1 << 40, fan_in=None).select("target_id", "caller_id", F.col("depth").cast("long").alias("min_depth"))


def _valid_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = _table(spark, sf_dir, "part").select(
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("part:"), k.cast("string"))).alias("id"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.concat(F.col("p_name"), F.when(k % 2 == 0, F.lit("\t\u0001x")).otherwise(""))).alias("name"),
        F.when(k % 7 == 0, "thing").otherwise("function").alias("kind"),
        F.concat(F.lit("m"), (k % 25).cast("string"), F.lit(".ts")).alias("file"),
        (k % 5).cast("int").alias("line"),
        F.when(k % 3 == 0, k.cast("int")).alias("column"),
        F.lit(None).cast("int").alias("end_line"),
        F.when(k % 17 != 0, F.repeat(F.col("p_type"), 40)).alias("signature"),
        F.when(k % 4 == 0, F.lit(True)).alias("exported"),
    )
    return valid_symbols(raw)


def _valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("from_id"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("ord:"), k.cast("string"))).alias("to_id"),
        F.when(k % 9 == 0, "").otherwise(F.col("o_orderpriority")).alias("to_name"),
        F.lit("a.ts").alias("file"),
        (k % 6).cast("int").alias("line"),
        (k % 4 != 0).alias("named"),
    )
    return valid_edges(raw, F.col("named")).drop("named")


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Long documents as what a search found, documents of good quality as the truth, by language."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), _table(spark, sf_dir, "labels")
    return docs.filter("n_chars > 600").select("lang", "doc_id"), docs.join(labels.filter("quality = 1"), "doc_id").select("lang", "doc_id")


def _score(lenient: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = score_sets(*_sets(spark, sf_dir), "lang", "doc_id", lenient)
        return out.select("lang", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))

    return run


def _page_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's linked paths against the words of its address, as arrays."""
    found = F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))
    truth = F.filter(F.split("url", "[^A-Za-z]+"), lambda x: x != "")
    s = score_arrays(found, truth)
    return _table(spark, sf_dir, "pages").select("page_id", *(F.round(s[c], 9).alias(c) for c in ("precision", "recall", "f1")))


def _rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rank_stats(_table(spark, sf_dir, "events"), "event_type", "value", FRACTIONS)
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), "max", *FRACTIONS)


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of bytes saved by reading first lines instead of texts, by language, and the mean reduction."""
    docs = _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("lang", F.octet_length("text").alias("b"), F.octet_length(F.substring_index("text", "\n", 1)).alias("g"))
    out = docs.groupBy("lang").agg(F.sum("b").alias("base"), F.sum("g").alias("now"), F.avg(reduction(F.col("b"), F.col("g"))).alias("mean"))
    return out.select("lang", percent_saved(F.col("base"), F.col("now")).alias("saved"), F.round("mean", 6).alias("mean_reduction"))


def _display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees of every call: both ends, where, and how sure."""
    named = name_ends(_edges(spark, sf_dir), symbols(spark, sf_dir))
    sha = F.when(F.col("to_id").isNotNull(), F.sha2("from_id", 256))
    return named.select("from_id", "to_name", "caller_name", display_name(F.element_at(F.split("to_id", ":"), 1), F.col("callee_name")).alias("callee"), F.concat(anchor(F.col("file"), F.length("to_name"), sha), ambiguity(F.col("candidate_count"))).alias("place"), sha_tag(sha).alias("tag"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors in texts that place calls in files of every shape, with and without revisions."""
    shown = _display(spark, sf_dir).groupBy("from_id").agg(F.min("place").alias("a"), F.max("place").alias("z"))
    text = F.concat(F.lit("see ("), F.col("a"), F.lit(") and src/[id].tsx:4 @ "), F.substring(F.sha2("from_id", 256), 1, 9), F.lit(", lib/a$b.js:"), F.length("from_id").cast("string"), F.lit(" x.md:3 @ abcdef1 "), F.col("z"))
    return shown.select("from_id", F.explode(anchors(text)).alias("x")).groupBy("from_id", "x.file", "x.line", "x.sha").agg(F.count("*").alias("times"))


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every_kth(symbols(spark, sf_dir), 20)


def queries() -> dict[str, Query]:
    return {
        "impact_tests": _impact_tests,
        "impact_min_depth": _min_depth,
        "validate_symbols": _valid_symbols,
        "validate_edges": _valid_edges,
        "score_prf1": _score(False),
        "score_f1_lenient": _score(True),
        "score_page_sets": _page_sets,
        "latency_stats": _rank_stats,
        "wins_losses": lambda s, d: wins(_table(s, d, "lineitem").withColumn("a", F.col("l_discount")).withColumn("b", F.col("l_tax")), "a", "b", "l_returnflag"),
        "token_summary": lambda s, d: turn_sizes(_table(s, d, "conversations")),
        "percent_saved": _saved,
        "edge_display": _display,
        "anchor_extraction": _anchors,
        "caller_names": lambda s, d: name_ends(callers(_edges(s, d), TARGET, 500), symbols(s, d)).select("caller_name").distinct(),
        "every_kth_symbol": _sampled,
        "symbol_by_id": lambda s, d: find_by_id(symbols(s, d), TARGET).select("id", "name", "kind", "file"),
        "keyword_rate_ci": lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", hit_rate(F.col("text"), KEYWORDS).alias("rate"), (hit_rate(F.col("text"), KEYWORDS) >= 0.6).alias("correct")),
    }


_ANCHOR = r"'(\S+\.(?:ts|tsx|js|jsx)):(\d+)(?:\s+@\s+([0-9a-f]{7}))?'"


def _score_sql(empty: str) -> str:
    return f"""WITH f AS (SELECT DISTINCT lang, doc_id FROM documents WHERE n_chars > 600), t AS (SELECT DISTINCT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
m AS (SELECT coalesce(f.lang, t.lang) AS lang, f.doc_id AS a, t.doc_id AS b FROM f FULL JOIN t ON f.doc_id = t.doc_id AND f.lang IS NOT DISTINCT FROM t.lang),
c AS (SELECT lang, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (b IS NULL) AS fp, count(*) FILTER (a IS NULL) AS fn FROM m GROUP BY lang),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE {empty} END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE {empty} END AS q FROM c)
SELECT lang, tp, fp, fn, round(p, 9) AS precision, round(q, 9) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 9) AS f1 FROM r"""


def oracle_sql() -> dict[str, str]:
    columns = ", ".join(c for c in IMPACT_COLUMNS if c not in ("caller_file", "is_test"))
    reach = f"reach AS (SELECT target_id, target_id AS id, 0::BIGINT AS d FROM (SELECT unnest(['{TARGET}', 'part:3', 'ord:1']) AS target_id) UNION SELECT target_id, from_id, d + 1 FROM reach JOIN edges ON to_id = id WHERE d < 5)"
    display = f"""WITH {GRAPH}, shown AS (SELECT e.from_id, e.to_name, coalesce(a.name, e.from_id) AS caller_name, concat_ws('.', split_part(e.to_id, ':', 1), coalesce(b.name, e.to_name)) AS callee, CASE WHEN e.to_id IS NULL THEN '' ELSE ' @ ' || substr(sha256(e.from_id), 1, 7) END AS tag, e.file || ':' || length(e.to_name) || tag || CASE WHEN e.candidate_count > 1 THEN ' (1 of ' || e.candidate_count || ' candidates)' ELSE '' END AS place FROM edges e LEFT JOIN symbols a ON a.id = e.from_id LEFT JOIN symbols b ON b.id = e.to_id)"""
    return {
        "impact_tests": _impact_sql(3, 100, f"SELECT {columns}, regexp_replace(caller_file, '^m(3|8)\\.ts$', 'm\\1.spec.ts') AS caller_file, true AS is_test", "caller_file IN ('m3.ts', 'm8.ts')"),
        "impact_min_depth": f"WITH RECURSIVE {GRAPH}, {reach} SELECT target_id, id AS caller_id, min(d) AS min_depth FROM reach WHERE id <> target_id AND id IN (SELECT id FROM symbols) GROUP BY ALL",
        "validate_symbols": r"""WITH raw AS (SELECT p_partkey AS k, 'part:' || p_partkey AS id, p_name || CASE WHEN p_partkey % 2 = 0 THEN '  x' ELSE '' END AS name, 'm' || (p_partkey % 25) || '.ts' AS file, (p_partkey % 5)::INT AS line, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::INT ELSE 1 END AS "column", 0 AS end_line, substr(repeat(p_type, 40), 1, 400) AS signature, p_partkey % 4 = 0 AS exported FROM part)
SELECT id, name, 'function' AS kind, file, line, "column", end_line, signature, exported FROM raw WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 7 <> 0 AND k % 5 <> 0 AND k % 17 <> 0""",
        "validate_edges": "SELECT 'cust:' || o_custkey AS from_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'ord:' || o_orderkey END AS to_id, o_orderpriority AS to_name, 'a.ts' AS file, (o_orderkey % 6)::INT AS line FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 4 <> 0",
        "score_prf1": _score_sql("0"),
        "score_f1_lenient": _score_sql("1"),
        "score_page_sets": """WITH s AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS f, list_distinct(list_filter(regexp_split_to_array(url, '[^A-Za-z]+'), lambda x: x <> '')) AS t FROM pages), c AS (SELECT page_id, len(list_intersect(f, t))::DOUBLE AS tp, len(f) AS nf, len(t) AS nt FROM s),
r AS (SELECT page_id, CASE WHEN nf > 0 THEN tp / nf WHEN nt > 0 THEN 0 ELSE 1 END AS p, CASE WHEN nt > 0 THEN tp / nt WHEN nf > 0 THEN 0 ELSE 1 END AS q FROM c)
SELECT page_id, round(p, 9) AS precision, round(q, 9) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 9) AS f1 FROM r""",
        "latency_stats": "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, max(value) AS max, max(value) FILTER (i = least(n - 1, floor(0.5 * n))) AS p50, max(value) FILTER (i = least(n - 1, floor(0.95 * n))) AS p95 FROM o GROUP BY event_type",
        "wins_losses": "SELECT l_returnflag, count(*) AS tasks, count(*) FILTER (l_discount - l_tax >= 0.001) AS wins, count(*) FILTER (l_discount - l_tax <= -0.001) AS losses, count(*) FILTER (abs(l_discount - l_tax) < 0.001) AS ties FROM lineitem GROUP BY l_returnflag",
        "token_summary": "SELECT role, coalesce(sum(length(text)) FILTER (turn < 2), 0)::BIGINT AS opening, coalesce(sum(length(text)) FILTER (turn >= 2), 0)::BIGINT AS later FROM conversations GROUP BY role",
        "percent_saved": "WITH s AS (SELECT lang, strlen(text) AS b, strlen(split_part(text, chr(10), 1)) AS g FROM documents WHERE text IS NOT NULL) SELECT lang, CASE WHEN sum(b) > 0 THEN floor((sum(b) - sum(g)) / sum(b) * 100 + 0.5) ELSE 0 END::BIGINT AS saved, round(avg(CASE WHEN b > 0 THEN 1 - g / b ELSE 0 END), 6) AS mean_reduction FROM s GROUP BY lang",
        "edge_display": f"{display} SELECT from_id, to_name, caller_name, callee, place, tag FROM shown",
        "anchor_extraction": rf"""{display}, texts AS (SELECT from_id, 'see (' || min(place) || ') and src/[id].tsx:4 @ ' || substr(sha256(from_id), 1, 9) || ', lib/a$b.js:' || length(from_id) || ' x.md:3 @ abcdef1 ' || max(place) AS t FROM shown GROUP BY from_id),
each AS (SELECT from_id, unnest(regexp_extract_all(t, {_ANCHOR}, 1)) AS file, unnest(regexp_extract_all(t, {_ANCHOR}, 2)) AS line, unnest(regexp_extract_all(t, {_ANCHOR}, 3)) AS sha FROM texts)
SELECT from_id, file, line::BIGINT AS line, coalesce(sha, '') AS sha, count(*) AS times FROM each GROUP BY ALL""",
        "caller_names": f"WITH {GRAPH}, near AS (SELECT * FROM edges WHERE to_id = '{TARGET}' ORDER BY t, k0, k1, k2, k3 LIMIT 500) SELECT DISTINCT coalesce(s.name, from_id) AS caller_name FROM near LEFT JOIN symbols s ON s.id = from_id",
        "every_kth_symbol": f"WITH {GRAPH}, r AS (SELECT id, name, kind, row_number() OVER (ORDER BY t, k) - 1 AS rank, greatest(1, count(*) OVER () // 20) AS step FROM symbols WHERE kind IN ('function', 'method')) SELECT id, name, kind, rank FROM r WHERE rank % step = 0 AND rank < step * 20",
        "symbol_by_id": f"WITH {GRAPH} SELECT id, name, kind, file FROM symbols WHERE id = '{TARGET}'",
        "keyword_rate_ci": "SELECT conv_id, turn, n / 4.0::DOUBLE AS rate, n / 4.0::DOUBLE >= 0.6 AS correct FROM (SELECT conv_id, turn, contains(lower(text), 'the')::INT + contains(lower(text), 'error')::INT + contains(lower(text), 'que')::INT + contains(lower(text), 'und')::INT AS n FROM conversations)",
    }
