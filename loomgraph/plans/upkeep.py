"""Registered queries for stored graphs, their upkeep by events, paths and texts, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import bytes_text, delta_text, ms_text, posix
from ..operators.evaluate import answer_checks, parse_messages, scan_text, source_bytes, token_usage, truth_keywords
from ..operators.impact import impact, is_test_file
from ..operators.index import Graph, build
from ..operators.lookup import recall
from ..operators.validate import sanitize_array
from ..sources.relational import symbols
from ..sources.scan import detect_language, watchable
from ..sources.store import Store
from ..streaming.maintain import Maintainer, apply_events
from .code import _files
from .queries import EDGE_COLUMNS, GRAPH, IMPACT_COLUMNS, TARGET, _edges, _impact_sql, _into, _table
from .shared import shared_root

Query = Callable[[SparkSession, str], DataFrame]
FOLDERS = ["src", "node_modules", "dist", "lib/.git", "src/build", "src/out.d", "coverage", "src/__tests__", "src/.cache"]
ENDINGS = [".ts", ".TSX", ".js", ".d.ts", ".mjs", ".json", ".spec.cjs", ""]


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex[:12]}")


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as the newest snapshot has them; an older one holds none."""
    store = _store(spark)
    nodes, edges = symbols(spark, sf_dir), _edges(spark, sf_dir)
    store.save(Graph(nodes, edges.limit(0)), "/data/a")
    store.save(Graph(nodes, edges), "/data/a")
    return store.load("/data/a").graph.edges.select(*EDGE_COLUMNS)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored graph for each kind of symbol, with its calls to nowhere as edges."""
    store = _store(spark)
    nodes, open_ = symbols(spark, sf_dir), _edges(spark, sf_dir).filter("to_id IS NULL")
    for kind in ("variable", "class", "class"):
        store.save(Graph(nodes.filter(F.col("kind") == kind), open_ if kind == "variable" else open_.limit(0)), f"/data/{kind}")
    return store.catalog().select("root_path", "symbol_count", "edge_count")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the files of ``code``: a third removed, a third written twice, and some that do not count."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("src/c"), k.cast("string"), F.lit(".ts"))
    rows = _table(spark, sf_dir, "customer").select(k.alias("k"), name.alias("path"))
    text = F.concat(F.lit("export function moved_"), F.col("k").cast("string"), F.lit("() { cust_"), F.col("k").cast("string"), F.lit("(); }\n"))

    def events(some: DataFrame, step: int, path, kind: str, content) -> DataFrame:
        return some.select((F.col("k") * 10 + step).cast("long").alias("event_seq"), path.alias("path"), F.lit(kind).alias("kind"), content.cast("string").alias("content"))

    written, path = rows.filter("k % 3 = 1"), F.col("path")
    out = events(rows.filter("k % 3 = 0"), 1, path, "unlink", F.lit(None)).unionByName(events(written, 2, path, "change", text))
    out = out.unionByName(events(written, 1, path, "change", F.lit("early();"))).unionByName(events(written, 3, path, "touch", F.lit("late();")))
    return out.unionByName(events(rows, 4, F.concat(F.lit("node_modules/"), path), "add", F.lit("function cust_1() {}"))).unionByName(events(rows, 5, F.concat(path, F.lit(".txt")), "add", F.lit("boot();")))


def _kept(spark: SparkSession, sf_dir: str) -> Graph:
    return apply_events(build(_files(spark, sf_dir)), _changes(spark, sf_dir))


def _upkept(spark: SparkSession, sf_dir: str):
    """The same graph, stored, and kept by a maintainer that writes changed partitions."""
    store = _store(spark)
    store.save(build(_files(spark, sf_dir)), "/data/code")
    Maintainer(spark, store, "/data/code").apply(_changes(spark, sf_dir))
    return store.load("/data/code").graph


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages, and what a watcher of /site or of /site/src takes up, for paths of every shape."""
    k = F.col("page_id")
    pick = lambda items, by: F.element_at(F.array(*map(F.lit, items)), (by % len(items) + 1).cast("int"))
    path = F.concat(F.lit("/site/"), pick(FOLDERS, k), F.lit("/p"), k.cast("string"), pick(ENDINGS, F.floor(k / len(FOLDERS))))
    rows = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return rows.select("page_id", "path", detect_language(p).alias("language"), watchable(p).alias("watched"), watchable(p, "/site/src/").alias("inside"), is_test_file(p).alias("test"))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after by event type, with the change as a watcher reports it."""
    out = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("event_id") % 3 != 0).alias("before"), F.count_if((F.col("event_id") % 4 != 0) | (F.col("event_type") == "error")).alias("after"))
    return out.select("event_type", delta_text(F.col("after"), F.col("after") - F.col("before")).alias("shown"))


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text search for the name of a nation's function finds."""
    return scan_text(_files(spark, sf_dir), "nation_7").select("file", "bytes", F.array_join("names", ",").alias("names"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talks as transcript lines: assistant turns carry usage, every fifth lacks one of its counts; blank lines between."""
    turns = _table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    usage = F.when(F.col("role") == "assistant", F.struct(F.when(F.col("conv_id") % 5 != 0, F.length("text")).alias("input_tokens"), (F.col("turn") + 1).alias("output_tokens")))
    lines = turns.select(F.col("conv_id").cast("string").alias("transcript"), F.to_json(F.struct("role", usage.alias("usage"))).alias("value"))
    return token_usage(parse_messages(lines.unionByName(lines.select("transcript", F.lit("  ").alias("value")))))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of answers that name a page's links, against the words of its address; answers of several shapes, some after finding nothing."""
    said = F.when(F.col("page_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1)))
    shapes = F.array(F.lit("main.py:12 @ "), F.lit("src/p1.ts:7 "), F.lit("see x.md:3@"), F.lit("line 5 @\t"), F.lit("a:b @ "))
    answer = F.concat(F.element_at(shapes, (F.col("page_id") % 5 + 1).cast("int")), F.substring(F.sha2("url", 256), 1, 9))
    checks = answer_checks(answer, said, F.split("url", "[^A-Za-z]+"))
    return _table(spark, sf_dir, "pages").select("page_id", checks["anchored"].alias("anchored"), checks["invented"].cast("long").alias("invented"))


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", r"([A-Za-z]+)\.", "`$1`")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", truth_keywords(F.split("role", "s"), text).alias("k"))
    return rows.select("conv_id", "turn", F.array_join("k", ",").alias("keywords"))


def queries() -> dict[str, Query]:
    pages, docs = (lambda s, d: _table(s, d, "pages")), (lambda s, d: _table(s, d, "documents"))
    return {
        "store_round_trip": _round_trip,
        "store_catalog": _catalog,
        "maintained_symbols": lambda s, d: _kept(s, d).symbols.select("id", "name", "kind", "file", "line", "column", "exported"),
        "maintained_edges": lambda s, d: _kept(s, d).edges.select("from_id", "to_id", "to_name", "file", "line"),
        "upkept_symbols": lambda s, d: _upkept(s, d).symbols.select("id", "name", "kind", "file", "line", "column", "exported"),
        "upkept_edges": lambda s, d: _upkept(s, d).edges.select("from_id", "to_id", "to_name", "file", "line"),
        "recall_skips_modules": lambda s, d: recall(build(_files(s, d)).symbols, "U", 40, substring=True).select("id", "name", "kind"),
        "impact_depth_clamped": lambda s, d: impact(s.createDataFrame([(TARGET,)], "target_id string"), _into(s, d), symbols(s, d), 99).select(*IMPACT_COLUMNS),
        "watched_paths": _paths,
        "update_text": _deltas,
        "sanitized_items": lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", F.array_join(sanitize_array(F.split("text", " "), 5), "|").alias("items")),
        "posix_paths": lambda s, d: pages(s, d).select("page_id", posix(F.translate("url", "/", "\\")).alias("path")),
        "size_text": lambda s, d: docs(s, d).select("doc_id", bytes_text(F.octet_length("text") * F.col("doc_id") * F.col("doc_id")).alias("size")),
        "time_text": lambda s, d: _table(s, d, "events").select("event_id", ms_text(F.col("value") * F.when(F.col("event_id") % 2 == 0, 8.0).otherwise(0.0078125)).alias("time")),
        "text_scan": _scan,
        "token_usage": _messages,
        "answer_checks": _answers,
        "truth_keywords": _keywords,
        "source_bytes": lambda s, d: source_bytes(_files(s, d)),
    }


_KEPT = "c AS (SELECT c_custkey AS k, c_nationkey AS n, 'src/c' || c_custkey || '.ts' AS f FROM customer WHERE c_custkey % 3 = 2), w AS (SELECT c_custkey AS k, 'src/c' || c_custkey || '.ts' AS f FROM customer WHERE c_custkey % 3 = 1), m AS (SELECT n_nationkey AS k, n_regionkey AS r, 'src/n' || n_nationkey || '.tsx' AS f FROM nation)"
_BOOT = "(SELECT f || '#boot@2' FROM m ORDER BY f LIMIT 1)"


def oracle_sql() -> dict[str, str]:
    edge, found = ", ".join(EDGE_COLUMNS), "SELECT " + ", ".join(IMPACT_COLUMNS)
    folders, endings = ([f"'{x}'" for x in items] for items in (FOLDERS, ENDINGS))
    ignored = r"(^|/)(node_modules|dist|build|\.git|coverage|\.next|\.nuxt|\.cache|out)(/|$)|\.d\.ts$"
    watched = rf"(regexp_matches(path, '(?i)\.(ts|tsx|js|jsx|mjs|cjs)$') AND NOT regexp_matches(path, '{ignored}'))"
    size = "floor(n * 10.0 / {0} + 0.5)::BIGINT"
    tenths = f"CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (({size.format(1024)}) // 10) || '.' || (({size.format(1024)}) % 10) || ' KB' WHEN n < 1073741824 THEN (({size.format(1048576)}) // 10) || '.' || (({size.format(1048576)}) % 10) || ' MB' ELSE (h // 100) || '.' || lpad((h % 100)::VARCHAR, 2, '0') || ' GB' END"
    found_sql = {
        "store_round_trip": f"WITH {GRAPH} SELECT {edge} FROM edges",
        "store_catalog": f"WITH {GRAPH} SELECT '/data/' || kind AS root_path, count(*) AS symbol_count, CASE WHEN kind = 'variable' THEN (SELECT count(*) FROM edges WHERE to_id IS NULL) ELSE 0 END AS edge_count FROM symbols WHERE kind IN ('variable', 'class') GROUP BY kind",
        "maintained_symbols": f"""WITH {_KEPT}
SELECT f || '#cust_' || k || '@2' AS id, 'cust_' || k AS name, 'function' AS kind, f AS file, 2 AS line, 8 AS "column", true AS exported FROM c
UNION ALL SELECT f || '#C_' || k || '@6', 'C_' || k, 'class', f, 6, 1, false FROM c
UNION ALL SELECT f || '#C_' || k || '.run@7', 'run', 'method', f, 7, 3, false FROM c
UNION ALL SELECT f || '#<module>', '<module>', 'module', f, 1, 1, false FROM c
UNION ALL SELECT f || '#moved_' || k || '@1', 'moved_' || k, 'function', f, 1, 8, true FROM w
UNION ALL SELECT f || '#nation_' || k || '@1', 'nation_' || k, 'variable', f, 1, 14, true FROM m
UNION ALL SELECT f || '#boot@2', 'boot', 'function', f, 2, 8, true FROM m""",
        "maintained_edges": f"""WITH {_KEPT}
SELECT c.f || '#cust_' || c.k || '@2' AS from_id, m.f || '#nation_' || m.k || '@1' AS to_id, 'nation_' || c.n AS to_name, c.f AS file, 3 AS line FROM c LEFT JOIN m ON m.k = c.n
UNION ALL SELECT f || '#cust_' || k || '@2', NULL, unnest(['missing', 'inner']), f, 4 FROM c
UNION ALL SELECT f || '#C_' || k || '.run@7', NULL, 'map', f, 7 FROM c
UNION ALL SELECT f || '#C_' || k || '.run@7', f || '#cust_' || k || '@2', 'cust_' || k, f, 7 FROM c
UNION ALL SELECT f || '#<module>', {_BOOT}, 'boot', f, 9 FROM c
UNION ALL SELECT f || '#moved_' || k || '@1', NULL, 'cust_' || k, f, 1 FROM w
UNION ALL SELECT f || '#nation_' || k || '@1', NULL, 'Region_' || r, f, 1 FROM m
UNION ALL SELECT f || '#boot@2', f || '#nation_' || k || '@1', 'nation_' || k, f, 2 FROM m""",
        "recall_skips_modules": """WITH c AS (SELECT c_custkey AS k, 'src/c' || c_custkey || '.ts' AS f FROM customer),
s AS (SELECT f || '#cust_' || k || '@2' AS id, 'cust_' || k AS name, 'function' AS kind, f, 1 AS ord FROM c UNION ALL SELECT f || '#C_' || k || '.run@7', 'run', 'method', f, 3 FROM c),
g AS (SELECT *, first_value(f) OVER w AS f0, first_value(ord) OVER w AS o0 FROM s WINDOW w AS (PARTITION BY name ORDER BY f, ord))
SELECT id, name, kind FROM g ORDER BY f0, o0, f, ord LIMIT 40""",
        "impact_depth_clamped": _impact_sql(5, 100, found),
        "watched_paths": rf"""WITH p AS (SELECT page_id, '/site/' || ([{", ".join(folders)}])[page_id % {len(FOLDERS)} + 1] || '/p' || page_id || ([{", ".join(endings)}])[(page_id // {len(FOLDERS)}) % {len(ENDINGS)} + 1] AS path FROM pages)
SELECT page_id, path, CASE lower(regexp_extract(path, '\.([^./]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' END AS language, {watched} AS watched, starts_with(path, '/site/src/') AND {watched} AS inside,
regexp_matches(path, '(?i)\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)$') OR regexp_matches(path, '(^|/)__tests__/') AS test FROM p""",
        "update_text": "SELECT event_type, CASE WHEN a = b THEN a::VARCHAR ELSE a || ' (' || CASE WHEN a > b THEN '+' ELSE '' END || (a - b) || ')' END AS shown FROM (SELECT event_type, count(*) FILTER (event_id % 3 <> 0) AS b, count(*) FILTER (event_id % 4 <> 0 OR event_type = 'error') AS a FROM events GROUP BY event_type)",
        "sanitized_items": r"SELECT conv_id, turn, CASE WHEN len(x) > 0 THEN array_to_string(x, '|') END AS items FROM (SELECT conv_id, turn, list_slice(list_filter(list_transform(string_split(text, ' '), lambda i: substr(regexp_replace(i, '[\x00-\x1F\x7F]', ' ', 'g'), 1, 5)), lambda i: i <> ''), 1, 50) AS x FROM conversations)",
        "posix_paths": "SELECT page_id, url AS path FROM pages",
        "size_text": f"SELECT doc_id, {tenths} AS size FROM (SELECT doc_id, n, floor(n * 100.0 / 1073741824 + 0.5)::BIGINT AS h FROM (SELECT doc_id, strlen(text) * doc_id * doc_id AS n FROM documents))",
        "time_text": "SELECT event_id, CASE WHEN v < 1 THEN round(v::DECIMAL(30, 12), 2)::DECIMAL(18, 2) || ' ms' WHEN v < 1000 THEN round(v::DECIMAL(30, 12), 1)::DECIMAL(18, 1) || ' ms' ELSE round((v / 1000)::DECIMAL(30, 12), 2)::DECIMAL(18, 2) || ' s' END AS time FROM (SELECT event_id, value * CASE WHEN event_id % 2 = 0 THEN 8.0::DOUBLE ELSE 0.0078125::DOUBLE END AS v FROM events)",
        "text_scan": """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, '// file of hidden()' || chr(10) || 'export function cust_' || c_custkey || '(a: number): void {' || chr(10) || '  nation_' || c_nationkey || '();' || chr(10) || '  if (a) { missing(`${inner()}`); }' || chr(10) || '}' || chr(10) || 'class C_' || c_custkey || ' extends Base<string> {' || chr(10) || '  run(x = skipped()) { xs.map(v => cust_' || c_custkey || '(v)); }' || chr(10) || '}' || chr(10) || 'boot();' || chr(10) AS t FROM customer WHERE c_nationkey = 7)
SELECT 'src/c' || k || '.ts' AS file, strlen(t) AS bytes, '' AS names FROM c
UNION ALL SELECT 'src/n7.tsx', strlen('export const nation_7 = () => <Region_' || n_regionkey || ' title="nation_0()" />;' || chr(10) || 'export function boot() { nation_7(); }' || chr(10)), 'boot' FROM nation WHERE n_nationkey = 7""",
        "token_usage": "SELECT conv_id::VARCHAR AS transcript, count(*) AS messages, coalesce(sum(CASE WHEN role = 'assistant' THEN CASE WHEN conv_id % 5 <> 0 THEN length(text) ELSE 0 END + turn + 1 END), 0)::BIGINT AS tokens FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
        "answer_checks": r"""WITH p AS (SELECT page_id, url, ['main.py:12 @ ', 'src/p1.ts:7 ', 'see x.md:3@', 'line 5 @' || chr(9), 'a:b @ '][page_id % 5 + 1] || substr(sha256(url), 1, 9) AS answer, CASE WHEN page_id % 7 = 0 THEN [] ELSE list_distinct(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) END AS said FROM pages)
SELECT page_id, regexp_matches(answer, ':\d+\s*@\s*[0-9a-f]{7}') OR len(said) = 0 AS anchored, len(list_filter(said, lambda x: NOT list_contains(regexp_split_to_array(url, '[^A-Za-z]+'), x))) AS invented FROM p""",
        "truth_keywords": r"""WITH r AS (SELECT conv_id, turn, string_split(role, 's') AS hints, list_slice(regexp_extract_all(regexp_replace(text, '([A-Za-z]+)\.', '`\1`', 'g'), '`([^`]+)`', 1), 1, 5) AS named FROM conversations),
e AS (SELECT conv_id, turn, list_filter(list_concat(hints, named), lambda x: x <> '') AS l FROM r)
SELECT conv_id, turn, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 8), ',') AS keywords FROM e""",
        "source_bytes": """SELECT (SELECT sum(strlen('// file of hidden()' || chr(10) || 'export function cust_' || c_custkey || '(a: number): void {' || chr(10) || '  nation_' || c_nationkey || '();' || chr(10) || '  if (a) { missing(`${inner()}`); }' || chr(10) || '}' || chr(10) || 'class C_' || c_custkey || ' extends Base<string> {' || chr(10) || '  run(x = skipped()) { xs.map(v => cust_' || c_custkey || '(v)); }' || chr(10) || '}' || chr(10) || 'boot();' || chr(10))) FROM customer)::BIGINT
+ (SELECT sum(strlen('export const nation_' || n_nationkey || ' = () => <Region_' || n_regionkey || ' title="nation_0()" />;' || chr(10) || 'export function boot() { nation_' || n_nationkey || '(); }' || chr(10))) FROM nation)::BIGINT AS bytes, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS files""",
    }
    return found_sql | {f"upkept_{t}": found_sql[f"maintained_{t}"] for t in ("symbols", "edges")}
