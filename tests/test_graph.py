"""Every graph query against its SQL on the smallest tables, and the edge cases of the operators."""

import duckdb
import pytest

from loomgraph.plans import code, evaluation, questions, upkeep
from loomgraph.plans import queries as graph

QUERIES, SQL = graph.queries() | evaluation.queries() | code.queries() | upkeep.queries() | questions.queries(), graph.oracle_sql() | evaluation.oracle_sql() | code.oracle_sql() | upkeep.oracle_sql() | questions.oracle_sql()

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    other = duck.sql(SQL[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(other.columns, other.fetchall())


def _impact(spark, edges, targets=("a",), **more):
    from loomgraph.operators.impact import impact

    names = sorted({x for e in edges for x in e[:2] if not x.startswith("no")} | set(targets))
    symbols = spark.createDataFrame([(n, f"{n}.ts", i) for i, n in enumerate(names)], "id string, file string, seq long")
    rows = spark.createDataFrame([(f, t, i) for i, (f, t) in enumerate(edges)], "from_id string, to_id string, seq long")
    found = impact(spark.createDataFrame([(t,) for t in targets], "target_id string"), rows, symbols, **more)
    return sorted((r.depth, r.disc_rank, r.caller_id) for r in found.collect())


def test_impact_cycles_and_self_calls(spark):
    assert _impact(spark, [("a", "a"), ("b", "a"), ("a", "b"), ("c", "b")]) == [(1, 1, "b"), (2, 1, "c")]


def test_impact_level_limit_reports_less_but_searches_all(spark):
    edges = [(x, "a") for x in "bcdef"] + [("z", "f")]
    assert _impact(spark, edges, level_limit=2) == [(1, 1, "b"), (1, 2, "c"), (2, 1, "z")]


def test_impact_drops_callers_without_symbol(spark):
    assert _impact(spark, [("nobody", "a"), ("b", "nobody")]) == []


def test_redaction_rules(spark):
    from pyspark.sql import functions as F

    from loomgraph.functions.redact import detect_secrets, redact_secrets

    key = "AK" + "IA" + "ABCDEFGH12345678"
    row = spark.createDataFrame([(f"é{key} \"{'a' * 40}\"",)], "t string").select(redact_secrets(F.col("t")).alias("r"), detect_secrets(F.col("t")).alias("d")).first()
    assert row.r == 'éAKIA***REDACTED*** "***REDACTED-LONG-TOKEN***"' and row.d == "aws-akia,long-token-in-string"


def test_a_hot_name_is_dealt_and_changes_nothing(spark):
    from pyspark.sql import functions as F

    from loomgraph.operators.resolve import heavy_names, resolve_calls

    symbols = spark.createDataFrame([("a#hot", "hot", "a", 1), ("b#hot", "hot", "b", 2), ("b#x", "x", "b", 3)], "id string, name string, file string, seq long")
    n = 20_000
    calls = spark.range(n).select(F.concat(F.lit("c"), "id").alias("from_id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("n"), (F.col("id") % 5000).cast("string"))).alias("to_name"), F.when(F.col("id") % 4 == 0, "b").otherwise("z").alias("file"), F.col("id").alias("seq"))
    heavy = heavy_names(calls)
    assert heavy == ["hot"]
    plain, dealt = resolve_calls(calls, symbols), resolve_calls(calls, symbols, heavy=heavy)
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty() and dealt.count() == n
    row = dealt.filter("to_name = 'hot'").groupBy("to_id", "ambiguous", "candidate_count").count().orderBy("to_id").collect()
    assert [tuple(r) for r in row] == [("a#hot", True, 2, n // 4), ("b#hot", True, 2, n // 4)]
    salt = F.when(F.col("to_name") == "hot", F.pmod(F.xxhash64("file", "seq"), F.lit(64))).otherwise(0)
    sizes = sorted(r["count"] for r in calls.select(F.spark_partition_id(), "to_name", salt.alias("s")).filter("to_name IS NOT NULL").repartition(8, "to_name", "s").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4]
    assert heavy_names(calls.limit(0)) == []


def test_search_of_many_names_equals_one_by_one(spark):
    from pyspark.sql import functions as F

    from loomgraph.operators.lookup import recall
    from loomgraph.operators.tasks import search_names

    names = ["Foo", "foo", "FOO", "fo", "f", "barFoo", "xfooy", "Bar", "éÉa", "ab", "<module>", "foo.bar*", "aaaa"]
    symbols = spark.createDataFrame([(f"{n}#{k}", n, "module" if n == "<module>" else "function", "a.ts", 100 - k) for k, n in enumerate(names * 2)], "id string, name string, kind string, file string, seq long")
    asked = [(q, sub, most) for q in ("foo", "FO", "f", "É", "a", "aaa", "o.b", "*", "zzz", "module") for sub in (False, True) for most in (1, 3, 100)]
    rows = spark.createDataFrame([(str(k), *a) for k, a in enumerate(asked)] + [("none", "", True, 5)], "task_id string, query string, substring boolean, most int")
    found = search_names(symbols, rows).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    got = {r.task_id: r.ids for r in found.collect()}
    for k, (q, sub, most) in enumerate(asked):
        assert got.get(str(k), []) == [r.id for r in recall(symbols, q, most, sub).collect()], (q, sub, most)
    assert "none" not in got


def test_answers_of_awkward_tasks_and_the_report(spark):
    from loomgraph.operators.index import build
    from loomgraph.operators.tasks import TASK, evaluate, report, report_text

    files = spark.createDataFrame([("src/a.ts", "export function alpha() { beta(); }\nclass K {}\n"), ("src/b.test.ts", "function beta() {}\nfunction check() { alpha(); }\n"), ("src/c.ts", None)], "file string, content string")
    graph = build(files.filter("content IS NOT NULL"))
    tasks = [("1", "callers", "beta", ["alpha"]), ("2", "callers", "src/a.ts#alpha@1", ["check"]), ("3", "callers", "nobody#x@1", []), ("4", "tests-affected", "alpha", ["src/b.test.ts"]), ("5", "kind-filter", "class", ["K"]), ("6", "kind-filter", "(", []), ("7", "string-literal", "check", ["src/b.test.ts"]), ("8", "recall", "", []), ("9", "impact", "beta", ["alpha", "check"]), ("10", "odd", "x", [])]
    rows = {r.task_id: r for r in evaluate(spark.createDataFrame(tasks, TASK), graph.symbols, graph.edges, files).collect()}
    assert {k: r.graph_f1 for k, r in rows.items()} == dict.fromkeys(rows, 1.0) and len(rows) == 10
    assert rows["1"].scan_f1 == 1.0 and rows["1"].winner == "tie" and rows["9"].winner == "graph"  # the scan meets the line of one call
    assert (rows["5"].graph_bytes, rows["8"].graph_bytes, rows["8"].scan_bytes) == (len('["K"]'), 2, 0)
    text = report_text(evaluate(spark.createDataFrame(tasks, TASK), graph.symbols, graph.edges, files))
    assert text.splitlines()[-1].startswith("| all | 10 | 1.00 |") and len(text.splitlines()) == 2 + 7 + 1
    assert report_text(evaluate(spark.createDataFrame([], TASK), graph.symbols, graph.edges, files)).count("\n") == 1


def test_edges_into_some_symbols_are_those_of_the_whole_graph(spark):
    from loomgraph.operators.impact import impact
    from loomgraph.operators.resolve import edges_into, resolve_calls

    names = [("a#f", "f", "a"), ("b#f", "f", "b"), ("b#g", "g", "b"), ("c#h", "h", "c"), ("c#h", "other", "c"), ("d#i", "i", "d")]
    symbols = spark.createDataFrame([(*n, k) for k, n in enumerate(names)], "id string, name string, file string, seq long")
    calls = spark.createDataFrame([("b#g", "f", "b", 0), ("d#i", "f", "d", 1), ("c#h", "g", "c", 2), ("d#i", "other", "d", 3), ("a#f", None, "a", 4), ("a#f", "none", "a", 5), ("b#f", "h", "b", 6), ("d#i", "i", "d", 7)], "from_id string, to_name string, file string, seq long")
    whole = resolve_calls(calls, symbols)
    met = []

    def calls_to(names):
        met.append(sorted(r[0] for r in names.collect()))
        return calls.join(names, "to_name", "left_semi")

    for some in (["a#f"], ["b#f"], ["c#h", "b#g"], ["nobody"]):
        ids = spark.createDataFrame([(x,) for x in some], "id string")
        want = whole.filter(whole["to_id"].isin(some)).select(*whole.columns)
        assert _rows(whole.columns, edges_into(calls_to, symbols, ids).select(*whole.columns).collect()) == _rows(whole.columns, want.collect())
    assert met == [["f"], ["f"], ["g", "h", "other"], []]
    targets = spark.createDataFrame([("a#f",), ("c#h",)], "target_id string")
    plain, narrow = (impact(targets, e, symbols) for e in (whole, lambda ids: edges_into(calls_to, symbols, ids)))
    assert _rows(plain.columns, plain.collect()) == _rows(plain.columns, narrow.collect()) and plain.count() == 4


def test_a_search_writes_no_more_than_it_finds(spark, monkeypatch):
    from loomgraph.operators import impact as search
    from loomgraph.operators import resolve
    from loomgraph.plans.shared import cut
    from loomgraph.sources import relational

    sizes = []

    def counted(df, name):
        out = cut(df, name)
        sizes.append(out.count())
        return out

    for module in (search, resolve, relational):
        monkeypatch.setattr(module, "cut", counted, raising=False)
    QUERIES["impact_d3"](spark, SF)
    assert max(sizes) < 1000  # of 14,500 calls


@pytest.mark.parametrize("name", ["impact_d2", "impact_tests", "impact_min_depth"])  # the others are built like the first
def test_a_search_moves_neither_symbols_nor_calls_to_its_frontier(spark, monkeypatch, name):
    from loomgraph.operators import impact as search
    from loomgraph.operators import resolve
    from loomgraph.plans.shared import cut
    from loomgraph.sources import relational

    joins = []

    def seen(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins.extend(line.strip() for line in plan.split("\n") if "Join" in line)
        return cut(df, name)

    for module in (search, resolve, relational):
        monkeypatch.setattr(module, "cut", seen)
    QUERIES[name](spark, SF)
    assert joins and [j for j in joins if "BroadcastHashJoin" not in j] == []


@pytest.mark.parametrize("name", ["impact_d2", "impact_min_depth"])  # the others are built like the first
def test_a_frontier_above_the_session_limit_moves_no_table(spark, monkeypatch, name):
    from loomgraph.operators import impact as search
    from loomgraph.operators import resolve
    from loomgraph.plans import shared
    from loomgraph.sources import relational

    joins = []

    def seen(df, name):
        if name in ("called", "alike", "narrowed") or name.startswith("found-"):
            plan = df._jdf.queryExecution().executedPlan().toString()
            joins.extend(line.strip() for line in plan.split("\n") if "Join" in line and "LeftSemi" in line)
        return shared.cut(df, name)

    for module in (search, resolve, relational):
        monkeypatch.setattr(module, "cut", seen)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if every frontier were too large for it
    try:
        df = QUERIES[name](spark, SF)
        few = _rows(df.columns, df.collect())
        assert joins and [j for j in joins if "BroadcastHashJoin" not in j] == []
        monkeypatch.setattr(shared, "FEW", -1)  # more rows than that are shuffled, with the same result
        joins.clear()
        df = QUERIES[name](spark, SF)
        assert few and _rows(df.columns, df.collect()) == few
        assert [j for j in joins if "BroadcastHashJoin" in j] == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("common", ["part", "supplier"])  # the searches from a part and from a supplier
def test_lines_stay_where_many_rows_have_a_called_name(spark, monkeypatch, common):
    from loomgraph.plans import shared
    from loomgraph.sources import relational

    table = spark.read.parquet(f"{SF}/{common}.parquet").withColumnRenamed(f"{common[0]}_name", "to_name")
    names = shared.cut(table.select("to_name").limit(1), "names")

    def joins_of(df):
        return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line and "Inner" in line]

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if the parts of that name were too many bytes for it
    try:
        stay = relational.raw_calls(spark, SF, names)
        assert joins_of(stay) and [j for j in joins_of(stay) if "BroadcastHashJoin" not in j] == []
        monkeypatch.setattr(shared, "FEW", -1)  # more rows than that are shuffled, with the same result
        moved = relational.raw_calls(spark, SF, names)
        assert [j for j in joins_of(moved) if "BroadcastHashJoin" in j] == []
        assert stay.count() > 0 and _rows(stay.columns, stay.collect()) == _rows(moved.columns, moved.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_ends_of_calls_that_lead_nowhere(spark):
    from loomgraph.functions.display import name_ends

    symbols = spark.createDataFrame([("a", "A", 1), ("a", "B", 2), ("\0x", "odd", 3)], "id string, name string, seq long")
    edges = spark.createDataFrame([("a", "a", "n"), ("x", None, "m"), ("a", None, "k"), ("a", "gone", "l"), (None, "a", "o")], "from_id string, to_id string, to_name string")
    assert sorted((r.to_name, r.caller_name, r.callee_name) for r in name_ends(edges, symbols).collect()) == [("k", "B", "k"), ("l", "B", "l"), ("m", "x", "m"), ("n", "B", "B"), ("o", None, "B")]


def _much_called(spark):
    """Symbols and edges: 600 functions and, last, ``late`` call ``hot``; a ``run`` of each and the module of ``late`` call those."""
    names = [("hot", "hot", "function"), ("late", "late", "function"), ("top", "<module>", "module")]
    names += [x for k in range(600) for x in ((f"f{k}", f"f_{k}", "function"), (f"r{k}", "run", "method"))]
    calls = [(f"f{k}", "hot") for k in range(600)] + [("late", "hot")] + [(f"r{k}", f"f{k}") for k in range(600)] + [("top", "late")]
    symbols = spark.createDataFrame([(i, n, kind, f"src/{i}.ts", at) for at, (i, n, kind) in enumerate(names)], "id string, name string, kind string, file string, seq long")
    return symbols, spark.createDataFrame([(f, t, at) for at, (f, t) in enumerate(calls)], "from_id string, to_id string, seq long")


def test_answers_search_all_calls_and_count_names_once(spark):
    from loomgraph.operators.tasks import answer_from_graph

    tasks = spark.createDataFrame([("i", "impact", "hot"), ("t", "tests-affected", "hot"), ("c", "callers", "hot")], "task_id string, kind string, query string")
    found = sorted((r.task_id, r["item"]) for r in answer_from_graph(tasks, *_much_called(spark)).collect())
    want = [("i", x) for x in [f"f_{k}" for k in range(100)] + ["run", "<module>"]] + [("c", f"f_{k}") for k in range(50)]
    assert found == sorted(want)


def test_report_scores_answers_beyond_the_first_calls(spark):
    from loomgraph.operators.tasks import TASK, evaluate, report

    truth = [f"f_{k}" for k in range(100)] + ["run", "<module>"]
    tasks, files = spark.createDataFrame([("i", "impact", "hot", truth)], TASK), spark.createDataFrame([], "file string, content string")
    row = report(evaluate(tasks, *_much_called(spark), files)).first()
    assert (row["tasks"], row.graph_f1, row.graph_bytes) == (1, 1.0, sum(len(x) + 3 for x in truth) + 1)


def _breadth_first(calls, symbols, targets, depth):
    """(target, caller, depth, disc_rank) by a plain search: the order of the frontier, then of the calls."""
    out = []
    for target in targets:
        seen, frontier = {target}, [target]
        for level in range(1, depth + 1):
            found = [f for at in frontier for f, t in calls if t == at]
            fresh = [f for k, f in enumerate(found) if f not in seen and f not in found[:k]]
            seen.update(fresh)
            frontier = [f for f in fresh if f in symbols]
            out += [(target, f, level, k + 1) for k, f in enumerate(frontier)]
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 19, -1])  # levels of more rows are numbered by many tasks
def test_a_search_of_all_calls_equals_a_plain_one(spark, monkeypatch, most):
    import random

    from loomgraph.operators.impact import impact
    from loomgraph.plans import shared

    deal = random.Random(7)
    calls = [(f"f{k}", "a") for k in range(510)] + [(f"g{deal.randrange(40)}", f"f{deal.randrange(510)}") for _ in range(400)] + [("gone", "a"), ("late", "a"), ("top", "late"), ("end", "top"), ("lost", "gone"), ("a", "end")] + [(f"f{deal.randrange(510)}", "g3") for _ in range(30)]
    names = sorted({f for f, _ in calls} - {"gone"})
    symbols = spark.createDataFrame([(n, f"{n}.ts", at) for at, n in enumerate(names)], "id string, file string, seq long")
    edges = spark.createDataFrame([(f, t, at) for at, (f, t) in enumerate(calls)], "from_id string, to_id string, seq long")
    monkeypatch.setattr(shared, "FEW", most)
    found = impact(spark.createDataFrame([("a",), ("g3",)], "target_id string"), edges, symbols, 5, 10, fan_in=None).collect()
    want = _breadth_first(calls, set(names), ["a", "g3"], 5)
    assert sorted((r.target_id, r.caller_id, r.depth, r.disc_rank) for r in found) == [w for w in want if w[3] <= 10]
    many = {(t, d) for t, _, d, k in want if k > 10}
    assert many and {(r.target_id, r.depth) for r in found if r.truncated} == many


def test_min_depth_reads_more_than_500_calls_into_a_symbol(spark, duck):
    df = QUERIES["impact_min_depth"](spark, SF)
    lines = duck.sql("SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 1)").fetchall()[0][0]
    direct = df.filter("target_id = 'supp:1' AND min_depth = 1").count()
    assert direct == lines > 500
