"""Many questions in one job: answers from the graph, from a text scan as a reader without a graph would make it, and a report that scores both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut
from ..schema import DEFAULT_LEVEL_LIMIT
from .evaluate import DECLARED, percent_saved, score_sets
from .impact import impact

TASK = "task_id string, kind string, query string, truth array<string>"
SIDES = ("graph", "scan")

# Kinds of questions, how many symbols each search gives, how deep the impact goes.
SEARCHES = {"recall": (False, 50), "recall-substring": (True, 100), "recall-miss": (False, 10), "string-literal": (False, 5)}
DEPTHS = {"impact": 2, "tests-affected": 3}
MAX_CALLS = 50
TEST_FILE = r"\.(test|spec)\.[jt]sx?$"

BLOCK = 128  # questions that one pass over the files answers


def _grams(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` characters of a text that has at least that many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def search_names(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Symbols by name for every row of ``queries`` (task_id, query, substring, most), with ``task_id`` and ``rank`` from 1.

    Each query finds what ``lookup.recall`` finds, in its order: without
    regard to case, module scopes never, exact names in the query's own case
    first, names that merely hold the query in order of their first symbol.
    An empty query finds nothing; task ids must be unique.

    Names that hold a query are found by an inverted index of runs of three
    characters (fewer for shorter queries): a query meets the names of its
    rarest run, and ``contains`` decides.
    """
    named = symbols.filter("kind <> 'module'").withColumn("_low", F.lower("name"))
    asked = queries.filter("query <> ''").select("task_id", "query", "most", "substring", F.lower("query").alias("_ask"))
    exact = named.join(asked.filter("NOT substring").withColumnRenamed("_ask", "_low"), "_low")
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy((F.col("name") == F.col("query")).desc(), "seq")))

    held = asked.filter("substring").withColumn("_size", F.least(F.lit(3), F.length("_ask")))
    wanted = held.select("task_id", "_ask", "_size", F.explode(_grams(F.col("_ask"), F.col("_size"))).alias("_gram"))
    sizes = held.agg(F.array_sort(F.collect_set("_size")).alias("_sizes"))  # one row of at most three numbers
    names = named.select("_low").distinct().crossJoin(F.broadcast(sizes))
    runs = names.select("_low", F.explode(F.flatten(F.transform("_sizes", lambda n: F.when(F.length("_low") >= n, _grams(F.col("_low"), n)).otherwise(F.array().cast("array<string>"))))).alias("_gram"))
    runs = runs.join(wanted.select("_gram").distinct(), "_gram", "left_semi")
    common = runs.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = wanted.join(common, "_gram", "left").groupBy("task_id", "_ask").agg(F.min_by("_gram", F.coalesce("_n", F.lit(0))).alias("_gram"))
    pairs = rarest.join(runs, "_gram").filter(F.col("_low").contains(F.col("_ask"))).select("task_id", "_low")
    some = named.join(pairs, "_low").join(asked.select("task_id", "query", "most"), "task_id")
    some = some.withColumn("_first", F.min("seq").over(Window.partitionBy("task_id", "_low")))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("_first", "seq")))
    columns = ["task_id", "rank", "most", *symbols.columns]
    return exact.select(*columns).unionByName(some.select(*columns)).filter("rank <= most").drop("most")


def answer_from_graph(tasks: DataFrame, symbols: DataFrame, edges: DataFrame, prefix: str = "src/") -> DataFrame:
    """(task_id, item), as often as found, for ``tasks`` (task_id, kind, query): names, or files for the kinds that ask for files.

    callers: who calls the symbol (by id where the query holds # and @), of
    its first 50 calls; recall, recall-substring, recall-miss: names found;
    kind-filter: names of a kind below ``prefix``; impact: names of callers up
    to two calls away, the first 100 of each level; tests-affected: test files
    up to three calls away; string-literal: where a symbol of that name is declared, since texts are
    not in the graph.  An unknown kind or symbol finds nothing.  All calls are
    searched, however many lead into a symbol, and many callers of one name
    are one answer and take one of the 100 places.
    """
    tasks = cut(tasks.select("task_id", "kind", "query"), "tasks")
    searches = F.create_map(*(F.lit(x) for kind, (sub, most) in SEARCHES.items() for x in (kind, f"{int(sub)}{most}")))
    code = searches[F.col("kind")]
    by_id = F.col("query").contains("#") & F.col("query").contains("@")
    pointed = F.col("kind").isin("callers", *DEPTHS)
    asked = tasks.filter(code.isNotNull()).select("task_id", "query", (F.substring(code, 1, 1) == "1").alias("substring"), F.substring(code, 2, 9).cast("int").alias("most"))
    asked = asked.unionByName(tasks.filter(pointed & ~by_id).select("task_id", "query", F.lit(False).alias("substring"), F.lit(1).alias("most")))
    found = cut(search_names(symbols.select("id", "name", "kind", "file", "seq"), asked), "found")

    kinds = tasks.select("task_id", "kind")
    named = found.withColumnRenamed("kind", "_kind").join(kinds, "task_id")
    target = named.filter(pointed).select("task_id", F.col("kind"), F.col("id").alias("target_id"))
    direct = tasks.filter(pointed & by_id).join(symbols.select("id").distinct(), F.col("query") == F.col("id"), "left_semi").select("task_id", "kind", F.col("query").alias("target_id"))
    target = cut(target.unionByName(direct), "targets")
    out = named.filter(F.col("kind").isin("recall", "recall-substring", "recall-miss")).select("task_id", F.col("name").alias("item"))
    out = out.unionByName(named.filter("kind = 'string-literal'").select("task_id", F.col("file").alias("item")).distinct())

    last = symbols.groupBy("id").agg(F.max_by("name", "seq").alias("item"))
    calls = edges.select(F.col("to_id").alias("target_id"), "from_id", "seq").join(target.filter("kind = 'callers'").select("task_id", "target_id"), "target_id")
    first = calls.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy("seq"))).filter(F.col("n") <= MAX_CALLS)
    out = out.unionByName(first.join(last.withColumnRenamed("id", "from_id"), "from_id").select("task_id", "item").distinct())

    listed = symbols.filter(F.col("file").startswith(prefix)).select(F.col("kind").alias("query"), F.col("name").alias("item"))
    out = out.unionByName(tasks.filter("kind = 'kind-filter'").join(listed, "query").select("task_id", "item"))

    reached = impact(target.filter("kind <> 'callers'").select("target_id").distinct(), edges, symbols, max(DEPTHS.values()), 1 << 40, fan_in=None)
    deep = F.create_map(*(F.lit(x) for pair in DEPTHS.items() for x in pair))
    near = reached.join(target.filter("kind <> 'callers'"), "target_id").filter(F.col("depth") <= deep[F.col("kind")])
    told = near.filter("kind = 'impact'").join(last.withColumnRenamed("id", "caller_id"), "caller_id")
    told = told.groupBy("task_id", "depth", "item").agg(F.min("disc_rank").alias("_first"))
    told = told.withColumn("n", F.row_number().over(Window.partitionBy("task_id", "depth").orderBy("_first"))).filter(F.col("n") <= DEFAULT_LEVEL_LIMIT)
    out = out.unionByName(told.select("task_id", "item").distinct())
    return out.unionByName(near.filter("kind = 'tests-affected' AND is_test").select("task_id", F.col("caller_file").alias("item")).distinct())


def _named_after(word: Column) -> Column:
    """A pattern of the names that follow a word."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    return F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted, F.lit(r"\s+([A-Za-z_$][A-Za-z0-9_$]*)"))


def answer_from_text(tasks: DataFrame, files: DataFrame, prefix: str = "src/") -> tuple[DataFrame, DataFrame]:
    """((task_id, item), (task_id, bytes)): what a scan of ``files`` (file, content) finds for each task, and the size of the files it has to read.

    Names are those that matching lines declare, without the query itself;
    kind-filter takes the names that follow the word below ``prefix``;
    string-literal and tests-affected give files.  Null content matches
    nothing.  Questions are sent to the files in blocks of ``BLOCK``; each
    block is one pass, and no pair of file and question is made that does not
    match.
    """
    spark = tasks.sparkSession
    rows = [(r.task_id, r.kind, r.query) for r in tasks.select("task_id", "kind", "query").filter("query <> ''").toLocalIterator()]
    hits = None
    for at in range(0, len(rows), BLOCK):
        asked = F.array(*(F.struct(F.lit(i).alias("task_id"), F.lit(k).alias("kind"), F.lit(q).alias("query")) for i, k, q in rows[at : at + BLOCK]))
        word = lambda t: F.rlike("content", _named_after(t["query"])) & F.col("file").startswith(prefix)
        held = F.filter(asked, lambda t: F.when(t["kind"] == "kind-filter", word(t)).otherwise(F.col("content").contains(t["query"])))
        one = files.filter(F.col("content").isNotNull()).select("file", "content", F.explode(held).alias("t")).select("file", "content", "t.*")
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        return spark.createDataFrame([], "task_id string, item string"), spark.createDataFrame([], "task_id string, bytes long")
    lines = F.filter(F.split("content", "\n", -1), lambda x: x.contains(F.col("query")))
    declared = F.transform(lines, lambda x: F.when(x.rlike(DECLARED[0]), F.regexp_extract(x, DECLARED[0], 1)).otherwise(F.regexp_extract(x, DECLARED[1], 1)))
    following = F.regexp_extract_all("content", _named_after(F.col("query")), F.lit(1))
    file = F.array(F.col("file"))
    items = (
        F.when(F.col("kind") == "kind-filter", following)
        .when(F.col("kind") == "string-literal", file)
        .when(F.col("kind") == "tests-affected", F.when(F.col("file").rlike(TEST_FILE), file).otherwise(F.array().cast("array<string>")))
        .otherwise(F.filter(declared, lambda x: (x != "") & (x != F.col("query"))))
    )
    told = cut(hits.select("task_id", F.octet_length("content").cast("long").alias("bytes"), F.array_distinct(items).alias("items")), "hits")
    return told.select("task_id", F.explode("items").alias("item")).distinct(), told.groupBy("task_id").agg(F.sum("bytes").alias("bytes"))


def listing_bytes(found: DataFrame) -> DataFrame:
    """(task_id, bytes): the size of each task's items as a JSON list of texts."""
    size = F.octet_length(F.to_json(F.array("item"))) - 1  # the text in its quotes and what separates it
    return found.groupBy("task_id").agg((F.sum(size) + 1).cast("long").alias("bytes"))


def evaluate(tasks: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame, tie: float = 0.001) -> DataFrame:
    """A row per task (see ``TASK``): precision, recall, f1 and bytes of both sides, and the winner (graph, scan or tie).

    A side that finds nothing where nothing is to be found scores 1.
    """
    truth = tasks.select("task_id", F.explode("truth").alias("item"))
    found, (scanned, cost) = answer_from_graph(tasks, symbols, edges), answer_from_text(tasks, files)
    found = cut(found, "answers")
    out = tasks.select("task_id", "kind")
    for side, some, size in (("graph", found, listing_bytes(found)), ("scan", scanned, cost)):
        scored = score_sets(some, truth, "task_id", "item").select("task_id", *(F.col(c).alias(f"{side}_{c}") for c in ("precision", "recall", "f1")))
        out = out.join(scored, "task_id", "left").join(size.withColumnRenamed("bytes", f"{side}_bytes"), "task_id", "left")
    out = out.fillna(1.0, [f"{s}_{c}" for s in SIDES for c in ("precision", "recall", "f1")]).fillna({"graph_bytes": 2, "scan_bytes": 0})
    gap = F.col("graph_f1") - F.col("scan_f1")
    return out.withColumn("winner", F.when(F.abs(gap) < tie, "tie").when(gap > 0, "graph").otherwise("scan"))


def report(scores: DataFrame, by: str | None = "kind") -> DataFrame:
    """Tasks, mean f1 and bytes of both sides, percent saved, and who wins, by kind of task or (``by`` none) in all."""
    counts = [F.count_if(F.col("winner") == w).cast("long").alias(f"{w}_wins" if w != "tie" else "ties") for w in (*SIDES, "tie")]
    means = [F.avg(f"{s}_f1").alias(f"{s}_f1") for s in SIDES]
    sizes = [F.sum(f"{s}_bytes").cast("long").alias(f"{s}_bytes") for s in SIDES]
    out = scores.groupBy(*([by] if by else [])).agg(F.count("*").alias("tasks"), *means, *sizes, *counts)
    return out.withColumn("saved", percent_saved(F.col("scan_bytes"), F.col("graph_bytes")))


def report_text(scores: DataFrame) -> str:
    """The report as a table in Markdown: a line per kind of task, and one for all."""
    rows = sorted(report(scores).collect(), key=lambda r: r["kind"]) + [r for r in report(scores, None).withColumn("kind", F.lit("all")).collect() if r["tasks"]]
    lines = ["| kind | tasks | f1 graph | f1 scan | bytes graph | bytes scan | saved | wins graph, scan, ties |", "|---|---|---|---|---|---|---|---|"]
    return "\n".join(lines + [f"| {r['kind']} | {r['tasks']} | {r['graph_f1']:.2f} | {r['scan_f1']:.2f} | {r['graph_bytes']} | {r['scan_bytes']} | {r['saved']} % | {r['graph_wins']}, {r['scan_wins']}, {r['ties']} |" for r in rows])
