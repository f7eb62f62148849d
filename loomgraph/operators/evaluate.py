"""Scores of found against true sets, exact rank statistics, and cost summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import cut

BUCKETS = 4096  # value ranges per key in the first pass of rank statistics


def score_sets(found: DataFrame, truth: DataFrame, key: str, item: str, lenient: bool = False) -> DataFrame:
    """(key, tp, fp, fn, precision, recall, f1) of the distinct items of each key on either side.

    Two empty sides score 1 throughout and cannot occur for a key that has a
    row.  With only one side empty the score of the empty side is 0, or 1 if
    ``lenient`` (nothing found is then never imprecise, nothing to find never
    missed).  One shuffle by (key, item), which no hot key can overload, then
    a small one by key.
    """
    sides = found.select(key, item, F.lit(1).alias("f"), F.lit(0).alias("t")).unionByName(truth.select(key, item, F.lit(0).alias("f"), F.lit(1).alias("t")))
    merged = sides.groupBy(key, item).agg(F.max("f").alias("f"), F.max("t").alias("t"))
    counts = merged.groupBy(key).agg(F.sum(F.col("f") * F.col("t")).alias("tp"), F.sum(F.col("f") * (1 - F.col("t"))).alias("fp"), F.sum((1 - F.col("f")) * F.col("t")).alias("fn"))
    empty = F.lit(1.0 if lenient else 0.0)

    def share(whole: Column) -> Column:
        return F.when(whole > 0, F.col("tp") / whole).otherwise(empty)

    rated = counts.withColumn("precision", share(F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp") + F.col("fn")))
    total = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def score_arrays(found: Column, truth: Column) -> Column:
    """Struct (precision, recall, f1) of two arrays taken as sets; both empty score 1."""
    tp, nf, nt = F.size(F.array_intersect(found, truth)), F.size(F.array_distinct(found)), F.size(F.array_distinct(truth))
    precision = F.when(nf > 0, tp / nf).otherwise(F.when(nt > 0, 0.0).otherwise(1.0))
    recall = F.when(nt > 0, tp / nt).otherwise(F.when(nf > 0, 0.0).otherwise(1.0))
    total = precision + recall
    return F.struct(precision.alias("precision"), recall.alias("recall"), F.when(total > 0, 2 * precision * recall / total).otherwise(0.0).alias("f1"))


def rank_stats(df: DataFrame, key: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """(key, n, mean, max, one column per fraction): the value at index min(n - 1, floor(p n)) of the sorted values.

    Exact without sorting a key in one task: values are counted in ranges,
    running counts over at most ``BUCKETS`` ranges name the one that holds the
    rank, and only its distinct values are ranked.  Null values do not count.
    """
    rows = df.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    whole = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("max"))
    span = F.col("max") - F.col("low")
    placed = rows.join(whole, key).withColumn("b", F.when(span > 0, F.floor((F.col("v") - F.col("low")) / span * (BUCKETS - 1))).otherwise(0))
    tally = placed.groupBy(key, "b", "v").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(key).orderBy("b")) - F.col("c")
    ranges = tally.groupBy(key, "b").agg(F.sum("c").alias("c")).withColumn("before", before)
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in fractions.items()))).alias("q")
    goal = whole.select(key, "n", wanted).select(key, "q.name", F.least(F.col("n") - 1, F.floor(F.col("q.p") * F.col("n"))).alias("at"))
    hit = ranges.join(goal, key).filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("c"))).select(key, "b", "name", "at", "before")
    inside = tally.join(hit, [key, "b"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(key, "name").orderBy("v")))
    picked = inside.filter(F.col("upto") > F.col("at")).groupBy(key).agg(*(F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in fractions))
    return whole.select(key, "n", "mean", "max").join(picked, key)


def wins(df: DataFrame, ours: str, theirs: str, by: str | None = None, tie: float = 0.001) -> DataFrame:
    """Sums of both scores, and how often ours is better, worse or within ``tie``."""
    gap = F.col(ours) - F.col(theirs)
    counts = [F.count_if(gap >= tie).alias("wins"), F.count_if(gap <= -tie).alias("losses"), F.count_if(F.abs(gap) < tie).alias("ties")]
    return df.groupBy(*([by] if by else [])).agg(F.count("*").alias("tasks"), *counts)


def hit_rate(answer: Column, keywords: list[str]) -> Column:
    """Share of the keywords that the answer contains, without regard to case; 1 for no keywords."""
    if not keywords:
        return F.lit(1.0)
    low = F.lower(answer)
    return sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0)) / len(keywords)


def percent_saved(base: Column, now: Column) -> Column:
    """Whole percent by which ``now`` is below ``base``, halves up; 0 for a base of 0."""
    return F.when(base > 0, F.floor((base - now) / base * 100 + 0.5)).otherwise(0).cast("long")


def reduction(base: Column, now: Column) -> Column:
    return F.when(base > 0, 1 - now / base).otherwise(0.0)


def every_kth(symbols: DataFrame, n: int, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """n evenly spaced symbols of these kinds in ``seq`` order: the feature is the sample.

    The rank within the order comes from a range partitioning and counts per
    partition, not from one global window.
    """
    some = symbols.filter(F.col("kind").isin(*kinds)).select("id", "name", "kind", "seq")
    part = some.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("m", F.monotonically_increasing_id())
    part = cut(part, "ranks")  # read twice: both must see the same partitions
    part = part.withColumn("p", F.shiftright("m", 33)).withColumn("r", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = part.groupBy("p").agg(F.count("*").alias("c"))
    start = sizes.withColumn("start", F.sum("c").over(Window.orderBy("p")) - F.col("c")).select("p", "start")  # a row per partition
    total = sizes.agg(F.sum("c").alias("total"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / n))
    ranked = part.join(F.broadcast(start), "p").crossJoin(F.broadcast(total)).withColumn("rank", F.col("start") + F.col("r"))
    return ranked.filter((F.col("rank") % step == 0) & (F.col("rank") < step * n)).select("id", "name", "kind", "rank")


#: What a line says it declares, and how an answer gives a line at a revision.
DECLARED = [r"(?:function|class|interface)\s+([A-Za-z_$][A-Za-z0-9_$]*)", r"(?<![A-Za-z0-9_])([A-Za-z_$][A-Za-z0-9_$]*)\s*[:=]\s*(?:async\s+)?(?:function|\()"]
EVIDENCE = r":\d+\s*@\s*[0-9a-f]{7}"
MESSAGE = "role string, usage struct<input_tokens:bigint,output_tokens:bigint>"


def scan_text(files: DataFrame, query: str) -> DataFrame:
    """(file, bytes, names) of the files (file, content) with a line that holds ``query``: what a reader without a graph would look at.

    ``names`` are the distinct names, in order, that such lines declare (the
    first rule that matches a line counts), without the query itself.  Null
    content matches nothing.
    """
    hit = files.filter(F.col("content").contains(query))
    lines = F.filter(F.split("content", "\n", -1), lambda x: x.contains(query))
    first, second = (lambda x, p=p: F.regexp_extract(x, p, 1) for p in DECLARED)
    names = F.transform(lines, lambda x: F.when(x.rlike(DECLARED[0]), first(x)).otherwise(second(x)))
    return hit.select("file", F.octet_length("content").cast("long").alias("bytes"), F.array_sort(F.array_distinct(F.filter(names, lambda x: (x != "") & (x != query)))).alias("names"))


def scan_kind(files: DataFrame, keyword: str, prefix: str = "src/") -> DataFrame:
    """(file, bytes, names): the names that follow a keyword, in the files below ``prefix`` that have any."""
    pattern = rf"(?<![A-Za-z0-9_]){keyword}\s+([A-Za-z_$][A-Za-z0-9_$]*)"
    found = files.filter(F.col("file").startswith(prefix)).select("file", F.octet_length("content").cast("long").alias("bytes"), F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("names"))
    return found.filter(F.size("names") > 0)


def matching_bytes(files: DataFrame, query: str, by: str) -> DataFrame:
    """(by, files, bytes) of the files whose content holds ``query``, the cost of reading them all."""
    return files.filter(F.col("content").contains(query)).groupBy(by).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


def source_bytes(files: DataFrame) -> DataFrame:
    """One row: bytes and files of a source tree; unreadable files (null content) count for nothing."""
    return files.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"), F.count("content").alias("files"))


def parse_messages(lines: DataFrame) -> DataFrame:
    """(transcript, message) from the lines (transcript, value) of JSON transcripts; blank lines do not count, a broken one ends the job."""
    return lines.filter(F.trim("value") != "").select("transcript", F.from_json("value", MESSAGE, {"mode": "FAILFAST"}).alias("message"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``parse_messages`` of the files at ``path``; a transcript is a file."""
    return parse_messages(spark.read.text(path).select(F.input_file_name().alias("transcript"), "value"))


def token_usage(messages: DataFrame) -> DataFrame:
    """(transcript, messages, tokens): input and output tokens of all messages; missing counts are 0."""
    usage = F.col("message.usage")
    spent = F.when(usage.isNotNull(), F.coalesce(usage["input_tokens"], F.lit(0)) + F.coalesce(usage["output_tokens"], F.lit(0)))
    return messages.groupBy("transcript").agg(F.count("*").alias("messages"), F.coalesce(F.sum(spent), F.lit(0)).cast("long").alias("tokens"))


def turn_sizes(turns: DataFrame, opening: int = 2) -> DataFrame:
    """(role, opening, later): characters of the turns before and from the ``opening``-th on."""
    size, early = F.length("text"), F.col("turn") < opening
    parts = {"opening": F.when(early, size), "later": F.when(~early, size)}
    return turns.groupBy("role").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in parts.items()))


def answer_checks(answer: Column, found: Column, truth: Column) -> Column:
    """Struct (anchored, invented): whether an answer gives a line at a revision, which one that found nothing need not, and how many distinct found names the truth lacks.

    A null answer says nothing; null arrays count as empty.
    """
    found, truth = (F.coalesce(x, F.array().cast("array<string>")) for x in (found, truth))
    return F.struct((F.coalesce(answer, F.lit("")).rlike(EVIDENCE) | (F.size(found) == 0)).alias("anchored"), F.size(F.array_except(found, truth)).alias("invented"))


def truth_keywords(hints: Column, answer: Column) -> Column:
    """The hints, then the first five names in back quotes of an answer: distinct, not empty, at most eight."""
    named = F.slice(F.regexp_extract_all(answer, F.lit("`([^`]+)`"), F.lit(1)), 1, 5)
    return F.slice(F.filter(F.array_distinct(F.concat(hints, named)), lambda x: x != ""), 1, 8)
