"""Secret scans that link the parts of a credential, in DataFrame operations only.

Strong parts are reported wherever they stand.  Weak parts (account names,
random-looking tokens, endpoints) are reported only where the parts that
complete them stand within ``SCOPE`` code points of the same text, counted
between the nearer ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stash import Stash

SCOPE = 300

#: The contract's patterns, then the weak ones, in the order of their kinds.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
IDENT = r"""(?i)(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
KINDS = ["assign", "access", "hex", "ident", "key", "endpoint"]
STRONG = 3
LEAST = (6, 20, 24, 0, 20, 0)  # least characters of a match (of an assigned value)
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _gaps(text: Column, pattern: str, group: int = 0) -> Column:
    """(gap, size, value) of all matches: the lengths of the text before each since the last, of the match and of its group."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    return F.zip_with(F.arrays_zip(hits.alias("hit"), values.alias("value")), F.slice(gaps, 1, F.size(hits)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m["hit"]).alias("size"), F.length(m["value"]).alias("value")))


def _found(rows: Column, kind: int, least: int) -> Column:
    """Spans of the matches in the plain column ``rows`` whose value has ``least`` characters.

    Places are running sums, taken in blocks of about the square root of the
    matches, since a growing array is copied for each element added.
    """
    n = F.size(rows)
    width = F.greatest(F.lit(16), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    none = F.expr(f"cast(array() as {SPAN})")

    def block(b: Column) -> Column:
        return F.transform(F.sequence(b * width, F.least(n, (b + 1) * width) - 1), lambda k: F.get(rows, k))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + m["size"]).alias("end"))
        return F.struct((begin + m["size"]).alias("at"), F.when(m["value"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def join(acc: Column, b: Column) -> Column:
        inner = F.aggregate(block(b), F.struct(acc["at"].alias("at"), none.alias("spans")), step, lambda x: x["spans"])
        moved = F.aggregate(block(b), acc["at"], lambda at, m: at + m["gap"] + m["size"])
        return F.struct(moved.alias("at"), F.concat(acc["blocks"], F.array(inner)).alias("blocks"))

    begin = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("blocks"))
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))
    return F.when(n > 0, F.aggregate(blocks, begin, join, lambda acc: F.flatten(acc["blocks"]))).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _parts(docs: DataFrame) -> DataFrame:
    """id columns of ``docs`` with ``base`` and ``weak`` span arrays; a pattern runs only where its fixed letters occur."""
    text = F.col("text")
    low = F.lower(text)
    none = F.expr("cast(array() as array<struct<gap:int,size:int,value:int>>)")
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey")
    account = low.contains("user") | low.contains("login") | low.contains("account") | low.contains("client")
    gates = [named, text.contains("AKIA"), text.rlike("[0-9a-f]{24}"), account, text.rlike("[A-Za-z0-9+/_-]{20}") & text.rlike("[0-9]"), text.contains("://")]
    patterns = [(ASSIGN, 2), (ACCESS, 0), (HEX, 0), (IDENT, 0), (KEY, 0), (ENDPOINT, 0)]
    rest = [c for c in docs.columns if c != "text"]
    gaps = docs.select(*rest, *(F.when(gate, _gaps(text, *pattern)).otherwise(none).alias(f"gaps{k}") for k, (gate, pattern) in enumerate(zip(gates, patterns, strict=True), 1)))
    spans = [_found(F.col(f"gaps{k}"), k, least) for k, least in enumerate(LEAST, 1)]
    return gaps.select(*rest, F.array_sort(F.concat(*spans[:STRONG])).alias("base"), F.array_sort(F.concat(*spans[STRONG:])).alias("weak"))


def _linked(parts: DataFrame, key: str, scope: int) -> DataFrame:
    """(key, more): the weak spans that touch no base span and whose complements stand within ``scope``.

    An interval join on scope-sized buckets: a span is in every bucket that it
    touches, and a bucket's complements are reduced to their first start and
    last end, which decide whether any lies within reach of a part in that
    bucket or a neighbouring one, so no pairs are made.  Of the base spans of
    a bucket, only the last to start before a weak span's end can matter to
    it; base spans of one kind never overlap, so it meets at most one a kind.
    """
    rows = parts.filter(F.size("weak") > 0).select(key, F.explode(F.concat("base", "weak")).alias("p")).select(key, "p.*")
    rows = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    order = Window.partitionBy(key, "bucket").orderBy("event", F.col("kind"))
    # a base span is an event at its start, a weak one at its end: the latest ends of the base spans before it are known then
    events = rows.withColumn("event", F.when(F.col("kind") <= STRONG, F.col("start") * 2 + 1).otherwise(F.col("end") * 2))
    touched = events.withColumn("reach", F.max(F.when(F.col("kind") <= STRONG, F.col("end"))).over(order)).filter((F.col("kind") > STRONG) & (F.col("reach") > F.col("start"))).select(key, "start", "kind", "end").distinct()
    rows = rows.join(touched, [key, "start", "kind", "end"], "left_anti")
    names, secrets = F.col("kind").isin(2, 4), F.col("kind").isin(1, 3, 5)
    edges = rows.groupBy(key, "bucket").agg(*(f(F.when(c, F.col(end))).alias(f"{n}_{end}") for n, c in (("name", names), ("secret", secrets)) for f, end in ((F.min, "start"), (F.max, "end"))))
    near = edges.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")).withColumn("bucket", F.col("bucket") + F.col("step")).drop("step")
    weak = rows.filter(F.col("kind") > STRONG).join(near, [key, "bucket"])
    reach = {n: F.coalesce(F.max((F.col(f"{n}_end") >= F.col("start") - scope) & (F.col(f"{n}_start") <= F.col("end") + scope)), F.lit(False)).alias(n) for n in ("name", "secret")}
    judged = weak.groupBy(key, "start", "kind", "end").agg(*reach.values())
    whole = F.when(F.col("kind") == 4, F.col("secret")).when(F.col("kind") == 5, F.col("name")).otherwise(F.col("name") & F.col("secret"))
    return judged.filter(whole).groupBy(key).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per input row: counts and spans of ``doc_id`` and ``text``; null text is empty.

    Positions count code points.  Repeated rows repeat; other columns are not
    read.  Only span lists leave the scan; they are written to the shared
    folder with a row number, so text is read once and never shuffled.
    """
    stash = Stash(docs.sparkSession, "secrets")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = stash.keep(_parts(plain).withColumn("row", F.monotonically_increasing_id()), "parts")
    told = parts.join(_linked(parts, "row", scope), "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {SPAN})"))))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k - 1]}") for k in (1, 2, 3)]
    return told.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"))


MASK = "[REDACTED]"


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``MASK``; rows, columns of any name and other values stay.

    Overlapping spans give one mask; null text and null ids stay; repeated
    rows are masked alike; an empty table stays empty.  Spans are brought back
    to their texts by two hashes of id and text, and only for texts that have
    any; the span lists are written first, so Spark knows their size.
    """
    stash = Stash(docs.sparkSession, "redact")
    mark = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    other = F.xxhash64(F.reverse("text"), F.length("text"))
    keyed = docs.select(mark.alias("mark"), other.alias("other"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # written before the filter, which would otherwise be pushed below the spans and repeat every pattern for every match
    parts = stash.keep(_parts(keyed), "all").filter((F.size("base") > 0) | (F.size("weak") > 0))
    parts = stash.keep(parts.dropDuplicates(["mark", "other"]).withColumn("row", F.monotonically_increasing_id()), "parts")
    told = parts.join(_linked(parts, "row", scope), "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {SPAN})"))))
    # cuts: where each span begins and how far the spans before it reach, in order
    spans = told.select("mark", "other", F.posexplode(spans).alias("n", "s")).select("mark", "other", "n", "s.start", "s.end")
    before = Window.partitionBy("mark", "other").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cuts = spans.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0))).groupBy("mark", "other").agg(F.array_sort(F.collect_list(F.struct("n", "at", "start", "end"))).alias("cuts"), F.max("end").alias("last"))
    cuts = stash.keep(cuts, "cuts")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), mark.alias("mark"), other.alias("other"), F.col("text").cast("string").alias("text"))
    both = row.join(cuts, ["mark", "other"], "left")
    # four bytes a code point, so that a piece is found without counting through the text
    both = both.select("row", "cuts", "last", F.when(F.col("cuts").isNotNull(), F.encode("text", "UTF-32")).alias("wide"))

    def piece(begin: Column, size: Column) -> Column:
        return F.decode(F.substring("wide", begin * 4 + 1, size * 4), "UTF-32")

    kept = F.transform(F.filter("cuts", lambda c: c["start"] >= c["at"]), lambda c: piece(c["at"], c["start"] - c["at"]))
    masked = F.array_join(F.concat(kept, F.array(piece(F.col("last"), F.octet_length("wide")))), MASK)
    return both.select(*(F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(masked).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
