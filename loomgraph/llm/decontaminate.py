"""Benchmark decontamination on canonical templates, in DataFrame operations only.

A text is read as tokens: white-space separated words without punctuation and
symbols, and a unit that is joined to its number is a token of its own.  Two
views replace values by typed placeholders.  The view of words has them for
numbers and for units after numbers, whatever the letter case.  The view of
names also has them for words that begin with a capital, one for neighbouring
such words, so a name may have another number of words.  A question asked
again with other values has the same template in one of the views, and a copy
in other letter case or punctuation has the same plain form.

Benchmark windows of both views are hash-joined with document windows that
start at every ``stride``-th token.  The stride is such that any stretch long
enough to be reported holds one of those windows whole, so nothing is lost by
skipping the others.  Diagonals that meet are then compared token by token,
and the values in the placeholders must correspond one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stash import Stash

WINDOW = 8
TOKENS = 13  # least tokens of a reported stretch (all of a shorter item)
LITERALS = 4  # least tokens of a window that are not placeholders; with fewer, it matches by its plain form alone

# Units that become a placeholder after a number.
UNITS = "km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|kg|g|mg|lbs?|pounds?|oz|l|ml|liters?|gallons?|hours?|hrs?|h|minutes?|min|seconds?|sec|s|days?|weeks?|months?|years?|dollars?|usd|eur|euros?|cents?|percent|degrees?|mph|kph|kw|w|v|a|hz|khz|mhz|ghz|kb|mb|gb|tb"
NAME, NUMBER, UNIT = "<a>", "<n>", "<u>"
#: Ranges of punctuation and symbols (ASCII, Latin-1, general, CJK).
MARKS = r"!-/:-@\[-`{-~\u00A1-\u00A9\u00AB-\u00B1\u00B4\u00B6-\u00B8\u00BB\u00BF\u00D7\u00F7\u2010-\u205E\u3000-\u303F"


def _bare(text: Column) -> Column:
    """The text without punctuation and symbols, which may join the parts of a word but never two words; all white space is blanks."""
    return F.regexp_replace(F.regexp_replace(text, f"[{MARKS}]+", ""), r"[\x09-\x0D]", " ")


def _split(bare: Column) -> Column:
    """Its words; an empty array for a text without any."""
    return F.array_remove(F.split(bare, " ", -1), "")


def _forms(rows: DataFrame) -> DataFrame:
    """``rows`` with the column ``bare`` replaced by ``forms``: for each view its templates ``t`` and plain forms ``p``, aligned.

    ``^`` marks a word that begins with a capital and ``_`` joins names; a bare text holds neither.
    """
    rest = [c for c in rows.columns if c != "bare"]
    marked = F.lower(F.regexp_replace("bare", r"\p{Lu}(?<![^ ].)[^ ]*", "^$0"))
    rows = rows.select(*rest, marked.alias("marked"))
    numbers = F.col("marked").rlike(r"\p{Nd}")  # most texts without any are spared three passes
    apart = F.regexp_replace("marked", rf"(\p{{Nd}}) *\^?(?=(?:{UNITS})(?: |$))", "$1 ")
    rows = rows.select(*rest, numbers.alias("numbers"), F.when(numbers, apart).otherwise(F.col("marked")).alias("plain"))
    typed = F.regexp_replace(F.regexp_replace("plain", r"\p{Nd}+", NUMBER), f"{NUMBER} +(?:{UNITS})(?= |$)", f"{NUMBER} {UNIT}")
    typed = F.when(F.col("numbers"), typed).otherwise(F.col("plain"))
    rows = rows.select(*rest, "plain", typed.alias("typed"))
    bare, joined = (lambda c: F.replace(c, F.lit("^"), F.lit(""))), (lambda c: F.regexp_replace(c, r"(\^[^ ]*) +(?=\^)", "$1_"))
    views = [(bare(F.col("typed")), bare(F.col("plain"))), (F.regexp_replace(joined("typed"), r"\^[^ ]*", NAME), bare(joined("plain")))]
    return rows.select(*rest, F.array(*(F.struct(_split(t).alias("t"), _split(p).alias("p")) for t, p in views)).alias("forms"))


def _is_unit(plain: Column) -> Column:
    return plain.rlike(f"^(?:{UNITS})$")


def _key(view: Column, t: Column, p: Column, at: Column, size: int) -> Column:
    """Hash of a window: of its template, or of its plain form if too few tokens of the template are words.

    Whether a unit follows a number cannot be told of a window's first token
    from the window, so a unit there is always a placeholder.  Tokens are read
    by places: a slice would copy the whole array for each window.
    """
    tokens = [F.when(_is_unit(F.get(p, at)), UNIT).otherwise(F.get(t, at))] + [F.get(t, at + k) for k in range(1, size)]
    words = sum((F.when(x.contains("<"), 0).otherwise(1) for x in tokens), F.lit(0))
    return F.xxhash64(view, F.when(words >= min(LITERALS, size), F.xxhash64(*tokens)).otherwise(F.xxhash64(*(F.get(p, at + k) for k in range(size)))))


def _windows(view: int, t: Column, p: Column, size: int, stride: int) -> Column:
    """(window, place) of each run of ``size`` tokens that starts at a multiple of ``stride``; ``t`` and ``p`` must be plain columns, as each run reads them."""
    last = F.size(p) - size
    runs = F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.struct(_key(F.lit(view), t, p, i, size).alias("window"), i.alias("place")))
    return F.when(last >= 0, runs).otherwise(F.expr("cast(array() as array<struct<window:bigint,place:int>>)"))


def _stretches(flags: Column, extra: Column, verbatim: bool) -> Column:
    """The maximal runs of true among ``flags``, as (first place, tokens, verbatim); a run covers ``extra`` tokens more than it has places."""
    none = F.expr("cast(array() as array<struct<first:int,tokens:int,verbatim:boolean>>)")
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), none.alias("found"))

    def closed(acc: Column) -> Column:
        run = F.struct((acc["at"] - acc["run"]).alias("first"), (acc["run"] + extra).alias("tokens"), F.lit(verbatim).alias("verbatim"))
        return F.when(acc["run"] > 0, F.concat(acc["found"], F.array(run))).otherwise(acc["found"])

    def step(acc: Column, flag: Column) -> Column:
        return F.struct((acc["at"] + 1).alias("at"), F.when(flag, acc["run"] + 1).otherwise(F.lit(0)).alias("run"), F.when(flag, acc["found"]).otherwise(closed(acc)).alias("found"))

    return F.aggregate(flags, begin, step, closed)


def _pairs(at: Column, asked: Column, given: Column) -> Column:
    """(at, asked, given) of a slot's values: word by word for names of equally many words, else a shared first word and the rest."""
    a, g = F.split(asked, "_"), F.split(given, "_")
    pair = lambda x, y: F.struct(at.alias("at"), x.alias("asked"), y.alias("given"))
    rest = lambda x: F.array_join(F.slice(x, 2, F.size(x)), "_")
    other = F.when((a[0] == g[0]) & (F.size(a) > 1) & (F.size(g) > 1), F.array(pair(a[0], g[0]), pair(rest(a), rest(g)))).otherwise(F.array(pair(asked, given)))
    return F.when(F.size(a) == F.size(g), F.zip_with(a, g, pair)).otherwise(other)


def _others(slots: Column, same: str, other: str) -> Column:
    """(at, back) per slot: the last place before it that has its ``same`` value with another ``other`` value; -1 for none."""
    rows = F.array_sort(F.transform(slots, lambda s: F.struct(s[same].alias("same"), s["at"].alias("at"), s[other].alias("other"))))
    none = F.expr("cast(array() as array<struct<at:int,back:int>>)")
    begin = F.struct(F.lit(None).cast("string").alias("same"), F.lit(None).cast("string").alias("other"), F.lit(-1).alias("at"), F.lit(-1).alias("back"), none.alias("found"))

    def step(acc: Column, s: Column) -> Column:
        back = F.when(~acc["same"].eqNullSafe(s["same"]), F.lit(-1)).when(acc["other"] != s["other"], acc["at"]).otherwise(acc["back"])
        return F.struct(s["same"].alias("same"), s["other"].alias("other"), s["at"].alias("at"), back.alias("back"), F.concat(acc["found"], F.array(F.struct(s["at"].alias("at"), back.alias("back")))).alias("found"))

    return F.aggregate(rows, begin, step, lambda acc: acc["found"])


def _parts(slots: Column, tokens: Column) -> Column:
    """(first, tokens) of the longest parts of a stretch in which values correspond one to one; a part ends before a value that contradicts it."""
    none = F.expr("cast(array() as array<struct<first:int,tokens:int>>)")
    cuts = F.array_sort(F.filter(F.concat(_others(slots, "asked", "given"), _others(slots, "given", "asked")), lambda c: c["back"] >= 0))

    def part(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("first"), (end - start).alias("tokens")))

    def step(acc: Column, c: Column) -> Column:
        later = c["back"] + 1 > acc["start"]
        return F.struct(F.greatest(c["back"] + 1, acc["start"]).alias("start"), F.when(later, F.concat(acc["found"], part(acc["start"], c["at"]))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(cuts, F.struct(F.lit(0).alias("start"), none.alias("found")), step, lambda acc: F.concat(acc["found"], part(acc["start"], tokens)))


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, least: int = TOKENS) -> DataFrame:
    """(doc_id, item_id, n_tokens, doc_start, reparameterised): the items that leaked into each document.

    On one diagonal of a document and an item, in either view, a window of
    ``size`` tokens (of a shorter item: all) matches if its plain forms agree,
    or if its templates agree and it has ``LITERALS`` tokens without
    placeholders (all of a window with fewer tokens; a unit at its start is
    none).  A stretch is a run of
    matching windows without a gap.  It is cut where the values in its
    placeholders no longer correspond one to one; values of several words
    correspond as ``_pairs`` says.  A part counts if it has
    ``least`` tokens (all of a shorter item); a run of that many tokens with
    equal plain forms counts whatever stands around it.

    ``n_tokens`` and ``doc_start`` tell the longest such part of a document
    and an item and its first token, in tokens of the view of words; of
    equally long ones the first counts, and ``reparameterised`` says whether
    it has changed values.  Changed names are told by their capitals, so a
    text in one letter case throughout may change numbers and units only.
    Null texts and ids match nothing; rows with one id are one document, and
    an item_id with several texts is found by any of them; an empty table on
    either side gives no rows; texts without tokens match nothing; other
    columns are not read.  Benchmark windows are joined as Spark finds
    cheapest for their size; the documents that meet an item are read again.
    """
    stash = Stash(docs.sparkSession, "leaks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    docs = _forms(texts.select("doc_id", _bare(F.col("text")).alias("bare")))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _bare(F.col("text").cast("string")).alias("bare")).dropna().distinct()
    items = _forms(items.select("item_id", F.xxhash64("bare").alias("variant"), "bare"))
    items = items.select("item_id", "variant", F.posexplode("forms").alias("view", "form")).select("item_id", "variant", "view", "form.*").filter(F.size("p") > 0)
    items = stash.keep(items, "items")
    asked = items.select("item_id", "variant", "view", "t", "p", F.size("p").alias("length"), F.least(F.lit(size), F.size("p")).alias("n"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("n"))).alias("at"))
    window = F.coalesce(*(F.when(F.col("n") == n, _key(F.col("view"), F.col("t"), F.col("p"), F.col("at"), n)) for n in range(1, size + 1)))
    asked = stash.keep(asked.select("item_id", "variant", "view", "length", "n", "at", window.alias("window")), "asked")
    lengths = {r["length"] for r in asked.filter(F.col("length") < least).select("length").distinct().collect()}  # fewer than ``least`` numbers
    # (tokens of a window, stride, shortest and longest item): a stretch of stride + tokens - 1 tokens holds a window
    classes = [(size, least - size + 1, least, None)]
    classes += [(n, 1, n, n) for n in sorted(lengths) if n < size]
    if between := [n for n in lengths if n >= size]:
        classes.append((size, min(between) - size + 1, size, least - 1))
    found = None
    for n, stride, shortest, longest in classes:
        some = asked.filter((F.col("length") >= shortest) & (F.col("length") <= longest if longest else F.lit(True)))
        seen = docs.select("doc_id", *(F.col("forms")[v][c].alias(f"{c}{v}") for v in (0, 1) for c in "tp"))
        seen = seen.select("doc_id", F.explode(F.concat(*(_windows(v, F.col(f"t{v}"), F.col(f"p{v}"), n, stride) for v in (0, 1)))).alias("w")).select("doc_id", "w.*")
        hit = seen.join(some, "window").select("doc_id", F.struct("view", "item_id", "variant", "length", F.col("n").alias("n"), (F.col("place") - F.col("at")).cast("int").alias("shift")).alias("diagonal"))
        found = hit if found is None else found.unionByName(hit)
    found = stash.keep(found.groupBy("doc_id").agg(F.collect_set("diagonal").alias("diagonals")), "found")
    # the tokens beside each item, for documents that meet one only
    met = stash.keep(_forms(texts.join(found, "doc_id").select("doc_id", "diagonals", _bare(F.col("text")).alias("bare"))), "met")
    first, extent = (lambda d: F.greatest(d["shift"], F.lit(0))), (lambda d: d["length"] + F.least(d["shift"], F.lit(0)))
    form = lambda d, c: F.get("forms", d["view"])[c]
    before = lambda d: F.aggregate(F.slice(form(d, "p"), 1, first(d)), F.lit(0), lambda acc, p: acc + _words(p))
    beside = F.transform("diagonals", lambda d: F.struct(d.alias("d"), before(d).alias("begin"), *(F.slice(form(d, c), first(d) + 1, extent(d)).alias(f"given_{c}") for c in "tp")))
    met = met.select("doc_id", F.explode(beside).alias("m")).select("doc_id", "m.d.*", "m.begin", "m.given_t", "m.given_p")
    met = met.join(items, ["item_id", "variant", "view"])
    skip = F.greatest(-F.col("shift"), F.lit(0))
    parts = [F.slice(c, skip + 1, F.size("given_p")) for c in "tp"]
    cells = F.zip_with(F.arrays_zip(parts[0].alias("t"), parts[1].alias("p")), F.arrays_zip(F.col("given_t").alias("t"), F.col("given_p").alias("p")), lambda a, g: F.struct((a["t"].eqNullSafe(g["t"])).alias("t"), (a["p"].eqNullSafe(g["p"]) & ((F.col("view") == 0) | a["t"].eqNullSafe(g["t"]))).alias("p"), a["t"].contains("<").alias("slot"), _is_unit(a["p"]).alias("unit"), a["p"].alias("asked"), g["p"].alias("given")))
    met = stash.keep(met.select("doc_id", "item_id", "n", F.least(F.lit(least), F.col("length")).alias("least"), "begin", cells.alias("cells")).filter(F.size("cells") >= F.col("least")), "cells")

    def fits(j: Column) -> Column:
        run = F.transform(F.sequence(j, j + F.col("n") - 1), lambda k: F.get("cells", k))
        literal = F.size(F.filter(run, lambda c, i: ~c["slot"] & ~((i == 0) & c["unit"]))) >= F.least(F.lit(LITERALS), F.col("n"))
        return F.forall(run, lambda c: c["p"]) | (F.forall(run, lambda c: c["t"]) & literal)

    places = F.transform(F.sequence(F.lit(0), F.size("cells") - F.col("n")), fits)
    stretches = F.concat(_stretches(places, F.col("n") - 1, False), _stretches(F.transform("cells", lambda c: c["p"]), F.lit(0), True))
    told = met.select("doc_id", "item_id", "least", "begin", "cells", F.explode(stretches).alias("s")).filter(F.col("s.tokens") >= F.col("least"))
    run = F.filter(F.transform(F.slice("cells", F.col("s.first") + 1, F.col("s.tokens")), lambda c, i: F.struct(i.alias("at"), c.alias("cell"))), lambda c: c["cell"]["slot"] & ~F.col("s.verbatim"))
    told = told.select("doc_id", "item_id", "least", "begin", "cells", "s", F.flatten(F.transform(run, lambda c: _pairs(c["at"], c["cell"]["asked"], c["cell"]["given"]))).alias("slots"))
    told = told.select("*", F.explode(_parts(F.col("slots"), F.col("s.tokens"))).alias("part")).filter(F.col("part.tokens") >= F.col("least"))
    words = lambda start, count: F.aggregate(F.slice("cells", start + 1, count), F.lit(0), lambda acc, c: acc + _words(c["given"]))
    start = F.col("s.first") + F.col("part.first")
    inside = lambda c: (c["at"] >= F.col("part.first")) & (c["at"] < F.col("part.first") + F.col("part.tokens"))
    changed = F.exists("slots", lambda c: inside(c) & (c["asked"] != c["given"]))
    told = told.select("doc_id", "item_id", words(start, F.col("part.tokens")).alias("n_tokens"), (F.col("begin") + words(F.lit(0), start)).alias("doc_start"), changed.alias("changed"))
    best = F.max(F.struct("n_tokens", (-F.col("doc_start")).alias("back"), (~F.col("changed")).alias("same"))).alias("best")
    return told.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.n_tokens").cast("long").alias("n_tokens"), (-F.col("best.back")).cast("long").alias("doc_start"), (~F.col("best.same")).alias("reparameterised"))


def _words(plain: Column) -> Column:
    """Words of a token: more than one where names were joined."""
    return F.length(plain) - F.length(F.replace(plain, F.lit("_"), F.lit(""))) + 1


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark item; all columns stay, whatever their names.

    Rows with a null id or text stay; repeated rows stay or go together; empty
    tables on either side change nothing.  The ids that go are written first,
    so Spark knows their size when it chooses the join.
    """
    bad = Stash(docs.sparkSession, "leaked").keep(matches(docs, benchmark).select(F.col("doc_id").alias("leaked")).distinct(), "ids")
    return docs.join(bad, docs["doc_id"].cast("long") == bad["leaked"], "left_anti")
