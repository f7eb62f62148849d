"""URL filtering with a bit-parallel wildcard automaton.

Every rule is a glob over the canonical form ``.host<END>path``.  All rules
are packed into one multiword Shift-And machine: a bit per symbol, a mask per
input byte for the symbols it may match, and a mask per byte for the symbols
that may stay (a following ``*``).  A step of the machine is a shift with
carry, an AND and an OR over the words, done for all URLs of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 0xFF  # stands between host and path, where no UTF-8 text has it; a host wildcard never crosses it


@dataclass(frozen=True)
class Rule:
    """``host`` fits itself and its subdomains; a null ``name`` marks a method rule."""

    host: str
    path: str
    verdict: str
    name: str | None = None


#: The contract's rules.
BASE_RULES = [Rule("net", "/", "block", "net/"), Rule("example.net", "/en/", "allow", "example.net/en/"), Rule("example.com", "/de/", "block", "example.com/de/"), Rule("org", "/fr/", "allow", "org/fr/")]

#: Host labels, path segments and file types of pages that are no text worth keeping.
HOST_WORDS = "ads adserver adserv adnet adclick adtrack banner banners doubleclick popunder popup spam casino poker bingo roulette betting sportsbet slots jackpot porn xxx sex adult escort camgirls webcams dating viagra cialis pharma replica warez torrent crack keygen serials track?ng tracker telemetry pixel beacon affiliate".split()
PATH_WORDS = "ads adserver banner banners popup sponsored affiliate tracking track pixel beacon login logout signin signup register password cart checkout basket wishlist account wp-admin wp-login cgi-bin print share redirect unsubscribe captcha".split()
FILE_TYPES = "exe msi dmg apk iso zip rar gz 7z tar jar jpg jpeg png gif ico svg mp3 mp4 avi mov wmv css js woff ttf swf".split()
#: How a host word stands in a host (whole label, start of a label, before a number), and a path word in a path.
HOST_FORMS, PATH_FORMS, TYPE_FORMS = ("*.{}.*", "*.{}-*", *(f"*.{{}}{digit}*" for digit in range(10))), ("*/{}", "*/{}/*", "*/{}.*", "*/{}-*"), ("*.{}", "*.{}/*")


def method_globs() -> list[tuple[str, str]]:
    """(host glob, path glob) for URLs that no rule fits; any match blocks.  A longer list can be given to ``judge``."""
    hosts = [(form.format(word), "*") for word in HOST_WORDS for form in HOST_FORMS]
    paths = [("*", form.format(word)) for words, forms in ((PATH_WORDS, PATH_FORMS), (FILE_TYPES, TYPE_FORMS)) for word in words for form in forms]
    return hosts + paths


METHOD_GLOBS = method_globs()


class Automaton:
    """Globs ``(host glob, path glob)`` compiled to multiword masks; ``match`` gives a row x glob matrix.

    ``*`` stands for any characters, ``?`` for one character; neither crosses
    from host to path.
    """

    def __init__(self, globs: list[tuple[str, str]]):
        symbols: list[tuple[str, object]] = []
        self.last: list[int] = []
        for host, path in globs:
            symbols.append(("start", None))
            for part, is_host in ((host.encode(), True), (bytes((END,)), False), (path.encode(), False)):
                for c in part:
                    if c == ord("*"):
                        symbols[-1] = (symbols[-1][0], "host" if is_host else "path")
                    else:
                        symbols.append(("any", "rest") if c == ord("?") else (c, None))
            self.last.append(len(symbols) - 1)
        self.words = -(-len(symbols) // 64)
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        everything = np.arange(256)
        in_host = everything != END
        inner = (everything >= 0x80) & (everything < 0xC0)  # bytes that go on with a character
        stays = {"host": in_host, "path": everything >= 0, "rest": inner}
        for i, (symbol, loop) in enumerate(symbols):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if symbol == "start":
                self.begin[word] |= bit
            else:
                fits = in_host & ~inner if symbol == "any" else everything == symbol
                self.step[fits, word] |= bit
            if loop:
                self.stay[stays[loop], word] |= bit
        self.settled = np.zeros(self.words, np.uint64)
        for i in self.last:
            if symbols[i][1] == "path":
                self.settled[i // 64] |= np.uint64(1 << (i % 64))

    def match(self, texts: list[bytes]) -> np.ndarray:
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        state = np.repeat(self.begin[None, :], len(texts), axis=0)
        live = np.arange(len(texts))
        at, width, block = 0, 256, None
        while len(live):
            live = live[lengths[live] > at]  # rows are in order of length, so this is a prefix of what lives
            if at % 16 == 0:  # a row whose bits can only stay needs no more input
                live = live[(state[live] & ~self.settled).any(axis=1)]
            if not len(live):
                break
            if at % width == 0:
                block = np.zeros((len(texts), width), np.uint8)
                for row in live:
                    part = texts[order[row]][at : at + width]
                    block[row, : len(part)] = np.frombuffer(part, np.uint8)
            c = block[live, at % width]
            now = state[live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[live] = (moved & self.step[c]) | (now & self.stay[c])
            at += 1
        out = np.zeros((len(texts), len(self.last)), bool)
        for g, i in enumerate(self.last):
            out[order, g] = (state[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path), both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:stop], rest[stop:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:cut]


SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def _literal(text: str) -> str:
    if any(c in "*?" for c in text):
        raise ValueError("wildcards belong in METHOD_GLOBS, not in a rule's literal host or path")
    return text


def judge(pages: DataFrame, rules: list[Rule] | None = None, globs: list[tuple[str, str]] | None = None) -> DataFrame:
    """One verdict per input row, from ``page_id`` and ``url`` alone.

    The longest fitting rule decides (of equally long ones the first); where
    none fits, any matching glob blocks, and so does an empty host; everything
    else is allowed.  A null url has empty host and path, a null id stays
    null; repeated rows repeat, an empty table stays empty; no shuffle.
    """
    rules = BASE_RULES if rules is None else rules
    rules = sorted(rules, key=lambda r: -len(r.host + r.path))
    globs = METHOD_GLOBS if globs is None else globs
    wanted = [("*." + _literal(r.host), _literal(r.path) + "*") for r in rules] + list(globs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(wanted)
        for batch in batches:
            split = [canonical(u) for u in batch.column("url").to_pylist()]
            hits = machine.match([b"." + h.encode() + bytes((END,)) + p.encode() for h, p in split])
            names, verdicts = [], []
            for row, (host, _) in zip(hits, split, strict=True):
                rule = next((r for r, hit in zip(rules, row, strict=False) if hit), None)
                names.append(rule.name if rule else None)
                verdicts.append(rule.verdict if rule else "block" if not host or row[len(rules) :].any() else "allow")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, SCHEMA)


def _fits(globs: list[str], column: str) -> str:
    """SQL that says whether any of the globs fits the column."""
    one = ["".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c) for c in glob) for glob in globs]
    return f"regexp_full_match({column}, '(?s)(?:{'|'.join(one)})')"


ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE
  {" ".join(f"WHEN ends_with('.' || host, '.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(BASE_RULES, key=lambda r: -len(r.host + r.path)))}
  ELSE NULL END AS rule FROM split)
SELECT page_id, host, path, rule, CASE
  {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in BASE_RULES)}
  WHEN host = '' OR {_fits([h for h, p in METHOD_GLOBS if p == '*'], "'.' || host")} OR {_fits([p for h, p in METHOD_GLOBS if h == '*'], 'path')} THEN 'block'
  ELSE 'allow' END AS verdict FROM ruled
"""
