"""License detection with ordered signature rules.

One pass over a text finds which of all rules' keywords it holds; a rule runs
if all of its keywords are there.  Detections are resolved by priority: one
that lies inside an interval already taken by an earlier rule is suppressed.
The three base phrases are matched on words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import SIGNATURES
from .textkit import slices, spans, text_bytes

#: The contract's phrases and labels.
BASE = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
_GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_EDGE = rb"[0-9a-z\x80-\xff]"
_PHRASES = [(re.compile(rb"(?<!" + _EDGE[:-1] + rb"])" + _GAP.join(w.encode() for w in words) + rb"(?!" + _EDGE[:-1] + rb"])"), label) for words, label in BASE]

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_WORDS = sorted({w for s in SIGNATURES for w in s.keywords if w})
_NEEDS = [frozenset(_WORDS.index(w) for w in s.keywords if w) for s in SIGNATURES]
#: The rules of each keyword; a rule stands at the longest of its keywords, the one that texts have least.
_RULES: dict[int, list[int]] = {}
for _i, _s in enumerate(SIGNATURES):
    _RULES.setdefault(_WORDS.index(max(_s.keywords, key=len)), []).append(_i)
_finder = None


def _present(lowered: str) -> set[int]:
    """Numbers of the keywords that the text holds, found in one pass."""
    global _finder
    if _finder is None:
        _finder = ahocorasick.Automaton()
        for i, word in enumerate(_WORDS):
            _finder.add_word(word, {i} | {j for j, w in enumerate(_WORDS) if w in word})
        _finder.make_automaton()
    found: set[int] = set()
    for _, some in _finder.iter(lowered):
        found |= some
    return found


class Intervals:
    """Intervals none of which lies inside another, so that their ends are in the order of their starts."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def covers(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return at > 0 and self.ends[at - 1] >= end

    def add(self, start: int, end: int) -> None:
        """Take an interval that is not covered; those inside it go."""
        a, b = bisect_left(self.starts, start), bisect_right(self.ends, end)
        self.starts[a:b], self.ends[a:b] = [start], [end]


def detect(lowered: str) -> list[tuple[int, int, int]]:
    """(start, end, rule) of the detections that stay, in order of priority.

    A rule runs if all of its keywords occur.  Within a rule, matches are
    leftmost and do not overlap; a match inside an interval that stays is
    suppressed.
    """
    have = _present(lowered)
    kept: list[tuple[int, int, int]] = []
    taken = Intervals()
    for i in sorted(i for word in have for i in _RULES.get(word, ()) if _NEEDS[i] <= have):
        for m in SIGNATURES[i].pattern.finditer(lowered):
            if not taken.covers(*m.span()):
                taken.add(*m.span())
                kept.append((*m.span(), i))
    return kept


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row, from ``doc_id`` and ``text`` alone; null text is empty.

    ``labels`` joins the base labels and the labels of the detections that
    stay; ``score`` is 1 - product(1 - weight) over the distinct labels, a
    base label weighing at least 0.6.  Repeated rows repeat; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, offsets = text_bytes(part.column("text"))
                low = LOWER[raw]
                starts, _ = spans(WORD[low], offsets)
                counts = np.diff(np.searchsorted(starts, offsets))
                data = low.tobytes()
                out: list[list] = [[] for _ in range(6)]
                for r in range(part.num_rows):
                    row = _row(data[offsets[r] : offsets[r + 1]])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _row(low: bytes) -> tuple:
    places, weights = [], {}
    if b"license" in low:
        for pattern, label in _PHRASES:
            found = [m.start() for m in pattern.finditer(low)]
            places += found
            if found:
                weights[label] = 0.6
    base = sorted(weights)
    first = last = None
    if places:
        starts, _ = spans(WORD[np.frombuffer(low, np.uint8)], np.array([0, len(low)]))
        first, last = (int(np.searchsorted(starts, f(places))) for f in (min, max))
    for _, _, i in detect(low.decode()):
        s = SIGNATURES[i]
        weights[s.label] = max(weights.get(s.label, 0.0), s.weight)
    miss = 1.0
    for w in sorted(weights.values()):
        miss *= 1.0 - w
    return len(places), first, last, ",".join(base), ",".join(sorted(weights)), 1.0 - miss
