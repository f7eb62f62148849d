"""Best-fit packing of token sequences by bin completion.

Bins are filled per *length*, not per document: the driver sees only the
histogram of piece lengths (at most ``capacity`` numbers whatever the corpus
size), finds patterns with repeat counts, and every piece takes its place from
its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stash import Stash, release
from .textkit import Words, equal_spans, ragged, slices

CAPACITY = 2048
CACHE_WORDS = 2_500_000


class WordTokenizer:
    """Ids of whole texts from cached ids of their ASCII-white-space separated words.

    The vocabulary's pre-tokenizer never joins characters across white space
    and drops it, so a text's ids are its words' ids in order.  The cache is
    keyed by a 64-bit hash of the word and holds ``CACHE_WORDS`` words; the
    bytes are compared too, and a text with a word whose hash belongs to
    another word is tokenized whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)
        self.text, self.text_bounds = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        self.text = np.concatenate((self.text, np.frombuffer(b"".join(words), np.uint8)))
        self.text_bounds = np.concatenate((self.text_bounds, self.text_bounds[-1] + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        slot = np.arange(len(keys)) + len(self.keys)
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(lengths)))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.slot = np.insert(self.keys, at, keys[order]), np.insert(self.slot, at, slot[order])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's ids start, and the end)."""
        words = Words(column)
        which, keys = pd.factorize(words.hash)
        first = np.empty(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = words.raw.tobytes()
            where = first[new]
            spans = zip(words.starts[where].tolist(), words.ends[where].tolist(), strict=True)
            self._learn(keys[new], [raw[s:e] for s, e in spans])
            at = np.searchsorted(self.keys, keys)
        at = self.slot[at][which] if len(keys) else np.zeros(0, np.int64)
        starts = self.bounds[at]
        counts = self.bounds[at + 1] - starts
        before = np.concatenate(([0], np.cumsum(counts)))
        ids, first = self.ids[ragged(starts, counts)], before[words.first]
        sizes = words.ends - words.starts
        other = sizes != self.text_bounds[at + 1] - self.text_bounds[at]
        same = ~other
        other[same] = ~equal_spans(words.raw, words.starts[same], self.text, self.text_bounds[at][same], sizes[same])
        if other.any():
            return self._whole(column, ids, first, np.unique(np.searchsorted(words.first, np.flatnonzero(other), side="right") - 1))
        return ids, first

    def _whole(self, column: pa.Array, ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode``'s result with ``rows`` tokenized without the cache."""
        parts = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        for r in rows.tolist():
            parts[r] = np.array(self.tokenizer.encode(column[r].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer and cache for all tasks of a worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Cut every document's ids, with ``end_id`` after them, into pieces of at most ``capacity``.

    ``local_rank`` counts the pieces of equal length that the same task made
    before; ``part`` is that task's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch):
                found, at = tokenizer.encode(rows.column("text"))
                doc_ids = rows.column("doc_id").to_pylist()
                out: list[tuple] = []
                for r, doc_id in enumerate(doc_ids):
                    ids = np.concatenate((found[at[r] : at[r + 1]], np.array([end_id], np.uint32))).astype("<u4")
                    for k in range(0, len(ids), capacity):
                        cut = ids[k : k + capacity]
                        out.append((part, doc_id, k // capacity, k, len(cut), zlib.crc32(cut.tobytes()), int(seen[len(cut)])))
                        seen[len(cut)] += 1
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


Pattern = tuple[tuple[int, ...], int]  # the lengths in one bin, how many such bins


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and the bound by items that cannot share a bin (over all thresholds)."""
    sizes = np.arange(len(counts))
    volume = int((counts * sizes).sum())
    best = -(-volume // capacity)
    big = np.cumsum(counts[::-1])[::-1]  # items of at least this length
    mass = np.concatenate(([0], np.cumsum(counts * sizes)))
    for k in range(0, capacity // 2 + 1):
        alone = int(big[capacity - k + 1]) if capacity - k + 1 < len(counts) else 0
        half = int(big[capacity // 2 + 1]) - alone if capacity // 2 + 1 < len(counts) else 0
        medium = int(mass[capacity - k + 1] - mass[capacity // 2 + 1])  # over half, up to capacity - k
        small = int(mass[capacity // 2 + 1] - mass[k])
        best = max(best, alone + half + max(0, -(-(small - (half * capacity - medium)) // capacity)))
    return best


def fillings(counts: np.ndarray, room: int, limit: int) -> list[tuple[int, ...]]:
    """Ways to fill ``room``, least waste first.

    Built largest length first and maximal.  A filling is dropped if an unused
    length could take the place of one of its items with no more than the
    waste left; exchanges of two items are not tested.  The list ends at
    ``limit`` fillings, after 40 steps for each of them, or soon after the
    first without waste; where it is cut, the best-fit filling is in it.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    lengths = np.flatnonzero(counts[: room + 1])[::-1]
    left = dict(zip(lengths.tolist(), counts[lengths].tolist(), strict=True))
    lengths = lengths.tolist()
    steps, cut = 0, False
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * limit + 1000))  # a step may be one level deeper

    def grow(at: int, space: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps, cut
        steps += 1
        if steps > 40 * limit or (found and len(found) >= limit):
            cut = True
            return
        fits = False
        for i in range(at, len(lengths)):
            x = lengths[i]
            if x <= space and left[x]:
                fits = True
                left[x] -= 1
                grow(i, space - x, (*chosen, x))
                left[x] += 1
                if steps > 40 * limit or len(found) >= limit or (found and found[-1][0] == 0 and i > at):
                    cut = True
                    return
        if not fits and not any(left[y] for y in lengths[:at] if y <= space):
            if not any(y > x and left.get(y) for x in set(chosen) for y in range(x + 1, x + space + 1)):
                found.append((space, chosen))

    grow(0, room, ())
    if cut:
        space, chosen = room, ()
        for x in lengths:
            k = min(left[x], space // x)
            space, chosen = space - k * x, chosen + (x,) * k
        if (space, chosen) not in found:
            found.append((space, chosen))
    found.sort(key=lambda f: (f[0], len(f[1])))
    return [f for _, f in found]


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Longest item first; each bin then takes the longest item that fits until none does."""
    counts = counts.copy()
    out: list[Pattern] = []
    while (have := np.flatnonzero(counts)).size:
        bin_, room = [], capacity
        use: dict[int, int] = {}
        free = counts.copy()
        while True:
            fit = np.flatnonzero(free[: room + 1])
            if not fit.size:
                break
            x = int(fit[-1])
            k = min(int(free[x]), room // x)
            bin_ += [x] * k
            use[x] = use.get(x, 0) + k
            free[x] -= k
            room -= x * k
        times = min(int(counts[x]) // k for x, k in use.items())
        for x, k in use.items():
            counts[x] -= k * times
        out.append((tuple(bin_), times))
        assert have.size
    return out


def solve(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = 4000, width: int = 24) -> tuple[list[Pattern], int]:
    """(patterns that use every item, lower bound on the number of bins).

    Branch and bound: take the longest item left, try its fillings
    (``fillings``, at most ``width`` and one), least waste first, each repeated as often as the counts allow;
    leave a branch when its waste exceeds what an improvement may waste, or
    its bins plus the bound of the rest reach the incumbent.  The incumbent
    starts as the best-fit solution; the search ends at the bound or after
    ``nodes`` nodes, and then returns the incumbent, which is always complete.
    """
    counts = np.asarray(counts, np.int64)
    counts = np.concatenate((counts, np.zeros(max(0, capacity + 1 - len(counts)), np.int64)))
    bound = lower_bound(counts, capacity)
    volume = int((counts * np.arange(len(counts))).sum())
    best = best_fit(counts, capacity)
    best_bins = sum(t for _, t in best)
    spent = 0
    # a branch is its parent's counts and the step to take, and its patterns a chain of links: siblings share both
    stack: list[tuple] = [(counts, None, 0, 0, None)]
    while stack and best_bins > bound and spent < nodes:
        rest, chain, bins, waste, step = stack.pop()
        spent += 1
        allowed = (best_bins - 1) * capacity - volume
        if waste > allowed:
            continue
        if step:
            pattern, times = step
            rest = rest.copy()
            for x in pattern:
                rest[x] -= times
            chain = (chain, step)
        have = np.flatnonzero(rest)
        if not have.size:
            if bins < best_bins:
                best, best_bins = [], bins
                while chain:
                    chain, last = chain
                    best.append(last)
                best.reverse()
            continue
        if spent % 64 == 1 and bins + lower_bound(rest, capacity) >= best_bins:
            continue
        longest = int(have[-1])
        rest[longest] -= 1
        found = fillings(rest, capacity - longest, width)
        rest[longest] += 1
        branches = []
        for filling in found:
            pattern = (longest, *filling)
            lost = capacity - sum(pattern)
            if waste + lost > allowed:
                continue
            times = min(int(rest[x]) // pattern.count(x) for x in set(pattern))
            if lost:
                times = max(1, min(times, (allowed - waste) // lost))
            branches.append((rest, chain, bins + times, waste + lost * times, (pattern, times)))
        stack += branches[::-1]
    return best, bound


def _slots(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks per length: ranks first .. first + times of a length stand in bins bin, bin + 1, ... at one offset."""
    rows, first, bin_ = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rows.append((x, first[x], bin_, offset))
            first[x] += times
            offset += x
        bin_ += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "bin": table[:, 2], "offset": table[:, 3]}


RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and offset there; sequences hold at most ``capacity`` ids.

    Null text is an empty document of one id; repeated rows are packed as
    often as they occur; only ``doc_id`` and ``text`` are read; an empty table
    gives no rows.  Pieces that fill a sequence alone take negative sequence
    ids and need no plan; the other ids count from 0.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "packing")
    release(spark)
    cut = stash.keep(pieces(docs, tokenizer_path, capacity), "pieces")
    part = cut.filter(F.col("length") < capacity)
    by_task = part.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        histogram[row["length"]] = row["n"]
    patterns, _ = solve(histogram, capacity)
    release(spark)
    plan = spark.sparkContext.broadcast(_slots(patterns, capacity))  # its size follows the lengths, not the rows
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = part.join(starts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        key = slots["length"].astype(np.float64) * 2.0**40 + slots["first"]  # ranks of one length stay below 2**40
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length.astype(np.float64) * 2.0**40 + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(slots["bin"][at] + rank - slots["first"][at]), pa.array(slots["offset"][at])], [x.split()[0] for x in RESULT.split(", ")])

    whole = cut.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, RESULT).unionByName(whole)
