"""Exact removal of repeated word windows, found through difference-cover anchors.

Word positions modulo 7 in {0, 1, 3} form a difference cover: for any two
positions some shift of at most 6 brings both into it.  Two equal windows of
13 words therefore share an anchor of 7 words that stands at a cover position
in both, so only 3 of 7 positions are hashed and dealt out.  Only windows
around an anchor that occurs in two texts are compared.

Texts are kept in compressed *units* of about ``UNIT_BYTES``.  A unit tells
each key once, however often its texts hold it, so a passage that a third of
all documents share costs one row a unit.  The keys of units are dealt into
groups by their value; the number of groups follows the bytes of the input, so
a group stays small at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import Stash
from .textkit import Words, slices

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
UNIT_BYTES = 2 << 20
GROUP_BYTES = 16 << 20  # bytes of text whose keys make one group


def _units(docs: DataFrame, limit: int) -> DataFrame:
    """(unit, size, body): consecutive rows of ``docs``, compressed together; a text is never divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=limit):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([part.column("text").nbytes], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["unit", "size", "body"])
                unit += 1

    return docs.mapInArrow(run, "unit long, size long, body binary")


class _Unit:
    """The words of a unit, and the cover anchors and windows of its rows that have an id and at least a window."""

    def __init__(self, body: bytes):
        self.batch = pa.ipc.open_stream(body).read_next_batch()
        self.words = Words(self.batch.column("text"))
        self.ids = self.batch.column("doc_id").fill_null(0).to_numpy()
        self.known = np.asarray(self.batch.column("doc_id").is_valid()) & (self.words.counts >= WINDOW)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, key) of the cover positions."""
        words = self.words
        at, hashed = words.grams(ANCHOR)
        row = np.searchsorted(words.first, at, side="right") - 1
        take = np.isin((at - words.first[row]) % PERIOD, COVER) & self.known[row]
        return row[take], at[take], hashed[take]

    def windows(self, wanted: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
        """(word, owner, one, two) of the windows around an anchor of two texts of this unit or among ``wanted``."""
        words = self.words
        row, place, key = self.anchors()
        owner = self.ids[row]
        order = np.lexsort((owner, key))
        k, o = key[order], owner[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        last = np.append(np.flatnonzero(new)[1:], len(k)) - 1
        several = o[new] != o[last] if len(k) else np.zeros(0, bool)
        hit = np.zeros(len(key), bool)
        hit[order] = several[group]
        hit |= np.isin(_tag(key, groups), wanted)
        marks = np.zeros(len(words.starts) + WINDOW, np.int64)
        marks[place[hit]] = 1
        sums = np.concatenate(([0], np.cumsum(marks)))
        at, one = words.grams(WINDOW)
        _, two = words.grams(WINDOW, second=True)
        row = np.searchsorted(words.first, at, side="right") - 1
        near = (sums[at + PERIOD] > sums[at]) & self.known[row]
        return at[near], self.ids[row[near]], one[near], two[near]


def _tag(key: np.ndarray, groups: int) -> np.ndarray:
    """The group of a key and 32 bits of it: within a group few keys agree by chance, at any number of groups."""
    return (_group(key, groups) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def _group(key: np.ndarray, groups: int) -> np.ndarray:
    return (key >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)


def _firsts(owner: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key and owner, whether a place of it begins a new key, number of its key)."""
    order = np.lexsort((owner, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    return order, new, np.cumsum(new) - 1


def _told(found: tuple[np.ndarray, ...], groups: int) -> tuple[np.ndarray, ...]:
    """(order, new, number, sent): the unit's distinct windows, ``sent`` being those numbers in the order in which they go out, by group and owner."""
    _, owner, one, two = found
    order, new, number = _firsts(owner, one, two)
    least = order[new]
    return order, new, number, np.lexsort((owner[least], _group(one[least], groups)))


def _split(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, places) of the runs of a sorted array."""
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(group)])), strict=True):
        if b > a:
            yield int(group[a]), slice(a, b)


def _anchor_rows(units: DataFrame, groups: int) -> DataFrame:
    """(grp, unit, keys): each distinct anchor of a unit once, as 32 bits beside its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, body in zip(batch.column("unit").to_pylist(), batch.column("body"), strict=True):
                tags = np.unique(_tag(_Unit(body.as_py()).anchors()[2], groups))
                rows = [(g, tags[part].astype(np.uint32).tobytes()) for g, part in _split(tags >> np.uint64(32))]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int64()), pa.array([unit] * len(rows), pa.int64()), pa.array([k for _, k in rows], pa.binary())], ["grp", "unit", "keys"])

    return units.select("unit", "body").mapInArrow(run, "grp long, unit long, keys binary")


def _shared(rows: DataFrame) -> DataFrame:
    """(unit, grp, keys): of each group, the keys that several units hold, told to each of them."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(blobs), np.uint32)
        source = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        twin = np.zeros(len(keys), bool)
        equal = sorted_[1:] == sorted_[:-1]
        twin[order[1:][equal]] = True
        twin[order[:-1][equal]] = True
        keys, source = keys[twin], source[twin]
        units = table.column("unit").to_numpy()
        out = [(int(units[s]), keys[part].tobytes()) for s, part in _split(source)]
        grp = table.column("grp")[0].as_py()
        return pa.table({"unit": pa.array([u for u, _ in out], pa.int64()), "grp": pa.array([grp] * len(out), pa.int64()), "keys": pa.array([k for _, k in out], pa.binary())})

    return rows.groupBy("grp").applyInArrow(run, "unit long, grp long, keys binary")


def _wanted(lists: list[dict] | None) -> np.ndarray:
    parts = [np.frombuffer(x["keys"], np.uint32).astype(np.uint64) | np.uint64(x["grp"] << 32) for x in lists or ()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _window_rows(asked: DataFrame, groups: int) -> DataFrame:
    """(grp, unit, owners, ones, twos): each distinct window around a shared anchor with its unit's smallest owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, body, lists in zip(batch.column("unit").to_pylist(), batch.column("body"), batch.column("wanted"), strict=True):
                found = _Unit(body.as_py()).windows(_wanted(lists.as_py()), groups)
                order, new, _, sent = _told(found, groups)
                _, owner, one, two = (x[order[new][sent]] for x in found)
                rows = [(g, *(x[part].tobytes() for x in (owner, one, two))) for g, part in _split(_group(one, groups))]
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([unit] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "unit", "owners", "ones", "twos"])

    return asked.mapInArrow(run, "grp long, unit long, owners binary, ones binary, twos binary")


def _beaten(rows: DataFrame) -> DataFrame:
    """(unit, grp, mask): a bit for each window that the unit sent to the group; set if another unit has it with a smaller owner."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("owners").to_pylist()
        owner = np.frombuffer(b"".join(blobs), np.int64)
        one, two = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("ones", "twos"))
        order, new, number = _firsts(owner, one, two)
        gone = np.zeros(len(owner), bool)
        gone[order] = owner[order] > owner[order[new]][number]
        ends = np.cumsum([len(b) // 8 for b in blobs])
        masks = [np.packbits(gone[e - len(b) // 8 : e]).tobytes() for e, b in zip(ends, blobs, strict=True)]
        return pa.table({"unit": table.column("unit"), "grp": table.column("grp"), "mask": pa.array(masks, pa.binary())})

    return rows.groupBy("grp").applyInArrow(run, "unit long, grp long, mask binary")


def _result(asked: DataFrame, groups: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, lists, masks in zip(batch.column("body"), batch.column("wanted"), batch.column("masks"), strict=True):
                unit = _Unit(body.as_py())
                words, found = unit.words, unit.windows(_wanted(lists.as_py()), groups)
                at, owner, one, _ = found
                order, new, number, sent = _told(found, groups)
                beaten = np.zeros(len(sent), bool)
                bits = {m["grp"]: m["mask"] for m in masks.as_py() or ()}
                for g, part in _split(_group(one[order[new][sent]], groups)):
                    if g in bits:
                        beaten[sent[part]] = np.unpackbits(np.frombuffer(bits[g], np.uint8), count=part.stop - part.start).astype(bool)
                hit = np.zeros(len(at), bool)
                hit[order] = beaten[number] | (owner[order] > owner[order[new]][number])
                edge = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(edge, at[hit], 1)
                np.add.at(edge, at[hit] + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                raw = words.raw.tobytes()
                removed, shas = [], []
                for r in range(len(unit.ids)):
                    span = slice(words.first[r], words.first[r + 1])
                    stay = ~gone[span]
                    left = b" ".join([raw[s:e] for s, e in zip(words.starts[span][stay].tolist(), words.ends[span][stay].tolist(), strict=True)])
                    removed.append(len(stay) - int(stay.sum()))
                    shas.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([unit.batch.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return asked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, unit_bytes: int = UNIT_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row per input row.

    A word goes if a window of 13 words that covers it also starts in a
    document with a smaller id.  Null text has no words; a row with a null id
    neither loses words nor makes others lose any; rows with one id do not
    affect each other; an empty table gives no rows; other columns are not
    read.  Anchors only say where to look; windows are compared by two
    independent 64-bit hashes.  The sizes change the work's grain alone.
    """
    stash = Stash(docs.sparkSession, "substrings")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    units = stash.keep(_units(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), unit_bytes), "units")
    groups = max(1, -(-(units.agg(F.sum("size")).first()[0] or 0) // group_bytes))
    shared = _shared(_anchor_rows(units, groups)).groupBy("unit").agg(F.collect_list(F.struct("grp", "keys")).alias("wanted"))
    asked = stash.keep(units.select("unit", "body").join(shared, "unit", "left"), "asked")
    stash.drop(units)
    masks = _beaten(_window_rows(asked, groups)).groupBy("unit").agg(F.collect_list(F.struct("grp", "mask")).alias("masks"))
    return _result(asked.join(stash.keep(masks, "masks"), "unit", "left"), groups)
