"""Ranked search by Fagin's threshold algorithm over shards of a forward index.

Documents are dealt into shards, as they lie in the written forward index.  A
shard holds, for each term of the queries, the list of its documents by falling
impact, and for random access the impacts of each document.  A query reads its
lists round-robin in growing blocks, looks every new document up in full, and
stops when the sum of the lists' last impacts falls strictly below its k-th
best score.  A task carries its best documents from shard to shard, so later
shards stop sooner; what tasks report is at most k rows a query, ranked again
at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .stash import Stash
from .textkit import SpanHash, equal_spans, ragged, slices, spans, text_bytes

BLOCK_BYTES = 256 << 10  # of query texts that are answered in one go
SHARD_CELLS = 12 << 20  # documents times terms of a shard
FIRST = 8  # entries of a list in the first round; each round takes twice as many
CELLS = 64  # parts of one query's reports
FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"

_TERM = np.ones(256, bool)
_TERM[:128] = [chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats: runs of ASCII letters, digits and anything beyond ASCII; A-Z lower-cased."""
    raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends = spans(_TERM[raw], np.array([0, len(raw)]))
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Vocabulary:
    """Finds the number of each term span in a sorted table of hashes; the bytes decide."""

    def __init__(self, terms: list[bytes]):
        self.raw = np.frombuffer(b"".join(terms), np.uint8)
        self.ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in terms], np.int64)
        hashes = SpanHash(self.raw).of(self.starts, self.ends)[0]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise RuntimeError("two query terms share a hash")

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 for others."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.order) or not len(starts):
            return out
        hashes = SpanHash(raw).of(starts, ends)[0]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[hit]]
        sizes = ends[hit] - starts[hit]
        same = self.ends[term] - self.starts[term] == sizes
        hit, term, sizes = hit[same], term[same], sizes[same]
        right = equal_spans(raw, starts[hit], self.raw, self.starts[term], sizes)
        out[hit[right]] = term[right]
        return out


def forward_index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts) per row of ``docs``: the number of all its terms, and which of ``terms`` it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            for part in slices(batch):
                raw, offsets = text_bytes(part.column("text"))
                raw = _LOWER[raw]
                starts, ends = spans(_TERM[raw], offsets)
                first = np.searchsorted(starts, offsets)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                term = vocabulary.find(raw, starts, ends)
                known = term >= 0
                width = len(terms) + 1
                keys, counts = np.unique(row[known] * width + term[known], return_counts=True)
                ends_of = pa.array(np.searchsorted(keys, np.arange(part.num_rows + 1) * width).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends_of, pa.array(v.astype(np.int32))) for v in (keys % width, counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FORWARD)


class Shard:
    """Impact-sorted lists and a table for random access over some documents of the forward index."""

    def __init__(self, part: pa.RecordBatch, n_docs: int, n_terms: int, width: int):
        ids = part.column("doc_id").to_numpy(zero_copy_only=False) if not part.column("doc_id").null_count else np.array([_NO_ID if x is None else x for x in part.column("doc_id").to_pylist()], np.int64)
        self.ids = ids.astype(np.int64)
        lists, n = part.column("terms"), part.column("n").to_numpy()
        row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
        term, tf = lists.flatten().to_numpy().astype(np.int64), part.column("counts").flatten().to_numpy().astype(np.int64)
        m = 10 + (90 * n * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        self.table = np.zeros((part.num_rows, width), np.int32)  # an impact is below a million
        self.table[row, term] = impact
        order = np.lexsort((row, -impact, term))
        self.rows, self.impacts = row[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(width + 1))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids) of the k best of ``held`` and this shard, and how deep the lists were read."""
        scores, ids = held
        starts, ends = self.starts[terms], self.starts[terms + 1]
        seen = np.zeros(len(self.ids), bool)
        depth, step = 0, FIRST
        while True:
            low, high = np.minimum(starts + depth, ends), np.minimum(starts + depth + step, ends)
            at = self.rows[ragged(low, high - low)]
            fresh = np.unique(at[~seen[at]])
            if len(fresh):
                seen[fresh] = True
                found = self.table[np.ix_(fresh, terms)].astype(np.int64) @ weights
                good = found >= (scores[-1] if len(scores) == k else 1)
                scores, names = np.concatenate((scores, found[good])), np.concatenate((ids, self.ids[fresh[good]]))
                first = np.lexsort((names, -scores))[:k]
                scores, ids = scores[first], names[first]
            depth, step = depth + step, step * 2
            unread = high < ends
            if not unread.any():
                break
            threshold = int((self.impacts[high[unread] - 1] * weights[unread]).sum())
            if threshold <= 0 or (len(scores) == k and threshold < scores[-1]):
                break
        return scores, ids, depth


_NO_ID = (1 << 63) - 1  # a document without an id ranks last among equals


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _answer(docs: DataFrame, items: list[tuple], kind: pa.DataType, schema: str, k: int, stash: Stash) -> DataFrame:
    """(item, doc_id, score): each task's best k documents for each of ``items`` (item, terms)."""
    spark = docs.sparkSession
    terms = sorted({t for _, some in items for t in some})
    index = stash.keep(forward_index(docs, terms), "forward")
    held = index.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    n_docs, n_terms = held[0], held[1] or 0
    df = dict.fromkeys(range(len(terms)), 0)
    for row in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # one row per query term
        df[row.t] = row.df
    number = {t: i for i, t in enumerate(terms)}
    asked = []
    for item, some in items:
        rated = [(number[t], w) for t in some if df[number[t]] and (w := _weight(n_docs, df[number[t]])) > 0]
        asked.append((item, np.array([i for i, _ in rated], np.int64), np.array([w for _, w in rated], np.int64)))
    width = max(1, len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(asked)
        for batch in batches:
            rows = max(1, SHARD_CELLS // width)
            for at in range(0, batch.num_rows, rows):
                shard = Shard(batch.slice(at, rows), n_docs, n_terms, width)
                for i, (_, some, weights) in enumerate(asked):
                    if len(some):
                        best[i] = shard.best(some, weights, k, best[i])[:2]
        ids = np.concatenate([none, *(b[1] for b in best)])
        names = pa.array([a[0] for a in asked], kind).take(pa.array(np.repeat(np.arange(len(asked)), [len(b[0]) for b in best])))
        yield pa.RecordBatch.from_arrays([names, pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([none, *(b[0] for b in best)]))], ["item_id", "doc_id", "score"])

    return index.filter("n > 0").mapInArrow(run, schema) if n_docs else spark.createDataFrame([], schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of ``docs`` (doc_id, text) for each item of ``items`` (item_id, text).

    Terms and scores as ``terms_of`` and ``Shard`` say; only scores above 0
    are ranked, equal ones by ascending doc_id, a null id last; repeated rows
    are documents of their own.  Rows of one item id count as one item with
    the terms of all; null and empty texts have no terms; an item without
    results, and empty tables, give no rows.  Other columns are not read.

    Items are answered in blocks of about ``BLOCK_BYTES`` of their texts, each
    with a pass over the documents: what goes to every task is a block's
    terms.  An item's reports (k rows from a task) are cut down in cells of
    their own before they meet.
    """
    stash = Stash(docs.sparkSession, "search")
    asked = items.select(F.col(item).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    kind = asked.schema["item_id"].dataType
    schema = f"item_id {kind.simpleString()}, doc_id long, score long"
    out = None
    for block in range(blocks):
        merged: dict = {}
        for row in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            merged.setdefault(row.item_id, set()).update(terms_of(row.text))
        found = _answer(docs, [(i, sorted(some)) for i, some in merged.items()], to_arrow_type(kind), schema, k, stash) if merged else docs.sparkSession.createDataFrame([], schema)
        out = found if out is None else out.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    cell = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))).orderBy(*order)
    few = out.withColumn("rank", F.row_number().over(cell)).filter(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
whole AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, whole GROUP BY term),
scored AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score FROM q JOIN p USING (term) JOIN v USING (term), whole GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
