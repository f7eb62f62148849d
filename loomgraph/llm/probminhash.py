"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Every distinct shingle of a text starts a process of arrivals whose rate is
its weight; each arrival visits one signature component, and a component
keeps the shingle that came first.  A process stops once its next arrival
would be later than the last first-comer, so long texts cost little more than
one draw per shingle.  Components agree with the probability Jaccard
similarity of the weighted sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, spread_join
from .stash import Stash, release
from .textkit import Words, mix, slices

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5  # a pair at 0.8 meets in some band with probability 0.9996
BLOCK, BLOCK_BYTES = 256, 4 << 20  # texts and characters of one block where a family is compared in full
SIZE = 101  # a prime: steps of any stride visit every component once


def shingles(column: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of every distinct shingle, by row; the weight counts its places.

    A shingle is ``n`` words in a row; a row with fewer words has its whole
    word sequence as one shingle, and a row without words has none.
    """
    words = Words(column)
    at, hashed = words.grams(n)
    row = np.searchsorted(words.first, at, side="right") - 1
    counts = words.counts
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            where, one = words.grams(k)
            take = np.searchsorted(where, words.first[short])
            row = np.concatenate((row, short))
            hashed = np.concatenate((hashed, mix(one[take] + np.uint64(k))))
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    first = np.flatnonzero(new)
    return row[first], hashed[first], np.diff(np.concatenate((first, [len(row)])))


def signatures(rows: int, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The shingle that came first at each component, rows x size; zeros for a row without shingles.

    A shingle visits the components without repetition, in steps of a stride
    drawn from it; the waiting time before the j-th visit is exponential with
    the rate of those not yet visited, which gives the first arrivals the law
    of independent processes.
    """
    best = np.full(rows * size, np.inf)
    owner = np.zeros(rows * size, np.uint64)
    place = (shingle % np.uint64(size)).astype(np.int64)
    stride = (mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(size - 1)).astype(np.int64) + 1
    rate = weight.astype(np.float64)
    time = np.zeros(len(shingle))
    live = np.arange(len(shingle))
    for j in range(size):
        u = (mix(shingle[live] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        time[live] -= np.log1p(-u) / rate[live] * (size / (size - j))
        if j:
            last = best.reshape(rows, size).max(axis=1)
            live = live[time[live] < last[row[live]]]
        if not len(live):
            break
        slot = row[live] * size + (place[live] + j * stride[live]) % size
        np.minimum.at(best, slot, time[live])
        won = best[slot] == time[live]
        owner[slot[won]] = shingle[live[won]]
    return owner.reshape(rows, size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.zeros((len(signature), bands), np.uint64)
    for b in range(bands):
        key[:, b] = np.uint64(b + 1)
        for r in range(rows):
            key[:, b] = mix(key[:, b] * np.uint64(0x9E3779B97F4A7C55) + signature[:, b * rows + r])
    return key.view(np.int64)


def similarity(x_ids: np.ndarray, x: np.ndarray, y_ids: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets given by sorted ids; 1 for two empty ones."""
    if not len(x_ids) and not len(y_ids):
        return 1.0
    common, i, j = np.intersect1d(x_ids, y_ids, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = x.astype(np.float64), y.astype(np.float64)
    only_x, only_y = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    a, b = x[i], y[j]
    ratio, which = np.unique(a / b, return_inverse=True)
    total = np.array([np.maximum(a, r * b).sum() + only_x + r * only_y for r in ratio])  # times 1 / a for each shared shingle
    return float((a / total[which]).sum())


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                row, shingle, weight = shingles(text)
                key = band_keys(signatures(part.num_rows, row, shingle, weight))
                has = np.zeros(part.num_rows, bool)
                has[row] = True
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * BANDS))).astype(np.int32)), pa.array(key[has].ravel()))
                digest = pa.array([hashlib.md5(t.as_py() or b"").digest() for t in text.cast(pa.large_binary())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), digest, bands], ["doc_id", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def _compare(pairs: DataFrame) -> DataFrame:
    """(node, lead, similarity) from rows (node, lead, node_text, lead_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "node_text"):
                sets = []
                leads, which = np.unique(part.column("lead").to_numpy(), return_inverse=True)
                first = np.zeros(len(leads), np.int64)
                first[which[::-1]] = np.arange(part.num_rows)[::-1]
                for column in (part.column("node_text"), part.column("lead_text").take(pa.array(first))):  # a lead's text once
                    row, shingle, weight = shingles(column)
                    bounds = np.searchsorted(row, np.arange(len(column) + 1))
                    sets.append([(shingle[s:e], weight[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)])
                found = [similarity(*sets[0][r], *sets[1][which[r]]) for r in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("lead"), pa.array(found, pa.float64())], ["node", "lead", "similarity"])

    return pairs.select("node", "lead", "node_text", "lead_text").mapInArrow(run, "node long, lead long, similarity double")


def _merge(classes: DataFrame | None, links: DataFrame, stash: Stash) -> DataFrame:
    """(node, component) after new links; only classes that they join are worked on."""
    if classes is None:
        return stash.keep(components(links, stash), "classes")
    name = classes.withColumnRenamed("component", "c")
    ends = links.join(name.withColumnRenamed("node", "u"), "u", "left").withColumn("u", F.coalesce("c", "u")).drop("c")
    ends = stash.keep(ends.join(name.withColumnRenamed("node", "v"), "v", "left").select("u", F.coalesce("c", "v").alias("v")).filter("u <> v").distinct(), "joined")
    if not ends.limit(1).count():
        return classes
    after = components(ends, stash)
    moved = classes.join(after.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    return stash.keep(moved.unionByName(after.join(classes, "node", "left_anti").select("node", "component")), "classes")


def _families(kept: DataFrame, classes: DataFrame, stash: Stash) -> DataFrame:
    """(node, component, family) of the texts in buckets that hold several classes; buckets with a text in common are one family."""
    named = kept.join(classes, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("z"), F.min("node").alias("least")).filter("a < z").select("bucket", "least")
    open_ = stash.keep(spread_join(named, several, "bucket", "node").select("node", "component", "least"), "open")
    joined = components(open_.select(F.col("node").alias("u"), F.col("least").alias("v")), stash)
    return open_.select("node", "component").distinct().join(joined.withColumnRenamed("component", "family"), "node")


def _spans(left: tuple, right: tuple, same: bool, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of a block pair's texts with at least the similarity; only those of different classes are judged.

    A pair must share the threshold's part of the weight of either text, which
    matrix products over slices of the vocabulary find for all pairs at once.
    """
    sides = []
    for nodes, classes, column in (left, right):
        row, shingle, weight = shingles(column)
        sides.append((nodes, classes, row, shingle, weight, np.searchsorted(row, np.arange(len(nodes) + 1))))
    vocabulary = np.intersect1d(sides[0][3], sides[1][3])
    n, m = len(sides[0][0]), len(sides[1][0])
    of_left, of_right = np.zeros((n, m)), np.zeros((n, m))
    for k in range(0, len(vocabulary), 4096):
        words = vocabulary[k : k + 4096]
        tables = []
        for nodes, _, row, shingle, weight, _ in sides:
            at = np.minimum(np.searchsorted(words, shingle), len(words) - 1)
            hit = words[at] == shingle
            table = np.zeros((len(nodes), len(words)), np.float32)
            table[row[hit], at[hit]] = (weight / np.bincount(row, weight, len(nodes))[row])[hit]
            tables.append(table)
        of_left += tables[0] @ (tables[1] > 0).T.astype(np.float32)
        of_right += (tables[0] > 0).astype(np.float32) @ tables[1].T
    close = (of_left >= threshold - 1e-4) & (of_right >= threshold - 1e-4) & (left[1][:, None] != right[1][None, :])
    root = {c: c for c in np.concatenate((left[1], right[1])).tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in zip(*np.nonzero(np.triu(close, 1) if same else close), strict=True):
        a, b = find(int(left[1][i])), find(int(right[1][j]))
        if a == b:
            continue
        x, y = (s[3:5] for s in sides)
        p, q = slice(*sides[0][5][i : i + 2]), slice(*sides[1][5][j : j + 2])
        if similarity(x[0][p], x[1][p], y[0][q], y[1][q]) >= threshold:
            root[max(a, b)] = min(a, b)
            yield int(left[0][i]), int(right[0][j])


def _family_links(families: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links that join the classes of each family, from all its pairs taken in blocks.

    A block has about ``BLOCK`` texts or ``BLOCK_BYTES``; two blocks make one
    group, and a group reports at most one link per class that it joins.
    """

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        first, second = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        found: list[tuple[int, int]] = []
        sides = []
        for block in (first, second):
            part = group.filter(pa.array(side == block)).combine_chunks()
            sides.append((part.column("node").to_numpy(), part.column("component").to_numpy(), part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string())))
        if len(sides[0][0]) and len(sides[1][0]):
            found = list(_spans(*sides, first == second, threshold))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    told = families.join(texts, "node")
    blocks = told.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("text")) / BLOCK_BYTES)).alias("blocks"))
    dealt = spread_join(told, blocks, "family", "node").withColumn("side", F.pmod(F.xxhash64("node"), "blocks"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = paired.select("family", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "component", "text")
    return keyed.groupBy("family", "i", "j").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, copy_of, class_id): one row per input row.

    ``copy_of`` is the smallest id with exactly this text; ``class_id`` the
    smallest id of the class, the classes being the components of all links
    of at least ``threshold`` between texts that share a band.

    A bucket's most central text (the one that meets most others over all
    bands) is compared with the rest.  Since 1 - similarity is a metric, a
    text linked to it can be linked to an unlinked one only if their distances
    to it differ by at most 1 - threshold; texts for which that is impossible
    leave the bucket.  Buckets that still hold several classes are compared in
    full, in blocks of bounded size (``_family_links``), so no link that joins
    two classes is lost.

    Null text is empty text; texts without words only have exact copies; a
    row with a null id keeps null classes; rows with one id are one document.
    Other columns are not read.
    """
    return _classes(docs, threshold).select("doc_id", "copy_of", "class_id")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``near_duplicates`` with the digest (MD5) of each row's text."""
    spark = docs.sparkSession
    stash = Stash(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = stash.keep(_signed(docs), "signatures")
    nodes = stash.keep(signed.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "nodes")
    release(spark)
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = stash.keep(spread_join(placed, shared, "bucket", "node"), "met")
    central = met.groupBy("node").agg(F.sum("n").alias("rank"))
    ranked = stash.keep(met.join(central, "node").select("bucket", "node", "rank"), "ranked")
    leads = ranked.groupBy("bucket").agg(F.min(F.struct(-F.col("rank"), F.col("node").alias("lead"))).alias("best")).select("bucket", F.col("best.lead").alias("lead"))
    live = stash.keep(spread_join(ranked, leads, "bucket", "node").select("bucket", "node", "lead"), "buckets")
    wanted = live.select("node").distinct()
    texts = stash.keep(docs.hint("merge").join(wanted, docs["doc_id"] == wanted["node"]).select("node", "text"), "texts")
    release(spark)
    pairs = live.filter("node <> lead").select("node", "lead").distinct()
    filled = pairs.join(texts.withColumnRenamed("text", "node_text"), "node").join(texts.select(F.col("node").alias("lead"), F.col("text").alias("lead_text")), "lead")
    judged = stash.keep(_compare(filled).groupBy("node", "lead").agg(F.max("similarity").alias("similarity")), "compared")
    links = judged.filter(F.col("similarity") >= threshold).select(F.col("node").alias("u"), F.col("lead").alias("v"))
    classes = stash.keep(components(links, stash), "classes")
    release(spark)
    seen = live.filter("node <> lead").join(judged, ["node", "lead"]).select("bucket", "node", (1 - F.col("similarity")).alias("far"), (F.col("similarity") < threshold).alias("apart"))
    nearest = seen.filter("apart").groupBy("bucket").agg(F.min("far").alias("nearest"))
    stays = F.col("apart") | (F.col("far") >= F.col("nearest") - (1 - threshold) - 1e-9)
    kept = spread_join(seen, nearest, "bucket", "node").filter(stays).select("bucket", "node")
    families = stash.keep(_families(kept, classes, stash), "families")
    release(spark)
    more = stash.keep(_family_links(families, texts, threshold), "links")
    classes = _merge(classes, more, stash)
    release(spark)
    named = nodes.select("digest", "node").join(classes, "node", "left").select("digest", F.col("node").alias("copy_of"), F.coalesce("component", "node").alias("class_id"))
    return spread_join(signed.select("doc_id", "digest"), named, "digest", "doc_id", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("copy_of")).alias("copy_of"), F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "digest")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their text's class, with all columns.

    A row goes by its id and text together: another text under the same id
    stays, if it is the first of its own class.  Repeated rows of a kept id
    and text all stay; rows with a null id are kept, null text counts as
    empty; an empty table gives no rows.
    """
    gone = _classes(docs, threshold).filter("class_id <> doc_id").select(F.col("doc_id").alias("_drop"), F.col("digest").alias("_digest")).distinct()
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    marked = docs.withColumn("_text_digest", digest)
    return marked.join(gone, (marked["doc_id"].cast("long") == gone["_drop"]) & (marked["_text_digest"] == gone["_digest"]), "left_anti").drop("_text_digest")
