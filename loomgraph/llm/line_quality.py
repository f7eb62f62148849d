"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled bad or good from its own surface statistics and those
of the lines beside it, with a learnt transition between neighbours.  The
forward-backward marginals of a document's lines, weighted by line length,
average to its quality.  Line labels are latent in training: a document's
label is a noisy observation of each of its lines, so a bad document may have
good lines and the field learns moves in both directions.  Training is plain
numpy in one task on a bounded sample of labelled documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import held_out
from .textkit import SPACE, Words, slices

#: Most labelled documents that a model is fitted on; all their lines take part.
SAMPLE_DOCS = 2000
#: Log odds with which a line carries its document's label, and longest chain in training (longer documents are several chains there).
EVIDENCE = 2.0
CHAIN = 256

UPPER, LOWERCASE, DIGIT, MARK, PUNCT, WIDE = range(6)
_CLASS = np.full(256, 6, np.uint8)
_CLASS[0x41:0x5B] = UPPER
_CLASS[0x61:0x7B] = LOWERCASE
_CLASS[0x30:0x3A] = DIGIT
_CLASS[[ord(c) for c in "#$%&*|!@^~<>=+/\\_{}[]"]] = MARK
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = PUNCT
_CLASS[0x80:] = WIDE
N_OWN = 16


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, bytes per line, first line of each row and the end).

    A row has a line for each newline and one more; an empty row has one
    empty line.  Own features come first, then those of the line before and
    after (zeros at the ends).
    """
    words = Words(column)
    raw, offsets = words.raw, words.offsets
    breaks = np.flatnonzero(raw == 0x0A)
    rows = len(offsets) - 1
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    first = np.searchsorted(starts, offsets[:-1], side="left")
    # rows that begin where an earlier one ends share a start; keep one line for each
    row_of = np.searchsorted(offsets, breaks, side="right") - 1
    lines_in = np.bincount(row_of, minlength=rows) + 1
    first = np.concatenate(([0], np.cumsum(lines_in)))
    starts = np.empty(first[-1], np.int64)
    starts[first[:-1]] = offsets[:-1]
    rest = np.ones(first[-1], bool)
    rest[first[:-1]] = False
    starts[rest] = breaks + 1
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:]
    ends[first[1:] - 1] = offsets[1:]
    size = (ends - starts).astype(np.float64)
    kind = _CLASS[raw]

    def per_line(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return (sums[ends] - sums[starts]).astype(np.float64)

    blank = SPACE[raw]
    solid = np.maximum(size - per_line(blank), 1)
    first_word = np.searchsorted(words.starts, starts)
    last_word = np.searchsorted(words.starts, ends)
    n = (last_word - first_word).astype(np.float64)

    def per_word(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return (sums[last_word] - sums[first_word]).astype(np.float64)

    total = len(words.starts)
    again = np.zeros(total, bool)
    again[1:] = words.hash[1:] == words.hash[:-1]
    inside = first_word[(first_word > 0) & (first_word < total)]
    again[inside] = False
    line_of = np.repeat(np.arange(len(starts)), last_word - first_word)
    order = np.lexsort((words.hash, line_of))
    twice = np.zeros(total, bool)
    if total:
        twice[order[1:]] = (words.hash[order[1:]] == words.hash[order[:-1]]) & (line_of[order[1:]] == line_of[order[:-1]])
    tail = kind[words.ends - 1] if total else np.zeros(0, np.uint8)
    length = words.ends - words.starts
    some = np.maximum(n, 1)
    own = np.stack(
        [
            np.log1p(size) / 8,
            np.log1p(n) / 6,
            per_line(kind == UPPER) / solid,
            per_line(kind == LOWERCASE) / solid,
            per_line(kind == DIGIT) / solid,
            per_line(kind == MARK) / solid,
            per_line(kind == PUNCT) / solid,
            per_line(kind == WIDE) / solid,
            per_word(again) / some,
            per_word(twice) / some * np.minimum(1, 30 / some),
            per_word(tail == MARK) / some,
            per_word(length == 1) / some,
            np.minimum(per_word(length) / some, 40) / 20,
            per_word(length > 25) / some,
            (n == 0).astype(np.float64),
            np.minimum(per_word(again), 5) / 5,
        ],
        axis=1,
    )
    own = np.concatenate((own, np.sqrt(own[:, [2, 5, 8, 9, 10, 11]])), axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate((own, before, after, np.ones((len(own), 1))), axis=1), size, first


class LineField:
    """Weights of the field: a score per line feature for "good" against "bad", and 2 x 2 transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, mean: np.ndarray, scale: np.ndarray, cut: float = 0.0):
        self.weights, self.moves, self.mean, self.scale, self.cut = weights, moves, mean, scale, cut

    def _marginals(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good) per line, P(pair of labels) per line with a successor, log normaliser per row), all rows at once."""
        counts = np.diff(first)
        rows, longest = len(counts), int(counts.max(initial=0))
        alpha, beta = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
        emit = np.stack((np.zeros(len(scores)), scores), axis=1)
        alpha[first[:-1]] = emit[first[:-1]]
        order = np.argsort(-counts, kind="stable")
        sizes = counts[order]
        for t in range(1, longest):
            live = first[:-1][order[: np.searchsorted(-sizes, -t, side="left")]] + t
            last = alpha[live - 1]
            alpha[live] = np.logaddexp(last[:, :1] + self.moves[0], last[:, 1:] + self.moves[1]) + emit[live]
        for t in range(1, longest):
            live = first[1:][order[: np.searchsorted(-sizes, -t, side="left")]] - 1 - t
            ahead = beta[live + 1] + emit[live + 1]
            beta[live] = np.logaddexp(ahead[:, :1] + self.moves[:, 0], ahead[:, 1:] + self.moves[:, 1])
        z = np.logaddexp(*alpha[first[1:] - 1].T)
        line_z = np.repeat(z, counts)
        good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - line_z, 0))
        inner = np.ones(len(scores), bool)
        inner[first[1:] - 1] = False
        at = np.flatnonzero(inner)
        pair = np.exp(alpha[at][:, :, None] + self.moves[None] + (emit[at + 1] + beta[at + 1])[:, None, :] - line_z[at][:, None, None])
        assert len(z) == rows
        return good, pair, z

    def lines(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._marginals((features - self.mean) / self.scale @ self.weights, first)[0]

    def quality(self, column: pa.Array) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; empty text has one empty line."""
        features, size, first = line_features(column)
        good = self.lines(features, first)
        weight = size + 1
        raw = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        raw = np.clip(raw, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(np.log(raw / (1 - raw)) - self.cut)))


def fit(texts: list[str], labels: list[int], steps: int = 120, decay: float = 1e-4) -> LineField:
    """Maximise the likelihood of the documents' labels given the lines, whose labels are latent, by Adam on the full sample.

    A line shows its document's label with the log odds ``EVIDENCE``; the
    gradient is the difference of the field's expectations with and without
    that evidence.  The cut on the mean marginal is then placed where the two
    kinds of error of the sample balance.  With one class only, every score
    leans to it.
    """
    parts = [line_features(part.column("text")) for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"]))]
    features, size = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
    del parts
    truth = np.asarray(labels, np.float64)
    line_truth = np.repeat(truth, np.diff(first))
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    x = (features - mean) / scale
    share = min(max(truth.mean(), 0.02), 0.98)
    row_weight = np.where(truth == 1, 0.5 / share, 0.5 / (1 - share)) / np.sqrt(np.diff(first))
    weight = np.repeat(row_weight, np.diff(first))
    weight /= weight.sum()
    chains = np.concatenate([np.arange(a, b, CHAIN) for a, b in zip(first[:-1], first[1:], strict=True)] + [first[-1:]])
    inner = np.ones(len(x), bool)
    inner[chains[1:] - 1] = False
    at = np.flatnonzero(inner)
    evidence = EVIDENCE * (2 * line_truth - 1)
    field = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)), mean, scale)
    m = [np.zeros_like(field.weights), np.zeros((2, 2))]
    v = [np.zeros_like(field.weights), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        scores = x @ field.weights
        good, pair, _ = field._marginals(scores, chains)
        told, told_pair, _ = field._marginals(scores + evidence, chains)
        grads = [x.T @ (weight * (told - good)) - decay * field.weights, np.einsum("n,nij->ij", weight[at], told_pair - pair) - 1e-2 * field.moves]
        for k, (value, grad) in enumerate(zip((field.weights, field.moves), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            value += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    good = field.lines(features, first)
    weight = size + 1
    raw = np.clip(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 1e-6, 1 - 1e-6)
    logit = np.log(raw / (1 - raw))
    order = np.argsort(logit, kind="stable")
    lost = np.concatenate(([0], np.cumsum(truth[order]))) / max(truth.sum(), 1)
    passed = 1 - np.concatenate(([0], np.cumsum(1 - truth[order]))) / max((1 - truth).sum(), 1)
    cost = 3 * lost + passed  # losing a good document weighs three times as much as keeping a bad one
    best = int(np.argmin(cost))
    low = logit[order[best - 1]] if best else logit[order[0]] - 1
    high = logit[order[best]] if best < len(order) else logit[order[-1]] + 1
    field.cut = float((low + high) / 2)
    return field


def fitted(docs: DataFrame, labels: DataFrame, label: str, limit: int, fit: Callable):
    """``fit(texts, labels)`` on up to ``limit`` labelled documents outside the held-out third, or None without any.

    The documents are chosen by a hash of their id; ids and labels alone are
    sorted, and the chosen ids (at most ``limit``) are broadcast to fetch the
    texts.  One task fits the model, so texts never reach the driver.  Rows
    with a null id or label are left out; of contradicting labels the smaller
    counts, and of several texts with one id the smallest; a null text is empty.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().filter(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t, q) for b in batches for i, t, q in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True))
        if rows:
            model = fit([t for _, t, _ in rows], [q for _, _, q in rows])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = texts.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Quality of every whole text: one row per input row, null text as empty, without a shuffle.

    Texts alone decide a score, so equal texts get equal scores.  Without
    any labelled row all scores are 0.5.
    """
    model = fitted(docs, labels, "quality", sample, fit)
    return apply_score(docs, model, 0.5)


def apply_score(docs: DataFrame, model, threshold: float, method: str = "quality") -> DataFrame:
    """Score texts with ``model.quality`` (an array per Arrow column) and compare with the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = getattr(model, method)(part.column("text")) if model is not None else np.full(part.num_rows, 0.5)
                found = np.round(found, 9)  # equal texts agree whatever stands beside them
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least the threshold; all columns stay, whatever their names, and nothing is shuffled.

    Null text is empty text; equal rows stay or go together; an empty table
    stays empty, and without any labelled row every row stays.
    """
    model = fitted(docs, labels, "quality", sample, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if model is not None:
                    part = part.filter(pa.array(np.round(model.quality(part.column("text")), 9) >= threshold))
                yield part

    return docs.mapInArrow(run, docs.schema)
