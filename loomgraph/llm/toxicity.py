"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, with marks where it begins and
ends, and of itself; a document is the average over its distinct words,
among which ``EMPTY`` empty ones count, so that one odd word does not decide
about a text of few words.  A linear softmax over the average gives the
document's log odds.  Embeddings and softmax are trained together in numpy.
Misspellings that the sample lacks share most of their n-grams with words that
it has.

Only n-grams that stand in more toxic documents of the sample than chance
explains (a chi-squared test) are embedded; without this the many n-grams of a
few thousand documents learn their labels by heart.  The cut between toxic and
clean is set on documents that the model did not see: each half of the sample
is judged by a model of the other half.

Since softmax and average are linear, a trained model needs one number per
n-gram bucket: the product of its embedding with the softmax direction.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .line_quality import apply_score, fitted
from .textkit import SPACE, mix, powers, prefix_hash, ragged, spans, text_bytes

#: Most labelled documents that a model is fitted on.
SAMPLE_DOCS = 4000
BUCKETS = 1 << 19
DIMENSION = 8
NGRAMS = (3, 4, 5, 6)
EMPTY = 20
CHI_SQUARED, LEAST = 15.0, 3  # what an n-gram must reach, and the toxic documents it must stand in
GAIN = 30.0  # by which averages are multiplied, since few of a document's words are toxic
ALARM = 10  # how many misses a false alarm weighs where the cut is set
THRESHOLD = 0.7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes that end a word: white space and ASCII punctuation.
_BREAK = SPACE.copy()
_BREAK[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


class Bags:
    """Distinct words of each row of a column, and the n-gram buckets of each word."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        raw = _LOWER[raw]
        starts, ends = spans(~_BREAK[raw], offsets)
        prefix = prefix_hash(raw)
        _, down = powers(len(raw) + 1)
        hashed = mix((prefix[ends] - prefix[starts]) * down[starts])
        keys, first, word = np.unique(hashed, return_index=True, return_inverse=True)
        n = max(1, len(keys))
        row = np.repeat(np.arange(len(column)), np.diff(np.searchsorted(starts, offsets)))
        pairs = np.unique(row.astype(np.int64) * n + word)
        self.row, self.word, self.rows, self.words = pairs // n, pairs % n, len(column), len(keys)
        self.size = np.bincount(self.row, minlength=self.rows)  # distinct words of a row
        length = ends[first] - starts[first]
        marked = np.full(int((length + 2).sum()), 0x20, np.uint8)  # every word between two marks
        at = np.cumsum(length + 2) - (length + 2)
        marked[ragged(at + 1, length)] = raw[ragged(starts[first], length)]
        prefix = prefix_hash(marked)
        _, down = powers(len(marked) + 1)
        of, buckets = [np.arange(len(keys))], [self._bucket((prefix[at + length + 2] - prefix[at]) * down[at], 0)]
        for k in NGRAMS:
            count = np.maximum(length + 3 - k, 0)
            places = ragged(at, count)
            of.append(np.repeat(np.arange(len(keys)), count))
            buckets.append(self._bucket((prefix[places + k] - prefix[places]) * down[places], k))
        self.of, self.buckets = np.concatenate(of), np.concatenate(buckets)  # a word and one of its n-grams
        self.grams = np.bincount(self.of, minlength=len(keys))

    @staticmethod
    def _bucket(hashed: np.ndarray, n: int) -> np.ndarray:
        return (mix(hashed + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(45)).astype(np.int32)

    def only(self, kept: np.ndarray) -> Bags:
        """The same rows and words, with the n-grams of some buckets (a mask) alone, which are numbered anew."""
        out = copy.copy(self)
        some = kept[self.buckets]
        number = np.cumsum(kept) - 1
        out.of, out.buckets = self.of[some], number[self.buckets[some]]
        return out

    def average(self, value: np.ndarray) -> np.ndarray:
        """Mean over the words of each row, and the empty ones, of the mean ``value`` (a number per bucket) of a word's n-grams."""
        each = np.bincount(self.of, value[self.buckets], self.words) / self.grams
        return np.bincount(self.row, each[self.word], self.rows) / (self.size + EMPTY)

    def spread(self, grad: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
        """The transpose of ``average``: a gradient per bucket from one per row."""
        each = np.bincount(self.word, (grad / (self.size + EMPTY))[self.row], self.words) / self.grams
        return np.bincount(self.buckets, each[self.of], buckets)

    def toxic_grams(self, truth: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """A mask of the buckets that stand in more toxic than clean ones of the ``chosen`` rows, beyond chance."""
        order = np.argsort(self.of, kind="stable")
        begin = np.searchsorted(self.of[order], np.arange(self.words + 1))
        whole, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        rows = np.flatnonzero(chosen)
        first = np.searchsorted(self.row, np.arange(self.rows + 1))
        for at in range(0, len(rows), 256):  # buckets of some rows at a time
            some = rows[at : at + 256]
            pairs = ragged(first[some], first[some + 1] - first[some])
            words = self.word[pairs]
            count = begin[words + 1] - begin[words]
            held = np.unique(np.repeat(self.row[pairs], count) * BUCKETS + self.buckets[order[ragged(begin[words], count)]])
            whole += np.bincount(held % BUCKETS, minlength=BUCKETS)
            toxic += np.bincount(held % BUCKETS, truth[held // BUCKETS], BUCKETS)
        n, all_toxic = len(rows), truth[chosen].sum()
        clean = whole - toxic
        lead = toxic * (n - all_toxic - clean) - clean * (all_toxic - toxic)
        spare = whole * (n - whole) * all_toxic * (n - all_toxic)
        chi = np.where(spare > 0, np.maximum(np.abs(lead) - n / 2, 0) ** 2 * n / np.maximum(spare, 1), 0)
        return (lead > 0) & (chi >= CHI_SQUARED) & (toxic >= LEAST)


class ToxicityModel:
    def __init__(self, value: np.ndarray, bias: float, shift: float = 0.0):
        self.value, self.bias, self.shift = value, bias, shift

    def log_odds(self, words: Bags) -> np.ndarray:
        return GAIN * words.average(self.value) + self.bias

    def quality(self, column: pa.Array) -> np.ndarray:
        z = np.clip(self.log_odds(Bags(column)) - self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))


def _trained(every: Bags, truth: np.ndarray, chosen: np.ndarray, epochs: int, rate: float, seed: int) -> ToxicityModel:
    """Joint training of embeddings and softmax by AdaGrad over the ``chosen`` rows; toxic and clean ones weigh the same together."""
    kept = every.toxic_grams(truth, chosen)
    words, grams = every.only(kept), int(kept.sum())
    rng = np.random.default_rng(seed)
    table, direction, bias = rng.normal(0, 0.1, (grams, DIMENSION)), rng.normal(0, 0.5, DIMENSION), -2.0
    square_table, square_direction, square_bias = np.full((grams, DIMENSION), 1e-8), np.full(DIMENSION, 1e-8), 1e-8
    share = min(max(truth[chosen].mean(), 0.02), 0.98)
    weight = np.where(chosen, np.where(truth == 1, 0.5 / share, 0.5 / (1 - share)), 0.0)
    weight /= weight.sum()
    for _ in range(epochs):
        z = np.clip(GAIN * words.average(table @ direction) + bias, -30, 30)
        g_row = weight * (1 / (1 + np.exp(-z)) - truth)
        g_value = GAIN * words.spread(g_row, grams)
        g_table = g_value[:, None] * direction[None, :] + 1e-5 * table
        g_direction = g_value @ table
        square_table += g_table**2
        table -= rate * g_table / np.sqrt(square_table)
        square_direction += g_direction**2
        direction -= 0.1 * rate * g_direction / np.sqrt(square_direction)
        square_bias += g_row.sum() ** 2
        bias -= rate * g_row.sum() / np.sqrt(square_bias)
    value = np.zeros(BUCKETS)
    value[kept] = table @ direction
    return ToxicityModel(value, float(bias))


def fit(texts: list[str], labels: list[int], epochs: int = 100, rate: float = 0.5, seed: int = 7) -> ToxicityModel:
    """A model of all texts, whose probability 0.7 lies where errors on unseen halves are fewest, a false alarm weighing ``ALARM`` misses.

    With labels of one kind only, all texts score alike.
    """
    truth = np.asarray(labels, np.float64)
    words = Bags(pa.array(texts, pa.large_string()))
    model = _trained(words, truth, np.ones(len(texts), bool), epochs, rate, seed)
    half = np.random.default_rng(seed).permutation(len(texts)) % 2 == 0
    odds = np.zeros(len(texts))
    for side in (half, ~half):
        if 0 < truth[side].sum() < side.sum():
            odds[~side] = _trained(words, truth, side, epochs, rate, seed).log_odds(words)[~side]
        else:
            odds[~side] = model.log_odds(words)[~side]
    clean, toxic = truth == 0, truth == 1
    if clean.any() and toxic.any():
        order = np.argsort(odds, kind="stable")
        missed = np.concatenate(([0], np.cumsum(toxic[order]))) / toxic.sum()
        alarms = 1 - np.concatenate(([0], np.cumsum(clean[order]))) / clean.sum()
        cost = ALARM * alarms + missed
        best = np.flatnonzero(cost <= cost.min() + 1e-12)
        at = int(best[len(best) // 2])
        low, high = odds[order[max(at - 1, 0)]], odds[order[min(at, len(order) - 1)]]
        model.shift = float((low + high) / 2 - np.log(THRESHOLD / (1 - THRESHOLD)))
    return model


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Toxicity of every whole text: one row per input row, null text as empty, without a shuffle.

    Texts alone decide a score.  Without any labelled row all scores are 0.5.
    """
    return apply_score(docs, fitted(docs, labels, "toxic", sample, fit), THRESHOLD)
