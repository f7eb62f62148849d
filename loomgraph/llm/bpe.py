"""Byte-level BPE encoding and decoding with the vocabulary of a tokenizer file.

A word's merges come from a segment tree over the ranks of its adjacent pairs:
the root holds the lowest rank, the way down that keeps to the left finds the
leftmost such pair, and a merge changes three leaves, each in logarithmic time,
until no pair can be merged.  The trees of a slice's short words are worked on
together; words that were met before are looked up.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .textkit import ragged, slices

KEPT_WORDS, KEPT_IDS = 1 << 19, 1 << 22  # words, and ids of words, from which a worker forgets and starts anew
LONGEST = 32  # bytes of words whose trees are worked on together
IDS = 1 << 20  # ids that are decoded together
_NONE = 1 << 30  # rank of a pair that is never merged

# How byte-level vocabularies cut a text into words (L letters, N numbers, S white space), and what became a letter or number after version 16 of the character standard, which the tokenizers library follows.
WORD = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
LATER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1
1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""


def word_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """``WORD`` with its classes spelled out as ranges, for texts whose characters go up to ``last``: short classes are searched faster."""
    later = {c for part in LATER.split() for a, _, z in [part.partition("-")] for c in range(int(a, 16), int(z or a, 16) + 1)}
    every = "".join(chr(c) if c not in later and not 0xD800 <= c < 0xE000 else "\0" for c in range(last + 1))

    def ranges(pattern: str) -> str:
        return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in regex.finditer(pattern, every))

    classes = {"L": ranges(r"\p{L}+"), "N": ranges(r"\p{N}+"), "S": ranges(r"\p{White_Space}+")}
    return re.compile(re.sub("[LNS]", lambda m: classes[m.group()], WORD))


def byte_letters() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself where it prints, else the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class Bpe:
    """Encodes and decodes as the library does with the file at ``path``, without its special tokens added.

    Texts of added tokens that stand in a text become their ids, the longest
    first where several begin at one place.  A file of another kind (no
    byte-level BPE, a normaliser, tokens that strip or need whole words) is
    refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model, cutter, added = raw["model"], raw.get("pre_tokenizer") or {}, raw.get("added_tokens") or []
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and (raw.get("decoder") or {}).get("type") == "ByteLevel"
        if not plain or not level or raw.get("normalizer") or raw.get("truncation") or raw.get("padding") or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in added}
        for token, i in self.added.items():
            self.bytes_of[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        size = max(self.bytes_of) + 1
        if set(self.bytes_of) != set(range(size)):
            raise ValueError(f"{path} leaves ids out")
        self.sizes = np.array([len(self.bytes_of[i]) for i in range(size)], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(self.bytes_of[i] for i in range(size)), np.uint8)
        self.byte_ids = [vocab[c] for c in letters]
        self._byte_ids = np.array(self.byte_ids, np.int64)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocab[left], vocab[right]] = len(self.made)
            self.made.append(vocab[left + right])
        pairs = np.array(list(self.rank), np.int64).reshape(-1, 2)
        ranks = np.array(list(self.rank.values()), np.int64)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self._keys, self._ranks = np.append(keys[order], np.int64(1) << 62), np.append(ranks[order], _NONE)
        self._made = np.array([*self.made, 0], np.int64)
        self.words, self.any_words = word_pattern(0xFFFF), word_pattern()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.forget()

    def forget(self) -> None:
        """Start the table of known words anew; an added token is known by a tuple of its text."""
        self.known: dict[str | tuple[str], int] = {}
        self.flat, self.first, self.counts, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self._add([(t,) for t in self.added], np.array(list(self.added.values()), np.int64), np.ones(len(self.added), np.int64))

    def merge(self, ids: list[int]) -> list[int]:
        """The ids of one word after all merges; ``ids`` are those of its bytes and are used up."""
        n = len(ids)
        if n < 2:
            return ids
        rank, made = self.rank.get, self.made
        size = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        tree[size : size + n - 1] = [rank(pair, _NONE) for pair in zip(ids, ids[1:])]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, now: int) -> None:
            i = size + leaf
            tree[i] = now
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    return
                tree[i] = least

        while (best := tree[1]) < _NONE:
            i = 1
            while i < size:
                i *= 2
                if tree[i] != best:
                    i += 1
            i -= size
            gone = after[i]
            ids[i], ids[gone] = made[best], -1
            right, left = after[gone], before[i]
            after[i] = right
            if right < n:
                before[right] = i
                put(gone, _NONE)
            put(i, rank((ids[i], ids[right]), _NONE) if right < n else _NONE)
            if left >= 0:
                put(left, rank((ids[left], ids[i]), _NONE))
        return [x for x in ids if x >= 0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``_NONE`` for a pair that is not merged, or with a negative id."""
        wanted = left << 32 | right
        at = np.searchsorted(self._keys, wanted)
        return np.where((self._keys[at] == wanted) & (left >= 0) & (right >= 0), self._ranks[at], _NONE)

    def merge_many(self, ids: np.ndarray) -> np.ndarray:
        """``merge`` for the rows of ``ids``, filled up with -1; what is merged away becomes -1.

        Each row has its tree; the rows take their next merge together until none has one.
        """
        ids = ids.copy()
        rows, n = ids.shape
        size = 1 << n.bit_length()  # the leaves from n - 1 on have no pair; leaf n is a missing neighbour's
        levels = size.bit_length() - 1
        tree = np.full((rows, 2 * size), _NONE, np.int64)
        tree[:, size : size + n - 1] = self.ranks(ids[:, :-1], ids[:, 1:])
        for level in range(levels - 1, -1, -1):
            tree[:, 1 << level : 2 << level] = np.minimum(tree[:, 2 << level : 4 << level : 2], tree[:, (2 << level) + 1 : 4 << level : 2])
        after, before = (np.tile(np.clip(np.arange(n + 1) + step, 0 if step > 0 else -1, n), (rows, 1)) for step in (1, -1))
        ids = np.concatenate((ids, np.full((rows, 1), -1, np.int64)), axis=1)  # place n, also reached as -1, has no id
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            best = tree[row, 1]
            i = np.ones(len(row), np.int64)
            for _ in range(levels):
                i *= 2
                i += tree[row, i] != best
            i -= size
            gone = after[row, i]
            right, left = after[row, gone], before[row, i]
            ids[row, i], ids[row, gone] = self._made[best], -1
            after[row, i], before[row, right] = right, i
            for leaf, now in ((gone, _NONE), (i, self.ranks(ids[row, i], ids[row, right])), (np.where(left < 0, n, left), self.ranks(ids[row, left], ids[row, i]))):
                node = size + leaf
                tree[row, node] = now
                for _ in range(levels):
                    node >>= 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            row = row[tree[row, 1] < _NONE]
        return ids[:, :n]

    def _learn(self, words: set[str]) -> None:
        """Add words to the table with the ids that merging gives."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode("utf-8", "replace")
            by_size.setdefault(max(2, 1 << (len(data) - 1).bit_length()) if len(data) <= LONGEST else 0, []).append((word, data))
        for size, some in by_size.items():
            if size:
                padded = np.frombuffer(b"".join(data.ljust(size, b"\0") for _, data in some), np.uint8).reshape(-1, size)
                lengths = np.array([len(data) for _, data in some])
                merged = self.merge_many(np.where(np.arange(size) < lengths[:, None], self._byte_ids[padded], -1))
                alive = merged >= 0
                self._add([word for word, _ in some], merged[alive], alive.sum(axis=1))
            else:
                for word, data in some:
                    ids = self.merge([self.byte_ids[b] for b in data])
                    self._add([word], np.array(ids, np.int64), np.array([len(ids)]))

    def _add(self, words: list, ids: np.ndarray, counts: np.ndarray) -> None:
        n, k = len(self.known), len(words)
        self.flat, self.first, self.counts = _grown(self.flat, self.used + len(ids)), _grown(self.first, n + k), _grown(self.counts, n + k)
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[n : n + k], self.counts[n : n + k] = self.used + np.cumsum(counts) - counts, counts
        self.known |= zip(words, range(n, n + k))
        self.used += len(ids)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); null and empty have none."""
        if len(self.known) > KEPT_WORDS or self.used > KEPT_IDS:
            self.forget()
        words: list = []
        ends = []
        for text in texts:
            text, at = text or "", 0
            find = (self.words if max(text, default="") <= "\uffff" else self.any_words).findall
            for hit in self.cut.finditer(text) if self.cut else ():
                words += find(text, at, hit.start())
                words.append((hit.group(),))
                at = hit.end()
            words += find(text, at)
            ends.append(len(words))
        self._learn(set(words).difference(self.known))
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        counts = self.counts[code]
        upto = np.concatenate(([0], np.cumsum(counts)))
        return self.flat[ragged(self.first[code], counts)], np.diff(upto[[0, *ends]])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids, with those of added tokens; bytes that are no UTF-8 become the replacement character."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes)):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[ids]
        raw = self.raw[ragged(self.places[ids], sizes)].tobytes()
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(upto, upto[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


def _grown(array: np.ndarray, need: int) -> np.ndarray:
    return array if need <= len(array) else np.concatenate((array, np.zeros(max(need, 2 * len(array)) - len(array), array.dtype)))


_open: dict[str, Bpe] = {}


def _bpe(path: str) -> Bpe:
    if path not in _open:
        _open[path] = Bpe(path)
    return _open[path]


def _mapped(df: DataFrame, column: str, out: str, kind, step: Callable[[pa.Array], pa.Array], limit: Callable) -> DataFrame:
    """``df`` with ``out`` = step(``column``), slice by slice; a column already named ``out`` goes."""
    rest = [c for c in df.columns if c != out]
    schema = StructType([df.schema[c] for c in rest]).add(out, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in limit(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), step(part.column(column))], [*rest, out])

    return df.mapInArrow(run, schema)


def _id_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``IDS`` ids; one row is never divided."""
    ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + IDS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each text as an array; null and empty texts have an empty one, other columns stay.

    ``path`` names the tokenizer file, which every worker reads where it runs.
    """

    def step(texts: pa.Array) -> pa.Array:
        found, counts = _bpe(path).encode_all(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(found.astype(np.int32)))

    return _mapped(df, text, ids, ArrayType(IntegerType()), step, lambda batch: slices(batch, text))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of each array of ids; null counts as empty; an id that the file does not have ends the job."""

    def step(some: pa.Array) -> pa.Array:
        counts = some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(_bpe(path).decode_all(some.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts), pa.string())

    return _mapped(df, ids, text, StringType(), step, lambda batch: _id_slices(batch, ids))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``: the ids of its text, and the text that comes back from them.

    Null text counts as empty; repeated rows give repeated rows; an empty
    table gives none; other columns are not read.
    """
    both = decode(encode(docs.select("doc_id", "text"), path).select("doc_id", "ids"), path, text="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
