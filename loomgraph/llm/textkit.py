"""Vectorised text primitives shared by the Arrow-side operators.

All of them work on the concatenated UTF-8 bytes of a slice of rows, so the
cost per row is a few numpy passes rather than Python per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
KEPT = (2 << 20) + 4096  # most entries of a table that a worker keeps
_BASE = 0x9E3779B97F4A7C55 | 1  # odd, so that powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of about ``limit`` bytes of text; one row is never divided."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row offsets); null counts as empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _room(n: int) -> int:
    """Entries of a table that must have ``n``: what a slice needs, then ``KEPT``; longer tables are not kept."""
    return next((size for size in (SLICE_BYTES + 4096, KEPT) if n <= size), n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get("both")
    if have is None or len(have[0]) < n:
        have = _wrapped(_BASE, _room(n)), _wrapped(_INVERSE, _room(n))
        if len(have[0]) <= KEPT:
            _powers["both"] = have
    return have[0][:n], have[1][:n]


def _wrapped(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask`` that do not cross a row boundary."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (byte + 1) * base**k for i <= k < j."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


_PRIMES = (2147483647, 2147483629)
_PRIME_BASES = (1347269083, 918273645)
_residues: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prime_powers(n: int, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo ``prime`` for i < n."""
    have = _residues.get(prime)
    if have is None or len(have[0]) < n:
        have = _residue_table(_room(n), prime, base), _residue_table(_room(n), prime, pow(base, -1, prime))
        if len(have[0]) <= KEPT:
            _residues[prime] = have
    return have[0][:n], have[1][:n]


def _residue_table(size: int, prime: int, base: int) -> np.ndarray:
    table = np.ones(1, np.uint64)
    while len(table) < size:
        table = np.concatenate((table, table * np.uint64(pow(base, len(table), prime)) % np.uint64(prime)))
    return table[:size].copy()


class SpanHash:
    """Two 64-bit hashes of byte spans from three polynomials: modulo 2**64 and modulo two primes.

    Powers of two alone would let regular texts of two letters collide for
    every base; the primes do not share that weakness.
    """

    def __init__(self, raw: np.ndarray):
        self.prefix, n = prefix_hash(raw), len(raw)
        self.residues = []
        for prime, base in zip(_PRIMES, _PRIME_BASES, strict=True):
            up, _ = _prime_powers(n + 1, prime, base)
            step = (raw.astype(np.uint64) + np.uint64(1)) * up[:n]  # below 2**39
            if n > 1 << 24:
                step %= np.uint64(prime)
            out = np.zeros(n + 1, np.uint64)
            np.cumsum(step, out=out[1:])
            self.residues.append(out)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = span_hash(self.prefix, starts, ends)
        parts = []
        for out, prime, base in zip(self.residues, _PRIMES, _PRIME_BASES, strict=True):
            _, down = _prime_powers(len(out), prime, base)
            parts.append((out[ends] - out[starts]) % np.uint64(prime) * down[starts] % np.uint64(prime))
        two = mix((parts[0] << np.uint64(32)) | parts[1])
        return mix(one ^ two), mix(two + one * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """White-space separated words of a slice: byte spans, two 64-bit hashes and each row's word range."""

    def __init__(self, column: pa.Array, hashed: bool = True):
        self.raw, self.offsets = text_bytes(column)
        self.starts, self.ends = spans(~SPACE[self.raw], self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)  # row r has words first[r] .. first[r + 1]
        self.hash, self.check = SpanHash(self.raw).of(self.starts, self.ends) if hashed else (None, None)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each run of n words within one row, hash of the run, from the words' second hashes if asked)."""
        total = len(self.starts)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = powers(total + 1)
        prefix = np.zeros(total + 1, np.uint64)
        np.cumsum((self.check if second else self.hash) * up[:total], out=prefix[1:])
        row_end = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(total) + n <= row_end)
        return at, mix((prefix[at + n] - prefix[at]) * down[at])


def equal_spans(left: np.ndarray, left_starts: np.ndarray, right: np.ndarray, right_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each pair of byte spans of one size is equal."""
    out = np.ones(len(sizes), bool)
    some = np.flatnonzero(sizes)
    if len(some):
        same = left[ragged(left_starts[some], sizes[some])] == right[ragged(right_starts[some], sizes[some])]
        out[some] = np.logical_and.reduceat(same, np.cumsum(sizes[some]) - sizes[some])
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, concatenated."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
