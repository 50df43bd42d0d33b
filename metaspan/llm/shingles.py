"""Vectorised word and shingle hashing over the UTF-8 bytes of a batch.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's 64-bit hash is a
polynomial over random byte values, taken from prefix sums and mixed; a shingle's hash
combines those of its words in order. Two different shingles share a hash with
probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import frames

#: Words of a shingle.
WORDS = 5

_rng = np.random.default_rng(20240531)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_ORDER = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(max(n, 1 << 20) + 1, base & ((1 << 64) - 1), np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def word_hashes(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows in order, and where each row's words begin and the last end."""
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[body]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:]))
    power, inverse = _power_tables(n)
    sums = np.cumsum(_VALUE[body] * power[:n], dtype=np.uint64)
    total = sums[ends]
    total[starts > 0] -= sums[starts[starts > 0] - 1]
    return mix(total * inverse[starts]), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of the rows in order, with repeats, and where each row's begin.

    A row with fewer words has one shingle, the whole sequence; a row without words has none.
    """
    counts = np.diff(first)
    n_shingles = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(n_shingles)])
    out = np.empty(begins[-1], np.uint64)
    long_rows = counts >= k
    if long_rows.any() and len(words) >= k:
        rolled = words[: len(words) - k + 1] * _ORDER[0]
        for j in range(1, k):
            rolled += words[j : len(words) - k + 1 + j] * _ORDER[j]
        last = np.repeat(first[1:] - k, counts)[: len(rolled)]
        keep = np.arange(len(rolled)) <= last
        out[np.repeat(long_rows, n_shingles)] = rolled[keep]
    for row in np.flatnonzero((counts > 0) & ~long_rows):
        w = words[first[row] : first[row + 1]]
        out[begins[row]] = (w * _ORDER[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(out), begins


def of_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row of a string array without nulls: its shingle hashes, with repeats."""
    body, at = frames.raw(column)
    for a, b in frames.slices(at):
        words, first = word_hashes(body[at[a] : at[b]], at[a : b + 1] - at[a])
        hashes, begins = shingle_hashes(words, first)
        for row in range(b - a):
            yield hashes[begins[row] : begins[row + 1]]
