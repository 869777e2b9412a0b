"""Words of whole Arrow columns as numpy arrays.

One pass over a column's bytes gives every word's start, end, row and 64-bit hash. The
hash of a word is a difference of prefix sums of random byte values times powers of an odd
number modulo 2**64, moved to position 0 by the inverse power, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20_240_101).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space parts words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: All of ASCII but letters and digits parts words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        with np.errstate(over="ignore"):
            held = np.cumprod(held)
        if size <= 1 << 23:
            _powers[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its rows, from 0; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


@dataclass
class Words:
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    sums: np.ndarray

    def prefix(self, n: int, longer: np.ndarray) -> np.ndarray:
        """Hash sums of the first ``n`` bytes of the words that are ``longer``; any value for the rest."""
        last = np.where(longer, self.start + n, self.start)
        with np.errstate(over="ignore"):
            return (self.sums[last] - self.sums[self.start]) * powers(BACK, len(self.data) + 1)[self.start]

    def bounds(self) -> np.ndarray:
        """The n + 1 positions in the word arrays at which rows begin."""
        return np.searchsorted(self.start, self.offsets)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def words(column: pa.Array, parts: np.ndarray = BLANK, lower: bool = True) -> Words:
    data, offsets = column_bytes(column)
    n = len(data)
    inside = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    after = np.concatenate([inside[1:], [False]]) if n else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if lower:
        data = LOWER[data]
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[data] * powers(STEP, n), out=sums[1:])
        hashed = mix((sums[end] - sums[start]) * powers(BACK, n + 1)[start])
    return Words(data, offsets, start, end, np.searchsorted(offsets[1:], start, side="right"), hashed, sums)


def hash_word(word: str) -> int:
    """The hash that ``words`` gives to this one word."""
    return int(words(pa.array([word]), np.zeros(256, bool)).hash[0])


def shingles(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, or of the whole sequence where it has fewer."""
    n = len(hashed)
    if n == 0:
        return hashed[:0]
    k = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, k * STEP & (1 << 64) - 1, np.uint64)
        for i in range(k):
            out = (out ^ hashed[i : n - k + 1 + i]) * U(0xD6E8FEB86659FD93)
            out ^= out >> U(32)
    return out
