"""Whole-column text work for Arrow batches: words, shingles and their hashes.

A batch of texts is handled as one array of bytes, so the cost is a few array
operations per byte, whatever the length of a single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20                       # bytes of text handled at a time; one longer text is handled alone
_BASE = 0x9E3779B97F4A7C15 | 1        # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_word = np.zeros(256, dtype=bool)     # bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
_word[48:58] = _word[97:123] = _word[128:] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base & (2**64 - 1), dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def forget() -> None:
    """Drops the tables of powers, which one very long text makes as long as itself."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts, in order."""

    rows: np.ndarray      # positions of the texts in their batch
    bytes: np.ndarray     # A-Z lower-cased
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after each word
    bounds: np.ndarray    # words of text i: bounds[i]:bounds[i + 1]
    hash: np.ndarray      # 64 bits for each word
    total: np.ndarray     # hash sums up to each byte

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def prefix(self, n: int) -> np.ndarray:
        """A hash of the first n bytes of each word (of all, if it is shorter)."""
        end = np.minimum(self.end, self.start + n)
        return mix((self.total[end] - self.total[self.start]) * powers(_INVERSE, len(self.bytes) + 1)[self.start])

    def word(self, i: int) -> str:
        return self.bytes[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]] if len(at) else raw[:0], at - (at[0] if len(at) else 0)


def chunks(column: pa.Array, limit: int = CHUNK, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of a column, each of whole texts, at most ``most`` of them."""
    raw, at = buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, first + (most or last))
        yield first, last, raw[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def words(column: pa.Array) -> Iterator[Words]:
    for first, last, raw, at in chunks(column):
        low = _lower[raw]
        is_word = _word[low]
        before = np.zeros(len(low), dtype=bool)
        before[1:] = is_word[:-1]
        inner = at[1:-1]
        inner = inner[inner < len(low)]
        before[inner] = False                              # no word runs from one text into the next
        start = np.flatnonzero(is_word & ~before)
        after = np.zeros(len(low), dtype=bool)
        after[:-1] = is_word[1:]
        cut = inner[inner > 0] - 1
        after[cut] = False
        end = np.flatnonzero(is_word & ~after) + 1
        total = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(low)), out=total[1:])
        value = (total[end] - total[start]) * powers(_INVERSE, len(low) + 1)[start]
        yield Words(np.arange(first, last), low, start, end, np.searchsorted(start, at), mix(value), total)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; texts' ends are for the caller to mask. Empty if there are fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += hashes[j:j + n]
    return mix(out)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each word, which text it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
