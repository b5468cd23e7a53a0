"""Numpy kernels over the bytes of many texts at once: words, rolling hashes, shingles.

A text's words are its runs of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomials modulo 2**64 over a fixed
random value per byte, then mixed; two different spans get the same hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE2 = np.random.default_rng(20240202).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[starts[i]:ends[i]] for each i, whatever the place; values are uint64."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def texts(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) for pieces of about `size` bytes; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of a piece of texts: byte spans, row of each, and `first`: each row's first word, with one end more."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        word = ~SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:n]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:n]
        self.raw, self.offsets = raw, offsets
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE[self.raw], self.starts, self.ends)

    def second_hashes(self) -> np.ndarray:
        """Independent of the first: where both are equal, words are."""
        return span_hashes(_BYTE2[self.raw], self.starts, self.ends)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and the row of each; a text of 1 to n-1 words has one run, all of it."""
    long = words.counts >= n
    at = np.flatnonzero((np.arange(len(words.row)) + n <= words.first[1:][words.row]) & long[words.row]) if len(words.row) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & ~long)
    starts = np.concatenate([at, words.first[:-1][short]])
    ends = np.concatenate([at + n, words.first[1:][short]])
    rows = np.concatenate([words.row[at], short]) if len(words.row) else starts
    order = np.argsort(rows, kind="stable") if len(short) else slice(None)
    return span_hashes(words.hashes(), starts, ends)[order], rows[order]
