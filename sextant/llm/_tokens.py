"""Whole-batch tokenising and rolling hashes on Arrow buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All functions work on the text buffer
of many documents at once, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE, MOST = 1 << 20, 4096
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}
BYTE, WORD, WORD2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 in which each input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have


class Rolling:
    """Hashes of any slice of a uint64 sequence in constant time (polynomials modulo 2**64)."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.inverse = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(base, n + 1)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about SLICE bytes of ``columns`` (of "text" if none are given)
    and at most MOST rows; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in columns or ("text",):
            n = pa.compute.binary_length(batch.column(column))
            sizes += n.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at, done = 0, 0
        while at < len(ends):
            to = min(at + MOST, max(at + 1, int(np.searchsorted(ends, done + SLICE, "right"))))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


class Words:
    """Words of a column of texts: byte spans, and the first word of each document."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        a = texts.cast(pa.large_binary()).fill_null(b"")
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
        data = a.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.buf = _LOWER[buf] if lower else buf
        self.off = off - off[0]
        solid = ~_SPACE[self.buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[self.off] = True
        first, last = solid.copy(), solid.copy()
        if len(buf):
            first[1:] &= ~solid[:-1] | edge[1:-1]
            last[:-1] &= ~solid[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words of document i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return Rolling(self.buf.astype(np.uint64) + np.uint64(1), BYTE)(self.start, self.end)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def room(self) -> np.ndarray:
        """For each word, how many words its document has from there on."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each ``width`` successive values."""
    n = len(values)
    best = np.arange(n)
    size = 1
    while size * 2 <= width:
        left, right = best[: n - 2 * size + 1], best[size : n - size + 1]
        best = np.where(values[right] < values[left], right, left)
        size *= 2
    if size < width:
        left, right = best[: n - width + 1], best[width - size : n - size + 1]
        best = np.where(values[right] < values[left], right, left)
    return best


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ids(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).cast(pa.int64()).to_numpy(zero_copy_only=False)


def numbers(texts: pa.Array) -> np.ndarray:
    return texts.to_numpy(zero_copy_only=False)


def as_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
