"""Arrow string columns as numpy arrays: words, their 64-bit hashes and hashed word shingles of many documents at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: A word is a run of bytes other than space and 0x09-0x0D; upper-case A-Z counts as lower-case.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1_000_003)) * U(BASE))


BYTE_CODE = seeds(256, 7)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, dtype=U), np.full(n, BASE_INVERSE, dtype=U)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n - 1 (a few sizes are kept)."""
    size = 1 << max(20, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) of a sequence of 64-bit codes, whatever its place."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=U)
    np.cumsum(codes * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def text_slices(column: pa.Array, limit: int = 1 << 19, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets of the rows in them) of runs of at most `rows` rows, of about `limit` bytes; null
    is empty.

    A longer text makes a run of its own, so whole texts are seen and memory follows the longest one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    if n >= 1000:
        trim()


class Words:
    """The words of a run of texts: document, place and hash of each, in order. gaps: which bytes part words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SEPARATOR):
        n = len(data)
        gap = gaps[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        if n:
            before[1:], after[:-1] = gap[:-1], gap[1:]
            before |= edge[:-1]
            after |= edge[1:]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        self.first = np.searchsorted(self.start, offsets)  # the index of each document's first word
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        return self.hashed(BYTE_CODE)

    def hashed(self, byte_code: np.ndarray) -> np.ndarray:
        """The words' hashes by other random values of the bytes."""
        return span_hashes(byte_code[LOWER[self.data]], self.start, self.end)


def trim() -> None:
    """Give freed memory back: workers are kept between tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function over batches that trims the worker's memory when its partition is done."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


SHINGLE_WORDS = 5
SHINGLE_CODE = seeds(SHINGLE_WORDS, 11) | U(1)


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """Of each document: the sorted hashes of its distinct 5-word shingles; with fewer words, of the whole sequence."""
    h, k = words.hashes, SHINGLE_WORDS
    rolled = np.zeros(max(0, len(h) - k + 1), dtype=U)
    for j in range(k):
        rolled += h[j : j + len(rolled)] * SHINGLE_CODE[j]
    rolled = mix(rolled)
    for first, count in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if count >= k:
            yield np.unique(rolled[first : first + count - k + 1])
        elif count:
            whole = (h[first : first + count] * SHINGLE_CODE[:count]).sum(dtype=U) + U(count)
            yield mix(np.array([whole], dtype=U))
        else:
            yield np.zeros(0, dtype=U)
