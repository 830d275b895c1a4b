"""Vectorised words and rolling hashes over UTF-8 bytes, for operators that run in Arrow batches.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; no byte of a longer UTF-8 character is one of these.
Hashes are polynomials modulo 2**64 taken from prefix sums, then mixed, so that the cost is a few numpy passes over the
bytes. All sizes are those of one chunk of whole texts, never of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed odd multipliers and mixing constants.
BYTE_A, BYTE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WORD_A, WORD_B = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

CHUNK_BYTES, SLICE_ROWS = 1 << 19, 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, log_size: int) -> tuple[np.ndarray, np.ndarray]:
    def row(x: int) -> np.ndarray:
        out = np.full(1 << log_size, x, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return row(base), row(pow(base, -1, 1 << 64))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to ``size`` at least."""
    return _powers(base, max(16, int(size).bit_length()))


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out, down


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null counts as empty."""
    for at in range(0, len(column), SLICE_ROWS):  # copies are of a slice, not of the batch
        part = pc.fill_null(column.slice(at, SLICE_ROWS).cast(pa.large_string()), "")
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(part):
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(part))
            yield at + first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def tidy(run):
    """A partition function that gives freed memory back to the system when its partition ends."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()

    return wrapped


def _trim() -> None:
    import ctypes
    import sys

    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


class Words:
    """The words of a chunk of texts: byte spans, the text each belongs to and, on demand, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, self.offsets = data, offsets
        if not len(data):
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: first[i]: the first word of text i; first[-1]: their number
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, base: int = BYTE_A) -> np.ndarray:
        total, down = _prefix(self.data.astype(np.uint64) + np.uint64(1), base)
        span = (self.end - self.start).astype(np.uint64)
        return mix((total[self.end] - total[self.start]) * down[self.start] ^ span * np.uint64(WORD_B))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def ngrams(words: np.ndarray, n: int, base: int = WORD_A) -> np.ndarray:
    """Mixed hash of every run of n word hashes (runs over the ends of texts are for the caller to leave out)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total, down = _prefix(words, base)
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def sequence_hash(words: np.ndarray, first: np.ndarray, base: int = WORD_A) -> np.ndarray:
    """Mixed hash of the whole word sequence of each text."""
    total, down = _prefix(words, base)
    length = np.diff(first).astype(np.uint64)
    return mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] ^ length * np.uint64(WORD_B))


def deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key, from its high bits."""
    return ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
