"""Vectorised text kernels over Arrow buffers.

Texts arrive as Arrow string columns. The kernels work on the column's byte
buffer with numpy, so no Python object is made per word: a word's hash is a
difference of two prefix sums of a polynomial over its bytes, and a shingle's
hash is a mix of its words' hashes. Everything is a pure function of the
bytes, so results do not depend on batches, partitions or retries.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None
U = np.uint64
#: Bytes of text handled at once; bounds the temporaries of a kernel.
BLOCK_BYTES = 1 << 20
#: Bytes of blocks whose powers a worker keeps, 16 bytes each; those of a longer text are worked out anew.
POWERS = (BLOCK_BYTES, 4 * BLOCK_BYTES)
_R = U(0x9E3779B97F4A7C15)
_RINV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) on an array of uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, one row at least."""
    i = batch.schema.get_field_index(text)
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0), dtype=np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Give freed memory back to the system: workers are kept for later stages, and their executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def _raised(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, U)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _raised(_R, n), _raised(_RINV, n)


_held_powers = cache(_both_powers)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, up to n at least; a worker keeps those of blocks up to `POWERS`."""
    return next((_held_powers(most) for most in POWERS if n <= most), None) or _both_powers(n)


class Words:
    """The words of a block of texts.

    `inside` says which bytes belong to words (256 flags). A word ends at a
    byte outside, or at the end of its text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray = _LOWER):
        self.data, self.offsets = data, offsets
        self.docs = len(offsets) - 1
        on = inside[data]
        first, last = on.copy(), on.copy()
        if len(data):
            first[1:] &= ~on[:-1]
            last[:-1] &= ~on[1:]
            edge = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[edge] |= on[edge]
            edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            last[edge] |= on[edge]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: Words before each text: text i has the words bounds[i] .. bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offsets)
        self.fold = fold
        self._sums: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
        """Given spans of bytes as words, case kept; not dealt to texts."""
        out = cls.__new__(cls)
        out.data, out.starts, out.ends, out.fold, out._sums = data, starts, ends, np.arange(256, dtype=np.uint8), None
        return out

    def hashes(self, ends: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its bytes before `ends`."""
        if self._sums is None:
            self._sums = self._prefix_sums()
        total, back = self._sums
        return mix((total[self.ends if ends is None else ends] - total[self.starts]) * back[self.starts])

    def _prefix_sums(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        power, back = _powers(n)
        value = _BYTE[self.fold][self.data]
        value *= power[:n]
        total = np.zeros(n + 1, U)
        np.cumsum(value, out=total[1:])
        return total, back

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.bounds))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Everything but ASCII white space.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters and digits, and all bytes of non-ASCII characters.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def windows(h: np.ndarray, bounds: np.ndarray, size: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by text) of all runs of `size` words inside a text.

    With `short`, a text of fewer words (one at least) gives its whole
    sequence as one run, which equals no longer run.
    """
    n = np.diff(bounds)
    count = np.maximum(n - size + 1, 0)
    if short:
        count = np.where((n > 0) & (n < size), 1, count)
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(count, out=out_bounds[1:])
    acc = np.zeros(max(len(h) - size + 1, 0), U)
    for j in range(size):
        acc = acc * U(0x9FB21C651E98DF25) + h[j : j + len(acc)]
    out = np.zeros(out_bounds[-1], U)
    full = np.flatnonzero(n >= size)
    if len(full):
        width = n[full] - size + 1
        take = np.repeat(bounds[full] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        put = np.repeat(out_bounds[full] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        out[put] = mix(acc[take])
    if short:
        for m in range(1, size):
            rows = np.flatnonzero(n == m)
            acc = np.full(len(rows), m * 0xD6E8FEB86659FD93 % (1 << 64), U)
            for j in range(m):
                acc = acc * U(0x9FB21C651E98DF25) + h[bounds[rows] + j]
            out[out_bounds[rows]] = mix(acc)
    return out, out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each text, with their bounds."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    at = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[at] = True
    before = np.zeros(len(values) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return values[keep], before[bounds]
