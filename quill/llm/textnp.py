"""Vectorised byte and word helpers shared by the numpy operators of this subpackage.

Texts arrive as Arrow string columns; everything here works on one concatenated
``uint8`` array with row offsets, so no Python loop runs over characters or words.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BI = np.uint64(pow(int(_B), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def trim() -> None:
    """Give freed memory back to the system: workers stay alive between tasks, and several share an executor's limit."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, 2 * len(_POW), 1 << 16)
        base = np.full(size, _B, np.uint64)
        inv = np.full(size, _BI, np.uint64)
        base[0] = inv[0] = 1
        _POW, _IPOW = np.cumprod(base), np.cumprod(inv)
    return _POW[:n], _IPOW[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`range_hash` takes the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        pw, _ = powers(len(data) + 1)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hashes of the ranges [start, end): equal bytes, equal hash."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start])


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls have length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def row_chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: start, end, and for each row the index of its first word (n+1 values)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[(offsets < len(data))]] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    cut[len(data)] = True
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return ~_SPACE[data]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def segment_ids(first: np.ndarray) -> np.ndarray:
    """Row number of every item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
