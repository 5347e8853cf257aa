"""Words, shingles and 64-bit hashes of whole texts, taken from Arrow's UTF-8 buffers inside tasks.

A text never becomes Python strings here: one batch is one byte array plus text boundaries, and words,
hashes and shingles are numpy arrays over it.  Words are runs of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of text handled at once, so that temporaries stay in cache; a longer text is handled alone.
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _BASE)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 text boundaries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    bounds = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


class Words(NamedTuple):
    doc: np.ndarray  # text number of each word
    start: np.ndarray  # byte offsets in the piece
    end: np.ndarray
    hash: np.ndarray


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words never cross texts."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the disjoint, ordered byte ranges (none empty)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    at = np.zeros(len(data), np.int32)
    at[start] = start
    at = np.arange(len(data), dtype=np.int32) - np.maximum.accumulate(at)
    longest = int((end - start).max())
    value = _BYTE[data]
    value *= powers(longest)[np.minimum(at, longest - 1)]
    cuts = np.empty(2 * len(start), np.int64)
    cuts[0::2], cuts[1::2] = start, end
    return mix(np.add.reduceat(np.append(value, np.uint64(0)), cuts)[::2])


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> Words:
    data = LOWER[data] if lower else data
    start, end = spans(data, bounds)
    doc = np.searchsorted(bounds, start, "right") - 1
    return Words(doc, start, end, hashes(data, start, end))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every k-word window; a text of 1..k-1 words is one window of its own."""
    c = mix(np.arange(101, 101 + k, dtype=np.uint64)) | np.uint64(1)
    n = len(w.hash)
    if n >= k:
        acc = w.hash[: n - k + 1] * c[0]
        for j in range(1, k):
            acc += w.hash[j : n - k + 1 + j] * c[j]
        ok = w.doc[: n - k + 1] == w.doc[k - 1 :]
        doc, out = w.doc[: n - k + 1][ok], mix(acc[ok])
    else:
        doc, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n:
        first = np.flatnonzero(np.r_[True, w.doc[1:] != w.doc[:-1]])
        size = np.diff(np.r_[first, n])
        short = size < k
        if short.any():
            at = np.arange(n) - np.repeat(first, size)
            keep = np.repeat(short, size)
            f = np.r_[0, np.cumsum(size[short])[:-1]]
            acc = np.add.reduceat(w.hash[keep] * c[at[keep]], f) + size[short].astype(np.uint64)
            doc, out = np.r_[doc, w.doc[first[short]]], np.r_[out, mix(acc ^ np.uint64(0x5851F42D4C957F2D))]
    return doc, out


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, ordered by text and value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[keep], value[keep]


def pack(a: np.ndarray, ordered: bool = False) -> bytes:
    """Compressed bytes of an integer array; an ordered one is stored as differences."""
    a = np.ascontiguousarray(a)
    if ordered and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype, ordered: bool = False) -> np.ndarray:
    d = np.dtype(dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    a = np.ascontiguousarray(flat.reshape(d.itemsize, -1).T).reshape(-1).view(d)
    return np.cumsum(a, dtype=d) if ordered else a
