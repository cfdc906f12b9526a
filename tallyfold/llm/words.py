"""Vectorised words and shingles over Arrow text columns.

A word is a run of bytes other than space and \\t..\\r; A-Z counts as a-z. Words
are named by 64-bit hashes, so that whole batches are handled by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_PRIME = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(_PRIME)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix((np.arange(start, start + n, dtype=np.uint64)) * U64(_STEP))


_BYTE = seeds(256, 1000)
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)
_ODD = 0xA0761D6478BD642F


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        for name, base in (("_POW", _ODD), ("_INV", pow(_ODD, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            globals()[name] = np.cumprod(p, dtype=np.uint64)
    return _POW, _INV


def text_blocks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes body[start:end]."""
    n = len(body)
    power, inverse = _powers(n + 1)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[body] * power[:n], out=acc[1:])
    return mix((acc[end] - acc[start]) * inverse[start] + (end - start).astype(np.uint64) * U64(_STEP))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the place where its words begin."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    low = _LOWER[buf]
    inside = ~_SEP[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return hashes(low, s, e), np.searchsorted(s, offs)


_PLACE = seeds(64, 5000) | U64(1)


def shingle_sets(h: np.ndarray, wofs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, ascending, and where each text's begin.

    A text with fewer words has its whole sequence as one; without words, none.
    """
    out = []
    if len(h) >= size:
        full = h[: len(h) - size + 1] * _PLACE[0]
        for k in range(1, size):
            full = full + h[k : len(h) - size + 1 + k] * _PLACE[k]
        full = mix(full)
    for a, b in zip(wofs[:-1], wofs[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            one = np.uint64(0)
            with np.errstate(over="ignore"):
                for k in range(b - a):
                    one = one + h[a + k] * _PLACE[k]
                one = one + U64(b - a) * _PLACE[size]
            out.append(mix(np.array([one], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    lens = np.fromiter((len(x) for x in out), np.int64, len(out))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lens)])
