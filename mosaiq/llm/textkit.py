"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of digits, a-z (A-Z lower-cased) and characters beyond
ASCII.  Everything is done on the UTF-8 buffer of an Arrow column with numpy;
no Python object is made per word.  A slice holds about ``LIMIT`` bytes, so
memory is bounded by that or by one document's own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LIMIT = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_table = np.full(256, 32, np.uint8)
_table[48:58] = np.arange(48, 58)
_table[97:123] = np.arange(97, 123)
_table[65:91] = np.arange(97, 123)
_table[128:] = np.arange(128, 256)
#: Another split: everything but ASCII white space belongs to words; A-Z are lower-cased.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[9:14] = 32
SPACED[65:91] = np.arange(97, 123)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, LIMIT + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def _hash_run(low: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words in ``low``; no word crosses a position of ``breaks``."""
    inside = low != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    breaks = breaks[breaks < len(low)]
    first[breaks] = inside[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, U64)
    powers, inverse = _power_tables(len(low))
    values = low.astype(U64)
    values += U64(1)
    values *= inside
    values *= powers[: len(low)]
    return starts, mix(np.add.reduceat(values, starts) * inverse[starts])


def word_slices(column, limit: int = LIMIT, table: np.ndarray = _table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word offsets per row) for slices of a column."""
    off, raw = utf8(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        low = table[raw[off[i] : off[j]]]
        rel = off[i : j + 1] - off[i]
        if len(low) <= limit:
            starts, hashes = _hash_run(low, rel[:-1])
        else:  # one document beyond the limit: pieces that end between words
            parts, at = [], 0
            while at < len(low):
                end = min(len(low), at + limit)
                if end < len(low):
                    gaps = np.flatnonzero(low[at:end] == 32)
                    if len(gaps):
                        end = at + int(gaps[-1]) + 1
                    else:
                        later = np.flatnonzero(low[end:] == 32)
                        end = end + int(later[0]) if len(later) else len(low)
                s, h = _hash_run(low[at:end], np.zeros(0, np.int64))
                parts.append((s + at, h))
                at = end
            starts, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield i, j, hashes, np.searchsorted(starts, rel)
        i = j


def grams(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams within rows, and their offsets per row; rows with 1 to k-1 words have one shorter gram."""
    n = len(hashes)
    sizes = np.diff(offsets)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    new = np.concatenate([[0], np.cumsum(counts)])
    if not new[-1]:
        return np.zeros(0, U64), new
    rows = np.repeat(np.arange(len(sizes)), counts)
    at = offsets[rows] + np.arange(new[-1]) - new[rows]
    length = np.minimum(sizes, k)[rows]
    out = mix(length.astype(U64))
    for d in range(k):
        pick = np.minimum(at + d, n - 1)
        nxt = (out ^ hashes[pick]) * U64(0xFF51AFD7ED558CCD)
        nxt ^= nxt >> U64(32)
        out = np.where(d < length, nxt, out) if (sizes < k).any() else nxt
    return mix(out), new


def row_digest(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row of its word sequence."""
    n = np.diff(offsets)
    pos = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
    values = mix(hashes ^ mix(pos.astype(U64)))
    total = np.zeros(len(n) + 1, U64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    total = sums[offsets[1:]] - sums[offsets[:-1]]
    return mix(total ^ mix(n.astype(U64)))
