"""Vectorised scanning of UTF-8 text columns held in Arrow buffers.

Words are found and hashed for a whole slice of documents at once with NumPy, so no
Python code runs per word. A slice holds a bounded number of documents and bytes; only a
single text longer than the bound makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_DOCS = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of a shingle hash kept beside the document's number in a slice.
HASH_BITS = 54


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _letters() -> np.ndarray:
    """A random value for each byte; A-Z have the values of a-z."""
    table = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
    table[65:91] = table[97:123]
    return table


_LETTER = _letters()
#: The same for bytes as they are, A-Z apart from a-z.
EXACT = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
#: Separators: the six ASCII white-space characters.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators: every ASCII character but digits and letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = False
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x41:0x5B] = False

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for more than a slice aren't kept."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        found = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
        if size > SLICE_BYTES + 1:
            return found[0][:n], found[1][:n]
        _powers[:] = found
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array, docs: int = SLICE_DOCS, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = min(n, at + docs, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and bounds: words of row d are bounds[d]:bounds[d + 1]."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    full = offsets[1:] > offsets[:-1]
    first[1:] &= ~inside[:-1]
    first[offsets[:-1][full]] = inside[offsets[:-1][full]]
    last[:-1] &= ~inside[1:]
    last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray = _LETTER) -> np.ndarray:
    """A 64-bit hash of each word, by default the same for A-Z and a-z."""
    if len(data) > SLICE_BYTES and len(start) > 1:
        # a single long text: as many whole words at a time as a slice holds
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(end, start[at] + SLICE_BYTES, "right")))
            base = int(start[at])
            out[at:stop] = word_hashes(data[base : int(end[stop - 1])], start[at:stop] - base, end[at:stop] - base, letters)
            at = stop
        return out
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[:-1], out=total[1:])
    return mix64((total[end] - total[start]) * down[start])


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, with their bounds.

    A row with fewer words than the width, but not none, has one shingle of all of them.
    """
    counts = np.diff(bounds)
    keys = []
    factor = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]

    def combined(at: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(at), np.uint64(n), np.uint64)
        for k in range(n):
            out += hashes[at + k] * factor[k]
        return mix64(out)

    for n in range(1, width + 1):
        rows = np.flatnonzero(counts == n if n < width else counts >= n)
        if len(rows):
            if n < width:
                doc, at = rows, bounds[rows]
            else:
                each = counts[rows] - width + 1
                doc = np.repeat(rows, each)
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(bounds[rows], each)
            keys.append((doc.astype(np.uint64) << np.uint64(HASH_BITS)) | (combined(at, n) >> np.uint64(64 - HASH_BITS)))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    edges = np.searchsorted(key, np.arange(len(bounds), dtype=np.uint64) << np.uint64(HASH_BITS))
    return key & np.uint64((1 << HASH_BITS) - 1), edges
