"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z folded
to lower case.  Nothing here builds a Python string per word: a batch is one
byte buffer, each word's 64-bit hash is a polynomial over its bytes, and a
shingle's hash is a mixed linear form over five word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Bytes of text that one vectorised step works on (a longer document is one step).
CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240607))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LANES = _rng.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)


def _byte_values() -> np.ndarray:
    values = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    values[32] = values[9:14] = 0
    return values


_VALUE = _byte_values()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to a few MB."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES // 4), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty, offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    _, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte span of each word, and per document the index of its first word."""
    n_docs, n = len(offsets) - 1, len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(n_docs + 1, np.int64)
    solid = ~_IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = solid[edges]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = solid[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """64-bit hash of each span by the values of its members: of bytes, A-Z folded, if none are given.

    Spans are in a row, with nothing of value between them.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    weighted = values[data] * _power(_BASE, len(data))
    sums = np.add.reduceat(weighted, start)
    return mix(sums * _power(_BASE_INV, len(data))[start] + (end - start).astype(np.uint64) * _ODD)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document): every k-word window; a document of fewer words has one of all its words."""
    n_docs, counts = len(first) - 1, np.diff(first)
    windows = np.maximum(counts - k + 1, 0)
    docs = np.repeat(np.arange(n_docs), windows)
    at = np.arange(len(docs)) - np.repeat(np.cumsum(windows) - windows, windows) + first[:-1][docs]
    found = np.zeros(len(at), np.uint64)
    for j in range(k):
        found += hashes[at + j] * _LANES[j]
    found = mix(found)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        value = counts[short].astype(np.uint64) * _ODD
        for j in range(k - 1):
            more = counts[short] > j
            value[more] += hashes[first[:-1][short][more] + j] * _LANES[j]
        found, docs = np.concatenate([found, mix(value)]), np.concatenate([docs, short])
    return found, docs


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, ascending (uint64)."""
    for a, b in pieces(column):
        data, offsets = utf8(column.slice(a, b - a))
        start, end, first = words(data, offsets)
        found, docs = shingles(word_hashes(data, start, end), first)
        order = np.argsort(docs, kind="stable")
        found, cuts = found[order], np.searchsorted(docs[order], np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(found[cuts[i] : cuts[i + 1]])
