"""Vectorised helpers over the UTF-8 bytes of text columns, used inside Arrow batches.

A batch's text column is looked at as one byte array plus row offsets, so that
tokenising and hashing are a few numpy passes rather than a Python call per
word.  Long batches are cut into segments of a quarter of a megabyte, which bounds the
memory of a task whatever the Arrow batch size is; one text is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 18

#: Substrings are hashed modulo this prime, 2^61 - 1.
PRIME = (1 << 61) - 1
_P, _BITS = np.uint64(PRIME), np.uint64(61)
_LOW32, _LOW29, _U29, _U32 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1), np.uint64(29), np.uint64(32)


def _lut(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Word bytes of the class [^\x20\x09-\x0D]: everything but ASCII white space.
NOT_SPACE = ~_lut([0x20, *range(0x09, 0x0E)])
#: Word bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z, non-ASCII.
ALNUM_LOWER = _lut([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Word bytes of the class [^\x00-\x40\x5B-\x60\x7B-\x7F], lower-cased: a-z, non-ASCII.
LETTER_LOWER = _lut([*range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RANDOM = np.random.default_rng(20240611)
_BASE = int(_RANDOM.integers(1 << 40, PRIME))


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x, or that plus the prime: below 2^61 + 8."""
    return (x & _P) + (x >> _BITS)


def _reduced(x: np.ndarray) -> np.ndarray:
    """The one number below the prime for what was folded."""
    x = _folded(x)
    x -= (x >= _P) * _P
    return x


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2^32 modulo the prime, for a folded x; the result is below 2^62."""
    return ((x & _LOW29) << _U32) + (x >> _U29)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo the prime, folded, by 32-bit halves of folded numbers."""
    a0, a1, b0, b1 = a & _LOW32, a >> _U32, b & _LOW32, b >> _U32
    out = _shifted(_folded(a0 * b1 + a1 * b0))  # each product below 2^62
    out += _folded(a0 * b0)
    out += _folded((a1 * b1) << np.uint64(3))  # times 2^64, which is 8 modulo the prime
    return _folded(out)


@lru_cache(maxsize=2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, PRIME) if inverse else _BASE
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = _reduced(times(out[:m], np.uint64(pow(base, done, PRIME))))
        done += m
    return out


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or its inverse) modulo the prime."""
    size = max(1 << 19, 1 << int(n).bit_length())
    return _powers(size, inverse)[:n]


@lru_cache(maxsize=1)
def _all_halves(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = powers(n)
    return p & _LOW32, p >> _U32


def _halves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The low and high 32 bits of the first powers, as numbers."""
    return _all_halves(max(1 << 19, 1 << int(n).bit_length()))


_STRIDE = 1 << 14


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a hash is usable."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RollingHash:
    """Hashes of any substring of a byte array in constant time each.

    A polynomial in a random base modulo 2^61 - 1, over bytes plus one, so that
    strings of other lengths differ too: two given strings of n bytes have one hash for
    at most n of the bases, whatever their structure.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        low, high = _halves(n)
        self._sums = np.zeros(n + 1, np.uint64)
        carried = np.uint64(0)
        for a in range(0, n, _STRIDE):  # in steps that stay in the processor's cache
            values = data[a : a + _STRIDE].astype(np.uint64)
            values += np.uint64(1)
            # products stay below 2^41, running sums below 2^55
            own = _folded(_shifted(np.cumsum(values * high[a : a + len(values)])) + np.cumsum(values * low[a : a + len(values)]) + carried)
            self._sums[a + 1 : a + 1 + len(own)] = own
            carried = own[-1]
        self._undo = powers(n + 1, inverse=True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for a in range(0, len(start), _STRIDE):
            s, e = start[a : a + _STRIDE], end[a : a + _STRIDE]
            apart = _folded(self._sums[e] + (np.uint64(2 * PRIME) - self._sums[s]))
            out[a : a + _STRIDE] = mix(_reduced(times(apart, self._undo[s])))
        return out


#: Bytes of a span that are hashed by numpy, eight at a time; longer spans are digested whole.
LANE_BYTES = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: eight bytes at a time through a bijective mix; a keyed digest where a span is long."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    eight = lanes(data)
    at = np.flatnonzero((size > 0) & (size <= LANE_BYTES))
    k = 0
    while len(at):
        lane = eight[start[at] + k] & _KEEP[np.minimum(size[at] - k, 8)]
        out[at] = mix((out[at] ^ lane) + np.uint64(k + 1))
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LANE_BYTES).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=b"span").digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each span of data has the very bytes of the span of other at the same place in the lists."""
    out = end - start == other_end - other_start
    size = (end - start).astype(np.int64)
    at = np.flatnonzero(out & (size > 0))
    eight, others = lanes(data), lanes(other)
    k = 0
    while len(at):
        keep = _KEEP[np.minimum(size[at] - k, 8)]
        differ = (eight[start[at] + k] ^ others[other_start[at] + k]) & keep != 0
        out[at[differ]] = False
        at = at[~differ]
        k += 8
        at = at[size[at] > k]
    return out


def take_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans end to end, and the offsets of each (one more than spans)."""
    size = (end - start).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column of bytes that lie end to end."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).cast(pa.string())


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def segments(batch: pa.RecordBatch, column: str, limit: int = SEGMENT_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch at row borders into parts of about `limit` bytes of text."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    row, rows = 0, batch.num_rows
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of each row: start, end and hash of every word, words of a row together.

    `first[r]:first[r + 1]` are row r's words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool = True):
        n = len(data)
        if lower:
            data = LOWER[data]
        inside = word_bytes[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        borders = offsets[(offsets > 0) & (offsets < n)]
        start[borders] = inside[borders]
        end[borders - 1] = inside[borders - 1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.data = data

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


_STEP = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (as many as fit, row borders ignored)."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += word_hashes[k : k + m] * _STEP[k]
    return mix(out + np.uint64(n))


def inside_row(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether the n words from each position on lie in one row."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[:m] == row[n - 1 : n - 1 + m]


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values
