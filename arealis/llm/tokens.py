"""Words of whole texts as numpy arrays of 64-bit hashes.

A batch of texts stays one UTF-8 buffer from Arrow; words are found by byte
classes, which is exact for UTF-8 because every byte of a non-ASCII character
is 0x80 or more.  Texts are taken in slices of a few megabytes, so memory does
not depend on the batch size; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: bytes hashed at once; the arrays of the prefix sums take about 50 times as much
HASH_BYTES = 256 << 10

_ODD = 0x9E3779B97F4A7C15  # the base of the polynomial; odd, so it has an inverse modulo 2**64
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def byte_class(*outside: tuple[int, int]) -> np.ndarray:
    """True for every byte that is in none of the (first, last) ranges."""
    member = np.ones(256, dtype=bool)
    for first, last in outside:
        member[first : last + 1] = False
    return member


#: words are what lies between ASCII white space
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: words of ASCII letters and digits and of all non-ASCII characters
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def flatten(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after the other, and the n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` bytes; at least one text each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n + 1 offsets of the texts' words."""
    inside = member[data]
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a one-to-one function)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; sorting whole arrays is much faster here than numpy's hash table."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: a polynomial by prefix sums, then mixed."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(int(np.searchsorted(ends, base + HASH_BYTES, side="right")), at + 1)
        part = data[base : ends[to - 1]]
        n = len(part) + 1
        sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE_VALUES[part] * _powers(_ODD, n)[:-1], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * _powers(_INVERSE, n)[s]
        at = to
    return mix(out)


def hash_grams(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of every ``size`` consecutive values; shorter by ``size - 1`` than ``words``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64((int(salt) * 2 + 1) * _ODD % (1 << 64)))
    for j in range(size):
        h = h * np.uint64(_ODD) + words[j : j + n]
    return mix(h)
