"""Whole Arrow batches of text to word and window hashes in numpy, without a Python object for each word.

A hash is a polynomial over bytes (or over word hashes) modulo 2**64, taken from prefix sums, then
finished by an avalanche step. A polynomial modulo 2**64 gives equal values to some long regular strings whatever its base (from
1,024 letters on), so a word of LONG bytes or more gets xxh3 of its bytes instead. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text hashed at a time; a longer document is a group of its own.
GROUP = 1 << 19
#: Bytes from which on a word isn't hashed by the polynomial.
LONG = 64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Poly:
    """Powers of an odd base and of its inverse modulo 2**64, grown as longer inputs come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, b, U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], dtype=U, out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


BYTES = Poly(0xD6E8FEB86659FD93)
BYTES2 = Poly(0x8EBC6AF09C88C6E3)
WORDS = Poly(0xA0761D6478BD642F)
WORDS2 = Poly(0xE7037ED1A0B428DB)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray, size: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `size` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word and the first word of each document, of one group; offsets start at 0 in data."""
    n = len(data)
    dark = ~SPACE[data]
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    last[:-1] &= ~dark[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = dark[inner]
    last[inner - 1] = dark[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray, poly: Poly = BYTES) -> np.ndarray:
    """Hash of the bytes from start to end; BYTES2 gives a second one that doesn't depend on the first."""
    s = poly.prefix(data.astype(U) + U(1))
    size = end - start
    h = mix(poly.between(s, start, end) + size.astype(U))
    for k in np.flatnonzero(size >= LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), poly.base & 0xFFFF)
    return h


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word and the first word of each document, of one group; offsets start at 0 in data."""
    if lower:
        data = LOWER[data]
    start, end, first = bounds(data, offsets)
    return spelled(data, start, end), start, end, first


def windows(h: np.ndarray, start: np.ndarray, width: int, poly: Poly = WORDS, prefix: np.ndarray | None = None) -> np.ndarray:
    """Hash of the `width` words from each start."""
    s = poly.prefix(h) if prefix is None else prefix
    return mix(poly.between(s, start, start + width), width)
