"""Runs of CJK characters in Arrow texts, as arrays: the grams they hold and the words they are cut into, many runs at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The first and last character of a run, as in text.CJK.
FIRST, LAST = 0x4E00, 0x9FFF
#: Bits of a character in a key, and the characters that a key has room for.
BITS, ROOM = 15, 4
#: What leaves so many characters of a key.
MASKS = (np.uint64(1) << (np.uint64(BITS) * np.arange(ROOM + 1, dtype=np.uint64))) - np.uint64(1)
#: Characters whose grams are counted at once; characters of runs that are cut at once.
GRAMS, CUT = 1 << 21, 1 << 19
#: With fewer runs left, each is gone through by itself rather than side by side with the others.
FEW = 12


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all runs from 1 on, where each run starts and the end, the row of each run)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    at = np.flatnonzero((b >= 0xE4) & (b <= 0xE9))
    c = ((b[at] & 15).astype(np.uint16) << 12) | ((b[at + 1] & 63).astype(np.uint16) << 6) | (b[at + 2] & 63)
    on = (c >= FIRST) & (c <= LAST)
    at, c = at[on], c[on]
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) != 3
    # a row ends a run
    begins = np.searchsorted(at, offsets[:-1])
    first[begins[begins < len(at)]] = True
    start = np.flatnonzero(first)
    row = np.searchsorted(offsets, at[start], "right") - 1
    return c - np.uint16(FIRST - 1), np.append(start, len(at)), row


def _left(start: np.ndarray) -> np.ndarray:
    """Characters from each one to the end of its run."""
    return np.repeat(start[1:], np.diff(start)) - np.arange(start[-1])


def counted(c: np.ndarray, left: np.ndarray, size: int, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams in rows, 0 past a run's end; how often): the grams of at most size characters that start in lo to hi."""
    some = c[lo : hi + size - 1]
    seen = np.flatnonzero(np.bincount(some, minlength=1))
    bits = int(len(seen)).bit_length()
    if bits * size > 63 and hi - lo > 4096:
        mid = (lo + hi) // 2
        yield from counted(c, left, size, lo, mid)
        yield from counted(c, left, size, mid, hi)
        return
    number = np.zeros(int(seen[-1]) + 1, np.uint64)
    number[seen] = np.arange(1, len(seen) + 1)
    number = np.concatenate((number[some], np.zeros(size, np.uint64)))
    parts = [np.where(left[lo:hi] > k, number[k : k + hi - lo], 0) for k in range(size)]
    back = np.concatenate((np.zeros(1, np.uint16), seen.astype(np.uint16)))
    if bits * size > 63:
        rows, n = np.unique(np.stack(parts, axis=1), axis=0, return_counts=True)
        yield back[rows.astype(np.int64)], n
        return
    key = parts[0]
    for k in range(1, size):
        key |= parts[k] << np.uint64(bits * k)
    key = np.sort(key.astype(np.uint32) if bits * size <= 32 else key)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(at, len(key)))
    key = key[at].astype(np.uint64)
    yield back[np.stack([(key >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1) for k in range(size)], axis=1).astype(np.int64)], n


def strings(rows: np.ndarray) -> pa.Array:
    """Rows of characters, 0 past the end, as strings."""
    x = rows.astype(np.uint16)
    x[rows > 0] += FIRST - 1
    b = np.stack((0xE0 | (x >> 12), 0x80 | ((x >> 6) & 63), 0x80 | (x & 63)), axis=-1).astype(np.uint8)
    ends = np.concatenate(([0], np.cumsum((rows > 0).sum(axis=1) * 3))).astype(np.int32)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(b[rows > 0].tobytes()))


def heads(size: int):
    """Batches of (text) -> (head, c): the grams of size characters, shorter at the end of a run, that start at each character, counted by stretches."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def given():
            c, left = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for lo in range(0, len(c), GRAMS):
                for rows, n in counted(c, left, size, lo, min(lo + GRAMS, len(c))):
                    yield pa.RecordBatch.from_arrays([strings(rows), pa.array(n)], names=["head", "c"])

        for b in batches:
            c, start, _ = characters(b.column(0))
            if len(c):
                held.append((c, _left(start)))
            if sum(len(x) for x, _ in held) >= GRAMS:
                yield from given()
        if held:
            yield from given()

    return run


def keys(words: list[str]) -> np.ndarray:
    """Each word as a number; 0 for what isn't one to ROOM characters of a run."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        if 0 < len(w) <= ROOM and all(FIRST <= ord(x) <= LAST for x in w):
            out[i] = sum((ord(x) - FIRST + 1) << (BITS * k) for k, x in enumerate(w))
    return out


class Numbers:
    """Distinct keys, found by the leading bits of a product."""

    def __init__(self, key: np.ndarray):
        self.shift = np.uint64(64 - max(1, int(len(key)).bit_length() + 2))
        h = self._hash(key)
        self.order = np.argsort(h, kind="stable")
        self.key = np.append(key[self.order], np.uint64(0))
        self.start = np.searchsorted(h[self.order], np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key among those given, -1 for others."""
        h = self._hash(key)
        at, end = self.start[h], self.start[h + 1]
        out = np.full(len(key), -1, np.int64)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            on = self.key[at] == key[left]
            out[left[on]] = self.order[at[on]]
            at = at + 1
            more = ~on & (at < end)
            left, at, end = left[more], at[more], end[more]
        return out


class Cuts:
    """The words of a lexicon (of at most ROOM characters) for many runs at once: the paths of segmentation.Words, with the same sums in the same order."""

    def __init__(self, words: list[str], share: np.ndarray, unknown: float):
        key = keys(words)
        long = key >= np.uint64(1 << BITS)
        self.single = np.full(LAST - FIRST + 2, unknown)
        self.single[key[~long].astype(np.int64)] = share[~long]
        self.longer, self.share = Numbers(key[long]), np.append(share[long], -np.inf)

    def pieces(self, c: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For stretches of runs: (place of their first character, key of ROOM characters at each, where words start, their characters)."""
        a = 0
        while a < len(start) - 1:
            z = max(a + 1, int(np.searchsorted(start, start[a] + CUT, "right")) - 1)
            lo = int(start[a])
            window, step = self._steps(c[lo : start[z]].astype(np.uint64), start[a : z + 1] - lo)
            at = self._path(step, start[a : z + 1] - lo)
            yield lo, window, at, step[at]
            a = z

    def _steps(self, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(start)
        left = _left(start)
        window = c.copy()
        for k in range(1, ROOM):
            window[:-k] |= np.where(left[:-k] > k, c[k:], 0) << np.uint64(BITS * k)
        # characters by their distance from the end of their run, runs by length: what one step takes lies side by side
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n))
        alive = np.cumsum(np.bincount(n, minlength=2)[::-1])[::-1]
        off = np.concatenate(([0, 0], np.cumsum(alive[1:])))
        to = off[left] + np.repeat(rank, n)
        s = np.full((ROOM, len(c)), -np.inf)
        s[0, to] = self.single[c.astype(np.int64)]
        for k in range(1, ROOM):
            some = np.flatnonzero(left > k)
            found = self.longer.find(window[some] & MASKS[k + 1])
            s[k, to[some]] = self.share[found]
        step = np.ones(len(c), np.int64)
        best = [np.zeros(len(n))] * ROOM
        t, longest = 1, int(n.max())
        while t <= longest and alive[t] >= FEW:
            k, o = int(alive[t]), int(off[t])
            top, at = s[0, o : o + k] + best[0][:k], step[o : o + k]
            for j in range(1, ROOM):
                if t > j:
                    x = s[j, o : o + k] + best[j][:k]
                    on = x >= top
                    np.copyto(top, x, where=on)
                    at[on] = j + 1
            best = [top, *best[:-1]]
            t += 1
        for r in range(int(alive[t]) if t <= longest else 0):
            b0, b1, b2, b3 = (float(x[r]) for x in best)
            places = off[t : int(n[order[r]]) + 1] + r
            out = []
            for s0, s1, s2, s3 in zip(*(s[j, places].tolist() for j in range(ROOM)), strict=True):
                top, at = s0 + b0, 1
                if s1 + b1 >= top:
                    top, at = s1 + b1, 2
                if s2 + b2 >= top:
                    top, at = s2 + b2, 3
                if s3 + b3 >= top:
                    top, at = s3 + b3, 4
                out.append(at)
                b0, b1, b2, b3 = top, b0, b1, b2
            step[places] = out
        return window, step[to]

    def _path(self, step: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where words start, going on from the start of each run."""
        word = np.zeros(len(step), bool)
        at, end = start[:-1], start[1:]
        while len(at) >= FEW:
            word[at] = True
            at = at + step[at]
            on = at < end
            at, end = at[on], end[on]
        for i, z in zip(at.tolist(), end.tolist(), strict=True):
            go, a = step[i:z].tolist(), 0
            out = []
            while a < z - i:
                out.append(a)
                a += go[a]
            word[np.array(out) + i] = True
        return np.flatnonzero(word)
