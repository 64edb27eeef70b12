"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings resolves a pre-token that is a token as a whole. Tier two: other
pre-tokens are merged with a heap of ranked pairs over a linked list of bytes. Pre-tokens met before come from a bounded memo.
The driver makes the hash, once for all workers. A slice's ids are decoded together.

Defined results: null and empty texts give no ids; decoding gives the text's UTF-8 bytes back. Rows are encoded each by itself, whatever
their ids (null and repeated ones too); extra columns go; an empty table gives no rows. Pairs of equal rank are merged from the left.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, lean, slices, table

#: Pre-tokens a worker remembers, twice: as many again from before. About 170 bytes each.
MEMO = 250_000


class PerfectHash:
    """Hash and displace: keys fall into buckets, each bucket gets the first seed that sends its keys to free slots."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket.astype(np.int64), minlength=self.buckets)
        start = np.concatenate(([0], np.cumsum(size)))
        seeds, taken, slot_of = np.zeros(self.buckets, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        free = n
        for b in np.argsort(-size, kind="stable"):
            if not size[b]:
                break
            at = order[start[b] : start[b + 1]]
            if size[b] == 1:  # single keys fill what is free, by address
                while taken[free - 1]:
                    free -= 1
                taken[free - 1], slot_of[at[0]], seeds[b] = True, free - 1, -free
                continue
            first, many = 1, 16
            while True:  # so many seeds together; the first that fits counts
                s = self._slots(h[at], np.arange(first, first + many, dtype=np.uint64))
                sorted_ = np.sort(s, axis=1)
                fit = np.flatnonzero(~taken[s].any(axis=1) & (sorted_[:, 1:] != sorted_[:, :-1]).all(axis=1))
                if len(fit):
                    break
                first, many = first + many, min(2 * many, 1024)
            s = s[fit[0]]
            taken[s], slot_of[at], seeds[b] = True, s, first + fit[0]
        self.seeds = seeds.tolist()
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for k, v, s in zip(keys, values, slot_of.tolist(), strict=True):
            self.keys[s], self.values[s] = k, v

    def _slot(self, h: int, seed: int) -> int:
        return (((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 20) % self.n

    def _slots(self, h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """_slot of each hash, a row for each seed."""
        x = (h ^ (seeds[:, None] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int:
        """The value of key, or -1 if it isn't one of the keys."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[(h >> 32) % self.buckets]
        s = -seed - 1 if seed < 0 else self._slot(h, seed)
        return self.values[s] if self.keys[s] == key else -1


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, hash_: PerfectHash | None = None):
        import regex

        tokens = [b""] * (1 + max(ranks.values(), default=-1))
        for k, v in ranks.items():
            tokens[v] = k
        self.tokens = pa.array(tokens, pa.binary())
        self.hash = hash_ or PerfectHash(list(ranks), list(ranks.values()))
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of least rank, the leftmost of equals, until no pair is a token."""
        rank, push, pop, n = self.ranks.get, heapq.heappush, heapq.heappop, len(piece)
        # a part is known by its first byte; end[a] is where it ends, 0 once another has taken it in
        end, prev = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, a, a + 2) for a in range(n - 1) if (r := rank(piece[a : a + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, stop = pop(heap)
            b = end[a]
            if not b or b >= n or end[b] != stop:
                continue  # one of its parts has been merged since
            end[b], end[a] = 0, stop
            prev[stop] = a
            if stop < n and (r := rank(piece[a : end[stop]])) is not None:
                push(heap, (r, a, end[stop]))
            a0 = prev[a]
            if a0 >= 0 and (r := rank(piece[a0:stop])) is not None:
                push(heap, (r, a0, stop))
        out, a = [], 0
        while a < n:
            out.append(self.ranks[piece[a : end[a]]])
            a = end[a]
        return out

    def piece(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            raw = word.encode()
            r = self.hash.get(raw)
            ids = self.pack(*([r] if r >= 0 else self.merge(raw)))
        if len(self.memo) >= MEMO:  # words in use come back from the old one
            self.memo, self.old = {}, self.memo
        self.memo[word] = ids
        return ids

    @staticmethod
    def pack(*ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memo, piece = self.memo, self.piece
        return b"".join([memo.get(w) or piece(w) for w in self.split(text)])

    def decoded(self, ids: list[bytes]) -> pa.Array:
        """The bytes of each text's ids: tokens are taken for all texts at once, then cut where a text's ids end."""
        taken = pc.take(self.tokens, pa.array(np.frombuffer(b"".join(ids), np.dtype("<u4"))))
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
        at = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)[ends] if len(taken) else np.zeros(len(ends), np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at), taken.buffers()[2] or pa.py_buffer(b"")])


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file on the driver: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _worker(sent) -> Bpe:
    ranks, pattern, hash_, name = sent.value
    return kept(f"bpe {name}", lambda: Bpe(ranks, pattern, hash_))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, ids (binary, little-endian unsigned 32-bit) and decoded (binary)."""
    hash_ = PerfectHash(list(ranks), list(ranks.values()))
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern, hash_, hashlib.md5(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()))

    def run(batches):
        bpe = _worker(sent)
        for b in (x for batch in batches for x in slices(batch)):
            ids = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.binary()), bpe.decoded(ids)], names=["id", "ids", "decoded"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(lean(run, keeps=True), f"id {dict(d.dtypes)['id']}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    d = encoded(docs, ranks, pattern)
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
