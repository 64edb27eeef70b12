"""Cross-tokenizer alignment: where the tokens of two tokenizers meet in the same bytes.

The texts of a whole Arrow slice are laid end to end with the byte offset of each document. The ends of either tokenizer's tokens are counted
by byte once; a cut is a byte where both have one. Running sums of the counts give each token its group and the first and last token
of the other side that it overlaps, and differences of running sums at the documents' offsets give each document its own numbers.

Corpus-wide counts of linked id pairs come from each document's distinct pairs, which are written once with their multiplicities; map tasks
add them up before the shuffle. The most frequent pairs (HOT at most, so their size is bounded) are sent to every task, which settles nearly all links
on the spot; what is left is joined by pair.

Defined results: a text that is null or empty, or that either tokenizer doesn't give back byte for byte (with the space in front), has no tokens:
zeros and an empty string. Rows are documents, whatever their ids (null and repeated ones too): the same row twice counts twice.
Extra columns go; an empty table gives no rows. A document is tokenized whole, so a task holds the tokens of its longest one.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, lean, parts, slices, staged, table

#: Pairs that are sent to every task, at most; distinct pairs that a map task adds up before it sends them on.
HOT, HELD = 1 << 20, 1 << 20
#: Bits of a B id in a pair's key.
SHIFT = 32


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE of a tokenizer's json file; its strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            self.raw = f.read()
        model = json.loads(self.raw)["model"]
        letters = byte_letters()
        spelled = lambda token: bytes(letters[c] for c in token)
        self.pattern = pattern
        self.tokens = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            self.tokens[i] = spelled(token)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        #: Whether ids number the merges in their order; then ids are ranks, and the ranked merge gives the same ids in a third of the time.
        self.ranked = [model["vocab"][m] for m in merged] == [*range(256, 256 + len(merged))] and len(model["vocab"]) == 256 + len(merged)

    def loaded(self):
        if self.ranked:
            import tiktoken

            return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks={t: i for i, t in enumerate(self.tokens)}, special_tokens={}).encode_ordinary
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.raw)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model with byte fallback; it puts the space in front by itself."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.raw = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        self.tokens = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]

    def loaded(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.raw).encode


class Worker:
    """Both tokenizers in a task, with what their ids spell."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.encode = a.loaded(), b.loaded()
        self.tokens = a.tokens, b.tokens
        self.size = tuple(np.array([len(t) for t in x], np.int64) for x in self.tokens)
        self.spelled = tuple(self._spelled(len(x), last) for x, last in zip(self.tokens, (b"|", b";"), strict=True))

    @staticmethod
    def _spelled(n: int, last: bytes) -> np.ndarray:
        """The decimal of id i with a comma at 2 i, with the mark that ends its side of a group at 2 i + 1."""
        out = np.empty(2 * n, object)
        out[0::2] = [b"%d," % i for i in range(n)]
        out[1::2] = [b"%d%b" % (i, last) for i in range(n)]
        return out

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        if text:
            whole = (" " + text).encode()
            out = self.encode[0](" " + text), self.encode[1](text)
            if all(b"".join(map(t.__getitem__, x)) == whole for t, x in zip(self.tokens, out, strict=True)):
                return out
        return [], []


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each document's begin."""
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
    return np.fromiter((i for x in lists for i in x), np.int64, bounds[-1]), bounds


def since(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[bounds])


class Aligned:
    """The tokens a and b of documents laid end to end, of which both sides spell the same bytes."""

    def __init__(self, a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray, size: tuple[np.ndarray, np.ndarray]):
        ends = np.cumsum(size[0][a]), np.cumsum(size[1][b])
        n = int(ends[0][-1]) if len(a) else 0
        marks = [np.bincount(e, minlength=n + 1) for e in ends]
        cut = (marks[0] > 0) & (marks[1] > 0)
        cuts, ended = np.cumsum(cut), np.cumsum(marks[1])
        self.a, self.b, self.bounds = a, b, (a_bounds, b_bounds)
        self.group = cuts[ends[0] - 1], cuts[ends[1] - 1]
        start = ends[0] - size[0][a]
        # as many tokens of b have ended at a byte as stand before the one that holds it
        self.first = ended[start]
        self.n = np.maximum(ended[ends[0] - 1] - self.first + 1, 0)
        self.n_links = since(a_bounds, self.n)
        at = np.concatenate(([0], ends[0]))[a_bounds]
        self.n_groups = np.diff(np.concatenate(([0], cuts))[at + 1])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, key) of every link, documents in order."""
        of = np.repeat(np.arange(len(self.a)), self.n)
        b = np.repeat(self.first - np.concatenate(([0], np.cumsum(self.n)[:-1])), self.n) + np.arange(len(of)) if len(of) else of
        doc = np.repeat(np.arange(len(self.n_links)), self.n_links)
        return doc, (self.a[of] << SHIFT) | self.b[b]

    def spelled(self, tables: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """For each document the digest of its groups."""
        n_groups = int(self.group[0][-1]) + 1 if len(self.a) else 0
        each = [np.bincount(g, minlength=n_groups) for g in self.group]
        other = np.cumsum(each[1]) - each[1], np.cumsum(each[0])
        out = np.empty(len(self.a) + len(self.b), object)
        for side, ids in enumerate((self.a, self.b)):
            g = self.group[side]
            last = np.ones(len(g), np.int64)
            last[:-1] = g[1:] != g[:-1]
            out[np.arange(len(g)) + other[side][g]] = tables[side][2 * ids + last]
        bounds, words = (self.bounds[0] + self.bounds[1]).tolist(), out.tolist()
        return [hashlib.sha256(b"".join(words[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _worker(sent) -> Worker:
    a, b, name = sent.value
    return kept(f"alignment {name}", lambda: Worker(a, b))


#: pairs: the document's distinct keys in order; often: how many links have each; both little-endian.
DOC = "row long, id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, often binary"


def _aligner(sent):
    def run(batches):
        w, row = _worker(sent), TaskContext.get().partitionId() << 36
        for batch in (x for b in batches for x in slices(b, 1 << 19)):
            both = [w.ids(t) for t in batch.column("text").to_pylist()]
            (a, a_bounds), (b, b_bounds) = (joined([x[k] for x in both]) for k in (0, 1))
            n = len(both)
            al = Aligned(a, a_bounds, b, b_bounds, w.size)
            doc, key = al.links()
            order = np.lexsort((key, doc)) if len(w.tokens[0]) > 1 << 16 or len(w.tokens[1]) > 1 << 16 else None
            if order is None:  # both ids and the document fit a word, which sorts faster
                x = np.sort((doc << 32) | (key >> SHIFT << 16) | (key & 0xFFFF))
                doc, key = x >> 32, ((x >> 16 & 0xFFFF) << SHIFT) | (x & 0xFFFF)
            else:
                doc, key = doc[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            often, key = np.diff(np.append(at, len(key))).astype("<u4"), key[at].astype("<i8")
            to = np.searchsorted(doc[at], np.arange(n + 1)).tolist()
            cells = [[v[x:y].tobytes() for x, y in zip(to[:-1], to[1:], strict=True)] for v in (key, often)]
            sizes = [np.diff(v) for v in (a_bounds, b_bounds)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column("id"), *map(pa.array, (*sizes, al.n_groups, al.n_links)), pa.array(al.spelled(w.spelled), pa.string()), *(pa.array(c, pa.binary()) for c in cells)], names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often"])
            row += n

    return run


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binaries, and where each row's begin."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), np.concatenate(([0], np.cumsum(size, dtype=np.int64)))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at], np.add.reduceat(counts[order], at)


def _counts(batches):
    """(pair, c): in how many of a task's documents each pair is linked."""
    keys, counts, n = [], [], 0
    for b in batches:
        key, _ = _values(b.column("pairs"), "<i8")
        if not len(key):
            continue
        keys.append(key)
        counts.append(np.ones(len(key), np.int64))
        n += len(key)
        if n > 4 * HELD:
            key, c = _summed(keys, counts)
            keys, counts, n = [key], [c], len(key)
            if n > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c)], names=["pair", "c"])
                keys, counts, n = [], [], 0
    if keys:
        key, c = _summed(keys, counts)
        for k in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 16)]), pa.array(c[k : k + (1 << 16)])], names=["pair", "c"])


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, c, best): in how many documents each pair of ids is linked, and whether no pair of its A id is in more."""
    c = linked.select("pairs").mapInArrow(lean(_counts), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    c = staged(c.withColumn("a", F.shiftright("pair", SHIFT)))
    # an A id has as many pairs as there are B ids, at most
    most = c.groupBy("a").agg(F.max("c").alias("most"))
    return staged(c.join(most, "a").select("pair", "c", (F.col("c") == F.col("most")).alias("best")))


def _packed(batches):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(k).to_numpy(zero_copy_only=False).astype(t).tobytes()], pa.binary()) for k, t in (("pair", "<i8"), ("c", "<i8"), ("best", "<i1"))], names=["pair", "c", "best"])


def hot_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(pairs in order, counts, best) of the most frequent pairs, `most` at the utmost, and whether they are all."""
    size = F.floor(F.log2("c") * 8).cast("int")
    bins = counts.groupBy(size.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bin")).collect()  # a few hundred
    total, cut = 0, None
    for r in bins:
        if total + r.n > most:
            break
        total, cut = total + r.n, r.bin
    rows = counts.filter(size >= cut).coalesce(8).mapInArrow(_packed, "pair binary, c binary, best binary").collect() if cut is not None else []
    pair, c, best = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((0, "<i8"), (1, "<i8"), (2, "<i1")))
    order = np.argsort(pair)
    return pair[order], c[order], best[order], total == sum(r.n for r in bins)


def _settled(sent):
    def run(batches):
        pair, c, best = sent.value
        for batch in batches:
            key, bounds = _values(batch.column("pairs"), "<i8")
            often = _values(batch.column("often"), "<u4")[0].astype(np.int64)
            at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
            here = pair[at] == key if len(pair) else np.zeros(len(key), bool)
            n_best, total = (since(bounds, np.where(here, often * v[at], 0) if len(pair) else np.zeros(len(key), np.int64)) for v in (best, c))
            to = np.concatenate(([0], np.cumsum(~here)))[bounds].astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(to), pa.array(v[~here])) for v in (key, often)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), pa.array(n_best), pa.array(total), *left], names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pair", "often"])

    return run


def aligned(docs: DataFrame, a: ByteLevel, b: Pieces, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(d.dtypes)["id"]
    tokenizers = spark.sparkContext.broadcast((a, b, hashlib.md5(repr((a.tokens, b.tokens)).encode()).hexdigest()))
    linked = staged(d.mapInArrow(lean(_aligner(tokenizers), keeps=True), DOC.format(kind)), compression="zstd")
    counts = pair_counts(linked)
    *sent, whole = hot_pairs(counts, hot)
    out = linked.mapInArrow(lean(_settled(spark.sparkContext.broadcast(tuple(sent)))), f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pair array<long>, often array<long>")
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not whole:
        # links of rarer pairs, by pair: none of them is in many documents
        out = staged(out)
        left = out.select("row", F.explode(F.arrays_zip("pair", "often")).alias("x")).select("row", "x.pair", "x.often")
        left = left.repartition(parts(docs), "pair").join(counts, "pair").groupBy("row").agg(F.sum(F.col("often") * F.col("c")).alias("more"), F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("bests"))
        out = out.join(left, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("bests", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    return out.select(F.col("id").alias(id_col), *columns)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    import public_tokenizers

    a = ByteLevel(a_path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return aligned(table(spark, sf_dir, "documents"), a, Pieces(b_path or public_tokenizers.path("piece_bpe_32k.model")))
