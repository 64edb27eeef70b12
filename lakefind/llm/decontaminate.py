"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers (also in words) <num>, units <unit>, names (capitalised inside a sentence) <name>, others themselves in
lower case without outer punctuation; names and numbers of several words are one token. There are two forms: in the second one capitalised
words that begin a sentence are names too. Windows of WINDOW template tokens of documents and benchmark items are joined by hash, each form
with itself; a window counts only if LITERALS of its tokens are no placeholders. Matches of a document and an item on one diagonal (document
place minus item place), or on a chain of diagonals at most DRIFT words apart (words put in or left out), are one passage; its slots are
consistent if a value of the item's always meets the same value of the document's. A document leaks an item if a passage with consistent
slots covers COVER of the item's windows.

A filter of fixed size, made from the benchmark's windows, spares the shuffle all windows that can't match.
Defined results: null or empty texts leak nothing; an item shorter than WINDOW tokens is one window of its own length; an item none of whose
windows has LITERALS literals, or of fewer than SHORTEST tokens, is matched by windows with a single literal, and besides by all its words in
lower case, every one of them (so also where it has no literal at all); equal items are found by each of their ids; the same document row twice gives two rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import hashing as H
from .common import fits_broadcast, lean, slices, staged, table

WINDOW, LITERALS, COVER = 8, 5, 0.6
#: Words put in or left out between two diagonals of a chain.
DRIFT = 3
#: log2 of the filter's bits; the shortest item that is looked for, in tokens.
FILTER, SHORTEST = 22, 6
#: Fixed list of unit words.
UNITS = "km m cm mm mi ft kg g mg lb oz l ml s ms sec min h hr hours hour minutes minute seconds second days day weeks week months month years year meter meters metre metres kilometers miles mile feet foot inches inch kilograms grams gram pounds pound dollars dollar euros euro cents percent degrees degree liters litres kph mph km/h".split()
#: Marks around a word that aren't part of it; marks that end a sentence; quotes and brackets that may follow them.
EDGE, STOP, CLOSE = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?\"'()[]{}*#&%$|", b".!?", b"\"')"))
DIGIT, UPPER = np.zeros(256, bool), np.zeros(256, bool)
DIGIT[48:58] = UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = LETTER[128:] = True
#: Bytes that only words outside ASCII and the Latin-1 letters have.
ODD = np.zeros(256, bool)
ODD[128:] = True
ODD[0xC3] = False
#: Marks that can't be told from bytes, units and numbers for words that have such bytes.
MARKS = ".,;:!?\"'()[]{}*#&%$|…«»“”„‘’"
SIGNS = frozenset("€ £ °c °f".split())
NUMBER = re.compile(r"[-+$€£]*\d[\d.,:/]*(?:st|nd|rd|th|%|e\d+|€|£)?$")
_ONES = "one two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Fixed list of numbers in words.
NUMBERS = [*_ONES, *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen".split(), *_TENS, *(f"{t}-{o}" for t in _TENS for o in _ONES)]
#: The third form: words as they are.
BARE = 2
FORMS = np.array([0, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)
NAME, NUM, UNIT = np.uint64(0x6E616D65), np.uint64(0x6E756D), np.uint64(0x756E6974)


def _plain(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case: A-Z and the Latin-1 letters."""
    low = H.LOWER[data]
    big = np.flatnonzero(data[:-1] == 0xC3) + 1
    big = big[(data[big] >= 0x80) & (data[big] <= 0x9E) & (data[big] != 0x97)]
    low[big] += 0x20
    return low


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    return np.sort(H.spelled(data, np.concatenate(([0], end[:-1])), end))


UNIT_HASHES = _hash_of(UNITS)
NUMBER_HASHES = _hash_of(NUMBERS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Form:
    """One reading of the words: hash of each template token, whether it is a placeholder, its first word and the end of its last one."""

    def __init__(self, hashes: np.ndarray, slot: np.ndarray, glued: np.ndarray, doc: np.ndarray, first: np.ndarray):
        # names and numbers of several words are one slot
        run = np.zeros(len(hashes), bool)
        run[1:] = glued[1:] & ((hashes[1:] == NAME) | (hashes[1:] == NUM)) & (hashes[1:] == hashes[:-1])
        self.word = np.flatnonzero(~run)
        self.last = np.append(self.word[1:], len(hashes)) - 1
        self.hash, self.slot, self.doc = hashes[self.word], slot[self.word], doc[self.word]
        self.size = np.diff(np.searchsorted(self.word, first))

    def windows(self, width: int, literals: int = LITERALS) -> tuple[np.ndarray, np.ndarray]:
        """(token, hash) of the windows inside a document that have enough literals."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        c = np.concatenate(([0], np.cumsum(~self.slot)))
        start = np.flatnonzero((c[width:] - c[:n] >= literals) & (self.doc[:n] == self.doc[width - 1 :]))
        return start, H.windows(self.hash, start, width)


class Template:
    """Words of a group of documents in two forms (a capitalised word that begins a sentence: literal, name) and bare."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        start, end, self.first = H.bounds(data, offsets)
        n = len(start)
        self.low = low = _plain(data)
        # without the marks around it, however many
        core = np.append(np.flatnonzero(~EDGE[data]), len(data))
        lo, hi = np.searchsorted(core, start), np.searchsorted(core, end)
        s = np.minimum(core[lo], end)
        e = np.where(hi > lo, core[hi - 1] + 1, s)
        h = H.spelled(low, s, e)
        some = s < e
        one, two = data[np.minimum(s, len(data) - 1)], data[np.minimum(s + 1, len(data) - 1)]
        letters = np.concatenate(([0], np.cumsum(LETTER[data])))
        letters = letters[e] - letters[s]
        number = some & (DIGIT[one] | (((one == 43) | (one == 45)) & DIGIT[two] & (e - s > 1))) & (letters <= 2)
        number |= some & _among(h, NUMBER_HASHES)
        unit = some & _among(h, UNIT_HASHES) & ~number
        unit |= (end - start == 1) & ((data[start] == 37) | (data[start] == 36))
        wide = (one == 0xC3) & (two >= 0x80) & (two <= 0x9E)
        after = data[np.minimum(s + 1 + wide, len(data) - 1)]
        capital = some & (UPPER[one] | wide) & (e - s > 1 + wide) & LETTER[after] & ~UPPER[after]
        ends = STOP[data[end - 1]] | (CLOSE[data[end - 1]] & (end - start > 1) & STOP[data[np.maximum(end - 2, 0)]])
        odd = np.concatenate(([0], np.cumsum(ODD[data] & ~np.concatenate(([False], data[:-1] == 0xC3)))))
        odd = np.flatnonzero(odd[end] > odd[start])
        if len(odd):
            self._odd(data, odd, start, end, (s, e, h, number, unit, capital, ends))
        begin = np.ones(n, bool)
        begin[1:] = ends[:-1]
        begin[self.first[:-1][self.first[:-1] < n]] = True
        self.s, self.e = s, e
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        glued = np.zeros(n, bool)
        glued[1:] = (e[:-1] == end[:-1]) & (s[1:] == start[1:]) & (self.doc[1:] == self.doc[:-1])
        base = np.where(number, NUM, np.where(unit, UNIT, h))
        self.forms = []
        for name in (capital & ~begin & ~number & ~unit, capital & ~number & ~unit):
            self.forms.append(Form(np.where(name, NAME, base), number | unit | name, glued, self.doc, self.first))
        none = np.zeros(n, bool)
        self.bare = Form(h, none, none, self.doc, self.first)

    @staticmethod
    def _odd(data: np.ndarray, odd: np.ndarray, start: np.ndarray, end: np.ndarray, columns: tuple) -> None:
        """What the bytes can't say about words with other letters and marks, once for each distinct word."""
        s, e, h, number, unit, capital, ends = columns
        _, one, which = np.unique(H.spelled(data, start[odd], end[odd]), return_index=True, return_inverse=True)
        rows, bare = [], []
        for a, b in zip(start[odd[one]].tolist(), end[odd[one]].tolist(), strict=True):
            word = data[a:b].tobytes().decode(errors="replace")
            core = word.strip(MARKS)
            left = len(word[: len(word) - len(word.lstrip(MARKS))].encode()) if core else 0
            low = core.lower()
            bare.append(low)
            num = bool(NUMBER.match(core))
            rows.append((left, left + len(core.encode()), num, not num and (low in SIGNS or word in SIGNS or low in UNITS), core[:1].isupper() and core[1:2].islower(), word[-1] in ".!?…" or (len(word) > 1 and word[-1] in "\"')”»’" and word[-2] in ".!?…")))
        spelt = "".join(bare).encode()
        to = np.cumsum([len(w.encode()) for w in bare])
        hashes = H.spelled(np.frombuffer(spelt + b" ", np.uint8), np.concatenate(([0], to[:-1])), to)
        left, right, num, sign, cap, stop = (np.array(c)[which] for c in zip(*rows, strict=True))
        s[odd], e[odd], h[odd] = start[odd] + left, start[odd] + right, hashes[which]
        number[odd], unit[odd], capital[odd], ends[odd] = num | _among(h[odd], NUMBER_HASHES), sign | _among(h[odd], UNIT_HASHES), cap, stop

    def windows(self, width: int, literals: int):
        """(number of the form, form, token, hash) of the windows of each form with so many literals; without any, of the bare words. Forms have keys of their own."""
        for f, form in enumerate(self.forms) if literals else ((BARE, self.bare),):
            start, key = form.windows(width, literals)
            yield f, form, start, key ^ FORMS[f]

    def slots(self, form: Form, token: int, width: int) -> list[str | None]:
        """The words behind the placeholders of a window, in lower case."""
        return [bytes(self.low[self.s[form.word[j]] : self.e[form.last[j]]]).decode(errors="replace") if form.slot[j] else None for j in range(token, token + width)]


def templates(col: pa.Array):
    """(first row, Template) of each group of a batch's documents."""
    data, offsets = H.utf8(col)
    for a, b in H.groups(offsets):
        lo, hi = offsets[a], offsets[b]
        if hi > lo:
            yield a, Template(data[lo:hi], offsets[a : b + 1] - lo)


def item_windows(items: pa.Array, texts: pa.Array):
    """Rows (item, n windows, form, start, width, literals asked for, hash, slot words) of benchmark items; form BARE: windows of bare words."""
    items = items.to_pylist()
    for a, t in templates(texts):
        rows: list[list] = [[] for _ in range(len(t.first) - 1)]
        for least in (LITERALS, 1):
            # with a single literal only what has no window with more
            open_ = np.array([not r for r in rows])
            for w in range(SHORTEST if least == LITERALS else 1, WINDOW + 1):
                for f, form, start, key in t.windows(w, least):
                    doc = form.doc[start]
                    # marks alone are no literal to go by
                    told = np.concatenate(([0], np.cumsum(~form.slot & (t.s < t.e)[form.word])))
                    on = (np.minimum(form.size[doc], WINDOW) == w) & open_[doc] & (told[start + w] > told[start])
                    for j, k, d in zip(start[on].tolist(), key[on].view(np.int64).tolist(), doc[on].tolist(), strict=True):
                        rows[d].append((f, int(form.word[j] - t.first[d]), w, least, k, t.slots(form, j, w)))
        for d, found in enumerate(rows):
            n = len({r[1] for r in found})
            for r in found:
                yield items[a + d], n, *r
            lo, hi = int(t.first[d]), int(t.first[d + 1])
            if all(r[3] < LITERALS for r in found) and (t.s[lo:hi] < t.e[lo:hi]).any():
                w = min(hi - lo, WINDOW)
                keys = (H.windows(t.bare.hash, np.arange(lo, hi - w + 1), w) ^ FORMS[BARE]).view(np.int64).tolist()
                for j, k in enumerate(keys):
                    yield items[a + d], len(keys), BARE, j, w, 0, k, []


ITEM = "item_id long, n_windows int, form int, item_at int, width int, literals int, key long, item_slots array<string>"


def _items(batches):
    for b in batches:
        rows = list(item_windows(b.column("item_id"), b.column("text")))
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "n_windows", "form", "item_at", "width", "literals", "key", "item_slots"])


def _bits(batches):
    """The filter as bytes, of all keys of a task."""
    f, any_rows = np.zeros(1 << FILTER, bool), False
    for b in batches:
        any_rows = any_rows or b.num_rows > 0
        f[(b.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER)).astype(np.int64)] = True
    if any_rows:
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(f).tobytes()], pa.binary())], names=["bits"])


def _matches(sent, widths: list[tuple[int, int]]):
    def run(batches):
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for b in (x for batch in batches for x in slices(batch, 1 << 22)):
            ident = b.column("id")
            out: list[list] = [[], [], [], [], []]
            for a, t in templates(b.column("text")):
                for w, literals in widths:
                    for _, form, start, key in t.windows(w, literals):
                        on = np.flatnonzero(bits[(key >> np.uint64(64 - FILTER)).astype(np.int64)])
                        for j, k in zip(start[on].tolist(), key[on].view(np.int64).tolist(), strict=True):
                            d = int(form.doc[j])
                            for column, v in zip(out, (a + d, int(form.word[j] - t.first[d]), w, k, t.slots(form, j, w)), strict=True):
                                column.append(v)
            yield pa.RecordBatch.from_arrays([ident.take(pa.array(out[0], pa.int32())), b.column("th").take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.list_(pa.string()))], names=["id", "th", "at", "width", "key", "slots"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, item_id, cover) of the documents (th: hash of the text) that hold a benchmark item."""
    items = staged(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(_items, ITEM))
    spark = docs.sparkSession
    # of each width the least literals that an item asks for, and whether there are bare words: 2 * WINDOW pairs at most
    kinds = items.groupBy("width", (F.col("form") == BARE).alias("bare")).agg(F.min("literals").alias("literals")).orderBy("width", "bare").collect()
    widths = [(r.width, r.literals) for r in kinds]
    filters = [np.frombuffer(r.bits, np.uint8) for r in items.coalesce(8).mapInArrow(_bits, "bits binary").collect()]
    sent = spark.sparkContext.broadcast(np.bitwise_or.reduce(filters).tobytes() if filters else np.zeros((1 << FILTER) // 8, np.uint8).tobytes())
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    hit = d.mapInArrow(lean(_matches(sent, widths)), f"id {dict(d.dtypes)['id']}, th long, at int, width int, key long, slots array<string>")
    small = fits_broadcast(items, 600)
    x = hit.join(F.broadcast(items) if small else items, ["key", "width"]).withColumn("diagonal", F.col("at") - F.col("item_at"))
    x = x.select("id", "th", "item_id", "form", "diagonal", "n_windows", "item_at", F.filter(F.arrays_zip("item_slots", "slots"), lambda z: z["item_slots"].isNotNull()).alias("pairs")).distinct()
    x = staged(x)
    group = ["id", "th", "item_id", "form"]
    # neighbouring diagonals, at most DRIFT words apart, are one chain
    by = W.partitionBy(*group).orderBy("diagonal")
    chains = x.select(*group, "diagonal").distinct().withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= DRIFT, 0).otherwise(1))
    chains = chains.select(*group, "diagonal", F.sum("new").over(by).alias("chain"))
    same = [F.equal_null(F.col(f"x.{c}"), F.col(f"c.{c}")) for c in (*group, "diagonal")]
    chained = staged(x.alias("x").join(chains.alias("c"), same).select("x.*", "c.chain"))
    return _covered(chained, [*group, "diagonal"]).unionByName(_covered(chained, [*group, "chain"])).groupBy("id", "th", "item_id").agg(F.max("cover").alias("cover"))


def _covered(x: DataFrame, passage: list[str]) -> DataFrame:
    """(id, th, item_id, cover) of the passages with consistent slots that cover enough of their item."""
    cover = x.groupBy(*passage, "n_windows").agg(F.count_distinct("item_at").alias("c")).filter(F.col("c") >= F.ceil(F.col("n_windows") * F.when(F.col("form") == BARE, 1.0).otherwise(COVER)))
    # a value of the item's that meets two values of the document's breaks the passage
    broken = x.select(*passage, F.explode("pairs").alias("p")).groupBy(*passage, F.col("p.item_slots").alias("was")).agg(F.min("p.slots").alias("a"), F.max("p.slots").alias("b")).filter("a <> b").select(*passage).distinct()
    return cover.join(broken, passage, "left_anti").select("id", "th", "item_id", (F.col("c") / F.col("n_windows")).alias("cover"))


def flagged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __items: the sorted ids of the items that each document holds, empty if none."""
    by = leaks(docs, benchmark, id_col, text_col).groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.array_sort(F.collect_set("item_id")).alias("__items"))
    # the few documents that hold items, by id and text
    by = staged(by)
    cond = F.equal_null(F.col(id_col), F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__th"))
    out = docs.join(F.broadcast(by) if fits_broadcast(by, 200) else by, cond, "left")
    return out.drop("__id", "__th").withColumn("__items", F.coalesce("__items", F.array().cast("array<bigint>")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flagged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", (F.size("__items") > 0).alias("contaminated"), F.col("__items").alias("item_ids"))
