"""Convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of those of its hashed features (the word, its first 4 and 5 letters). Filters of several widths run over the embedded words,
each keeps its maximum over the whole text, and a logistic layer weighs the maxima. A filter's response is a sum of
one product for each word of its window, so products are made once for each distinct word. Thresholds are calibrated
for each language, inferred from the text's function words alone: each language's best threshold on rows held back from training
is moved to THRESHOLD.

Labels are learnt from all labelled rows outside the fold that is held out; texts are whole. They are cut into words and coded once, a number for each
word. In each pass over the codes a task begins with the common model and
goes through its own rows by stochastic gradient steps; then what tasks have changed is averaged, embeddings over the tasks that met a feature. Counts
of features and thresholds are sums over all rows. Only a model's weights, a count for each feature and a threshold for each language reach the driver.
Defined results: null and empty texts get the score of no words. One class: its label is every score; no labels: 0.5. Rows
with equal or null ids are scored each; a label row of a null id is left out, of several for one id the greatest label counts.
"""

from __future__ import annotations

import copy
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running
from . import hashing as H
from .common import give_back, lean, slices, staged, table
from .labelled import fold, labelled

THRESHOLD = 0.3
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 12, (1, 2, 3)
RATE, DECAY = 0.15, 1e-5
#: Passes over the rows: as many as make VISITS visits of rows, within bounds. Rows of a gradient step; rows for each of at most MOST_TASKS tasks.
VISITS, PASSES, STEP, TASK_ROWS, MOST_TASKS = 60_000, (3, 12), 64, 8000, 128
#: One row in HELD is held back from training, for thresholds.
HELD = 5
#: Pieces of the embedding that are averaged by themselves.
PIECES = 16
#: Fixed lists: frequent function words by which a text's language is inferred.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as be this have from or by",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans sur pas au plus par",
    "es": "de la que el en y a los se del las un por con no una su para es al lo",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
#: Words a worker remembers, and beginnings of words.
MEMO = 300_000
#: Words whose windows are made at once, unless one text has more.
WINDOWS = 1 << 15
#: A word's code: its features, FEATURE bits each, and above them a bit for each language that lists it.
FEATURE = 17
MARKS = ".,;:!?\"'()[]*#&%$|"
LISTED: dict[str, int] = {}
for _bit, _words in enumerate(FUNCTION_WORDS.values()):
    for _word in _words.split():
        LISTED[_word] = LISTED.get(_word, 0) | 1 << 3 * FEATURE + _bit


#: Of a word's UTF-8.
hashed = xxhash.xxh3_64_intdigest


def features(word: str) -> list[int]:
    w = word.strip(MARKS)
    return [hashed(x) % BUCKETS for x in dict.fromkeys((w, f"^{w[:4]}", f"^{w[:5]}"))]


def _packed(f: list[int]) -> int:
    return sum(x << k * FEATURE for k, x in enumerate(f + [BUCKETS] * (3 - len(f))))


def unpacked(codes: np.ndarray) -> np.ndarray:
    """Codes of words to rows of feature ids, padded with BUCKETS."""
    return np.stack([codes >> k * FEATURE & (1 << FEATURE) - 1 for k in range(3)], -1)


class Vocabulary(dict):
    """Words to numbers, 0, 1, … in the order they are met, each with its code. Beginnings are kept with their features: most words share theirs with others."""

    def __init__(self):
        self.codes = array("q")
        self.begun: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        w = word.strip(MARKS)
        rest = self.begun.get(w[:5])
        if rest is None:
            rest = self._beginning(w[:5])
        # a word of ^ alone may be one of its own beginnings
        code = _packed(features(word)) if w[:1] == "^" else rest | hashed(w) % BUCKETS
        self[word] = k = len(self)
        self.codes.append(code | LISTED[word] if word in LISTED else code)
        return k

    def _beginning(self, start: str) -> int:
        if len(self.begun) >= MEMO:
            self.begun.clear()
        out = self.begun[start] = _packed([0, *(hashed(x) % BUCKETS for x in dict.fromkeys((f"^{start[:4]}", f"^{start}")))])
        return out

    def forget(self) -> None:
        """Words go, beginnings stay."""
        self.clear()
        self.codes = array("q")

    def coded(self) -> np.ndarray:
        return np.array(self.codes, np.int64)

    @property
    def rows(self) -> np.ndarray:
        return unpacked(self.coded())

    def read(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of a column of texts, and where each text's begin and end."""
        if len(self) > MEMO:
            self.forget()
        words = [(t or "").lower().split() for t in text.to_pylist()]
        at = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, at[-1]), at


def language(words: list[str]) -> int:
    s = {}
    for w in words:
        s[w] = s.get(w, 0) + 1
    hits = [sum(s.get(w, 0) for w in lst.split()) for lst in FUNCTION_WORDS.values()]
    best = int(np.argmax(hits))
    return best if hits[best] * 20 >= len(words) and hits[best] else len(FUNCTION_WORDS)


def languages(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What `language` says of each text, from its words' codes."""
    hits = []
    for k in range(len(FUNCTION_WORDS)):
        n = np.concatenate(([0], np.cumsum(codes >> 3 * FEATURE + k & 1)))
        hits.append(n[at[1:]] - n[at[:-1]])
    best = np.argmax(hits, 0)
    most = np.max(hits, 0)
    return np.where((most * 20 >= np.diff(at)) & (most > 0), best, len(FUNCTION_WORDS))


class Model:
    """embed (BUCKETS + 1, DIM), the last row zero; filters of each width; out weights over all maxima."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = (r.normal(size=(BUCKETS + 1, DIM)) * 0.05).astype(np.float32)
        self.embed[BUCKETS] = 0
        self.filters = [(r.normal(size=(w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (r.normal(size=len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.b = np.float32(0)
        self.shift = np.zeros(len(LANGUAGES), np.float32)
        self.only: float | None = None

    def products(self, rows: np.ndarray) -> list[list[np.ndarray]]:
        """For each width and place in the window: the product of each distinct word's embedding with the filters."""
        e = self.embed[rows].sum(1)
        return [[e @ f[k] for k in range(len(f))] for f in self.filters]

    def maxima(self, ids: np.ndarray, at: np.ndarray, products) -> tuple[np.ndarray, np.ndarray]:
        """For each text, whose word ids begin and end at `at`, the maxima of all filters, and the first place of each among ids; no window: 0, -1."""
        n = len(at) - 1
        top, place = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.full((n, len(WIDTHS) * FILTERS), -1)
        for j, c, starts, ends, texts, first in self._windows(ids, at, products):
            s = slice(j * FILTERS, (j + 1) * FILTERS)
            most = _most(c, starts, ends)
            top[texts, s] = np.maximum(most + self.bias[j], 0)
            span = np.diff(starts, append=len(c))
            span[0] += starts[0]
            row, k = np.divmod(np.flatnonzero(c == np.repeat(most, span, axis=0)), FILTERS)
            of = np.searchsorted(starts, row, "right") - 1
            some = (of >= 0) & (row < ends[of])
            # the last that is written stays
            place[texts[of[some]][::-1], s.start + k[some][::-1]] = first + row[some][::-1]
        return top, np.where(top > 0, place, -1)

    def tops(self, ids: np.ndarray, at: np.ndarray, products) -> np.ndarray:
        """The maxima without their places."""
        top = np.zeros((len(at) - 1, len(WIDTHS) * FILTERS), np.float32)
        for j, c, starts, ends, texts, _ in self._windows(ids, at, products):
            top[texts, j * FILTERS : (j + 1) * FILTERS] = np.maximum(_most(c, starts, ends) + self.bias[j], 0)
        return top

    def _windows(self, ids: np.ndarray, at: np.ndarray, products):
        """For groups of texts and each width: its number, the filters' responses at all places, where those of each text that has a window begin and end, which texts these are, and the first place."""
        for a, b in H.groups(at, WINDOWS):
            own, begins = ids[at[a] : at[b]], at[a : b + 1] - at[a]
            for j, p in enumerate(products):
                over = len(p) - 1
                texts = np.flatnonzero(np.diff(begins) > over)
                if not len(texts):
                    continue
                n = len(own) - over
                c = p[0].take(own[:n], 0)
                for k in range(1, len(p)):
                    c += p[k].take(own[k : k + n], 0)
                yield j, c, begins[texts], begins[texts + 1] - over, a + texts, at[a]

    def logits(self, codes: np.ndarray, ids: np.ndarray, at: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The logit of each text; codes: of distinct words, of which ids are numbers."""
        return (self.tops(ids, at, self.products(unpacked(codes))) @ self.out + self.b).astype(np.float64) + self.shift[lang]

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.out, np.array([self.b])]

    def moved(self, by: np.ndarray) -> None:
        """Adds changes of the dense weights, all in one row."""
        for w in (*self.filters, *self.bias, self.out):
            w += by[: w.size].reshape(w.shape)
            by = by[w.size :]
        self.b += np.float32(by[0])

    def step(self, codes: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """A gradient step over some texts, whose words' codes begin and end at `at`."""
        used, ids = np.unique(codes, return_inverse=True)
        rows = unpacked(used)
        p, e = self.products(rows), self.embed[rows].sum(1)
        top, place = self.maxima(ids, at, p)
        g = (1 / (1 + np.exp(-(top @ self.out + self.b).astype(np.float64))) - y) * weight[y]
        back = np.where(place >= 0, g[:, None] * self.out, 0).astype(np.float32)
        g_out, g_b, g_e = g @ top, g.sum(), np.zeros((len(used), DIM), np.float32)
        g_f, g_bias = [np.zeros_like(f) for f in self.filters], back.sum(0)
        for j, f in enumerate(self.filters):
            s = slice(j * FILTERS, (j + 1) * FILTERS)
            text, k = np.nonzero(place[:, s] >= 0)
            gr, first = back[:, s][text, k], place[:, s][text, k]
            for i in range(len(f)):
                w = ids[first + i]
                np.add.at(g_f[j][i].T, k, e[w] * gr[:, None])
                np.add.at(g_e, w, f[i].T[k] * gr[:, None])
        n = len(y)
        self.out -= (rate * (g_out / n + DECAY * self.out)).astype(np.float32)
        self.b -= np.float32(rate * g_b / n)
        for j in range(len(WIDTHS)):
            self.filters[j] -= rate * (g_f[j] / n + DECAY * self.filters[j])
            self.bias[j] -= rate * g_bias[j * FILTERS : (j + 1) * FILTERS] / n
        hot = np.flatnonzero(np.abs(g_e).sum(1))
        np.subtract.at(self.embed, rows[hot].ravel(), np.repeat(rate * g_e[hot] / n * 4, 3, axis=0))
        self.embed[BUCKETS] = 0


def _most(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The maxima of rows from each start to its end; ends are after starts and not after the next one."""
    cuts = np.stack((starts, ends), 1).ravel()
    return np.maximum.reduceat(c, cuts[:-1] if cuts[-1] == len(c) else cuts, axis=0)[::2]


def coded(rows: DataFrame) -> DataFrame:
    """rows (h, text, y) -> (h, y, w): for each text the codes of its words, 8 bytes each. Texts are read here and not again."""

    def run(batches):
        vocab = Vocabulary()
        for b in (x for batch in batches for x in slices(batch)):
            ids, at = vocab.read(b.column("text"))
            codes = vocab.coded()[ids]
            w = pa.array([codes[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), w], names=["h", "y", "w"])

    return rows.mapInArrow(lean(run), "h long, y int, w binary")


def _read(batches, most: int | None = None):
    """(codes, where each text's begin and end, y) of slices of coded rows; most: of so many texts each, but for the last."""
    held: list[bytes] = []
    y: list[int] = []
    size = 0

    def made(k: int):
        at = np.concatenate(([0], np.cumsum([len(w) // 8 for w in held[:k]], dtype=np.int64)))
        return np.frombuffer(b"".join(held[:k]), np.int64), at, np.array(y[:k])

    for b in batches:
        for w, own in zip(b.column("w"), b.column("y").to_pylist(), strict=True):
            held.append(w.as_py())
            y.append(own)
            size += len(held[-1])
            if len(held) == most or most is None and size >= 1 << 20:
                yield made(len(held))
                held, y, size = [], [], 0
    if held:
        yield made(len(held))


def _begun(fit: DataFrame, n: np.ndarray) -> Model:
    """A start that knows what features lean to: the first dimension holds their log-odds over the rows that are fitted."""

    def run(batches):
        seen = np.zeros((2, BUCKETS + 1), np.int64)
        for codes, at, y in _read(batches):
            text = np.repeat(np.arange(len(y)), np.diff(at))
            text, f = np.divmod(np.unique(text[:, None] * (BUCKETS + 1) + unpacked(codes)), BUCKETS + 1)
            for k in (0, 1):
                seen[k] += np.bincount(f[y[text] == k], minlength=BUCKETS + 1)
        on = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(seen[0, on]), pa.array(seen[1, on])], names=["f", "n0", "n1"])

    seen = np.zeros((2, BUCKETS + 1))
    for r in fit.mapInArrow(lean(run), "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toLocalIterator():
        seen[:, r.f] = r.n0, r.n1
    m = Model()
    odds = np.log((seen[1] + 0.5) / (max(n[1], 1) + 1)) - np.log((seen[0] + 0.5) / (max(n[0], 1) + 1))
    odds = np.where(seen[0] + seen[1] >= 2, np.clip(odds, -1, 4), 0)
    m.embed[:, 0] = odds * 0.5
    m.embed[BUCKETS] = 0
    for f in m.filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.3
    for b in m.bias:
        b -= 0.5
    return m


def _passed(fit: DataFrame, m: Model, weight: np.ndarray, rate: float) -> None:
    """A pass over all rows that changes m."""
    sent = fit.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        was, own, n = sent.value, copy.deepcopy(sent.value), 0
        for codes, at, y in _read(batches, STEP):
            own.step(codes, at, y, weight, rate)
            n += len(y)
        if n:
            by = [*np.array_split(own.embed - was.embed, PIECES), np.concatenate([(a - b).ravel() for a, b in zip(own.dense(), was.dense(), strict=True)])]
            part, k = TaskContext.get().partitionId(), len(by)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array([n] * k, pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in by], pa.binary())], names=["piece", "part", "n", "v"])

    def averaged(batches):
        held: dict[int, list] = {}
        for b in batches:
            for piece, *rest in zip(*(b.column(c).to_pylist() for c in ("piece", "part", "n", "v")), strict=True):
                held.setdefault(piece, []).append(rest)
        for piece, of in held.items():
            total, count = 0.0, 0.0
            for _, n, v in sorted(of):
                v = np.frombuffer(v, np.float32).astype(np.float64)
                v = v.reshape(-1, DIM) if piece < PIECES else v
                met = v.any(1, keepdims=True) if piece < PIECES else 1.0
                total, count = total + n * v, count + n * met
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([(total / np.maximum(count, 1)).astype(np.float32).tobytes()], pa.binary())], names=["piece", "v"])

    got = fit.mapInArrow(lean(run), "piece int, part int, n long, v binary").repartition(PIECES, "piece").mapInArrow(lean(averaged), "piece int, v binary").collect()
    by = {r.piece: np.frombuffer(bytes(r.v), np.float32) for r in got}
    sent.unpersist()
    if by:
        m.embed += np.concatenate([by[k] for k in range(PIECES)]).reshape(-1, DIM)
        m.moved(by[PIECES])


def train(rows: DataFrame) -> Model:
    """rows (h, y, w), as `coded` gives them -> the model learnt from all of them."""
    n = rows.groupBy((F.pmod("h", F.lit(HELD)) == 0).alias("held"), "y").count().collect()
    of = {held: np.array([sum(r["count"] for r in n if r.held == held and r.y == y) for y in (0, 1)], float) for held in (True, False)}
    every = of[True] + of[False]
    if not every.all():
        m = Model()
        m.only = 0.5 if not every.any() else float(every[1] > 0)
        return m
    fit, held = (rows.filter((F.pmod("h", F.lit(HELD)) == 0) == back) for back in (False, True))
    m = _begun(fit, of[False])
    share = of[False][1] / max(of[False].sum(), 1)
    weight = np.array([0.5 / max(1 - share, 1e-3), 0.5 / max(share, 1e-3)], np.float32)
    passes = int(np.clip(round(VISITS / max(of[False].sum(), 1)), *PASSES))
    for k in range(passes):
        _passed(fit, m, weight, RATE * (1 - k / passes))
    # thresholds by language on the rows held back, drawn towards the common one where a language has few
    best = thresholds(_logits(held, m))
    common, target = best.get(-1, (0.0, 0))[0], np.log(THRESHOLD / (1 - THRESHOLD))
    for k in range(len(LANGUAGES)):
        t, n1 = best.get(k, (0.0, 0))
        m.shift[k] = target - (n1 * t + 20 * common) / (n1 + 20)
    return m


def _logits(rows: DataFrame, model: Model) -> DataFrame:
    """(k, z, y): the logit of each row by its language, and again by -1 for all."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for codes, at, y in _read(batches):
            lang = languages(codes, at)
            used, ids = np.unique(codes, return_inverse=True)
            z = sent.value.logits(used, ids, at, lang)
            k = np.concatenate((lang, np.full(len(lang), -1)))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(np.concatenate((z, z)), pa.float64()), pa.array(np.concatenate((y, y)), pa.int32())], names=["k", "z", "y"])

    return rows.mapInArrow(lean(run), "k int, z double, y int")


def thresholds(logits: DataFrame) -> dict[int, tuple[float, int]]:
    """logits (k, z, y) -> for each k with both classes the logit that parts them with the best F1 (the highest such), and the rows of class 1."""
    x = staged(logits.groupBy("k", (-F.col("z")).alias("z")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("tp")))
    total = x.groupBy("k").agg(F.sum("n").alias("all"), F.sum("tp").alias("n1")).filter("n1 > 0 and n1 < all")
    x = running(running(x, ["k"], ["z"], F.col("n"), "n_before"), ["k"], ["z"], F.col("tp"), "tp_before")
    f1 = 2 * (F.col("tp_before") + F.col("tp")) / (F.col("n_before") + F.col("n") + F.col("n1"))
    best = x.join(F.broadcast(total), "k").groupBy("k", "n1").agg(F.max(F.struct(f1.alias("f1"), (-F.col("z")).alias("z"))).alias("b")).select("k", "n1", F.col("b.z").alias("at"))
    low = x.join(F.broadcast(best), "k").groupBy("k", "n1", "at").agg(F.max(F.when(-F.col("z") < F.col("at"), -F.col("z"))).alias("low")).collect()
    return {r.k: ((r.at + (r.at - 1 if r.low is None else r.low)) / 2, r.n1) for r in low}


def _scorer(sent):
    """A function from a column of texts to their scores; words are remembered between calls."""
    m, vocab = sent.value, Vocabulary()

    def score(text: pa.Array) -> np.ndarray:
        if m.only is not None:
            return np.full(len(text), m.only)
        ids, at = vocab.read(text)
        codes, met = vocab.coded(), np.zeros(len(vocab), bool)
        met[ids] = True
        lang = languages(codes[ids], at)
        return 1 / (1 + np.exp(-np.clip(m.logits(codes[met], (np.cumsum(met) - 1)[ids], at, lang), -30, 30)))

    return score


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = _scorer(sent)
        for b in (x for batch in batches for x in slices(batch)):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(score(b.column("text")), pa.float64())], names=["id", "score"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(lean(run), f"id {dict(d.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def harmless(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (with a column text) whose score is below threshold, each judged by itself, whatever its id."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = _scorer(sent)
        for b in (x for batch in batches for x in slices(batch)):
            yield b.filter(pa.array(score(b.column("text")) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def learnt(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled(docs, labels, "toxic", fold("doc_id", 4) != 2)
    n = max(1, min(labels.count() // TASK_ROWS, MOST_TASKS))
    model = train(staged(coded(rows.repartition(n, "h").sortWithinPartitions("h", "text")), "zstd"))
    give_back()
    return model


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = scored(docs, learnt(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
