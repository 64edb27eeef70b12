"""Words of texts without spaces: a lexicon learnt from the corpus, and the best path over each run's word graph.

Learning counts the grams of all runs once, up to one character more than a word may have; everything else follows from those counts: how much more often
a gram stands than its parts would by chance (cohesion, at its weakest joint), and how free its neighbours are on either side (entropy), where
the neighbours of a gram are the counted grams that are longer by one. The lexicon is bounded, so it goes to every task; there a run is cut where the product
of its words' shares is greatest.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cjk
from ..functions.text import CJK, LATIN, STOP, tokens

#: Characters of a word; occurrences, cohesion and entropy of a word of several characters; words of a lexicon, which every task holds.
LONGEST, LEAST, COHESION, ENTROPY, MOST = 4, 5, 2.0, 1.0, 500_000


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CJK), F.lit(0))


def grams(docs: DataFrame, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(gram, c): how often each gram of up to `longest` + 1 characters stands in the runs of all texts."""
    # what starts at each character comes together at its greatest length before it is cut shorter
    heads = docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(cjk.heads(longest + 1), "head string, c long").groupBy("head").agg(F.sum("c").alias("c"))
    return heads.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("head")), lambda k: F.substring("head", F.lit(1), k))).alias("gram"), "c").groupBy("gram").agg(F.sum("c").alias("c"))


def measured(g: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """g (grams, staged) -> (word, c, cohesion, left, right) of grams of two characters or more that stand `least` times."""
    n = F.length("gram")
    total = g.filter(n == 1).agg(F.sum("c")).first()[0] or 0
    w = g.filter((n >= 2) & (n <= longest) & (F.col("c") >= least)).withColumnRenamed("gram", "word")
    joint = w.select("word", "c", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    joint = joint.select("word", "c", F.substring("word", F.lit(1), F.col("k")).alias("head"), F.expr("substring(word, k + 1)").alias("rest"))
    part = lambda name: g.select(F.col("gram").alias(name), F.col("c").alias(f"{name}_c"))
    joint = joint.join(part("head"), "head").join(part("rest"), "rest")
    chance = F.col("head_c").cast("double") * F.col("rest_c") / F.lit(float(total))
    out = w.join(joint.groupBy("word").agg(F.min(F.ln(F.col("c") / chance)).alias("cohesion")), "word")
    # entropy of neighbours: each edge of a run counts as a neighbour of its own
    longer = g.filter((n >= 3) & (n <= longest + 1))
    for side, word in (("right", F.expr("substring(gram, 1, length(gram) - 1)")), ("left", F.expr("substring(gram, 2)"))):
        near = longer.select(word.alias("word"), "c").groupBy("word").agg(F.sum(F.col("c") * F.ln("c")).alias("s"))
        out = out.join(near, "word", "left").withColumn(side, F.ln("c") - F.coalesce("s", F.lit(0.0)) / F.col("c")).drop("s")
    return out.select("word", "c", *(F.round(x, 6).alias(x) for x in ("cohesion", "left", "right")))


def lexicon(m: DataFrame, g: DataFrame, cohesion: float = COHESION, entropy: float = ENTROPY, most: int = MOST) -> DataFrame:
    """(word, c): the measured grams that are words, and every single character; the `most` most frequent."""
    words = m.filter((F.col("cohesion") >= cohesion) & (F.least("left", "right") >= entropy)).select("word", "c")
    return words.unionByName(g.filter(F.length("gram") == 1).select(F.col("gram").alias("word"), "c")).orderBy(F.desc("c"), "word").limit(most)


def learnt(docs: DataFrame, staged: Callable[[DataFrame], DataFrame], text: str = "text", **limits) -> DataFrame:
    """The lexicon of a corpus. staged: writes a table and reads it back."""
    g = staged(grams(docs, text))
    return staged(lexicon(measured(g), g, **limits))


class Words:
    """A lexicon in a task."""

    def __init__(self, counts: dict[str, int]):
        total = math.log(max(1, sum(counts.values())))
        self.share = {w: math.log(c) - total for w, c in counts.items() if c > 0}
        self.longest, self.unknown = max(map(len, self.share), default=1), -total

    def cut(self, run: str) -> list[str]:
        """The words of the best path; of equal ones the longer first word. A character that isn't known counts once."""
        n, get, unknown, longest = len(run), self.share.get, self.unknown, self.longest
        best, end = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            top, at = get(run[i], unknown) + best[i + 1], i + 1
            for j in range(i + 2, min(i + longest, n) + 1):
                s = get(run[i:j])
                if s is not None and s + best[j] >= top:
                    top, at = s + best[j], j
            best[i], end[i] = top, at
        out, i = [], 0
        while i < n:
            out.append(run[i : end[i]])
            i = end[i]
        return out


def cutter(lex: DataFrame) -> Callable[[Column], Column]:
    """A function from runs to their words, in Arrow batches. The lexicon (MOST words at most) goes to every task."""
    sent = lex.sparkSession.sparkContext.broadcast(Words({r.word: r.c for r in lex.select("word", "c").collect()}))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(found: pd.Series) -> pd.Series:
        words = sent.value
        return found.map(lambda rs: None if rs is None else [w for r in rs for w in words.cut(r)])

    return cut



class Tokens:
    """text.tokens with the words of a lexicon, as a column; or, where it has no longer words than a key holds, the tokens of a task's batches by number (see lexical.Asked.counted)."""

    def __init__(self, lex: DataFrame):
        words = Words({r.word: r.c for r in lex.select("word", "c").collect()})
        sc = lex.sparkSession.sparkContext
        self.words = cutter(lex)
        self.sent = sc.broadcast(cjk.Cuts(list(words.share), np.array(list(words.share.values())), words.unknown)) if words.longest <= cjk.ROOM else None

    def __call__(self, text: Column) -> Column:
        return tokens(text, words=self.words)

    @staticmethod
    def latin(text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(LATIN), F.lit(0))

    def further(self, terms: list[str]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A function for tasks: texts -> (row, number among terms) of their CJK tokens that are terms, and how many CJK tokens each row has."""
        sent = self.sent
        made: list = []

        def found(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not made:
                key = cjk.keys(terms)
                some = np.flatnonzero(key)
                stop = np.zeros(cjk.LAST - cjk.FIRST + 2, bool)
                stop[[ord(x) - cjk.FIRST + 1 for x in STOP]] = True
                made.append((sent.value, cjk.Numbers(key[some]), np.append(some, -1), stop))
            cuts, asked, number, stop = made[0]
            c, start, row = cjk.characters(texts)
            # a run has a pair less than characters
            n = np.bincount(row, np.diff(start) - 1, len(texts)).astype(np.int64)
            row = np.repeat(row, np.diff(start))
            rows, ats = [], []
            for lo, window, at, size in cuts.pieces(c, start):
                kept = (size > 1) | ~stop[c[lo + at]]
                at, size = at[kept], size[kept]
                n += np.bincount(row[lo + at], minlength=len(n))
                pair = np.flatnonzero(window >= np.uint64(1 << cjk.BITS))
                for key, place in ((window[at] & cjk.MASKS[size], at), (window[pair] & cjk.MASKS[2], pair)):
                    got = number[asked.find(key)]
                    on = np.flatnonzero(got >= 0)
                    rows.append(row[lo + place[on]])
                    ats.append(got[on])
            none = [np.zeros(0, np.int64)]
            return np.concatenate(rows or none), np.concatenate(ats or none), n

        return found
