"""Runs taken as arrays: the same grams, words and searches as by one run or one column at a time."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakefind.functions import cjk
from lakefind.functions import text as X
from lakefind.operators import lexical, segmentation

ODD = [None, "", "only latin 12", "一", "龥x一二,三㐀ꀀ四", "é天地天🙂地，人"]


def texts(seed, n=300, signs="天地人水火的", long=9000):
    r = random.Random(seed)
    return ODD + ["".join(r.choice(signs + "a. ") if r.random() < 0.1 else r.choice(signs) for _ in range(r.randint(0, 200))) for _ in range(n)] + ["".join(r.choice(signs) for _ in range(long))]


@pytest.mark.parametrize("seed", range(3))
def test_words_as_by_one_run_at_a_time(seed, monkeypatch):
    r = random.Random(seed)
    counts = {"".join(r.choice("天地人水的") for _ in range(r.randint(1, 4))): r.randint(1, 6) for _ in range(40)}
    words = segmentation.Words(counts)
    cuts = cjk.Cuts(list(words.share), np.array(list(words.share.values())), words.unknown)
    monkeypatch.setattr(cjk, "CUT", 700)
    some = texts(seed)
    c, start, row = cjk.characters(pa.array(some)[2:])
    got = [[] for _ in some]
    at_row = np.repeat(row, np.diff(start)) + 2
    for lo, _, at, size in cuts.pieces(c, start):
        for i, n in zip(at + lo, size, strict=True):
            got[at_row[i]].append("".join(chr(x + cjk.FIRST - 1) for x in c[i : i + n].tolist()))
    import re

    assert got == [[w for run in re.findall(X.CJK, t or "") for w in words.cut(run)] for t in some]


@pytest.mark.parametrize("signs", ["天地人水", "".join(chr(0x4E00 + k) for k in range(20992))])
def test_grams_of_few_and_of_many_characters(spark, signs, monkeypatch):
    import re

    some = texts(5, 40, signs, 12_000)
    want = Counter(x[i : i + n] for t in some for x in re.findall(X.CJK, t or "") for n in range(1, 6) for i in range(len(x) - n + 1))
    d = spark.createDataFrame([(t,) for t in some], "text string")
    assert {r.gram: r.c for r in segmentation.grams(d).collect()} == want
    c, start, _ = cjk.characters(pa.array(some))
    whole = Counter()
    for rows, n in cjk.counted(c, cjk._left(start), 7, 0, len(c)):
        whole.update(dict(zip(cjk.strings(rows).to_pylist(), n.tolist(), strict=True)))
    assert whole == Counter(x[i : i + 7] for t in some for x in re.findall(X.CJK, t or "") for i in range(len(x)))


def test_search_as_by_columns(spark):
    some = texts(8)
    d = spark.createDataFrame([("l", k, t) for k, t in enumerate(some)], "library_id string, doc_id long, text string").repartition(3)
    lex = spark.createDataFrame([("天地", 40), ("地人水", 9), ("的", 80), ("天", 30), ("水火的天", 5), ("火", 7)], "word string, c long")
    q = spark.createDataFrame([(1, "天地人水火的天"), (2, "火 only latin"), (3, "的"), (4, "龥 12")], "item_id long, text string")
    cut = segmentation.Tokens(lex)
    rows = lambda c: sorted(map(tuple, lexical.bm25(q, d, 9, cut=c).collect()))
    got = rows(cut)
    assert got == rows(lambda t: X.tokens(t, words=cut.words)) and {r[0] for r in got} >= {1, 2}


def test_a_million_characters_are_cut_in_a_few_seconds():
    r = random.Random(2)
    words = segmentation.Words({"".join(r.choice("天地人水火的") for _ in range(r.randint(1, 4))): r.randint(1, 99) for _ in range(300)})
    cuts = cjk.Cuts(list(words.share), np.array(list(words.share.values())), words.unknown)
    c, start, _ = cjk.characters(pa.array(["。".join("".join(r.choices("天地人水火的", k=60)) for _ in range(200)) for _ in range(84)]))
    began = time.process_time()
    assert sum(int(size.sum()) for *_, size in cuts.pieces(c, start)) == len(c) > 1_000_000
    assert time.process_time() - began < 2
