"""Lexicon and best path against brute force; how many planted words come back."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakefind.functions import text as X
from lakefind.operators import lexical, segmentation
from lakefind.storage import staged


def paths(run, words):
    """Every way to cut a run into words of the lexicon or single characters."""
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        if k == 1 or run[:k] in words:
            for rest in paths(run[k:], words):
                yield [run[:k], *rest]


@pytest.mark.parametrize("seed", range(4))
def test_best_path_is_the_best_of_all(seed):
    r = random.Random(seed)
    counts = {"".join(r.choice("天地人水") for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(12)}
    words = segmentation.Words(counts)
    value = lambda p: sum(math.log(counts[w] / sum(counts.values())) if w in counts else -math.log(sum(counts.values())) for w in p)
    for _ in range(60):
        run = "".join(r.choice("天地人水火") for _ in range(r.randint(0, 9)))
        got = words.cut(run)
        assert "".join(got) == run and abs(value(got) - max(map(value, paths(run, counts)))) < 1e-9
    assert segmentation.Words({}).cut("天地") == ["天", "地"]


def planted(n_docs=400, n_words=60, seed=1):
    r = random.Random(seed)
    signs = [chr(0x4E00 + k) for k in range(300)]
    words = list({"".join(r.sample(signs, r.choice((2, 2, 3, 4)))) for _ in range(n_words)})
    docs = []
    for i in range(n_docs):
        parts = [r.choice(words) if r.random() < 0.8 else r.choice(signs) for _ in range(r.randint(10, 60))]
        docs.append((i, parts, "".join(parts[: len(parts) // 2]) + "。" + "".join(parts[len(parts) // 2 :])))
    return words, docs


def test_planted_words_come_back(spark):
    words, docs = planted()
    d = spark.createDataFrame([(i, t) for i, _, t in docs] + [(900, None), (901, ""), (902, "only latin")], "doc_id long, text string").repartition(3)
    lex = segmentation.learnt(d, staged)
    known = {r.word for r in lex.collect()}
    assert len(known & set(words)) >= 0.95 * len(words), "recall of words"
    cut = segmentation.cutter(lex)
    got = {r.doc_id: r.w for r in d.select("doc_id", cut(segmentation.runs(F.col("text"))).alias("w")).collect()}
    assert got[900] == got[901] == got[902] == []
    ends = lambda ws: {sum(map(len, ws[: k + 1])) for k in range(len(ws))}
    hit = sum(len(ends(p) & ends(got[i])) for i, p, _ in docs)
    assert hit >= 0.95 * sum(len(p) for _, p, _ in docs) and hit >= 0.95 * sum(len(got[i]) for i, _, _ in docs), "ends of words"


def test_grams_and_measures_by_hand(spark):
    _, docs = planted(30, 12, 5)
    texts = [t for _, _, t in docs] + ["长" * 2500, "天地" * 1500]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    runs = [x for t in texts for x in t.split("。")]
    want = Counter(x[i : i + n] for x in runs for n in range(1, 6) for i in range(len(x) - n + 1))
    g = staged(segmentation.grams(d))
    assert {r.gram: r.c for r in g.collect()} == want
    total = sum(c for w, c in want.items() if len(w) == 1)
    for r in segmentation.measured(g).collect():
        c = want[r.word]
        assert c >= 5 and abs(r.cohesion - min(math.log(c * total / (want[r.word[:k]] * want[r.word[k:]])) for k in range(1, len(r.word)))) < 1e-5
        for side, near in (("right", lambda w: w[:-1]), ("left", lambda w: w[1:])):
            s = [n for w, n in want.items() if len(w) == len(r.word) + 1 and near(w) == r.word]
            h = -sum(n / c * math.log(n / c) for n in s) - (c - sum(s)) / c * math.log(1 / c)
            assert abs(r[side] - h) < 1e-5


def test_search_by_words(spark):
    words, docs = planted()
    d = spark.createDataFrame([("l", i, t) for i, _, t in docs], "library_id string, doc_id long, text string")
    cut = segmentation.cutter(segmentation.learnt(d, staged))
    q = spark.createDataFrame([(1, words[0]), (2, words[1] + words[2])], "item_id long, text string")
    by_words = lambda t: F.filter(X.tokens(t, words=cut), lambda w: F.length(w) > 0)
    for r in lexical.bm25(q, d, 5, cut=by_words).collect():
        text = docs[r.id][2]
        assert any(w in text for w in ([words[0]] if r.query_id == 1 else words[1:3]))
    p = lexical.postings(d, cut=by_words).filter(F.col("term") == words[3]).collect()
    assert len(p) >= 0.9 * sum(words[3] in parts for _, parts, _ in docs)


def test_long_runs_take_time_in_proportion(spark):
    """Pairs and grams of a run of 200,000 characters come from one pass over it."""
    import time

    from lakefind.functions.text import tokens

    n = 200_000
    d = spark.createDataFrame([(1, "".join(chr(0x4E00 + k * k % 5003) for k in range(n)))], "doc_id long, text string")
    began = time.time()
    r = d.select(tokens(F.col("text")).alias("t")).first().t
    assert len(r) == n - 1 and r[:2] == [chr(0x4E00) + chr(0x4E01), chr(0x4E01) + chr(0x4E04)]
    assert segmentation.grams(d).filter("length(gram) = 5").agg(F.sum("c")).first()[0] == n - 4
    assert time.time() - began < 60
