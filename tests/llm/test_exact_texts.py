"""BPE against tiktoken, substring dedup and near duplicates against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakefind.llm import bpe, ngram_join, substring_dedup


def test_bpe_is_tiktoken(spark):
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("t", pat_str=p.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
    r = random.Random(2)
    odd = ["", " ", "\n\n \t", "a" * 3000, "äöü ß €uro 💡💡", "日本語 текст", "don't I'll 123456 1,000", "\x00\x01", "é" * 500, "".join(chr(r.randrange(32, 0x3000)) for _ in range(4000))]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(150).collect()
    rows = [(10_000 + i, t) for i, t in enumerate(odd)] + [(d.doc_id, d.text) for d in docs] + [(None, None), (10_001, " ")]
    got = bpe.digests(spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, n_tokens string"), ranks, p.PATTERN).collect()
    want = Counter()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == want


@pytest.mark.parametrize("seed", range(3))
def test_substring_brute_force(spark, seed):
    r, width = random.Random(seed), 35
    runs = [[f"w{r.randrange(40)}" for _ in range(r.choice((34, 35, 36, 60, 90)))] for _ in range(5)]
    docs = []
    for i in range(25):
        words = []
        for _ in range(r.randint(0, 4)):
            words += r.choice(runs) if r.random() < 0.7 else [f"o{r.randrange(10**6)}" for _ in range(r.randint(1, 50))]
        docs.append((i, "  \n".join(words)))
    docs += [(50, docs[3][1]), (51, " ".join(["again"] * 80)), (52, None), (53, ""), (53, ""), (None, " ".join(runs[3] * 2))]
    seen = Counter(tuple(w[j : j + width]) for _, t in docs for w in [(t or "").split()] for j in range(len(w) - width + 1))
    want = Counter()
    for i, t in docs:
        w = (t or "").split()
        gone = {k for j in range(len(w) - width + 1) if seen[tuple(w[j : j + width])] > 1 for k in range(j, j + width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, starts string").repartition(3)
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.dedup(d).collect()) == want


def near(docs, width, percent):
    def shingles(t):
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
        return {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    return sets, label


def made(seed):
    r = random.Random(seed)
    base = [[f"t{r.randrange(300)}" for _ in range(r.choice((3, 8, 40, 120)))] for _ in range(12)]
    docs = []
    for i in range(70):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        docs.append((i, " ".join(w)))
    return [*docs, (80, None), (81, ""), (82, docs[0][1].upper())]


def test_near_duplicates_brute_force(spark):
    docs = made(1)
    _, label = near(docs, 4, 85)
    want = {i: min(docs[k][0] for k, v in enumerate(label) if v == label[n]) for n, (i, _) in enumerate(docs)}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similar(d).collect()} == want
    as_text = d.withColumn("doc_id", F.format_string("%03d", "doc_id"))
    assert {int(r.doc_id): int(r.component_id) for r in ngram_join.similar(as_text).collect()} == want
    small = d.withColumn("doc_id", F.col("doc_id").cast("smallint"))
    assert ngram_join.similar(small).dtypes[0][1] == "smallint" and ngram_join.similar(small).count() == len(docs)


def test_one_of_each(spark):
    docs = [*made(2), (None, "alpha beta gamma delta epsilon zeta eta theta"), (None, "alpha beta gamma delta epsilon zeta eta theta"), (300, "alpha beta gamma delta epsilon zeta eta theta"), (301, "one row twice and the same text in it"), (301, "one row twice and the same text in it"), (None, "only null ids here in this one"), (None, "only null ids here in this one")]
    sets, label = near(docs, 5, 80)
    got = Counter((r.doc_id, r.text, r.k) for r in ngram_join.one_of_each(spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, k string")).collect())
    ids = [i for i, _, _ in got.elements()]
    groups = {}
    for n, (i, _) in enumerate(docs):
        if sets[n]:
            groups.setdefault(label[n], []).append(i)
    want = sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)
    assert sorted((i for i, t, _ in got.elements() if t), key=str) == want and {80, 81} <= set(ids)
    assert ngram_join.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def thue_morse(n):
    one, two = "a", "b"
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


@pytest.mark.parametrize("n", [6, 10, 11, 12])
def test_regular_words_of_unequal_letters_differ(spark, n):
    """Words that any polynomial modulo 2**64 confuses."""
    x, y = thue_morse(n)
    fill = [f"w{k}" for k in range(34)]
    d = spark.createDataFrame([(1, " ".join([x, *fill])), (2, " ".join([y, *fill])), (3, " ".join(fill))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(d).collect()} == {1: 0, 2: 0, 3: 0}
    pair = spark.createDataFrame([(1, f"{x} p q r"), (2, f"{y} p q r")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similar(pair).collect()} == {1: 1, 2: 2}
