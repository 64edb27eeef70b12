"""Classifiers: held-out accuracy, bounded samples, defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefind.llm import labelled, quality, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op4_toxicity, "toxic", 0.95), (quality.op6_quality, "quality", 0.95)])
def test_held_out_rows(spark, query, label, least):
    s = query(spark, SF)
    t = s.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter(F.col(label).isin(0, 1)).select("score", "predicted", label).toPandas()
    y = t[label].to_numpy()
    assert auc(t.score.to_numpy(), y) > least and ((t.predicted == 1) == (y == 1)).mean() > 0.9
    assert s.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and s.filter("score is null or score < 0 or score > 1").count() == 0


def small(spark):
    bad = [(i, f"you horrible filthy trash number {i} go away", "k") for i in range(40)]
    good = [(100 + i, f"the garden was quiet in the morning of day {i}", "k") for i in range(40)]
    docs = spark.createDataFrame([*bad, *good, (900, None, "k"), (901, "", "k"), (None, "filthy horrible trash", "k"), (902, "the quiet garden " * 30_000, "k"), (5, "again", "k")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 40), int(i < 40)) for i, *_ in bad + good] + [(None, 1, 1), (7, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_rows(spark):
    docs, labels = small(spark)
    m = toxicity.learnt(docs, labels)
    got = toxicity.scored(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.harmless(docs, m)
    assert kept.columns == docs.columns
    # every row is judged by itself: one of a null id too
    n = {r.doc_id: r["n"] for r in kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert None not in n and 902 in n and sum(i < 40 for i in n if i is not None) <= 1
    # the model says what its maxima over all windows say
    vocab, text = toxicity.Vocabulary(), "you horrible filthy trash go away"
    ids = np.array([vocab[w] for w in text.split()])
    e = m.embed[np.array(vocab.rows)].sum(1)
    top = [max(0.0, max(float(sum(e[ids[i + k]] @ f[k][:, j] for k in range(len(f)))) + b[j] for i in range(len(ids) - len(f) + 1))) for f, b in zip(m.filters, m.bias) for j in range(toxicity.FILTERS)]
    want = 1 / (1 + np.exp(-(np.array(top) @ m.out + m.b + m.shift[toxicity.language(text.split())])))
    one = toxicity.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), m).first().score
    assert abs(one - want) < 1e-4
    assert toxicity.scored(docs.limit(0), m).count() == toxicity.harmless(docs.limit(0), m).count() == 0


def test_few_labels(spark):
    docs, labels = small(spark)
    none = toxicity.learnt(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.5}
    ones = toxicity.learnt(docs, labels.filter("toxic = 1"))
    assert {r.score for r in toxicity.scored(docs, ones).collect()} == {1.0}
    q = quality.Quadratic(np.zeros((0, 19)), np.zeros(0))
    assert {r.score for r in quality.scored(docs, q).collect()} == {0.5} and quality.scored(docs.limit(0), q).count() == 0


def test_quadratic_by_its_formula():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(80, 19)) + (np.arange(80) % 2)[:, None], np.arange(80) % 2
    m = quality.Quadratic(x, y)
    z, out = np.clip((x - m.at) / m.scale, -6, 6), []
    for c in (0, 1):
        s = np.linalg.inv(m.factor[c].T @ m.factor[c])
        d = z - m.mean[c]
        out.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-np.clip(m.slope * (out[1] - out[0] + m.log_odds), -30, 30)))
    assert np.allclose(m.score(x), want, atol=1e-6)
    assert quality.statistics("") == [0.0] * 19


def test_sample_bounds(spark, monkeypatch):
    docs, labels = small(spark)
    texts, y = labelled.sample(docs, labels, "toxic", F.lit(True), 7)
    assert len(texts) == 14 and y.sum() == 7
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 200)
    texts, y = labelled.sample(docs, labels, "toxic", F.lit(True), 1000)
    assert 0 < sum(len(t) for t, v in zip(texts, y) if v) <= 200 and 0 < sum(len(t) for t, v in zip(texts, y) if not v) <= 200


def test_a_long_text_takes_no_place_of_others(spark, monkeypatch):
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 4000)
    docs = spark.createDataFrame([(i, "x" * (4001 if i % 9 == 0 else 1000 if i % 9 == 1 else 20)) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 45)) for i in range(90)], "doc_id long, toxic int")
    texts, y = labelled.sample(docs, labels, "toxic", F.lit(True), 1000)
    assert len(texts) == 70 and set(map(len, texts)) == {20}
    assert labelled.fitting([(1, 3000), (2, 5000)]) == [1] and labelled.fitting([(2, 5000)]) == [] and labelled.fitting([]) == []


def test_quality_of_very_long_texts(spark):
    long = "the garden was quiet in the morning. " * 60_000
    m = quality.Quadratic(np.array([quality.statistics(t) for t in ["a b c d. " * k for k in range(1, 30)] + ["!!!| x\n" * k for k in range(1, 30)]]), np.repeat([1, 0], 29))
    got = quality.scored(spark.createDataFrame([(1, long), (2, long.replace(" ", ""))], "doc_id long, text string"), m).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)
