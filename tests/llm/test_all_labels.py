"""Models are learnt from all labelled rows."""

import numpy as np
from pyspark.sql import functions as F

from lakefind.llm import quality, toxicity
from lakefind.llm.labelled import fold, labelled


def test_no_labelled_row_is_left_out(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 90 > 0).cast("int").alias("quality"))
    n1, n0 = (labels.filter((fold("doc_id", 3) != 1) & (F.col("quality") == y)).count() for y in (1, 0))
    m = quality.learnt(docs, labels)
    assert n1 > 4000 and abs(m.log_odds - np.log(n1 / n0)) < 1e-9  # a sample of 4,000 of a class was learnt from before
    rows = labelled(docs, labels, "quality", fold("doc_id", 3) != 1)
    assert rows.count() == n0 + n1
    x = np.array([quality.statistics(r.text) for r in rows.collect()])
    assert np.allclose(m.at, x.mean(0)) and np.allclose(m.scale, x.std(0) + 1e-6)


def test_thresholds_are_the_best_of_all_rows(spark):
    r = np.random.default_rng(5)
    rows = [(k, float(np.round(r.normal() + y, 1)), int(y)) for k in (-1, 2) for y in r.integers(0, 2, 300)] + [(4, 1.0, 1), (4, 2.0, 1)]
    got = toxicity.thresholds(spark.createDataFrame(rows, "k int, z double, y int"))
    assert set(got) == {-1, 2}
    for k, (t, n1) in got.items():
        z, y = (np.array([row[c] for row in rows if row[0] == k]) for c in (1, 2))
        f1 = lambda cut: 2 * y[z >= cut].sum() / ((z >= cut).sum() + y.sum())
        assert n1 == y.sum() and abs(f1(t) - max(f1(c) for c in z)) < 1e-12
