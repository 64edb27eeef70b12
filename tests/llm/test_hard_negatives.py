"""Dual-tree search against scoring everything, and that it prunes where there is something to prune."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefind.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, v string, cell string"


def by_hand(rows):
    """Counter of the result's rows; rows (vec_id, embedding, label)."""
    v = []
    for n, (i, e, label) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = Counter()
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for n, i, label, e in v:
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(e, f, strict=False)), j, m, k) for m, j, k, f in v if m != n]
        for p, j, _, _ in sorted((s for s in scored if s[3] == label), key=order)[:5]:
            for rank, s in enumerate(sorted((s for s in scored if s[3] != label and 80 * p <= 100 * s[0] <= 100 * p), key=order)[:5], 1):
                out[i, j, rank, s[1], p, s[0]] += 1
    return out


def result(spark, rows, n=3):
    d = spark.createDataFrame([(*x, "k", "k", "k") for x in rows], SCHEMA).repartition(n)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return h.mined(h.usable(d, F.col("vec_id"), label, F.col("embedding"), F.col("vec_id") % 100 == 0))


def vectors(seed, n, dim=8, hubs=12):
    r = random.Random(seed)
    at = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(hubs)]
    return [(i, [x + r.gauss(0, 0.3) for x in r.choice(at)], r.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_by_hand(spark, seed, monkeypatch):
    monkeypatch.setattr(h, "SAMPLE", 60)
    monkeypatch.setattr(h, "LEAVES", (4, 8))
    rows = vectors(seed, 900)
    odd = [(i, [1.0] * 8, 3) for i in range(1000, 1120)]  # many equal vectors
    odd += [(1200, None, 1), (1201, [float("nan")] * 8, 2), (1202, [float("inf")] + [0.0] * 7, 2), (1203, [None] * 8, 2), (1204, [0.5] * 8, None), (1300, [], 4), (1301, [2.0, 1.0], 4), (None, [1.0] * 8, 5), (1400, [0.0] * 8, 6), (1500, [-1.0] * 8, 3)]
    rows += odd + rows[:3] + rows[100:101]
    assert Counter(tuple(x) for x in result(spark, rows).collect()) == by_hand(rows)


def test_rounds_and_long_integers(spark, monkeypatch):
    monkeypatch.setattr(h, "ROUND", 1000)
    rows = [(i, [x * 2.0**20 for x in e], k) for i, e, k in vectors(7, 700)]
    assert max(x for r in by_hand(rows) for x in r[4:]) > 2**53
    assert Counter(tuple(x) for x in result(spark, rows).collect()) == by_hand(rows)
    with pytest.raises(ValueError, match="64-bit"):
        result(spark, [(0, [2.0**40], 1), (1, [2.0**40], 1)])


def test_empty(spark):
    assert result(spark, []).collect() == []
    assert result(spark, [(1, [1.0], 2), (2, [1.0], 3)]).collect() == []
    assert result(spark, [(100, [1.0], 2)]).collect() == []


def test_pairs_of_nodes_are_pruned(monkeypatch):
    monkeypatch.setattr(h, "LEAVES", (4, 64))
    r = np.random.default_rng(3)
    hubs = r.normal(0, 1, (40, 16))
    hubs *= 1000 / np.linalg.norm(hubs, axis=1, keepdims=True)
    x = np.floor(hubs[np.sort(r.integers(0, 40, 8000))] + r.normal(0, 6, (8000, 16)))
    n = np.arange(8000)
    a = h.Anchors(n[::100], n[::100], np.zeros(80, np.int64), x[::100])
    a.trees()
    s = h.Search(a, 5)
    s.block(n, n, np.zeros(8000, np.int64), x)
    want = np.sort(np.where(n == n[::100, None], -np.inf, x[::100] @ x.T), axis=1)[:, ::-1][:, :5]
    assert (s.best.held[1].reshape(80, 5) == want).all()
    assert s.scored < s.possible / 2


def test_whole_table(spark):
    import duckdb

    p = "/root/testdata/sf0.01/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{p}'")
    assert Counter(tuple(r) for r in h.op12_hard_negatives(spark, "/root/testdata/sf0.01").collect()) == Counter(con.sql(h.ORACLE_SQL).fetchall())
