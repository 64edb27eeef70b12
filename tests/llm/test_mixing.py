"""Mixing against a plain sequential computation, and what the schedule promises."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lakefind.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, i string, target string"


def by_hand(rows, weights=(3, 1, 2)):
    """Counter of (doc_id, size, source_size, target, taken)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full: set = set()
    while True:
        rest = [s for s in names if s not in full]
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        target = {s: 2.0 * total[s] if s in full else left / sum(w[x] for x in rest) * w[s] for s in names}
        over = {s for s in rest if target[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    out = Counter()
    for s in names:
        docs = sorted(((hashlib.md5(f"{'' if i is None else i}|{t or ''}".encode()).hexdigest()[:16], i is not None, i or 0, size(t)), i, size(t)) for i, t, x in rows if x == s)
        line = [k for _ in range(2) for k, d in enumerate(docs) for _ in range(d[2])][: int(target[s] + 0.5)]
        took = Counter(line)
        for k, (_, i, n) in enumerate(docs):
            out[i, n, total[s], round(target[s], 6), took[k]] += 1
    return out


def random_rows(seed, n=300):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 4) for _ in range(r.choice((0, 1, 30, 400)))), r.choice(["s0"] * 4 + ["a", "b", "é", "s1", "", None])) for i in range(n)]
    rows += [(n, None, "a"), (n, "", "a"), (None, "x y", None), (None, None, None), (n + 1, "   x\x0b\x1cy", "b"), (n + 2, "long " * 30_000, "c"), (n + 3, " \t\n ", "only empty")]
    return rows + [(n + 4, "the same row", "s1")] * 50


@pytest.mark.parametrize("seed", range(3))
def test_by_hand(spark, seed):
    rows = random_rows(seed)
    d = spark.createDataFrame([(*x, "k", "k", "k") for x in rows], SCHEMA).repartition(3)
    got = Counter((x.doc_id, x["size"], x.source_size, round(x.target, 6), x.taken) for x in mixing.taken(d).collect())
    assert got == by_hand(rows)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = spark.createDataFrame([(*x, "k", "k", "k") for x in random_rows(9, 120)], SCHEMA)
    assert Counter(mixing.taken(rows.repartition(7)).collect()) == Counter(mixing.taken(rows.coalesce(1)).collect())


def test_schedule_keeps_to_the_targets_all_along(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "GROUP", 16)
    monkeypatch.setattr(mixing, "GROUPS", 4)
    rows = random_rows(4, 200)
    d = spark.createDataFrame([(*x, "k", "k", "k") for x in rows], SCHEMA).repartition(3)
    documents, pieces = mixing.mixed(d)
    at = {r.row: r for r in documents.collect()}
    slots = defaultdict(list)
    for p in pieces.collect():
        slots[p.slot].append((p.place, p.row, p.first, p.last))
    source = {k: {at[r].i for _, r, _, _ in v} for k, v in slots.items()}
    assert all(len(x) == 1 for x in source.values()), "a slot has words of one source"
    order = [source[k].copy().pop() for k in sorted(source)]
    share = Counter(order)
    for i, n in share.items():
        seen = 0
        for k, x in enumerate(order, 1):
            seen += x == i
            assert abs(seen - k * n / len(order)) < 8, "no source runs ahead of its share"
    words = [sum(last - first for _, _, first, last in v) for v in slots.values()]
    assert sum(n < 8 for n in words) <= len(share), "only a source's last block is cut"
    assert Counter((at[r].id, at[r]["size"], at[r].source_size, round(at[r].target, 6), n) for r, n in ((r, sum(y - x for v in slots.values() for _, q, x, y in v if q == r)) for r in at)) == by_hand(rows)


def test_empty_and_wordless_tables(spark):
    assert mixing.taken(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, None, "a", "", "", ""), (2, " ", None, "", "", "")], SCHEMA)
    assert Counter((r.doc_id, r["size"], r.target, r.taken) for r in mixing.taken(none).collect()) == Counter({(1, 0, 0.0, 0): 1, (2, 0, 0.0, 0): 1})


def test_native(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.taken(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert mixing.taken(d).agg(F.sum("taken") / F.sum("size")).first()[0] == pytest.approx(1.5, rel=1e-3)
