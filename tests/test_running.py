"""Running sums, batches and the map's order over rows that no single task holds."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefind.operators import content_map
from lakefind.operators.running import running
from lakefind.sources import extract


def test_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice("aaaab"), i, r.randint(0, 9)) for i in range(500)]
    d = spark.createDataFrame(rows, "k string, i long, x long").repartition(5)
    got = {(x.k, x.i): x.s for x in running(d, ["k"], ["i"], F.col("x"), "s").collect()}
    so_far = defaultdict(int)
    for k, i, x in rows:
        assert got[k, i] == so_far[k]
        so_far[k] += x


@pytest.mark.parametrize(("most_files", "most_pages"), [(3, 8), (1, 8), (20, 25), (5, 0)])
def test_batches_one_after_another(spark, most_files, most_pages):
    r = random.Random(most_pages)
    rows = [(k, f"{i:04}", r.choice((None, 0, 1, 2, 3, 5, 9, 30))) for k in "ab" for i in range(120)] + [("c", "x", 4)]
    got = {(x.library_id, x.path): x.batch for x in extract.batches(spark.createDataFrame(rows, "library_id string, path string, pages int"), most_files, most_pages).collect()}
    want, state = {}, {}
    for k, path, p in rows:
        b, n, s, shut = state.get(k, (-1, 0, 0, True))
        alone = most_files <= 1 or p is None or p > most_pages
        if alone or shut or n >= most_files or s + p > most_pages:
            b, n, s = b + 1, 0, 0
        state[k] = (b, n + 1, s + (p or 0), alone)
        want[k, path] = b
    assert got == want


def test_map_in_parts(spark, monkeypatch):
    r = np.random.default_rng(3)
    centre = content_map.unit(r.normal(size=(6, 70)))
    x = content_map.unit(np.repeat(centre, 50, axis=0) + 0.04 * r.normal(size=(300, 70)))
    rows = [("l", f"{i:04}", v.tolist()) for i, v in zip(r.permutation(300), x)] + [("m", f"{i}", x[0].tolist()) for i in range(30)] + [("n", "one", x[1].tolist())]
    d = spark.createDataFrame(rows, "library_id string, path string, v array<double>").repartition(3)
    whole = {(q.library_id, q.path): (q.place, q.group_no) for q in content_map.ordered(d).collect()}
    monkeypatch.setattr(content_map, "LOCAL", 25)
    monkeypatch.setattr(content_map, "SAMPLE", 120)
    parts = {(q.library_id, q.path): (q.place, q.group_no) for q in content_map.ordered(d).collect()}
    v = {(k, p): np.array(y) for k, p, y in rows}
    for got in (whole, parts):
        for k, n in (("l", 300), ("m", 30), ("n", 1)):
            assert sorted(place for (lib, _), (place, _) in got.items() if lib == k) == list(range(n))
        line = [key for key, _ in sorted(((key, place) for key, (place, _) in got.items() if key[0] == "l"), key=lambda z: z[1])]
        near = np.mean([1 - v[a] @ v[b] for a, b in zip(line, line[1:])])
        assert near < np.mean([1 - v[a] @ v[b] for a, b in zip(sorted(line), sorted(line)[1:])]) / 2, "like files are neighbours"
        kinds = defaultdict(set)
        for i, (k, p, _) in enumerate(rows[:300]):
            kinds[i // 50].add(got[k, p][1])
        assert all(len(g) == 1 for g in kinds.values()), "files of one kind are in one group"
