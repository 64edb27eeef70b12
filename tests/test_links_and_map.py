import math

import numpy as np
from pyspark.sql import functions as F

from lakefind.operators import content_map as C
from lakefind.operators import links as L
from lakefind.operators import notes as N
from lakefind.operators import vector


def files(spark):
    rows = [("l", "a.md", "[[b]] [[gone]] [[a]]"), ("l", "x/b.md", "[[a|me]] [[c.d]]"), ("l", "y/b.md", "[[x/b.md]]"), ("l", "c.md", ""), ("m", "a.md", "[[c]]")]
    return spark.createDataFrame(rows, "library_id string, path string, text string")


def test_relations(spark):
    f = files(spark)
    got = {(r.library_id, r.path): (r.outlinks, r.inlinks) for r in L.relations(L.wikilinks(f), f).collect()}
    # of two files of one stem the last path is meant; a name with a dot resolves by its stem
    assert got == {("l", "a.md"): (["y/b.md"], ["x/b.md"]), ("l", "x/b.md"): (["a.md", "c.md"], []), ("l", "y/b.md"): ([], ["a.md"]), ("l", "c.md"): ([], ["x/b.md"]), ("m", "a.md"): ([], [])}
    e = L.edges(L.wikilinks(f), f)
    assert sorted((r.source, r.target) for r in e.collect()) == [("a.md", "x/b.md"), ("a.md", "y/b.md"), ("c.md", "x/b.md")]


def test_graph(spark):
    inc = spark.createDataFrame([("l", p) for p in ("a.md", "b.pdf", "c.pdf", "d.md", "big.pdf")], "library_id string, path string")
    man = spark.createDataFrame([("l", "a.md", "indexed", None, None, 3, 5), ("l", "b.pdf", "failed", "scanned", "s", 2, 6), ("l", "big.pdf", "indexed", None, None, 9, 7)], "library_id string, path string, status string, failure_state string, failure_reason string, chunks int, mtime_ns long")
    pages = spark.createDataFrame([("l", "b.pdf", "p", "partial", [2, 1, 1, 0], None), ("l", "big.pdf", "p", "indexed", list(range(1, 30)), None), ("l", "zz.pdf", "p", "failed", [], "x")], "library_id string, path string, provider_id string, status string, pages array<int>, failure_reason string")
    link = spark.createDataFrame([("l", "a.md", "b.pdf"), ("l", "a.md", "out.md")], "library_id string, source string, target string")
    nodes, edges, stats = L.graph(inc, man, link, pages)
    n = {r.node_id: r for r in nodes.collect()}
    assert n["l|b.pdf"].state == "queued" and n["l|b.pdf"].chunks == 0 and n["l|b.pdf"].page_state == "done" and n["l|b.pdf"].page_count == 2
    assert n["l|c.pdf"].state == "none" and "l|d.md" not in n and n["l|p|big.pdf|grp"].kind == "pagegroup" and n["l|p|b.pdf|p1"].kind == "page" and n["l|a.md"].state == "done"
    assert {(r.source, r.target, r.kind) for r in edges.collect()} == {("l|a.md", "l|b.pdf", "link"), ("l|b.pdf", "l|p|b.pdf|p1", "page"), ("l|b.pdf", "l|p|b.pdf|p2", "page"), ("l|big.pdf", "l|p|big.pdf|grp", "page")}
    assert tuple(stats.first()) == (7, 4) and n["l|b.pdf"].is_hub


def test_semantic_order_and_cap(spark):
    v = [(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(12)]
    d = spark.createDataFrame(v, "id long, v array<double>")
    near = vector.knn(d.select(F.col("id").alias("query_id"), F.col("v").alias("q")), d, 6, "cosine").filter("query_id <> id and score >= 0.62")
    place = d.select("id", F.col("id").alias("place"))
    got = [tuple(r) for r in L.first_semantic(near, place, 2, 5).collect()]
    want, seen = [], set()
    for i, a in v:
        sims = sorted((-round(a[0] * b[0] + a[1] * b[1], 6), j) for j, b in v if j != i)
        for s, j in [x for x in sims if -x[0] >= 0.62][:2]:
            key = (min(i, j), max(i, j))
            if key not in seen:
                seen.add(key)
                want.append((*key, round(-s, 3)))
    assert got == want[:5]


def test_knn_edges(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (3, None), (1, [1.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.1]), (8, None), (None, [1.0, 0.0])], "query_id long, q array<double>")
    assert [(r.id, r["rank"]) for r in vector.knn(q, d, 2).orderBy("rank").collect()] == [(1, 1), (1, 2)]
    assert vector.knn(q.limit(0), d, 2).count() == vector.knn(q, d.limit(0), 2).count() == 0


def test_knn_in_rounds(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = r.normal(size=(60, 5))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(4)
    q = d.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    want = {(i, int(j)) for i in range(60) for j in np.lexsort((np.arange(60), -np.round(1 / (1 + ((v - v[i]) ** 2).sum(1)), 6)))[:7]}
    for round_, tile in ((20_000, 1 << 22), (9, 64)):
        monkeypatch.setattr(vector, "ROUND", round_)
        monkeypatch.setattr(vector, "TILE", tile)
        assert {(r.query_id, r.id) for r in vector.knn(q, d, 7).collect()} == want


def clusters():
    r = np.random.default_rng(3)
    centre = C.unit(r.normal(size=(4, 80)))
    return C.unit(np.repeat(centre, 30, axis=0) + 0.03 * r.normal(size=(120, 80))).astype(np.float32)


def test_map_functions():
    x = C.project(clusters()[np.random.default_rng(1).permutation(120)])
    assert x.shape == (120, 64) and np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)
    order = C.seriate(x)
    assert sorted(order.tolist()) == list(range(120)) and (C.seriate(x) == order).all()
    assert (1 - (x[order[1:]] * x[order[:-1]]).sum(1)).mean() < (1 - (x[1:] * x[:-1]).sum(1)).mean() / 3
    label, centre = C.groups(x, 4)
    assert sorted(np.bincount(label).tolist()) == [30] * 4 and len(centre) == 4
    assert [C.group_count(n) for n in (0, 1, 12, 48, 10**6)] == [0, 1, 1, 2, 16]
    assert len(C.seriate(x[:0])) == 0 and len(C.groups(x[:0], 3)[0]) == 0 and C.project(np.zeros((0, 9))).shape[0] == 0


def test_map_windows(spark):
    x = clusters()
    d = spark.createDataFrame([("l", f"{i:03}.md", v.tolist()) for i, v in enumerate(x)], "library_id string, path string, v array<double>")
    o = C.ordered(d).cache()
    rows = {r.place: np.array(r.v) for r in o.collect()}
    v = np.array([rows[i] for i in range(120)])
    gap = {r.place: r.gap for r in C.gaps(o).collect()}
    assert all(abs(gap[i] - (1 - v[i] @ v[i - 1])) < 1e-3 for i in range(120))
    w = C.window_of(120)
    loose = {r.place: r.loose for r in C.looseness(o, w).collect()}
    for i in range(120):
        s = v[max(0, i - w) : i + w + 1].sum(0)
        assert abs(loose[i] - v[i] @ s / np.linalg.norm(s)) < 1e-3
    s = C.samples(o, ["path"]).collect()
    assert {r.nth for r in s} == {1, 2, 3} and len({r.group_no for r in s}) == C.group_count(120)


def test_farthest(spark):
    pts = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [9.0, 0.0]), (4, [0.0, 5.0]), (5, [0.0, 0.0])]
    d = spark.createDataFrame(pts, "id long, v array<double>")
    assert C.farthest(d, 3) == [1, 3, 4] and C.farthest(d, 20) == [1, 3, 4, 2] and C.farthest(d.limit(0)) == []


def test_note_rules(spark):
    rows = [("l", "计划_一.md", "---\ntitle: t\n---\n# 计划\n## 1.2\nx"), ("l", "draft.md", "---\ntags: 动力学, b\n---\nno heading"), ("l", "README.md", ""), ("l", "2024-01-02.md", ""), ("l", "templates/x.md", ""), ("l", "好.md", "# 好\n[[draft]] [[计划_一]]")]
    d = spark.createDataFrame(rows, "library_id string, path string, text string")
    got = {(r.path, r.rule): (r.suggestion, r.inlinks) for r in N.violations(d).collect()}
    assert got == {("计划_一.md", "R2"): (None, 1), ("计划_一.md", "R4"): (None, 1), ("计划_一.md", "H1"): (None, 1), ("draft.md", "R1"): ("动力学 draft", 1), ("draft.md", "R3"): (None, 1), ("draft.md", "FM"): (None, 1), ("好.md", "FM"): (None, 0)}
    s = spark.createDataFrame([("l", "a.md", "H", "t1", 0), ("l", "b.md", None, "t2", 1)], "library_id string, path string, heading string, text string, place int")
    assert N.summary_prompt(s, "Lib").first().prompt == "Library: Lib\nFiles (2 sampled): a.md, b.md\n\nPassages, to be summed up and not quoted:\n- [a.md / H] t1\n- [b.md] t2"
