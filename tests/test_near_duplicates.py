import numpy as np

from lakefind.operators import near_duplicates as N

BASE = " ".join(f"word{i} speaks of thing{i * 7}" for i in range(60))


def shingles(t):
    t = " ".join(t.split())
    return {t[i : i + 5] for i in range(max(1, len(t) - 4))}


def test_estimate_is_near_the_exact_jaccard():
    other = BASE.replace("word7 ", "else7 ").replace("word30 ", "else30 ").replace("thing70", "thing99x")
    exact = len(shingles(BASE) & shingles(other)) / len(shingles(BASE) | shingles(other))
    assert abs((N.signature(BASE) == N.signature(other)).mean() - exact) < 0.12


def test_bands_fit_the_threshold():
    b, r = N.bands(0.8)
    assert b * r <= 128 and 0.7 < (1 / b) ** (1 / r) < 0.95


def test_groups(spark):
    rows = [("l", 1, BASE), ("l", 2, BASE + " end"), ("l", 3, "nothing like it at all"), ("m", 4, BASE), ("l", 5, None), ("l", 6, "  "), ("l", 7, BASE.replace(" ", "  ")), ("l", 8, "ab"), ("l", 9, "ab")]
    got = N.duplicate_groups(spark.createDataFrame(rows, "library_id string, id long, text string"))
    assert sorted((r.library_id, r.id, r.group_id) for r in got.collect()) == [("l", 1, 1), ("l", 2, 1), ("l", 7, 1), ("l", 8, 8), ("l", 9, 8)]
    links = N.duplicate_links(spark.createDataFrame(rows + [("m", 1, BASE), ("m", None, BASE)], "library_id string, id long, text string")).collect()
    assert sorted((r.library_id, r.a, r.b, r.similarity >= 0.9) for r in links) == [("l", 1, 2, True), ("l", 1, 7, True), ("l", 8, 9, True), ("m", 1, 4, True)]
    assert all(x.similarity >= y.similarity for x, y in zip(sorted((r for r in links if r.library_id == "l"), key=lambda r: r["rank"]), sorted((r for r in links if r.library_id == "l"), key=lambda r: r["rank"])[1:]))
    empty = spark.createDataFrame([], "library_id string, id long, text string")
    assert N.duplicate_groups(empty).collect() == []


def test_groups_are_those_of_all_pairs_of_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("source as library_id", "doc_id as id", "text")
    b, r = N.bands(0.8)
    label, seen = {}, {}
    for d in docs.collect():
        if d.text and d.text.strip():
            label[d.id] = d.id
            for k, part in enumerate(np.split(N.signature(d.text)[: b * r], b)):
                seen.setdefault((d.library_id, k, part.tobytes()), []).append(d.id)
    for ids in list(seen.values()) * 20:
        low = min(label[i] for i in ids)
        for i in ids:
            label[i] = low
    sizes = {g: list(label.values()).count(g) for g in label.values()}
    assert {(r.id, r.group_id) for r in N.duplicate_groups(docs).collect()} == {(i, g) for i, g in label.items() if sizes[g] > 1}
