"""The pipeline on planted rows: each stage's decisions take effect, clean documents stay, odd rows have defined results."""

import random

import pytest

import corpus_pipeline
from lakefind.llm.common import staged

ITEM = "a river boat carries 12 crates of apples from Lyon to the harbour and returns with 7 empty crates before the evening bell rings"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, root = random.Random(4), str(tmp_path_factory.mktemp("sf"))
    vocabulary = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su", "na") for b in ("ver", "dor", "lin", "gas", "pet", "mon", "ter", "ka")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    nasty = lambda: "you filthy horrible trash go away stupid idiot " * 3 + prose(5)
    rows = [(i, prose(60)) for i in range(150)] + [(200 + i, nasty()) for i in range(60)]
    labels = [(i, 1, int(i >= 200)) for i, _ in rows]
    clean = [(1000 + i, prose(80)) for i in range(20)]
    run = "\n".join(prose(8) for _ in range(4))
    rows += clean
    rows += [(2000, prose(40) + "\n" + run), (2001, run + "\n" + prose(40))]  # a later copy of a run of lines
    rows += [(2100, clean[0][1]), (2101, clean[1][1] + " more"), (None, clean[2][1] + " tail")]  # copies and near copies
    rows += [(2200, f"{prose(30)} {ITEM.replace('12', '40').replace('Lyon', 'Turin')} {prose(30)}")]  # a leak
    rows += [(None, nasty()), (2300, nasty())]  # toxic, one without an id
    rows += [(2400, None), (2401, ""), (2500, "one row that comes twice in this corpus of ours"), (2500, "one row that comes twice in this corpus of ours")]
    d = spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, note string")
    d.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, clean


def test_stages(spark, corpus):
    root, rows, clean = corpus
    docs, ids = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, root))
        ids[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
        if name != "byte-level BPE":
            assert docs.columns == corpus_pipeline.COLUMNS
            texts = {r.doc_id: r.text for r in docs.collect()}
        has = lambda i: any(not null and x == i for null, x in ids[name])  # noqa: E731, B023
        assert all(has(i) for i, _ in clean) and has(2400) and has(2401), name
        if name == "toxicity":
            # the toxic row without an id goes, the near copy without one stays so far
            assert not has(2300) and sum(null for null, _ in ids[name]) == 1 and not any(200 <= x < 260 for _, x in ids[name])
        if name == "line dedup":
            assert "\n" in texts[2000] and "\n" not in texts[2001] and not has(2100)
        if name == "n-gram Jaccard join":
            assert not has(2101) and not any(null for null, _ in ids[name]) and sum(x == 2500 for _, x in ids[name]) == 1
        if name == "benchmark decontamination":
            assert not has(2200)
    assert sorted(docs.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, root).select("doc_id", "ids_sha256").collect()) == sorted(tuple(r) for r in docs.select("doc_id", "ids_sha256").collect())


def test_empty_tables(spark, corpus, tmp_path):
    root = corpus[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
