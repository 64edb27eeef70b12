import pytest
from pyspark.sql import functions as F

from lakefind.functions import text as X
from lakefind.operators import catalog, lexical
from lakefind.plans import registry


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_tokens(spark):
    t = one(spark, "Spark Query v4.1 数据分析平台，很好！", X.tokens)
    assert {"spark", "query", "v4.1", "数据", "据分", "分析"} <= set(t) and "，" not in t and "好" not in t
    t = one(spark, "数据的分析", lambda c: X.tokens(c, ("数据", "分析")))
    assert t == ["数据", "分析", "数据", "据的", "的分", "分析"]


@pytest.mark.parametrize(
    ("text", "targets", "seen"),
    [
        ("[[note|shown]]", ["note"], "shown"),
        ("[[dir/sub/note#part]]", ["note"], "note"),
        (r"| [[note\|cell]] |", ["note"], "| cell |"),
        ("[[#^abc]] x", [], " x"),
        ("[[#part]]", [], "part"),
        ("![[picture.png]] [[b]] [[a]] [[b]]", ["a", "b"], " b a b"),
        ("[[note#^abc]]", ["note"], "note"),
    ],
)
def test_wikilinks(spark, text, targets, seen):
    assert one(spark, text, X.wikilink_targets) == targets
    assert one(spark, text, X.clean_wikilinks) == seen


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ("![a plot](plots/a.png)", "a plot"),
        ("![ ](x.png)y", "y"),
        ("![x](HTTPS://h/i.png)", "![x](HTTPS://h/i.png)"),
        ("![x](data:image/png;base64,aa)", "![x](data:image/png;base64,aa)"),
        ("<img src=a alt='one two'> <IMG ALT=three src=b> <img src=c>", "one two three "),
    ],
)
def test_images(spark, text, left):
    assert one(spark, text, X.strip_dead_images) == left


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ("top\n第 3 页\nPage12\n* 7 *\n-- 8 --\nend", "top\nend"),
        ("top\n1987\nend", "top\n1987\nend"),
        ("top\n7\nmid\r\n 8 \nend\n", "top\nmid\nend"),
        ("page 1 of 3", "page 1 of 3"),
        ("", ""),
    ],
)
def test_page_marks(spark, text, left):
    assert one(spark, text, X.strip_page_numbers) == left


def test_boilerplate(spark):
    same = "Company handbook"
    assert one(spark, f"{same}\na\n  {same}\nb\n{same}\nc", X.strip_boilerplate) == "a\nb\nc"
    for kept in ("# Title", "| a | b |", "> said", "- item one", "1. item one", "----", "abc"):
        text = "\n".join([kept, "x"] * 4)
        assert one(spark, text, X.strip_boilerplate) == text
    fenced = f"```\n{same}\n{same}\n```\n{same}\n{same}\nrest"
    assert one(spark, fenced, X.strip_boilerplate) == fenced
    assert one(spark, f"```\n{same}\n```\n{same}\nx\n{same}\ny\n{same}\n", X.strip_boilerplate) == f"```\n{same}\n```\nx\ny"
    assert one(spark, None, X.strip_boilerplate) is None


def test_layout_noise(spark):
    d = spark.createDataFrame([("Head\nbody\n# Head\n 12 ", [("header", "Head"), ("page_number", "12"), ("text", "body")])], "t string, b array<struct<type string, text string>>")
    assert d.select(X.strip_layout_noise(F.col("t"), F.col("b"))).first()[0] == "body\n# Head"
    assert d.select(X.strip_layout_noise(F.col("t"), F.lit(None).cast("array<struct<type string, text string>>"))).first()[0].startswith("Head")


def test_cut_and_anchor(spark):
    cut = lambda t, n=10, r=4: one(spark, t, lambda c: X.truncate_at_line(c, n, r, "…"))
    assert cut("short") == "short" and cut("12345678\nabcdef") == "12345678\n…" and cut("1234567890ab\ncd") == "1234567890ab\n…"
    assert cut("12\n4567890abcdefgh") == "12\n4567890\n…" and cut("x" * 30) == "x" * 10 + "\n…"
    d = spark.createDataFrame([("A / B\ntext", "A / B"), ("text", "A"), ("text", ""), ("text", None)], "t string, a string")
    assert [r[0] for r in d.select(X.strip_anchor(F.col("t"), F.col("a"))).collect()] == ["text"] * 4


@pytest.mark.parametrize(("text", "heavy"), [("TBD - soon\nb", True), ("[todo] x", True), ("TODO — x\n" + "a\n" * 20, False), ("", False), (None, None)])
def test_tbd(spark, text, heavy):
    assert one(spark, text, X.tbd_heavy) in (heavy, False if heavy is None else heavy)


def test_folders(spark):
    d = spark.createDataFrame([("a/b.md", "a"), ("ab/c.md", "a"), ("a", "/a/"), ("x", ""), ("x", None)], "p string, f string")
    assert [r[0] for r in d.select(X.in_folder(F.col("p"), F.col("f"))).collect()] == [True, False, True, True, True]
    assert [one(spark, p, X.needs_conversion) for p in ("a.md", "a.PDF", "noext", "b.markdown")] == [False, True, False, False]


@pytest.mark.parametrize("lists,first", [([["a", "b"], ["x", "b"]], "b"), ([["a", "b", "c"], ["a", "c", "b"]], "a")])
def test_rrf(spark, lists, first):
    dfs = [(spark.createDataFrame([(x, i + 1) for i, x in enumerate(l)], "id string, rank int"), 1.0) for l in lists]
    assert lexical.rrf(dfs, ["id"]).orderBy(F.desc("score"), "id").first().id == first


def test_rrf_needs_lists(spark):
    with pytest.raises(ValueError):
        lexical.rrf([], ["id"])
    d = spark.createDataFrame([("a", 1)], "id string, rank int")
    with pytest.raises(ValueError):
        lexical.fuse([d, d], ["id"], [1.0])


def test_bm25_edges(spark):
    docs = spark.createDataFrame([("l", 1, "engine core engine"), ("l", 2, None), ("l", 3, ""), ("l", 4, "weather walk")], "library_id string, doc_id long, text string")
    ask = lambda t: spark.createDataFrame([(1, t)], "item_id long, text string")
    got = lexical.bm25(ask("engine engine"), docs, 5).collect()
    once = lexical.bm25(ask("engine"), docs, 5).collect()
    assert [r.id for r in got] == [1] and abs(got[0].score - 2 * once[0].score) < 1e-5
    assert lexical.bm25(ask("nowhere"), docs, 5).count() == lexical.bm25(ask(""), docs, 5).count() == lexical.bm25(ask("engine"), docs.limit(0), 5).count() == 0


def test_runs(spark):
    p = spark.createDataFrame([("d", x) for x in (1, 2, 5, 9, 10)], "doc string, page long")
    r = catalog.runs(p, "doc", "page", 2)
    assert sorted(tuple(x[1:]) for x in r.collect()) == [(1, 5), (9, 10)]
    assert sorted(tuple(x) for x in catalog.split_runs(r, 3).select("first", "last").collect()) == [(1, 3), (4, 5), (9, 10)]


def test_splice(spark):
    pages = spark.createDataFrame([("d", p, f"t{p}.", p in (2, 3, 5)) for p in range(1, 7)], "doc string, page int, text string, image boolean")
    runs = spark.createDataFrame([("d", 2, 3, "seen\n\n"), ("d", 5, 6, None)], "doc string, first int, last int, text string")
    text, missing = catalog.splice(pages, runs)
    r = text.first()
    assert r.text == "t1.seen\n\nt4.t5.t6." and r.recognised == [2, 3] and missing.first().missing == [5]


def test_every_query_has_a_plan(spark):
    for name, q in registry.queries().items():
        assert q(spark, "/root/testdata/sf0.001").columns, name
