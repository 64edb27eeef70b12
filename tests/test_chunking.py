"""Sections, chunks and HTML tables, in our own words; nothing of a text is lost."""

import random

import pytest

from lakefind.functions import html_tables as H
from lakefind.functions import markdown as M
from lakefind.functions import sections as S
from lakefind.operators import chunking


def texts(t, most=S.MOST):
    return [c[3] for c in S.chunks(t, most)]


def test_headings():
    t = "intro\n# One\na\n## Two\nb\n### Three\nc\n## Other\nd\n#### four\ne\n# Next\nf"
    assert [(c[1], c[3]) for c in S.chunks(t)] == [("", "intro"), ("One", "a"), ("One / Two", "b"), ("One / Two / Three", "c"), ("One / Other", "d\n#### four\ne"), ("Next", "f")]
    assert texts("") == texts("# Only a heading\n\n") == []


@pytest.mark.parametrize("fence", ["```", "~~~", "````"])
def test_fences_hold_no_headings(fence):
    t = f"# A\n{fence}\n# comment\n``\n{fence}\nend"
    assert [c[1] for c in S.chunks(t)] == ["A"]


def test_formulas_hold_no_headings_and_blank_lines():
    t = "# A\n$$\nx = 1\n\n# no\n$$\nend"
    assert [c[1] for c in S.chunks(t)] == ["A"] and len(S.sections(t)[0].paragraphs) == 1
    open_ = "# A\n$$ never closed\n" + "line\n" * 70 + "# B\nb"
    assert [c[1] for c in S.chunks(open_, 10_000)] == ["A", "B"]


def test_sections_are_shared():
    t = "# A\n" + "\n\n".join(f"Sentence number {i} of this part is here." for i in range(40))
    got = list(S.chunks(t, 200))
    assert len(got) > 3 and len({c[0] for c in got}) == 1 and all(len(c[3]) <= 250 for c in got)


def test_tables_stay_whole_with_their_neighbours():
    table = "\n".join(f"| r{i} | {i} |" for i in range(25))
    t = f"Lead of the table.\n\n{table}\n\nTail of the table.\n\n" + "Far away. " * 30
    first = texts(t, 60)[0]
    assert first.startswith("Lead") and table in first and first.endswith("Tail of the table.")


def test_lists_are_cut_at_items():
    t = "\n".join(f"- item {i} with some words\n  and its own second line" for i in range(12))
    got = texts(t, 120)
    assert len(got) > 3 and all(x.startswith("- item") for x in got) and "\n".join(got) == t
    apart = "- a\n\n- b\n\n" + "Long text follows here. " * 10
    assert S.units(S.sections(apart)[0].paragraphs, 50)[0].text == "- a\n\n- b"


def test_formulas_keep_lead_and_explanation():
    t = "Words before. " * 30 + "\n\n$$a = b$$\n\nwhere b is the base.\n\n" + "Next topic. " * 30
    hit = [x for x in texts(t, 100) if "$$" in x]
    assert len(hit) == 1 and hit[0].endswith("where b is the base.") and hit[0].startswith("Words before.")
    chain = "\n\n".join(f"$$x_{{{i}}} = {i}$$" for i in range(30))
    assert all(len(x) <= 2 * 100 for x in texts(chain, 100))
    assert len(texts("$$a$$\n\n(7 points)\n\n" + "Text. " * 40, 100)[0].split("\n\n")) == 2


@pytest.mark.parametrize(("text", "parts"), [("Mr. Roe left. He ran.", ["Mr.", "Roe left.", "He ran."]), ("See Mr. Roe. Then go.", ["See Mr. Roe.", "Then go."]), ("a is 3.14 now", ["a is 3.14 now"]), ("好。是吗？对", ["好。", "是吗？", "对"]), ("e.g. This", ["e.g.", "This"]), ("so e.g. This", ["so e.g. This"])])
def test_sentences(text, parts):
    assert S.sentences(text) == parts


def test_small_paragraphs_are_packed():
    t = "\n\n".join(f"Short {i}." for i in range(20))
    got = texts(t, 100)
    assert len(got) <= 4 and all(len(x) <= 125 for x in got)


def test_nothing_is_lost():
    r = random.Random(4)
    kinds = ["# Head", "plain words. More of them. ", "| a | b |", "- item", "$$x$$", "```", "", "", "where x is y", "短句。下一句。"]
    for _ in range(200):
        t = "\n".join(r.choice(kinds) * r.choice((1, 1, 6)) for _ in range(r.randint(0, 40)))
        heads = [x for k, x in S.scan(t) if k == S.HEAD]
        want = "".join(t.split())
        got = "".join("".join(c.split()) for c in texts(t, r.choice((30, 120, 600))))
        assert len(got) == len(want) - sum(len("".join(h.split())) for h in heads)


def test_tables_flat():
    t = "before\n<table><tr><td rowspan=2>a</td><td>b|c</td></tr><tr><td>d<sup>2</sup>e<sub>3</sub><br>f</td></tr></table>\nafter"
    flat = H.flat(t)
    assert flat == "before\n\n| a | b\\|c |\n| --- | --- |\n| a | d^2e3 f |\n\nafter" and H.flat(flat) == flat
    assert H.flat("<table><tr><td colspan=3>t</td></tr><tr><td>1</td><td>2</td></tr></table>").splitlines()[0] == "| t |  |  |"
    assert "| x |" in H.flat("Sun</td></tr><tr><td>x</td></tr>") and "Sun" in H.flat("Sun</td></tr><tr><td>x</td></tr>")
    for same in ("a <td> is a cell", "```\n<table><tr><td>x</td></tr></table>\n```", "1 < 2", None, ""):
        assert H.flat(same) == same
    assert "script" not in H.flat("<table><tr><td onclick='x'><script>1</script>y</td></tr></table>")


def test_markdown():
    assert M.html("# T *x*\n\n- a\n- b\n\n1. c\n\n> q\n\n`<b>` & [l](https://h) [j](javascript:x)\n\n```\n<i>\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---") == (
        '<h1>T <em>x</em></h1>\n<ul><li>a</li><li>b</li></ul>\n<ol><li>c</li></ol>\n<blockquote><p>q</p></blockquote>\n<p><code>&lt;b&gt;</code> &amp; <a href="https://h">l</a> j</p>\n'
        "<pre><code>&lt;i&gt;</code></pre>\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>\n<hr>"
    )
    assert M.html(None) is None and M.html("") == "" and "<script>" not in M.html("<script>x</script>")


def test_files_to_chunks(spark):
    text = "---\ntitle: Plan\ntags: [x]\n---\n# Part\nsee [[dir/other|it]] ![p](a.png)\n" + "Sentence of some length here. " * 60
    d = spark.createDataFrame([("l", "a/b.md", text), ("l", "c.md", None), ("l", "d.md", "")], "library_id string, path string, text string")
    c = chunking.cleaned(d).cache()
    parts = chunking.pieces(c).cache()
    rows = chunking.anchored(chunking.chunks(parts), c).orderBy("chunk_index").collect()
    assert len(rows) > 2 and rows[0].chunk_id == "l:a/b.md:0" and rows[0].anchor == "b / Plan / x / Part" and rows[0].text.startswith("see it p") and rows[1].embedded.startswith("b / Plan / x / Part\n")
    s = chunking.sections(parts).collect()
    assert len(s) == 1 and s[0].chunk_count == len(rows) and s[0].text.startswith("see it p")
