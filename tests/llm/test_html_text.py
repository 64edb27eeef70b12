"""Main text of pages on which density decides."""

import time

import pytest

from lakefind.llm import html_text

LONG = "A paragraph of the article with enough words in it to be told from what stands around it on the page. " * 3


def test_density_without_links():
    page = f"<body><div class=qx7>Call us now.</div><div class=k1><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class=qx8><span>All</span> <span>rights</span></div></body>"
    assert html_text.extract(page) == f"Title\n{LONG.strip()}\n{LONG.strip()}"


def test_article_over_siblings():
    def half(k):
        return f"<section><h2>Part {k}</h2><p>{k} {LONG}</p><p>{k} {LONG}<a href=x>a link</a></p></section>"

    text = "".join(f"Part {k}\n{k} {LONG.strip()}\n{k} {LONG}a link\n" for k in (1, 2)).strip()
    page = f"<body><div class=qx7><a href=y>One</a> <a href=z>Two</a></div><div class=k1><h1>Title</h1>{half(1)}<p>Between.</p>{half(2)}</div></body>"
    assert html_text.extract(page) == f"Title\n{text}".replace("\nPart 2", "\nBetween.\nPart 2")


def test_articles_and_density_before_names():
    one, two = (f"<article><h1>T{k}</h1><p>{k} {LONG}</p><p>{k} {LONG}</p></article>" for k in (1, 2))
    text = "\n".join(f"T{k}\n{k} {LONG.strip()}\n{k} {LONG.strip()}" for k in (1, 2))
    assert html_text.extract(f"<body>{one}{two}</body>") == text
    page = f"<body><article><a href=x>Short</a></article><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert html_text.extract(page) == "\n".join([LONG.strip()] * 3)


def test_one_word_of_a_name_does_not_decide():
    def section(k):
        return f"<section id={k}><h2 id={k}-head>{k}</h2><p>{LONG}</p></section>"

    names = ("related-work", "social-impact", "navigation", "comments-on-the-method")
    text = "\n".join(f"{k}\n{LONG.strip()}" for k in names)
    links = "<div class=related-posts><a href=x>More of this</a> <a href=y>and that</a></div><div class=share-bar><span>Tell</span> <span>all</span></div><div class=ad>Buy this.</div>"
    head = "<div class=entry-header><h1>Title</h1></div>"
    assert html_text.extract(f"<body><article>{head}{''.join(map(section, names))}{links}</article></body>") == f"Title\n{text}"
    free = f"<body><div class=k1>{section('related-work')}{section('social-impact')}{links}</div></body>"
    assert html_text.extract(free) == f"related-work\n{LONG.strip()}\nsocial-impact\n{LONG.strip()}"


def test_wrappers_of_a_page():
    art = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
    text = "\n".join(["Title", *[LONG.strip()] * 3])
    menu = "<ul class=menu><li><a href=a>One</a><li><a href=b>Two</a></ul>"
    for page in (
        f'<body><div class="site-content no-sidebar">{menu}{art}</div></body>',
        f"<body><form action=x><input value=q>{menu}<div class=k1>{art}</div><button>Send</button></form></body>",
        f"<body>{menu}<div class=k1>{art}</div><div class=k2><p>Unrelated blurb.</p></div><form><p>Your name</p><input></form></body>",
        f"<body><article><div class='entry-header'><h1>Title</h1></div>{art[14:]}</article><div class=comments><p>First!</p></div></body>",
    ):
        assert html_text.extract(page) == text


@pytest.mark.parametrize("page", ["<a " * 60_000, '<a href="' * 30_000, "<div><p>x</b>" * 8_000, "<table><tr><td>x" * 5_000, "<b><i>" * 20_000 + "<h1>x" * 2_000, "<!-- " * 50_000, "<![CDATA[" * 30_000, "<a '\">" * 20_000, "<script>" * 20_000])
def test_long_broken_pages(page):
    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 10


def test_query_rows(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "old"), (1, "u", f"<p>{LONG}</p>", "old"), (2, None, None, "old"), (None, "w", "", "old"), (3, "v", "plain &lt;text&gt;", "old")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text) for r in html_text.extracted(d).collect()), key=str)
    assert got == sorted([(1, "u", LONG.strip()), (1, "u", LONG.strip()), (2, None, ""), (0, "w", ""), (3, "v", "plain <text>")], key=str)
    assert html_text.extracted(d.limit(0)).count() == 0


def test_references_are_decoded_string_by_string():
    assert html_text.extract("<body><p>a &am<b>p;</b> b &lt<i>;</i>x &amp; &copy;<!-- c --> d</p></body>") == "a &amp; b <;x & © d"


def test_density_is_counted_before_names():
    """Of two places with the same names, the one that density leaves out goes, and what names drop counts for the first choice."""
    prose = "".join(f"<p>Sentence {i} of the long story goes on and on for a while here.</p>" for i in range(12))
    links = "".join(f"<div><a href=x>{i}</a></div>" for i in range(60))
    page = f"<body><div class=x>{links}</div><div class=x>{prose}</div><div class=x>{links}</div></body>"
    root = html_text.parse(page)
    first = html_text.first_count(root)
    assert first and all("Sentence" in str(t) for x in first for t in html_text.blocks([x]))
    text = html_text.extract(page)
    assert text.startswith("Sentence 0") and text.endswith("here.") and len(text.split("\n")) == 12
    # names may drop all that density kept: then the page without them is looked at
    comments = "".join(f"<p>Comment {i} says a lot of things about the story.</p>" for i in range(40))
    assert html_text.extract(f"<body><div>{prose}</div><div class=comments>{comments}</div></body>").count("Comment") == 0
