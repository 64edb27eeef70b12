"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import CONF

#: Fixed pattern of a Latin token.
LATIN = r"[a-z0-9][a-z0-9._+-]{1,}"
#: Fixed pattern of a run of CJK characters.
CJK = r"[\u4e00-\u9fff]+"
#: Fixed pattern of each two CJK characters side by side; pairs overlap.
CJK_PAIR = r"(?=([\u4e00-\u9fff]{2}))"
#: Fixed list of CJK characters that say nothing by themselves.
STOP = "的了是在有和就不太人这那也还我一个要会去与或于及之而但并其们对为以据相关包括如何什么怎哪些需可应该你他样时候地方情况问题办法式途径通过进行使用到做着吧吗呢哦啊呀因所然后接下来"
#: Line ends of every kind.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Fixed patterns of page marks: named, decorated, bare.
PAGE_NAMED = r"(?i)^\s*(?:第\s*\d+\s*页|page\s*\d+)\s*$"
PAGE_DECORATED = r"^\s*[-–—_·•*]+\s*\d{1,4}\s*[-–—_·•*]+\s*$"
PAGE_BARE = r"^\s*\d{1,4}\s*$"
#: Fixed pattern of a line that stands for missing text.
TBD = r"(?i)\[TBD|TBD\s*[—-]|\[todo\]|TODO\s*[—-]"
#: Fixed patterns: a list item, a line of marks alone, a fenced block (from a fence line to the next one or the end).
LIST_ITEM = r"^(\s*)([-*+]|\d+[.)])\s"
MARKS_ONLY = r"^[\s\-*_#>|~`]+$"
FENCED = r"(?ms)^[ ]{0,3}(?:`{3,}|~{3,})[^\n]*(?:\n.*?^[ ]{0,3}(?:`{3,}|~{3,})[^\n]*$|\n.*\z|\z)"
#: Fixed kinds of layout blocks that aren't text of the document.
LAYOUT_NOISE = ["header", "footer", "page_number"]
#: Fixed mark behind a text that was cut.
CUT_MARK = "…"


def tokens(text: Column, lexicon: tuple[str, ...] = (), words: Callable[[Column], Column] | None = None) -> Column:
    """Lower-case Latin tokens, then for every CJK run its words (single stop characters go) and all two-character grams.

    Words come from a function of the runs (see operators.segmentation), or from a given lexicon, the longest first."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit(LATIN), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    # all pairs of one pass: places inside a run are found by reading it from its start each time
    grams = F.regexp_extract_all(low, F.lit(CJK_PAIR), F.lit(1))
    if words is not None:
        cut = words(runs)
    elif lexicon:
        any_of = "|".join([*sorted(map(re.escape, lexicon), key=lambda w: (-len(w), w)), "."])
        cut = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(f"(?:{any_of})"), F.lit(0))))
    else:
        return F.concat(latin, grams)
    return F.concat(latin, F.filter(cut, lambda w: ~F.contains(F.lit(STOP), w) | (F.length(w) > 1)), grams)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def char_shingles(text: Column, n: int = 5) -> Column:
    """Distinct n-character shingles of the squeezed text; a shorter text is its own shingle."""
    t = squeeze(text)
    return F.when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))))


def confidence_tier(score: Column) -> Column:
    return F.when(score >= CONF.high, "high").when(score >= CONF.warn, "mid").otherwise("weak")


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, even where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text, whatever its line ends; a line end at the very end begins no line."""
    return let(F.split(text, LINE_END, -1), lambda each: F.when(F.element_at(each, -1) == "", F.slice(each, F.lit(1), F.size(each) - 1)).otherwise(each))


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncate_at_line(text: Column, limit: int = CONF.text_limit, reach: int = CONF.line_search_back, mark: str = CUT_MARK) -> Column:
    """text up to limit characters and a line with the mark: cut at the last line end if it is at most `reach` before, else at the next one if it is as near, else right there. Shorter texts stay."""
    head = F.substring(text, 1, limit)
    before = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    after = F.locate("\n", text, limit + 1) - 1
    cut = F.when((before > 0) & (before >= limit - reach), before).when((after >= 0) & (after - limit <= reach), after).otherwise(limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substr(text, F.lit(1), cut), F.lit(f"\n{mark}")))


def strip_anchor(text: Column, anchor: Column) -> Column:
    """text without the line of its anchor, where it begins with it."""
    return F.when((F.coalesce(anchor, F.lit("")) != "") & F.startswith(text, F.concat(anchor, F.lit("\n"))), F.substr(text, F.length(anchor) + 2)).otherwise(text)


def wikilink_targets(text: Column) -> Column:
    """Distinct sorted names of the notes that are linked: the last part of the path; aliases, anchors and embeds go."""
    raw = F.regexp_extract_all(text, F.lit(r"(?<!!)\[\[([^\]]*)\]\]"), F.lit(1))
    named = F.transform(raw, lambda x: bare(F.regexp_replace(x, r"\\?\|[\s\S]*$|#[\s\S]*$", "")))
    last = F.transform(named, lambda x: bare(F.substring_index(x, "/", -1)))
    return F.array_sort(F.array_distinct(F.filter(last, lambda x: x != "")))


def clean_wikilinks(text: Column) -> Column:
    """What a reader sees of each link: its alias, else the note's name, else the heading; embeds and block ids go."""
    for pattern, seen in (
        (r"!\[\[[^\]]*\]\]", ""),
        (r"\[\[[^\]|]*\|\s*([^\]|]*?)\s*(?:\\?\|[^\]]*)?\]\]", "$1"),
        (r"\[\[\s*#\s*\^[^\]]*\]\]", ""),
        (r"\[\[\s*#\s*([^\]]*?)\s*\]\]", "$1"),
        (r"\[\[(?:[^\]#]*/)?\s*([^\]#/]*?)\s*(?:#[^\]]*)?\]\]", "$1"),
    ):
        text = F.regexp_replace(text, pattern, seen)
    return text


def strip_dead_images(text: Column) -> Column:
    """Local image references become their alternative text; http, https and data stay."""
    t = F.regexp_replace(text, r"!\[\s*([^\]]*?)\s*\]\((?!\s*(?i:https?://|data:))[^)]+\)", "$1")
    t = F.regexp_replace(t, r"""(?i)<img\b[^>]*?alt\s*=\s*(?:"\s*([^">]*?)\s*"|'\s*([^'>]*?)\s*'|([^\s>"']+))[^>]*>""", "$1$2$3")
    return F.regexp_replace(t, r"(?i)<img\b[^>]*>", "")


def strip_page_numbers(text: Column) -> Column:
    """Lines that are page marks go; bare numbers only if two or more differ."""
    marked = F.transform(lines(text), lambda x: F.struct(x.alias("x"), x.rlike(PAGE_BARE).alias("bare"), (x.rlike(PAGE_NAMED) | x.rlike(PAGE_DECORATED)).alias("mark")))
    bares = lambda each: F.size(F.array_distinct(F.transform(F.filter(each, lambda v: v["bare"]), lambda v: bare(v["x"]))))
    pair = let(marked, lambda each: F.struct(each.alias("each"), (bares(each) >= 2).alias("several")))
    kept = let(pair, lambda p: F.filter(p["each"], lambda v: ~v["mark"] & ~(p["several"] & v["bare"])))
    return F.array_join(F.transform(kept, lambda v: v["x"]), "\n")


def _may_repeat(line: Column) -> Column:
    """Whether a line that is repeated may be boilerplate: no heading, table row, quote, list item, marks alone or short text."""
    s = bare(line)
    return (F.length(s) >= 4) & ~s.rlike(MARKS_ONLY) & ~s.rlike(r"^[#|>]") & ~line.rlike(LIST_ITEM)


def _unix(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def boilerplate(text: Column, least: int = 3) -> Column:
    """Sorted distinct lines (without the blanks around them) that a text has `least` times or more outside fenced blocks."""
    outside = F.split(F.regexp_replace(_unix(text), FENCED, ""), LINE_END, -1)
    s = F.array_sort(F.transform(F.filter(outside, _may_repeat), bare))

    def repeated(s: Column) -> Column:
        far = F.sequence(F.lit(least), F.greatest(F.size(s), F.lit(least)))
        return F.array_distinct(F.transform(F.filter(far, lambda i: F.get(s, i - 1) == F.get(s, i - least)), lambda i: F.get(s, i - 1)))

    return let(s, repeated)


def strip_boilerplate(text: Column, least: int = 3) -> Column:
    """text without its boilerplate lines; fenced blocks stay as they are."""

    def left(v: Column) -> Column:
        cut = lambda g: F.array_join(F.filter(F.split(g, "\n", -1), lambda x: ~(F.array_contains(v["gone"], bare(x)) & _may_repeat(x))), "\n")
        gaps = F.transform(F.split(v["t"], FENCED, -1), cut)
        both = F.zip_with(gaps, F.regexp_extract_all(v["t"], F.lit(FENCED), F.lit(0)), lambda g, b: F.concat(g, F.coalesce(b, F.lit(""))))
        return F.array_join(lines(F.array_join(both, "")), "\n")

    value = F.struct(boilerplate(text, least).alias("gone"), _unix(text).alias("t"), text.alias("text"))
    return let(value, lambda v: F.when(F.size(v["gone"]) > 0, left(v)).otherwise(v["text"]))


def strip_layout_noise(text: Column, blocks: Column) -> Column:
    """text without the lines that are, word for word, a page's header, footer or number; blocks: array<struct<type, text>>."""
    noise = F.filter(F.transform(F.filter(blocks, lambda b: b["type"].isin(*LAYOUT_NOISE)), lambda b: bare(F.coalesce(b["text"], F.lit("")))), lambda x: x != "")
    value = F.struct(noise.alias("noise"), text.alias("text"))
    kept = lambda v: F.array_join(F.filter(lines(v["text"]), lambda x: ~F.array_contains(v["noise"], bare(x))), "\n")
    return let(value, lambda v: F.when(F.coalesce(F.size(v["noise"]), F.lit(0)) <= 0, v["text"]).otherwise(kept(v)))


def tbd_heavy(text: Column, ratio: float = CONF.tbd_ratio) -> Column:
    """Whether a share of `ratio` of the non-blank lines stands for missing text; never with a ratio of 0."""
    full = F.filter(lines(text), lambda x: bare(x) != "")
    return F.lit(ratio > 0) & (F.size(full) > 0) & (F.size(F.filter(full, lambda x: x.rlike(TBD))) >= F.size(full) * ratio)


def in_folder(path: Column, folder: Column) -> Column:
    """Whether path is folder or lies in it; an empty folder holds all."""
    f = F.btrim(F.translate(F.btrim(folder), "\\", "/"), F.lit("/ "))
    return (F.coalesce(f, F.lit("")) == "") | (path == f) | F.startswith(path, F.concat(f, F.lit("/")))


def needs_conversion(path: Column) -> Column:
    """Whether a file isn't plain text already."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return (ext != "") & ~ext.isin("md", "txt", "markdown")


def chunk_id(library: Column, path: Column, index: Column) -> Column:
    return F.concat_ws(":", library, path, index.cast("string"))


def parse_chunk_id(c: Column) -> tuple[Column, Column, Column]:
    return F.regexp_extract(c, r"^([^:]*):", 1), F.regexp_extract(c, r"^[^:]*:(.*):[^:]*$", 1), F.regexp_extract(c, r":([^:]*)$", 1).cast("int")


def theme(path: Column, rules: list[tuple[str, list[str]]], default: str = "general") -> Column:
    """First rule (name, keywords) one of whose keywords is in the lower-case path. The rules are the caller's."""
    out = F.lit(default)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(path), F.lit(w.lower()))
        out = F.when(hit, name).otherwise(out)
    return out
