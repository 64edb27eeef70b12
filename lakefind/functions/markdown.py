"""Markdown to safe HTML: headings, paragraphs, lists, quotes, fences, pipe tables, rules, formulas; everything else is escaped."""

from __future__ import annotations

import re
from html import escape
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sections import FENCE, formula_end

ITEM = re.compile(r"\s*([-*+]|\d+[.)])\s+(.*)")
RULE = re.compile(r"\s*([-*_])(?:\s*\1){2,}\s*")
HEAD = re.compile(r"(#{1,6})\s+(.*)")
DELIMITER = re.compile(r"\s*\|?\s*:?-{1,}:?\s*(\|\s*:?-{1,}:?\s*)*\|?\s*")
SAFE = re.compile(r"(?:https?:|mailto:|[^:]*$)", re.I)
#: Inline marks in the order they are looked for, on escaped text.
MARKS = [(re.compile(r"\*\*(.+?)\*\*"), "strong"), (re.compile(r"~~(.+?)~~"), "del"), (re.compile(r"(?<!\*)\*([^*\s][^*]*?)\*(?!\*)"), "em")]
LINK = re.compile(r"(!?)\[([^\]]*)\]\(([^)\s]+)\)")


def inline(text: str) -> str:
    """Code stays as it is; links go only to safe addresses."""
    out = []
    for i, part in enumerate(re.split(r"`([^`]+)`", text)):
        if i % 2:
            out.append(f"<code>{escape(part)}</code>")
            continue
        part = escape(part)
        part = LINK.sub(lambda m: (f'<img alt="{m[2]}" src="{m[3]}">' if m[1] else f'<a href="{m[3]}">{m[2]}</a>') if SAFE.match(m[3]) else m[2], part)
        for mark, tag in MARKS:
            part = mark.sub(rf"<{tag}>\1</{tag}>", part)
        out.append(part)
    return "".join(out)


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def _table(rows: list[str]) -> str:
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{inline(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + row(_cells(rows[0]), "th") + "".join(row(_cells(r), "td") for r in rows[2:]) + "</table>"


def _list(rows: list[str]) -> str:
    out = []
    for ordered, group in groupby((ITEM.fullmatch(r) for r in rows), key=lambda m: m[1][-1] in ".)"):
        tag = "ol" if ordered else "ul"
        out.append(f"<{tag}>" + "".join(f"<li>{inline(m[2])}</li>" for m in group) + f"</{tag}>")
    return "".join(out)


def html(text: str | None) -> str | None:
    if text is None:
        return None
    lines, out, at = text.splitlines(), [], 0

    def run(test) -> list[str]:
        nonlocal at
        first = at
        while at < len(lines) and test(lines[at]):
            at += 1
        return lines[first:at]

    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif m := FENCE.match(line):
            mark, at = m[1], at + 1
            code = run(lambda x: not ((f := FENCE.match(x)) and f[1][0] == mark[0] and len(f[1]) >= len(mark)))
            at += 1
            out.append(f"<pre><code>{escape(chr(10).join(code))}</code></pre>")
        elif (end := formula_end(lines, at)) is not None:
            out.append(f'<div class="formula">{escape(chr(10).join(lines[at : end + 1]))}</div>')
            at = end + 1
        elif m := HEAD.fullmatch(line):
            out.append(f"<h{len(m[1])}>{inline(m[2].strip())}</h{len(m[1])}>")
            at += 1
        elif RULE.fullmatch(line):
            out.append("<hr>")
            at += 1
        elif "|" in line and at + 1 < len(lines) and DELIMITER.fullmatch(lines[at + 1]) and "-" in lines[at + 1]:
            out.append(_table(run(lambda x: x.strip() and "|" in x)))
        elif line.lstrip().startswith(">"):
            quoted = run(lambda x: x.lstrip().startswith(">"))
            out.append(f"<blockquote>{html(chr(10).join(re.sub(r'^\s*>\s?', '', q) for q in quoted))}</blockquote>")
        elif ITEM.fullmatch(line):
            out.append(_list(run(lambda x: ITEM.fullmatch(x))))
        else:
            first = at
            at += 1
            run(lambda x: x.strip() and not FENCE.match(x) and not HEAD.fullmatch(x) and not ITEM.fullmatch(x) and not x.lstrip().startswith(">"))
            out.append("<p>" + "<br>".join(inline(x.strip()) for x in lines[first:at]) + "</p>")
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def rendered(text: pd.Series) -> pd.Series:
    return text.map(html, na_action="ignore")
