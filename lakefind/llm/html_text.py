"""Main text of web pages by composite text density.

The page becomes a tree; for every node the text density is its characters per tag, adjusted by its share of link text (composite text
density); on a page without links it is plain characters per tag. A node's density sum is that of its children and of its own text.
The threshold is the least density on the path from the node of the greatest sum to the body. From the body down, every node that has the
threshold keeps the subtree of the greatest sum in it, and its other children are looked at in the same way.
Densities are counted twice: first over all that a page shows, whatever its names, and what falls short there is out; then over the page without what
names mark, where the subtrees are chosen among those the first count has left (all of them if it has left none). Then
what is kept is widened to the article that holds it, or, if no article holds any of it, to main. Text elements between kept siblings and
headings right before them stay.
A form that holds more than half of the page's text is a frame and stays; only its fields go.
By names, what is a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment by its tag, role or class goes. A whole
class token of NAMES decides; one word of a longer name, or of an id inside an article, only if links or density confirm it.

Defined results: null and empty html give empty text; a page without body is its own body; a page without tags is its text. Each
row is read by itself, whatever its id; an input column called text goes, other extra columns stay. A page is read in time linear in its
length, but for names that need confirming inside each other.
"""

from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that hold a run of text; headings; blocks of text that aren't containers.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | {"p", "li", "blockquote"}
TEXTS = PARAGRAPHS | frozenset("address caption dd details dl dt figcaption figure hgroup hr ol pre table ul".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
DROPPED = frozenset("head script style noscript template iframe object svg math nav footer aside form button select option input textarea dialog menu".split())
#: Opening the key closes an open element of the value, up to a boundary.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
BOUNDARY = frozenset("ul ol dl table article section div body main aside td th form blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class and id names (split at anything but letters) that mark what is not the article.
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation navmenu menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar comment comments disqus respond replies reply cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget toolbar pagination pager skip login".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag: quoted values may hold >.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WHITE = re.compile(r"[ \t\n\r\f\v\xa0  -     　\x1c-\x1f\x85]+")


class Node:
    __slots__ = ("attrs", "chars", "children", "density", "dropped", "link_chars", "link_tags", "name", "sum", "tags", "up")

    def __init__(self, name: str, attrs: str, up: Node | None):
        self.name, self.attrs, self.up, self.children = name, attrs, up, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.dropped = False


def _tokens(page: str):
    """(text, end tag?, name, attributes, place behind the tag) one after another, in time linear in the page; name None ends it."""
    at, n, last, odd = 0, len(page), page.rfind(">"), False
    text = at
    no_cdata = False
    while True:
        m = page.find("<", at)
        if m < 0 or m > last:
            # an unclosed comment hides the rest, other unclosed marks are text
            end = page.find("<!--", at) if m >= 0 else -1
            yield page[text : end if end >= 0 else n], False, None, "", n
            return
        if page.startswith("<!--", m):
            close = page.find("-->", m + 4)
            yield page[text:m], False, "", "", (at := close + 3 if close >= 0 else n)
            text = at
            continue
        if not no_cdata and page.startswith("<![CDATA[", m):
            close = page.find("]]>", m)
            no_cdata = close < 0
            if close >= 0:
                yield page[text:m], False, "", "", (at := close + 3)
                text = at
                continue
        tag = TAG.match(page, m)
        if tag is None:
            if page[m + 1 : m + 2] in ("!", "?"):
                close = page.find(">", m)
                yield page[text:m], False, "", "", (at := close + 1)
                text = at
            else:
                at = m + 1
            continue
        rest = None if odd else REST.match(page, tag.end())
        if rest is None:
            # quotes that are never closed: from here on a tag ends at the next >
            odd = True
            close = page.find(">", tag.end())
            if close < 0:
                at = m + 1
                continue
        else:
            close = rest.end() - 1
        skip = yield page[text:m], bool(tag[1]), tag[2].lower(), page[tag.end() : close], close + 1
        at = text = skip if skip is not None else close + 1


class _Open:
    """Open elements, with the places of each name, so that looking for one takes no walk."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}
        self.bounds: list[int] = []
        self.row_bounds: list[int] = []

    def push(self, x: Node) -> None:
        i = len(self.stack)
        self.places.setdefault(x.name, []).append(i)
        if x.name in BOUNDARY:
            self.bounds.append(i)
            if x.name not in ("td", "th"):
                self.row_bounds.append(i)
        self.stack.append(x)

    def cut(self, i: int) -> None:
        """Close the elements from place i on."""
        while len(self.stack) > i:
            x = self.stack.pop()
            self.places[x.name].pop()
            if x.name in BOUNDARY:
                self.bounds.pop()
                if x.name not in ("td", "th"):
                    self.row_bounds.pop()

    def near(self, name: str) -> int | None:
        """The innermost place of an element of that name."""
        return self.places[name][-1] if self.places.get(name) else None

    def close_paragraph(self) -> None:
        i = self.near("p")
        if i is not None and i > (self.bounds[-1] if self.bounds else 0):
            self.cut(i)

    def close_implied(self, names: set[str]) -> None:
        low = self.row_bounds[-1] if self.row_bounds else 0
        first = [p[k] for n in names if (p := self.places.get(n)) and (k := bisect_right(p, low)) < len(p)]
        if first:
            self.cut(min(first))


def parse(page: str) -> Node:
    """A tree of Nodes and strings; unclosed and misplaced tags are mended the way browsers do in the common cases."""
    root = Node("html", "", None)
    held = _Open(root)
    tokens = _tokens(page)
    token = next(tokens, None)
    while token is not None:
        text, ends, name, attrs, behind = token
        skip = None
        top = held.stack[-1]
        if text:
            top.children.append(text)
        if name is None:
            break
        if name and name != "html":
            if ends:
                i = held.near(name)
                if i is not None:
                    held.cut(i)
                elif name == "p":
                    top.children.append(Node("p", "", top))
            else:
                if name in CLOSES_P:
                    held.close_paragraph()
                if name in IMPLIED:
                    held.close_implied(IMPLIED[name])
                top = held.stack[-1]
                node = Node(name, attrs, top)
                top.children.append(node)
                if name in RAW and not attrs.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, behind)
                    node.children.append(page[behind : end.start() if end else len(page)])
                    skip = end.end() if end else len(page)
                elif name not in VOID and not attrs.endswith("/"):
                    held.push(node)
        try:
            token = tokens.send(skip)
        except StopIteration:
            break
    return root


def _excluded(x: Node, in_article: bool) -> bool | None:
    """Whether x goes by its tag, role or class; None if a word of its name says so that density and links must confirm."""
    if x.name in DROPPED or (x.name == "header" and not in_article):
        return True
    named: bool | None = False
    for a in ATTR.finditer(x.attrs) if x.attrs else ():
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and x.name not in ("article", "main", "body"):
            sure = key == "class" or not (in_article or x.name in HEADINGS or x.name in PARAGRAPHS)
            for token in value.split():
                words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token)]
                if in_article and x.name == "header" and "header" in words:
                    continue
                if sure and token.lower() in NAMES:
                    return True
                if any(w in NAMES for w in words):
                    named = None
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return named


def _boilerplate(x: Node, frame: Node) -> bool:
    """Whether links or density confirm that x isn't part of the text of frame (its article, else the body)."""
    if 2 * x.link_chars > x.chars:
        return True
    if x.name in TEXTS:
        return False
    stack, paragraphs = [x], False
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node) and not c.dropped:
                if c.name in HEADINGS and frame.name in ("article", "main"):
                    return False
                paragraphs = paragraphs or c.name in PARAGRAPHS
                stack.append(c)
    plain = x.chars / max(x.tags, 1)
    return plain < frame.chars / max(frame.tags, 1) or not paragraphs and frame.name not in ("article", "main")


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; on a page without links the plain one, characters per tag."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    if base <= 1:
        return chars / max(tags, 1)
    inner = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(max(inner, 1.0)) / math.log(base)


def _count(order: list[tuple[Node, bool]]) -> None:
    for x, link in reversed(order):
        if x.dropped:
            continue
        for c in x.children:
            if isinstance(c, str):
                k = len(WHITE.sub(" ", c).strip())
                x.chars += k
                x.link_chars += k if link else 0
            elif not c.dropped:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.name == "a")


def _frames(root: Node) -> set[Node]:
    """Forms that are the frame of a page: they hold more than half of its text, so what is in them is judged, not they."""
    order, stack, forms = [], [root], []
    while stack:
        x = stack.pop()
        order.append(x)
        forms += [x] if x.name == "form" else []
        stack.extend(c for c in x.children if isinstance(c, Node) and c.name not in RAW)
    if not forms:
        return set()
    size: dict[Node, int] = {}
    for x in reversed(order):
        size[x] = sum(len(c.strip()) if isinstance(c, str) else size.get(c, 0) for c in x.children)
    return {x for x in forms if 2 * size[x] > size[root]}


def _weighed(order: list[tuple[Node, bool]], body: Node) -> None:
    """Densities and their sums of nodes that have been counted."""
    share = body.link_chars / max(body.chars, 1)
    for x, link in order:
        x.sum = 0.0
        if x.dropped:
            continue
        x.density = _density(x.chars, x.tags, x.link_chars, x.link_tags, share)
        for c in x.children:
            if isinstance(c, str):
                k = len(WHITE.sub(" ", c).strip())
                x.sum += _density(k, 0, k if link else 0, 0, share)
    for x, _ in order:
        if not x.dropped:
            x.sum += sum(c.density for c in x.children if isinstance(c, Node) and not c.dropped)


def first_count(root: Node) -> set[Node]:
    """What density alone keeps of all that a page shows: only what is no text at all is left out."""
    order, body, stack = [], None, [(root, False)]
    while stack:
        x, link = stack.pop()
        x.dropped = x.name in RAW or x.name == "head"
        order.append((x, link or x.name == "a"))
        if x.name == "body" and body is None:
            body = x
        if not x.dropped:
            stack.extend((c, link or x.name == "a") for c in x.children if isinstance(c, Node))
    body = body or root
    _count(order)
    _weighed(order, body)
    kept = dense(body)
    for x, _ in order:
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        x.density, x.dropped = 0.0, False
    return kept


def measure(root: Node) -> Node:
    """Counts and densities of all nodes without what names mark, bottom up; the body."""
    order, body, suspects, frames = [], None, [], _frames(root)
    stack: list = [(root, False, None)]
    while stack:
        x, link, article = stack.pop()
        excluded = x not in frames and _excluded(x, article is not None)
        x.dropped = excluded is True
        if excluded is None:
            suspects.append((x, article))
        order.append((x, link or x.name == "a"))
        if x.name == "body" and body is None:
            body = x
        if not x.dropped:
            frame = x if x.name in ("article", "main") else article
            stack.extend((c, link or x.name == "a", frame) for c in x.children if isinstance(c, Node))
    _count(order)
    body = body or root
    gone = [x for x, article in suspects if _boilerplate(x, article or body)]
    if gone:
        for x in gone:
            x.dropped = True
        for x, _ in order:
            x.chars = x.tags = x.link_chars = x.link_tags = 0
            x.dropped = x.dropped or (x.up is not None and x.up.dropped)
        _count(order)
    _weighed(order, body)
    return body


def _below(body: Node) -> list[Node]:
    order, stack = [], [body]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if isinstance(c, Node) and not c.dropped)
    return order


def dense(body: Node) -> set[Node]:
    """The nodes that density keeps."""
    order = _below(body)
    top: dict[Node, Node] = {}  # the node of the greatest sum in each subtree
    for x in reversed(order):
        t = x
        for c in x.children:
            if isinstance(c, Node) and not c.dropped and top[c].sum > t.sum:
                t = top[c]
        top[x] = t

    def holder(t: Node, x: Node) -> Node:
        while t is not x and (t.name not in BLOCK or t.name in PARAGRAPHS):
            t = t.up  # the sum of one long paragraph speaks for what holds it
        return t

    def path(x: Node) -> list[Node]:
        out = [x]
        while out[-1] is not body and out[-1].up is not None:
            out.append(out[-1].up)
        return out

    threshold = min((x.density for x in path(holder(top[body], body)) if x.density > 0), default=0.0)
    kept, stack = set(), [body]
    while stack:
        x = stack.pop()
        if x in kept or x.density < threshold or not x.density:
            continue
        t = holder(top[x], x)
        kept.add(t)
        if t is not x:
            stack.extend(c for c in x.children if isinstance(c, Node) and not c.dropped)
    return kept


def among(kept: set[Node], first: set[Node]) -> set[Node]:
    """Those of kept that lie in, or hold, a node of first; all of them if there is none."""
    above = set()
    for x in first:
        while x is not None and x not in above:
            above.add(x)
            x = x.up
    out = set()
    for x in kept:
        y = x
        while y is not None and y not in first:
            y = y.up
        if y is not None or x in above:
            out.add(x)
    return out or kept


def chosen(body: Node, first: set[Node]) -> set[Node]:
    """The nodes that density keeps both times, each widened to its article."""
    kept, order = among(dense(body), first), _below(body)
    for name in ("article", "main"):
        outer: dict[Node, Node | None] = {}  # the outermost element of that name around each node
        for x in order:
            outer[x] = (outer.get(x.up) if x is not body else None) or (x if x.name == name else None)
        if any(outer[x] for x in kept):
            return {outer[x] or x for x in kept}
    return kept


def parts(body: Node, first: set[Node]) -> list:
    """What is kept, in the page's order; None ends a block. Text elements between kept siblings and headings right before them stay."""
    kept = chosen(body, first)
    if not kept or body in kept:
        return [body]
    holds = set(kept)
    for x in kept:
        while x is not body and x.up is not None and x.up not in holds:
            x = x.up
            holds.add(x)
    out: list = []
    stack: list = [body]
    while stack:
        x = stack.pop()
        if not isinstance(x, Node) or x not in holds or x in kept:
            out.append(x)
            continue
        at = [i for i, c in enumerate(x.children) if isinstance(c, Node) and c in holds]
        first = at[0]
        while first and (isinstance(x.children[first - 1], str) and not x.children[first - 1].strip() or isinstance(x.children[first - 1], Node) and x.children[first - 1].name in HEADINGS):
            first -= 1
        inner = [c for c in x.children[first : at[-1] + 1] if isinstance(c, str) or c in holds or ((c.name not in BLOCK or c.name in TEXTS) and 2 * c.link_chars <= c.chars)]
        stack.extend((None, *reversed(inner), None))
    return out


def blocks(nodes: list) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        t = WHITE.sub(" ", "".join(held)).strip()
        held.clear()
        if t:
            out.append(t)

    stack: list = nodes[::-1]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(_html.unescape(x))  # by itself: what markup parts is no reference
        elif not x.dropped:
            if x.name == "br":
                held.append(" ")
                continue
            if x.name in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.children))
    end()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    first = first_count(root)
    return "\n".join(blocks(parts(measure(root), first)))


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages but html, with text."""
    keep = [c for c in pages.columns if c not in (html_col, "text")]
    d = pages.select(*keep, F.col(html_col).alias("__html"))

    def run(batches):
        for b in batches:
            text = pa.array([extract(x) for x in b.column("__html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), text], names=[*keep, "text"])

    kinds = dict(pages.dtypes)
    return d.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return t.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
