"""Files to text: providers by format, their chain, page routing, batches, caches. Failures are rows, never exceptions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, replace
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import needs_conversion
from ..operators.running import running
from ..storage import staged
from .tables import text_documents

TEXT_ROW = "library_id string, path string, content_hash string, text string, failure_state string, provider string"
#: Fixed namespace and names of heading styles of word-processor files.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
STYLE = re.compile(r"(?:heading|标题)\s*(\d+)", re.I)
#: The most bytes of XML that a word-processor file may unpack to.
MOST_XML = 512 << 20


def heading_level(style: str | None) -> int:
    """Level 1 to 3 of a heading style, 0 for others; deeper headings count as level 3."""
    name = (style or "").strip()
    m = STYLE.fullmatch(name)
    return 1 if name.lower() == "title" else max(1, min(3, int(m[1]))) if m else 0


def _text(x: ElementTree.Element) -> str:
    marks = {f"{WORD}t": lambda e: e.text or "", f"{WORD}tab": lambda e: "\t", f"{WORD}br": lambda e: "\n", f"{WORD}cr": lambda e: "\n"}
    return "".join(marks[e.tag](e) for e in x.iter() if e.tag in marks)


def docx_text(data: bytes) -> str:
    """Paragraphs, headings as #, and tables as pipe rows, in the order of the document's body."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist() if i.filename.endswith(".xml")) > MOST_XML:
            raise ValueError("the document unpacks to too much")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{WORD}style"):
                n = s.find(f"{WORD}name")
                styles[s.get(f"{WORD}styleId")] = n.get(f"{WORD}val") if n is not None else None
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    out = []
    for x in body if body is not None else ():
        if x.tag == f"{WORD}p":
            t = _text(x).strip()
            s = x.find(f"{WORD}pPr/{WORD}pStyle")
            sid = s.get(f"{WORD}val") if s is not None else None
            level = heading_level(styles.get(sid, sid))
            if t:
                out.append(f"{'#' * level} {t}" if level else t)
        elif x.tag == f"{WORD}tbl":
            rows = [["\n".join(_text(p) for p in c.iter(f"{WORD}p")).strip().replace("\n", " ") for c in r.findall(f"{WORD}tc")] for r in x.findall(f"{WORD}tr")]
            if rows:
                line = lambda cells: "| " + " | ".join(cells) + " |"
                out.append("\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]))
    return "\n\n".join(out)


@dataclass(frozen=True)
class Provider:
    """A way to read files of a format. read: bytes to text, None or blank if there is none; called in pandas batches on executors."""

    name: str
    formats: tuple[str, ...]
    read: Callable[[bytes], str | None]
    active: bool = True
    version: str = "1"


def _plain(data: bytes) -> str:
    return data.decode("utf-8-sig", errors="replace").replace("\r\n", "\n").replace("\r", "\n")


PLAIN, DOCX = Provider("text", ("md", "txt", "markdown"), _plain), Provider("docx", ("docx",), docx_text)


def attempted(files: DataFrame, providers: list[Provider]) -> DataFrame:
    """files (library_id, path, content_hash, content) -> TEXT_ROW and place: an attempt of every active provider of a file's format."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    out = None
    for place, p in enumerate(providers):
        if not p.active:
            continue

        def run(batches, p=p):
            for b in batches:
                text, state = [], []
                for data in b["content"]:
                    try:
                        t, s = (None, "unreadable") if data is None else (p.read(bytes(data)), None)
                    except Exception:  # what a file does to its reader is a failure of the file
                        t, s = None, "extract-failed"
                    blank = t is None or not t.strip()
                    text.append(None if blank else t)
                    state.append(s or ("empty" if blank else None))
                yield pd.DataFrame({"library_id": b["library_id"], "path": b["path"], "content_hash": b["content_hash"], "text": text, "failure_state": state, "provider": p.name})

        some = files.filter(ext.isin(list(p.formats))).select("library_id", "path", "content_hash", "content").mapInPandas(run, TEXT_ROW).withColumn("place", F.lit(place))
        out = some if out is None else out.unionByName(some)
    if out is None:
        return files.select("library_id", "path", "content_hash", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("failure_state"), F.lit(None).cast("string").alias("provider"), F.lit(0).alias("place")).limit(0)
    return out


def chained(files: DataFrame, attempts: DataFrame) -> DataFrame:
    """TEXT_ROW of every file: the first attempt that has text, else the first failure; without a provider the file can't be read."""
    key = ["library_id", "path"]
    w = W.partitionBy(*key).orderBy(F.col("text").isNull(), "place")
    best = attempts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*key, "text", "failure_state", "provider")
    x = files.select(*key, "content_hash").join(best, key, "left")
    return x.withColumn("failure_state", F.when(F.col("provider").isNull(), "extract-failed").otherwise(F.when(F.col("text").isNull(), F.col("failure_state"))))


def extracted(files: DataFrame, providers: list[Provider], cache: DataFrame | None = None) -> DataFrame:
    """chained() of files whose text isn't in the cache (content_hash, route, text); route: the provider and its version."""
    if cache is None:
        return chained(files, attempted(files, providers))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    routes = files.sparkSession.createDataFrame([(e, f"{p.name}:{p.version}", n) for n, p in enumerate(providers) if p.active for e in p.formats], "ext string, route string, n int")
    key = ["library_id", "path"]
    hit = files.select(*key, "content_hash", ext.alias("ext")).join(F.broadcast(routes), "ext").join(cache, ["content_hash", "route"])
    hit = hit.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy("n"))).filter("__n = 1")
    hit = hit.select(*key, "content_hash", "text", F.lit(None).cast("string").alias("failure_state"), F.substring_index("route", ":", 1).alias("provider"))
    rest = files.join(hit.select(*key), key, "left_anti")
    return hit.unionByName(chained(rest, attempted(rest, providers)))


def preview(files: DataFrame, providers: list[Provider], only: str = "") -> DataFrame:
    """Files (library_id, path, content_hash, content) tried without any index: ok, text, chars, reason and route of each.

    The chain is that of a round; only names a provider that is tried alone, active or not. Nothing is read from a cache or written."""
    if only:
        providers = [replace(p, active=True) for p in providers if p.name == only]
    x = extracted(files, providers)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    known = ext.isin(sorted({f for p in providers if p.active for f in p.formats}))
    reason = F.when(~known, F.concat(F.lit("no provider for ."), ext)).otherwise(F.col("failure_state"))
    return x.select("library_id", "path", F.col("text").isNotNull().alias("ok"), "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), reason.alias("reason"), F.coalesce("provider", F.lit("-")).alias("route"))


def pruned(cache: DataFrame, settled: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The cache rows (content_hash, route, text, written) that stay: not settled by a published index, and younger than `days`."""
    return cache.join(settled.select("content_hash").distinct(), "content_hash", "left_anti").filter(F.col("written") >= now - F.make_interval(days=F.lit(days)))


def routed(pages: DataFrame, budget: int, ocr: bool = True, overflow: bool = False) -> DataFrame:
    """(library_id, path, route, missing_reason, n): where the image pages of each PDF go. pages (library_id, path, page, kind)."""
    n = F.count_if(F.col("kind") == "image")
    x = pages.groupBy("library_id", "path").agg(n.alias("n"))
    over = (F.col("n") > budget) if budget > 0 else F.lit(False)
    route = F.when(F.col("n") == 0, "text").when(F.lit(not ocr), "text").when(~over, "ocr").when(F.lit(overflow), "overflow").otherwise("text")
    why = F.when((F.col("n") > 0) & F.lit(not ocr), "ocr-off").when(over & F.lit(not overflow), "too-many-pages")
    return x.select("library_id", "path", route.alias("route"), why.alias("missing_reason"), "n")


def missing_reason(states: Column) -> Column:
    """One reason for the runs that failed: a service that was down is tried again."""
    return F.when(F.array_contains(states, "deferred"), "ocr-deferred").otherwise("ocr-failed")


def batches(files: DataFrame, most_files: int, most_pages: int, by: str = "library_id", order: str = "path") -> DataFrame:
    """files (by, order, pages) with batch: in order, up to most_files files and most_pages pages; files of unknown or larger size alone.

    Where the batch that begins at a file ends follows from running sums of pages; the files at which batches really begin are those that the first one
    leads to, found by doubling the step: after k rounds 2**k batches are known. No library's files come together in one task.
    """
    f = files.select(by, F.col(order).alias("k"), F.col("pages").cast("long").alias("p"))
    alone = F.lit(most_files <= 1) | F.col("p").isNull() | (F.col("p") > most_pages)
    f = running(f.withColumn("alone", alone), [by], ["k"], 1, "i")
    f = staged(running(f, [by], ["i"], F.when(F.col("alone"), 0).otherwise(F.col("p")), "before"))
    # a batch is full at the first file that stands alone, that is one too many, or whose pages are: sums that lie beyond what its first file may reach
    ends = f.select(by, "i", (F.col("before") + F.when(F.col("alone"), 0).otherwise(F.col("p"))).alias("s"), F.lit(0).alias("kind"))
    asks = f.filter("not alone").select(by, "i", (F.col("before") + most_pages).alias("s"), F.lit(1).alias("kind"))
    full = running(ends.unionByName(asks), [by], ["s", "kind", "i"], F.when(F.col("kind") == 0, 1).otherwise(0), "fit").filter("kind = 1").select(by, "i", F.col("fit").alias("full"))
    blocks = f.filter("alone").select(by, F.col("i").alias("a"))
    n_before = running(f.select(by, "i", "alone"), [by], ["i"], F.col("alone").cast("int"), "m")
    numbered = running(blocks, [by], ["a"], 1, "m")
    shut = n_before.filter("not alone").join(numbered, [by, "m"], "left").select(by, "i", F.col("a").alias("shut"))
    nxt = f.select(by, "i", "alone").join(full, [by, "i"], "left").join(shut, [by, "i"], "left")
    nxt = nxt.select(by, "i", F.when(F.col("alone"), F.col("i") + 1).otherwise(F.least(F.col("i") + most_files, F.greatest("full", F.col("i") + 1), F.coalesce("shut", F.lit(2**62)))).alias("to"))
    jump, reached = staged(nxt), staged(f.filter("i = 0").select(by, "i"))
    count = reached.count()
    while count:
        more = reached.join(jump, [by, "i"]).select(by, F.col("to").alias("i")).join(f.select(by, "i"), [by, "i"], "left_semi")
        reached = staged(reached.unionByName(more).distinct())
        now = reached.count()
        if now == count:
            break
        count = now
        far = jump.select(by, F.col("i").alias("to"), F.col("to").alias("far"))
        jump = staged(jump.join(far, [by, "to"]).select(by, "i", F.col("far").alias("to")))
    begins = f.join(reached.withColumn("first", F.lit(1)), [by, "i"], "left")
    out = running(begins.withColumn("first", F.coalesce("first", F.lit(0))), [by], ["i"], F.col("first"), "b")
    return out.select(by, F.col("k").alias(order), F.col("p").alias("pages"), (F.col("b") + F.col("first") - 1).cast("int").alias("batch"))


def found_document(listing: DataFrame, library: str, path: str) -> str:
    """The path that is meant: that one, or without an extension the only file of that stem. KeyError if none or several, ValueError if it is excluded."""
    from ..operators.links import stem

    own = listing.filter(F.col("library_id") == library)
    rows = own.filter(F.col("path") == path).limit(2).collect()
    if not rows and "." not in path:
        rows = own.filter((stem(F.col("path")) == path) | (F.regexp_replace("path", r"\.[^./]*$", "") == path)).limit(2).collect()
    if len(rows) != 1:
        raise KeyError(f"{path}: {'several files' if rows else 'no file'} in {library}")
    if not rows[0].included:
        raise ValueError(f"{rows[0].path} is excluded: {rows[0].reason}")
    return rows[0].path


def read_document(listing: DataFrame, contents: DataFrame, cache: DataFrame, library: str, path: str) -> dict:
    """The whole text of one document: plain text from its source, others from what was extracted. One row reaches the driver."""
    p = found_document(listing, library, path)
    here = (F.col("library_id") == library) & (F.col("path") == p)
    plain = not listing.limit(1).select(needs_conversion(F.lit(p)).alias("c")).first().c
    rows = (text_documents(contents.filter(here)) if plain else cache.filter(here)).select("text").limit(1).collect()
    if not rows:
        raise ValueError(f"{p} has no text yet: index it first")
    return {"library_id": library, "path": p, "text": rows[0].text or "", "source": "file" if plain else "cache"}


def tail(log: DataFrame, after: int | None = None, most: int = 300) -> DataFrame:
    """Lines of a log (at, line) behind a place; without one the last `most`."""
    if after is not None:
        return log.filter(F.col("at") >= after).orderBy("at")
    return log.orderBy(F.desc("at")).limit(most).orderBy("at")
