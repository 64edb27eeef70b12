"""Rules on the names and headings of notes, suggested names, prompts about a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.front_matter import front_matter
from ..functions.text import bare
from .links import resolved, stem, wikilinks

#: Fixed patterns: CJK characters, headings, headings that are a number alone, names that aren't phrases, dates, codes.
CJK = r"[一-鿿]"
HEADING = r"(?m)^(#{1,3})\s+(.+?)\s*$"
NUMBER_ONLY = r"^\d+(\.\d+)*$"
BAD_NAME = r"[_:]| {2,}"
DATE, CODE = r"^\d{4}[-_.]\d{2}[-_.]\d{2}", r"^[A-Za-z]?\d+[._-][A-Za-z0-9_.-]|^.*?[A-Z]{2,}.*?_\d|^[A-Z0-9]+_[A-Z0-9_]+$|^(?=[^一-龥]*$)(?=.*\d)(?=.*_)[A-Za-z0-9_]+$"
#: Fixed names and folders that the rules leave alone.
FREE_NAMES = ["log.md", "目录.md", "home.md", "agents.md", "readme.md"]
FREE_PARTS, FREE_ROOTS = ["templates", "TODO", "任务节点", "Clippings"], ["00-Inbox", "90-Archive"]
#: Links to a note from which on renaming it is risky; characters of a suggested name.
MANY_LINKS, NAME_CHARS = 3, 24


def exempt(path: Column) -> Column:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    low, s = F.lower(name), stem(path)
    old = low.rlike("^(log|agents|readme)-.+") & F.contains(path, F.lit("90-Archive"))
    folder = F.arrays_overlap(parts, F.array(*map(F.lit, FREE_PARTS))) | F.get(parts, F.lit(0)).isin(FREE_ROOTS)
    return low.isin(FREE_NAMES) | low.rlike("^(_|moc-|graph-ignore-)") | old | s.rlike(DATE) | s.rlike(CODE) | folder


def shortened(text: Column) -> Column:
    """A phrase short enough for a name: up to the first mark, without brackets and double blanks; null if nothing is left."""
    first = F.get(F.split(text, "[—–；;，,。：:]"), F.lit(0))
    t = bare(F.regexp_replace(F.regexp_replace(first, r"^[【\s]+", ""), r"\s+", " "))
    return F.nullif(bare(F.substring(t, 1, NAME_CHARS)), F.lit(""))


def suggested(name: Column, meta: Column, body: Column) -> Column:
    """A name from what the note says in CJK: title, tags, aliases, summary, else its first such heading; the old name follows unless it is in it."""
    fields = F.flatten(F.transform(F.array(*map(F.lit, ("title", "tags", "aliases", "summary"))), lambda k: F.split(F.coalesce(F.try_element_at(meta, k), F.lit("")), ",")))
    said = F.filter(F.concat(F.transform(fields, bare), F.transform(F.regexp_extract_all(body, F.lit(HEADING), F.lit(2)), bare)), lambda x: x.rlike(CJK))
    head = shortened(F.get(said, F.lit(0)))
    return F.when(F.contains(F.lower(head), F.lower(name)), head).otherwise(F.concat_ws(" ", head, F.when(head.isNotNull(), name)))


def violations(files: DataFrame) -> DataFrame:
    """(library_id, path, rule, hard, suggestion, inlinks, risky) of Markdown files (library_id, path, text) that aren't exempt.

    R1 no CJK in the name, R2 marks in the name, R3 no heading, R4 headings of numbers alone; H1 first heading and name differ, FM no title.
    """
    md = files.filter(F.lower("path").endswith(".md"))
    x = md.filter(~exempt(F.col("path"))).withColumn("__f", front_matter("text")).withColumn("__s", stem(F.col("path")))
    heads = F.transform(F.regexp_extract_all("__f.body", F.lit(HEADING), F.lit(2)), bare)
    x = x.withColumn("__h", heads)
    squeezed = lambda c: F.lower(F.regexp_replace(c, r"[\s\-_]+", ""))
    a, b = squeezed(F.get("__h", F.lit(0))), squeezed(F.col("__s"))
    differs = (F.size("__h") > 0) & (a != "") & (b != "") & (a != b)
    name = F.nullif(suggested(F.col("__s"), F.col("__f.meta"), F.col("__f.body")), F.lit(""))
    rule = lambda k, when, hard, s=None: F.when(when, F.struct(F.lit(k).alias("rule"), F.lit(hard).alias("hard"), (F.lit(None).cast("string") if s is None else s).alias("suggestion")))
    found = F.array_compact(F.array(
        rule("R1", ~F.col("__s").rlike(CJK), True, name), rule("R2", F.col("__s").rlike(BAD_NAME), True), rule("R3", F.size("__h") == 0, True),
        rule("R4", F.exists("__h", lambda h: h.rlike(NUMBER_ONLY)), True), rule("H1", differs, False), rule("FM", F.coalesce(F.try_element_at("__f.meta", F.lit("title")), F.lit("")) == "", False),
    ))
    links = resolved(wikilinks(md), md).groupBy("library_id", F.col("to").alias("path")).agg(F.count_distinct("path").alias("inlinks"))
    out = x.select("library_id", "path", F.explode(found).alias("v")).select("library_id", "path", "v.*").join(links, ["library_id", "path"], "left")
    return out.withColumn("inlinks", F.coalesce("inlinks", F.lit(0))).withColumn("risky", F.col("inlinks") >= MANY_LINKS)


def summary_prompt(samples: DataFrame, name: str, files: int = 15) -> DataFrame:
    """(library_id, prompt): a library's name, some of its files and sampled texts (library_id, path, heading, text, place), for a model to describe it."""
    one = F.concat(F.lit("- ["), F.concat_ws(" / ", "path", F.nullif("heading", F.lit(""))), F.lit("] "), F.col("text"))
    g = samples.groupBy("library_id").agg(F.array_sort(F.collect_set("path")).alias("ps"), F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("t")))), lambda s: s["t"]).alias("ts"))
    head = F.concat(F.lit(f"Library: {name}\nFiles ("), F.size("ps").cast("string"), F.lit(" sampled): "), F.array_join(F.slice("ps", 1, files), ", "))
    return g.select("library_id", F.concat(head, F.lit("\n\nPassages, to be summed up and not quoted:\n"), F.array_join("ts", "\n")).alias("prompt"))


def expansion_prompt(query: Column) -> Column:
    """What a model is asked for a passage that would answer the query."""
    return F.concat(F.lit("Write a short note of 60 to 150 words that would answer this query, with its terms, tools and names, and nothing else.\nQuery: "), query)
