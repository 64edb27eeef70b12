"""Advice on a batch of results: ordered rules, each a condition on the results of a query; the first few that fire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import CONF
from .links import stem

#: Fixed hints of libraries that hold no notes; words that make a query a question.
NOT_NOTES = ["agents", "skills", "test"]
QUESTION_WORDS = ["怎么", "如何", "为什么", "哪些", "什么", "是否", "能不能"]
#: Rules in order, with what they say.
SAYS = {
    "empty-dropped": "Nothing found: all hits were under the confidence limit.",
    "empty": "Nothing found: try other words or more libraries.",
    "all-weak": "All hits are weak: the libraries may not hold an answer.",
    "one-strong": "Only one hit is really relevant.",
    "no-strong": "The best hit is of middling relevance: read it in context.",
    "same-name": "Files of one name in different places: use whole paths.",
    "not-notes": "Hits come from libraries that hold no notes.",
    "many-strong": "Many strong hits: raise top_k for more.",
    "one-file": "Most hits are of one file: read it whole.",
    "binary": "Hits in PDF or Word files: read the extracted text.",
    "folded": "Sections are given whole and once.",
    "capped": "A file's hits were capped: read it whole.",
    "list": "This is a list of candidates: pick some and read them.",
    "few": "Few hits: widen folders or libraries.",
    "keywords": "A keyword query: a whole question finds more.",
}


def signals(results: DataFrame, defaults: list[str] | None = None, high: float = CONF.high) -> DataFrame:
    """What the rules look at, a row for each query with results."""
    r = results.withColumn("__stem", stem(F.col("path")))
    hint = F.lit(False)
    for h in NOT_NOTES:
        hint = hint | F.contains(F.lower("library_id"), F.lit(h))
    foreign = ~F.col("library_id").isin(defaults) & hint if defaults else F.lit(False)
    files = r.groupBy("query_id", "library_id", "path", "__stem").agg(F.count(F.lit(1)).alias("n"))
    names = files.groupBy("query_id", "__stem").agg(F.count(F.lit(1)).alias("m"))
    per = files.groupBy("query_id").agg(F.max("n").alias("busiest")).join(names.groupBy("query_id").agg(F.max("m").alias("same")), "query_id")
    s = r.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"), F.count_if(F.col("confidence") >= high).alias("strong"), F.max("folded").alias("folded"),
        F.max("capped").alias("capped"), F.max("backfilled").alias("backfilled"), F.max(F.coalesce(foreign, F.lit(False))).alias("foreign"),
        F.max(F.lower("path").rlike(r"\.(pdf|docx)$")).alias("binary"),
    )
    return s.join(per, "query_id")


def keywordish(query: Column) -> Column:
    q = F.trim(query)
    asks = q.rlike("[?？]")
    for w in QUESTION_WORDS:
        asks = asks | F.contains(q, F.lit(w))
    return (q != "") & (F.length(q) <= 12) & ~asks


def advise(queries: DataFrame, results: DataFrame, empty: DataFrame, top_k: int, body: bool = True, defaults: list[str] | None = None, most: int = 2, warn: float = CONF.warn, high: float = CONF.high) -> DataFrame:
    """(query_id, rules, lines): at most `most` of the rules that fire for a query (query_id, text), in order."""
    x = queries.select("query_id", "text").join(signals(results, defaults, high), "query_id", "left").join(empty, "query_id", "left")
    c = F.col
    some = c("n").isNotNull()
    fires = {
        "empty-dropped": ~some & (c("reason") == "all-below-drop-threshold"),
        "empty": ~some & ~F.coalesce(c("reason") == "all-below-drop-threshold", F.lit(False)),
        "all-weak": c("top") < warn,
        "one-strong": (c("top") >= warn) & (c("strong") == 1) & (c("n") > 1),
        "no-strong": (c("top") >= warn) & (c("strong") == 0) & (c("top") < high),
        "same-name": c("same") > 1,
        "not-notes": c("foreign"),
        "many-strong": (c("strong") >= 3) | ((c("strong") >= 1) & (c("top") >= 0.9) & (c("n") >= top_k)),
        "one-file": (c("n") >= 3) & (c("busiest") >= F.greatest(F.lit(2), F.bround(c("n") * 0.6))),
        "binary": c("binary"),
        "folded": (c("folded") > 0) | c("backfilled"),
        "capped": c("capped"),
        "list": some & F.lit(not body),
        "few": (c("n") <= 2) & (c("top") >= warn),
        "keywords": some & keywordish(c("text")),
    }
    rules = F.slice(F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in fires.items()))), 1, max(most, 1)) if most > 0 else F.array().cast("array<string>")
    says = F.create_map(*(F.lit(y) for k, v in SAYS.items() for y in (k, v)))
    return x.select("query_id", rules.alias("rules")).withColumn("lines", F.transform("rules", lambda r: F.element_at(says, r)))
