"""Conversion reports: which files are text, whose pages are indexed, what is missing and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.text import needs_conversion

KEY = ["library_id", "path"]
PENDING = ["scanned", "deferred"]


def failure_code(detail: Column, state: Column, reason: Column) -> Column:
    """The reason code of a failed record: too many pages by its detail, else its state or reason where known."""
    known = list(R.REASONS)
    a, b = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (state, reason))
    return F.when(F.contains(F.coalesce(detail, F.lit("")), F.lit("too-many-pages")), "too-many-pages").when(a.isin(known), a).when(b.isin(known), b).otherwise("extract-failed")


def entries(included: DataFrame, manifest: DataFrame, cache: DataFrame, pages: DataFrame, pages_on: bool = True, generation: str | None = None) -> DataFrame:
    """One row for each included file that needs conversion.

    included (library_id, path); manifest (…, status, failure_state, failure_reason, failure_detail, extractor_id, missing_pages,
    missing_reason, ocr_pages, ocr_by); cache (…, text_file, text_bytes, text_updated); pages (…, provider_id, status, pages,
    page_count, built_in, failure_reason), of which the first provider counts.
    """
    x = included.select(*KEY).distinct().filter(needs_conversion(F.col("path"))).withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)))
    x = x.join(manifest.withColumn("__known", F.lit(True)), KEY, "left").join(cache, KEY, "left")
    first = pages.withColumn("__n", F.row_number().over(W.partitionBy(*KEY).orderBy("provider_id"))).filter("__n = 1")
    first = first.select(*KEY, F.array_sort(F.array_distinct(F.filter("pages", lambda p: p > 0))).alias("pages"), "page_count", F.col("status").alias("__ps"), "built_in", F.col("failure_reason").alias("pages_detail"))
    x = x.join(first, KEY, "left")
    missing = F.array_sort(F.array_distinct(F.coalesce("missing_pages", F.array().cast("array<int>"))))
    code = failure_code(F.col("failure_detail"), F.col("failure_state"), F.col("failure_reason"))
    known, indexed, cached = F.col("__known").isNotNull(), F.coalesce(F.col("status") == "indexed", F.lit(False)), F.col("text_file").isNotNull()
    state = F.when(~known, "pending").when(~indexed, F.when(code.isin(PENDING), "pending").otherwise("failed")).when(~cached, "missing").when(F.size(missing) > 0, "partial").otherwise("done")
    reason = F.when(~known, "not-indexed").when(~indexed, code).when(~cached, "cache-missing").when(F.size(missing) > 0, F.coalesce(F.nullif("missing_reason", F.lit("")), F.lit("ocr-failed")))
    some = F.coalesce(F.size("pages"), F.lit(0)) > 0
    pstate = (
        F.when(F.col("extension") != "pdf", "n/a").when(F.lit(not pages_on), "off").when(F.col("__ps").isNull(), "none")
        .when((F.col("__ps") == "indexed") & some, "done").when(F.col("__ps").isin("indexed", "partial") & some, "partial").otherwise("failed")
    )
    preason = {"off": "pages-off", "none": "pages-not-built", "partial": "pages-partial", "failed": "pages-failed"}
    x = x.withColumns({"text_state": state, "text_reason": reason, "text_missing_pages": F.when(state.isin("partial"), missing).otherwise(F.array().cast("array<int>")), "pages_state": pstate})
    x = x.withColumn("pages_reason", F.try_element_at(F.create_map(*(F.lit(y) for k, v in preason.items() for y in (k, v))), "pages_state"))
    rebuilt = F.coalesce(F.col("built_in") == generation, F.lit(False)) if generation else F.lit(False)
    ok = F.col("text_state").isin("done", "partial")
    return x.select(*KEY, "extension", "text_state", "text_reason", "text_missing_pages", F.when(ok, F.col("extractor_id")).alias("text_route"), F.when(ok, F.col("ocr_pages")).alias("text_ocr_pages"), F.when(ok, F.col("ocr_by")).alias("text_ocr_by"), "text_file", "text_bytes", "text_updated", "pages_state", "pages_reason", "pages_detail", "pages", "page_count", rebuilt.alias("pages_rebuilt"))


def needs_attention(e: DataFrame) -> Column:
    return (F.col("text_state") != "done") | F.col("pages_state").isin("none", "partial", "failed")


def missing_pages(pages: Column, count: Column) -> Column:
    """Pages of a document that aren't indexed, if it is known how many it has."""
    return F.when(F.coalesce(count, F.lit(0)) > 0, F.array_except(F.sequence(F.lit(1), count.cast("int")), pages)).otherwise(F.array().cast("array<int>"))


def summary(e: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per library: text reused, new and missing, pages too. fresh (library_id, path): files that were really extracted in this round."""
    x = e.join(fresh.select(*KEY).distinct().withColumn("__new", F.lit(True)), KEY, "left")
    done, new = F.col("text_state").isin("done", "partial"), F.col("__new").isNotNull()
    built, on = F.col("pages_state").isin("done", "partial"), F.col("pages_state") != "off"
    n = F.count_if
    gap = F.size("text_missing_pages")
    return x.groupBy("library_id").agg(
        n(done & ~new).alias("text_reused"), n(done & new).alias("text_new"), n(~done).alias("text_missing"), n(built & ~F.col("pages_rebuilt") & on).alias("pages_reused"),
        n(built & F.col("pages_rebuilt") & on).alias("pages_new"), n((F.col("extension") == "pdf") & ~built & on).alias("pages_missing"),
        F.sum(gap).alias("pages_unrecognised"), n(gap > 0).alias("files_unrecognised"), F.coalesce(F.sum(F.when(done, F.col("text_bytes"))), F.lit(0)).alias("text_bytes"),
    )


def by_route(e: DataFrame, fresh: DataFrame) -> DataFrame:
    """(library_id, rank, route, files, pages): what each route converted in this round, most first."""
    x = e.join(fresh.select(*KEY).distinct(), KEY, "left_semi").filter(F.col("text_state").isin("done", "partial"))
    g = x.groupBy("library_id", F.coalesce("text_route", F.lit("?")).alias("route")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce(F.size("text_ocr_pages"), F.lit(0))).alias("pages"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("library_id").orderBy(F.desc("files"), "route")))


def catalogue(e: DataFrame) -> DataFrame:
    """(library_id, path, line): a row of a Markdown table for each file, in order of path; head() is its head."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", "\\\\\\\\|"), "\n", " ")
    text = F.when(F.col("text_state") == "done", "yes").when(F.col("text_state") == "partial", F.concat(F.lit("pages "), R.page_ranges(F.col("text_missing_pages")), F.lit(" missing: "), R.reason_text(F.col("text_reason"))["label"])).otherwise(R.reason_text(F.col("text_reason"))["label"])
    ok = F.col("text_state").isin("done", "partial")
    shown = F.when(F.col("page_count") > 0, F.concat(F.coalesce(F.size("pages"), F.lit(0)).cast("string"), F.lit("/"), F.col("page_count").cast("string"))).otherwise(F.coalesce(F.size("pages"), F.lit(0)).cast("string"))
    pages = F.when(F.col("pages_state") == "n/a", "-").when(F.col("pages_state").isin("done", "partial"), shown).otherwise(R.reason_text(F.col("pages_reason"))["label"])
    cells = [F.col("path"), text, F.when(ok, F.col("text_route")), F.when(ok, R.human_bytes(F.col("text_bytes"))), F.when(ok, F.col("text_file")), pages]
    return e.select(*KEY, F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cells)), F.lit(" |")).alias("line"))


def head() -> list[str]:
    return ["| file | text | by | size | cache | pages |", "|---|---|---|---|---|---|"]


def issues(e: DataFrame) -> DataFrame:
    """(library_id, reason, files, label, place): reasons that need attention, in their fixed order."""
    order = F.array(*map(F.lit, R.REASONS))
    bad = e.filter(F.col("text_reason").isNotNull()).groupBy("library_id", F.col("text_reason").alias("reason")).agg(F.count(F.lit(1)).alias("files"))
    return bad.withColumn("label", R.reason_text(F.col("reason"))["label"]).withColumn("place", F.array_position(order, F.col("reason")))


def log_lines(failures: DataFrame, log: DataFrame, most: int = 3) -> DataFrame:
    """(library_id, path, line_no, line): the last lines of a log (line_no, line) that name a failed file."""
    f = failures.select(*KEY, F.element_at(F.split("path", "/"), -1).alias("__name")).distinct()
    # names are looked up by the tokens of a line, so no line meets every failure
    token = r"[^\s\"'()<>,;:]+"
    words = log.select("line_no", "line", F.explode(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("line", F.lit(token), F.lit(0)), lambda t: F.array(t, F.substring_index(t, "/", -1)))))).alias("__w"))
    first = f.withColumn("__w", F.regexp_extract("__name", token, 0))
    hit = words.join(first, "__w").filter(F.contains("line", F.col("__name"))).select(*KEY, "line_no", "line").distinct()
    return hit.withColumn("__n", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("line_no")))).filter(F.col("__n") <= most).drop("__n")


def page_index_status(files: DataFrame) -> DataFrame:
    """Per library: pages and PDFs in the page index, and its failures. files (library_id, path, status, pages, failure_reason)."""
    return files.groupBy("library_id").agg(F.sum(F.coalesce(F.size("pages"), F.lit(0))).alias("pages"), F.count(F.lit(1)).alias("pdfs"), F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.struct("path", "failure_reason")))).alias("failures"))


def page_plan(pdfs: DataFrame, recorded: DataFrame) -> DataFrame:
    """(library_id, path, action): what a round of the page index does with each PDF.

    pdfs (…, content_hash, signature), recorded (…, content_hash, signature, status): kept only if indexed and unchanged; others are tried again each round.
    """
    o = recorded.select(*KEY, F.col("content_hash").alias("o_hash"), F.col("signature").alias("o_signature"), F.col("status").alias("o_status"))
    j = pdfs.join(o, KEY, "full_outer")
    same = (F.col("content_hash") == F.col("o_hash")) & F.equal_null("signature", "o_signature")
    action = F.when(F.col("content_hash").isNull(), "removed").when(F.col("o_status").isNull(), "added").when((F.col("o_status") == "indexed") & same, "kept").when(F.col("o_status") == "indexed", "changed").otherwise("retried")
    return j.select(*KEY, action.alias("action"))


def page_status(encoded: Column, total: Column) -> Column:
    return F.when(encoded <= 0, "failed").when(encoded < total, "partial").otherwise("indexed")
