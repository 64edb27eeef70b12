"""Rules on pages, failures, libraries and anchors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Fixed limits: characters of a page with text, share of its area that pictures cover, characters of a picture page, of a watermark.
PAGE_CHARS, COVERAGE, PICTURE_CHARS, WATERMARK_CHARS = 10, 0.2, 200, 40
#: Fixed failure states that a reason may name before a colon.
STATES = ["unreadable", "empty", "tbd", "scanned"]


#: Fixed mark of a section without a heading.
UNTITLED = "(无标题)"


def page_kind(chars: Column, coverage: Column, has_image: Column, coverage_only: bool = False) -> Column:
    """text, image or blank; with coverage_only a page full of pictures counts as image however long its text is."""
    covered = (coverage >= COVERAGE) & (F.lit(coverage_only) | (chars < PICTURE_CHARS))
    return F.when(chars < PAGE_CHARS, F.when(has_image, "image").otherwise("blank")).when(covered, "image").otherwise("text")


def watermark(page_texts: Column) -> Column:
    """Whether all of two pages or more say the same short line."""
    folded = F.array_distinct(F.transform(page_texts, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))))
    return (F.size(page_texts) >= 2) & (F.size(folded) == 1) & (F.length(F.get(folded, F.lit(0))) <= WATERMARK_CHARS)


def failure_state(reason: Column) -> Column:
    head = F.substring_index(F.lower(F.trim(F.coalesce(reason, F.lit("")))), ":", 1)
    return F.when(head.isin(*STATES), head).otherwise("extract-failed")


def chosen_libraries(names: Column, exclude: Column, known: Column, defaults: Column) -> Column:
    """Libraries a query covers, in order: those named (all for "all"), else the known defaults, else all; less the excluded. Unknown names and an empty result are errors."""
    fallback = F.filter(defaults, lambda d: F.array_contains(known, d))
    named = F.when(F.lower(F.get(names, F.lit(0))) == "all", known).when(F.size(names) > 0, F.array_distinct(names)).when(F.size(fallback) > 0, fallback).otherwise(known)
    unknown = F.array_except(F.concat(named, exclude), known)
    left = F.array_except(named, exclude)
    fault = lambda text: F.raise_error(text).cast("array<string>")
    return F.when(F.size(unknown) > 0, fault(F.concat(F.lit("unknown libraries: "), F.array_join(F.array_sort(unknown), ", ")))).when(F.size(left) == 0, fault(F.lit("no library is left"))).otherwise(left)


def storage_key(library: Column) -> Column:
    """A folder name of its own for each library: safe characters and a short hash."""
    safe = F.substring(F.regexp_replace(library, r"[^A-Za-z0-9_-]", "_"), 1, 48)
    return F.concat_ws("-", F.when(safe == "", "library").otherwise(safe), F.substring(F.sha2(library, 256), 1, 16))


def anchor_context(parts: Column) -> Column:
    """Parts joined by " / ", each once whatever its case; blank ones go."""
    trimmed = F.filter(F.transform(parts, lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: (p != "") & (p != UNTITLED))
    once = F.aggregate(trimmed, F.array().cast("array<string>"), lambda seen, p: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(p)), seen).otherwise(F.array_append(seen, p)))
    return F.array_join(once, " / ")


def human_bytes(n: Column) -> Column:
    """Size in B, KB, MB or GB of 1,024: whole bytes, one decimal under 10, none above. Null and negative sizes are 0 B."""
    n = F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))
    power = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    v = n.cast("double") / F.pow(F.lit(1024.0), power)
    shown = F.when(power == 0, n.cast("long").cast("string")).when(v < 10, F.format_string("%.1f", F.bround(v, 1))).otherwise(F.bround(v, 0).cast("long").cast("string"))
    return F.concat_ws(" ", shown, F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power))


def page_ranges(pages: Column) -> Column:
    """Positive page numbers as 1–3、5: runs of neighbours, each once."""
    sorted_ = F.array_sort(F.array_distinct(F.filter(pages, lambda x: x > 0)))

    def ranges(p: Column) -> Column:
        firsts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
        lasts = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
        return F.zip_with(firsts, lasts, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string"))))

    return F.array_join(let(sorted_, ranges), "、")


#: Fixed reason codes, with what they mean and what to do next in our words.
REASONS = {
    "not-indexed": ("not indexed yet", "wait for the next round"),
    "scanned": ("scanned, waits for recognition", "turn recognition on"),
    "deferred": ("conversion service was down", "it is tried again next round"),
    "extract-failed": ("conversion failed", "mend the cause, then index again"),
    "unreadable": ("file can't be opened", "replace the file"),
    "empty": ("no text came out", "turn recognition on if it is a scan"),
    "tbd": ("mostly placeholders", "fill the placeholders in"),
    "ocr-off": ("image pages not recognised: recognition is off", "turn recognition on"),
    "too-many-pages": ("more pages than recognition may take", "raise the limit"),
    "ocr-deferred": ("image pages not recognised: service was down", "it is tried again next round"),
    "ocr-failed": ("image pages not recognised: errors", "mend the cause, then index again"),
    "cache-missing": ("converted text is gone", "rebuild the library"),
    "pages-off": ("page index is off", "turn it on"),
    "pages-not-built": ("page index not built yet", "wait for the next round"),
    "pages-partial": ("some pages not encoded", "they are tried again next round"),
    "pages-failed": ("page index failed", "free memory, then index again"),
}


def reason_text(code: Column) -> Column:
    """struct<label, next>: what a reason code means; codes that aren't known stand for themselves, null is empty."""
    known = {k: F.create_map(*(F.lit(x) for c, v in REASONS.items() for x in (c, v[i]))) for i, k in enumerate(("label", "next"))}
    code = F.coalesce(code, F.lit(""))
    return F.struct(F.coalesce(F.try_element_at(known["label"], code), code).alias("label"), F.coalesce(F.try_element_at(known["next"], code), F.lit("")).alias("next"))


def will_retry(status: Column, state: Column, signature: Column, current: Column, missing_pages: Column, missing_reason: Column) -> Column:
    """Whether the next round tries a record again: deferred ones always, scans and failures once what can be done has changed, indexed ones with missing pages."""
    changed = F.coalesce(signature, F.lit("")) != F.coalesce(current, F.lit(""))
    pages = (F.coalesce(F.size(missing_pages), F.lit(0)) > 0) & ((missing_reason == "ocr-deferred") | changed)
    return F.coalesce(F.when(status == "deferred", True).when(status == "indexed", F.coalesce(pages, F.lit(False))).otherwise(failure_state(state).isin("scanned", "extract-failed") & changed), F.lit(False))


def settings_outdated(status: Column, extractor: Column, recorded: Column, current: Column) -> Column:
    """Whether an indexed file was converted under settings (current: map of extractor to settings) that differ from its own."""
    now = F.try_element_at(current, F.coalesce(extractor, F.lit("")))
    return F.coalesce((status == "indexed") & now.isNotNull() & (F.coalesce(recorded, F.lit("")) != now), F.lit(False))
