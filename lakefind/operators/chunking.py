"""Files to chunks and sections, in Arrow batches: a file's chunks never leave its task before they are whole."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sections as S
from ..functions.front_matter import front_matter
from ..functions.html_tables import flatten
from ..functions.records import anchor_context
from ..functions.text import clean_wikilinks, strip_boilerplate, strip_dead_images, strip_layout_noise, strip_page_numbers

#: Characters of chunks in an output batch.
BATCH = 1 << 20
PARTS = "library_id string, path string, chunk_index int, total_chunks int, section_id string, heading string, section_chars int, text string, section_text string"


def _pieces(most: int):
    names = [c.split()[0] for c in PARTS.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for library, path, text in zip(*(b.column(c).to_pylist() for c in ("library_id", "path", "text")), strict=True):
                found = list(S.chunks(text or "", most))
                before = -1
                for i, (n, crumb, body, chunk) in enumerate(found):
                    # a section's text travels once, with its first chunk
                    held.append((library, path, i, len(found), f"s{n}", crumb, len(body), chunk, body if n != before else None))
                    size += len(chunk) + (len(body) if n != before else 0)
                    before = n
                if size >= BATCH:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return run


def pieces(files: DataFrame, most: int = S.MOST) -> DataFrame:
    """files (library_id, path, text) -> a row for each chunk; section_text is only set on a section's first chunk. Null and blank texts give none."""
    return files.select("library_id", "path", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(most), PARTS)


def chunks(parts: DataFrame) -> DataFrame:
    """Of pieces(): (chunk_id, library_id, path, chunk_index, total_chunks, section_id, heading, text)."""
    return parts.select(F.concat_ws(":", "library_id", "path", F.col("chunk_index").cast("string")).alias("chunk_id"), "library_id", "path", "chunk_index", "total_chunks", "section_id", "heading", "text")


def sections(parts: DataFrame) -> DataFrame:
    """Of pieces(): (library_id, path, section_id, heading, chunk_count, text)."""
    g = parts.groupBy("library_id", "path", "section_id")
    return g.agg(F.min_by("heading", "chunk_index").alias("heading"), F.count(F.lit(1)).alias("chunk_count"), F.max("section_text").alias("text"))


def cleaned(files: DataFrame, layout: str | None = None) -> DataFrame:
    """files (library_id, path, text [, layout]) with meta and the text as it is indexed.

    In order: front matter off, links as they are read, dead images, HTML tables to pipes, layout noise (where the
    column `layout` has blocks), page marks, boilerplate.
    """
    d = files.withColumn("__f", front_matter("text")).withColumn("meta", F.col("__f.meta"))
    text = strip_dead_images(clean_wikilinks(F.col("__f.body")))
    d = d.withColumn("text", text).drop("__f")
    d = d.withColumn("text", F.when(F.contains("text", F.lit("<")), flatten("text")).otherwise(F.col("text")))
    if layout:
        d = d.withColumn("text", strip_layout_noise(F.col("text"), F.col(layout)))
    return d.withColumn("text", strip_boilerplate(strip_page_numbers(F.col("text"))))


def anchored(c: DataFrame, meta: DataFrame) -> DataFrame:
    """chunks with anchor (file name, title, tags, heading, each once) and the text that is embedded: the anchor's line before the chunk's."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    m = meta.select("library_id", "path", "meta")
    parts = F.array(stem, F.try_element_at("meta", F.lit("title")), F.try_element_at("meta", F.lit("tags")), "heading")
    return c.join(m, ["library_id", "path"], "left").withColumn("anchor", anchor_context(parts)).withColumn("embedded", F.concat_ws("\n", F.nullif("anchor", F.lit("")), "text")).drop("meta")
