"""Hybrid search of a batch of queries in one plan: two ranked lists, fusion, pool, rerank or merge, delivery, advice.

Inputs: queries (query_id, text, q); chunks (library_id, path, chunk_index, total_chunks, section_id, heading, id, text,
embedded, anchor); vectors (library_id, id, v); sections (library_id, path, section_id, chunk_count, text).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..conf import CONF
from ..functions import text as X
from . import lexical, vector

#: A reranker gives the probability that a text answers a query.
Reranker = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Options:
    top_k: int = 10
    folder: str = ""
    body: bool = True
    lexical_weight: float = 1.0
    vector_weight: float = 1.0
    pool_factor: int = 8
    pool_least: int = CONF.candidate_pool
    rerank: int = CONF.rerank_candidates
    drop: float = CONF.drop
    cap: int = CONF.cap_per_file
    limit: int = CONF.text_limit
    backfill: bool = True

    @property
    def pool(self) -> int:
        return max(self.top_k * self.pool_factor, self.pool_least)


def active(chunks: DataFrame, manifest: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """(library_id, id) of the chunks of indexed files; formats (library_id, ext): only files of these."""
    ok = manifest.filter("status = 'indexed'").select("library_id", "path")
    if formats is not None:
        ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
        ok = ok.withColumn("ext", ext).join(formats.select("library_id", F.lower("ext").alias("ext")).distinct(), ["library_id", "ext"], "left_semi").drop("ext")
    return chunks.join(ok, ["library_id", "path"], "left_semi").select("library_id", "id")


def _per_library(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query in each library."""
    ids = vectors.select("library_id", "id", "v").withColumn("__id", F.xxhash64("library_id", "id"))
    near = vector.knn_in_each(queries, ids.select(F.col("__id").alias("id"), "v", F.col("library_id").alias("folder")), k)
    return near.select("query_id", F.col("id").alias("__id"), "score").join(ids.select("__id", "library_id", "id"), "__id").drop("__id")


@dataclass(frozen=True)
class Stored:
    """Postings (library_id, term, id, tf, dl, bucket) and statistics (library_id, n_docs, avgdl) of an index; bucket: the folder of a term's postings."""

    postings: DataFrame
    stats: DataFrame
    bucket: Callable[[str], Column]

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        """As lexical.bm25 of queries (query_id, text): only the folders of their terms are read; postings that terms have met are put together by document, and a task gives its best rows."""
        q = lexical.query_terms(queries, "query_id")
        if (asked := lexical.Asked.of(q)) is not None and (found := asked.best(asked.gathered(self.postings, self.bucket), top_k, self.stats)) is not None:
            return found
        terms = q.select("term").distinct()
        buckets = [r[0] for r in terms.select(self.bucket("term")).distinct().collect()]
        small = terms.limit(lexical.TERMS + 1).count() <= lexical.TERMS
        sent = F.broadcast if small else lambda d: d
        p = self.postings.filter(F.col("bucket").isin(buckets)).join(sent(terms), "term", "left_semi")
        return lexical.ranked(q, p, self.stats, top_k, sent)


def candidates(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, on: DataFrame, o: Options, stored: Stored | None = None) -> DataFrame:
    """(query_id, library_id, id, score, rank): both lists fused in each library, best first.

    Words take their best before inactive chunks go, vectors after; folders are looked at after both.
    """
    if stored is not None:
        lex = stored.search(queries.select("query_id", "text"), o.pool)
    else:
        docs = chunks.select("library_id", F.col("id").alias("doc_id"), F.col("embedded").alias("text"))
        lex = lexical.bm25(queries.select(F.col("query_id").alias("item_id"), "text"), docs, o.pool)
    near = _per_library(queries.select("query_id", "q"), vectors.join(on, ["library_id", "id"], "left_semi"), o.pool)
    where = chunks.select("library_id", "id", "path")
    lists = []
    for d in (lex.join(on, ["library_id", "id"], "left_semi"), near):
        d = d.join(where, ["library_id", "id"])
        d = d.filter(X.in_folder(F.col("path"), F.lit(o.folder))) if o.folder else d
        lists.append(lexical.top(d.select("query_id", "library_id", "id", "score"), ["query_id", "library_id"], [F.desc("score"), F.asc("id")], o.pool))
    fused = lexical.fuse(lists, ["query_id", "library_id", "id"], [o.lexical_weight, o.vector_weight])
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "library_id").orderBy(F.desc("score"), "id")))


def scored(found: DataFrame, queries: DataFrame, chunks: DataFrame, o: Options, reranker: Reranker | None = None) -> DataFrame:
    """found with confidence, place (over all libraries) and pooled (whether its text was fetched: only such rows are delivered)."""
    pooled = F.col("rank") <= o.rerank
    most = (o.lexical_weight + o.vector_weight) / (CONF.rrf_k + 1)
    fallback = F.least(F.lit(1.0), F.col("score") / most)
    if reranker is None:
        norm = F.col("score") / F.max("score").over(W.partitionBy("query_id", "library_id"))
        x = found.withColumn("confidence", fallback).withColumn("__o", norm).withColumn("__g", F.lit(0))
    else:
        texts = chunks.select("library_id", "id", "embedded")
        p = found.filter(pooled).join(texts, ["library_id", "id"]).join(queries.select("query_id", F.col("text").alias("__q")), "query_id")
        p = p.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), reranker(F.col("__q"), F.col("embedded"))))).drop("embedded", "__q")
        # what wasn't reranked comes after it, library by library
        rest = found.filter(~pooled).withColumn("confidence", fallback)
        x = p.withColumn("__o", F.col("confidence")).withColumn("__g", F.lit(0)).unionByName(rest.withColumn("__o", F.lit(0.0)).withColumn("__g", F.lit(1)))
    w = W.partitionBy("query_id").orderBy("__g", F.desc("__o"), "library_id", "rank", "id")
    return x.withColumn("place", F.row_number().over(w)).withColumn("pooled", pooled).drop("__o", "__g")


def delivered(s: DataFrame, chunks: DataFrame, sections: DataFrame, o: Options) -> DataFrame:
    """Results (query_id, position, …, folded, capped): in order of place, inside the window.

    Weak rows go, then rows without a record; later chunks of a section whose text is given whole are folded; rows of a file
    beyond its cap go; then top_k. folded and capped speak of rows that were met before the last result.
    """
    window = o.top_k * (CONF.fold_window if o.body else 1)
    r = s.filter(F.col("place") <= window).filter((F.col("confidence") >= o.drop) & F.col("pooled")).select("query_id", "library_id", "id", "confidence", "place")
    r = r.join(chunks, ["library_id", "id"])
    sec = sections.select("library_id", "path", "section_id", F.col("chunk_count").alias("__n"), F.col("text").alias("__whole"))
    r = r.join(sec, ["library_id", "path", "section_id"], "left")
    whole = F.lit(o.body and o.backfill) & (F.coalesce("__n", F.lit(0)) > 1) & (F.length("__whole") > CONF.backfill_chars)
    r = r.withColumn("backfilled", F.coalesce(whole, F.lit(False)))
    first = W.partitionBy("query_id", "library_id", "path", "section_id", "backfilled").orderBy("place")
    r = r.withColumn("__nth", F.when(F.col("backfilled"), F.row_number().over(first)).otherwise(1))
    if o.body:
        file = W.partitionBy("query_id", "library_id", "path").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
        r = r.withColumn("__in_file", F.count_if(F.col("__nth") == 1).over(file)).withColumn("__ok", (F.col("__nth") == 1) & (F.col("__in_file") <= o.cap))
        # a section counts as given only if its first chunk was
        r = r.withColumn("__given", F.first("__ok").over(first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    else:
        r = r.withColumn("__ok", F.lit(True)).withColumn("__given", F.lit(True))
    so_far = W.partitionBy("query_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumn("__before", F.coalesce(F.count_if("__ok").over(so_far), F.lit(0))).filter(F.col("__before") < o.top_k)
    every = W.partitionBy("query_id")
    r = r.withColumn("folded", F.count_if((F.col("__nth") > 1) & F.col("__given")).over(every)).withColumn("capped", F.max(~F.col("__ok") & ((F.col("__nth") == 1) | ~F.col("__given"))).over(every))
    plain = X.strip_anchor(F.col("embedded"), F.col("anchor"))
    cut = F.lit(o.body and o.limit > 0) & (F.length(plain) > o.limit)
    shown = F.when(F.col("backfilled"), F.col("__whole")).otherwise(F.when(cut, X.truncate_at_line(plain, o.limit)).otherwise(plain))
    r = r.filter("__ok").withColumn("position", (F.col("__before") + 1).cast("int"))
    return r.select("query_id", "position", "library_id", "path", "id", "chunk_index", "total_chunks", "section_id", "heading", "confidence", X.confidence_tier(F.col("confidence")).alias("tier"), "backfilled", cut.alias("truncated"), shown.alias("text"), F.col("folded").cast("int").alias("folded"), "capped")


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, sections: DataFrame, manifest: DataFrame, o: Options = Options(), formats: DataFrame | None = None, reranker: Reranker | None = None, stored: Stored | None = None) -> DataFrame:
    """Results of a batch of queries, best first; a query without any gives no row (see empty_reasons). stored: the index' postings, else chunks are tokenised."""
    found = candidates(queries, chunks, vectors, active(chunks, manifest, formats), o, stored)
    return delivered(scored(found, queries, chunks, o, reranker), chunks, sections, o)


def empty_reasons(queries: DataFrame, s: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, reason) of queries without results: all were under the drop threshold, or nothing had a score."""
    seen = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    q = queries.select("query_id").join(results.select("query_id").distinct(), "query_id", "left_anti").join(seen, "query_id", "left")
    return q.select("query_id", F.when(F.coalesce("n", F.lit(0)) > 0, "all-below-drop-threshold").otherwise("no-score").alias("reason"))


def second_pass(first: DataFrame, again: Callable[[DataFrame], DataFrame], queries: DataFrame, below: float = 0.5) -> DataFrame:
    """Results where queries whose best confidence is under `below` (or that found nothing) are asked again in other words.

    again: the results of those queries. A query keeps them only if they are better.
    """
    best = first.groupBy("query_id").agg(F.max("confidence").alias("top"))
    weak = queries.join(best, "query_id", "left").filter(F.coalesce("top", F.lit(-1.0)) < below)
    second = again(weak.drop("top"))
    gain = second.groupBy("query_id").agg(F.max("confidence").alias("new")).join(best, "query_id", "left").filter(F.col("new") > F.coalesce("top", F.lit(-1.0))).select("query_id")
    return first.join(gain, "query_id", "left_anti").unionByName(second.join(gain, "query_id", "left_semi"))


def navigate(queries: DataFrame, pages: DataFrame, top_k: int = 5) -> DataFrame:
    """(query_id, library_id, path, page, score, rank): the pages nearest by cosine over all libraries. pages (library_id, path, page, v)."""
    p = pages.withColumn("id", F.xxhash64("library_id", "path", "page"))
    near = vector.knn(queries.select("query_id", "q"), p.select("id", "v"), top_k, "cosine")
    hit = near.join(p.select("id", "library_id", "path", "page"), "id").withColumn("score", F.round("score", 4))
    return lexical.top(hit.drop("rank", "id"), ["query_id"], [F.desc("score"), "library_id", "path", "page"], top_k)
