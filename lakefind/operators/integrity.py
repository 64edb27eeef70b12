"""Whether an index can still be trusted: expected and actual chunks, signatures, formats, and freshness of libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R

#: Signatures written in this fixed way say how an extractor was set, not its version.
SETTING = "selected:"
EXTRACTOR = "extractor:"


def expected_chunks(manifest: DataFrame) -> DataFrame:
    """(library_id, expected): chunks that indexed files should have. manifest (library_id, path, status, chunk_ids)."""
    own = F.when(F.col("status") == "indexed", F.size(F.filter(F.coalesce("chunk_ids", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != ""))).otherwise(0)
    return manifest.groupBy("library_id").agg(F.sum(own).alias("expected"))


def drift(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """(library_id, expected, actual, drift): drift only if chunks are known to be missing. stored (library_id, actual); actual null: it couldn't be counted."""
    e = expected_chunks(manifest).join(stored, "library_id", "left")
    return e.withColumn("drift", F.coalesce((F.col("expected") > 0) & (F.col("actual") < F.col("expected")), F.lit(False)))


def _version_changed(recorded: Column, current: Column) -> Column:
    """Whether a plugin that both lists (array<struct<plugin, version>>) have is of another version."""
    return F.exists(current, lambda c: F.exists(recorded, lambda r: (r["plugin"] == c["plugin"]) & ~F.startswith(r["version"], F.lit(SETTING)) & (r["version"] != c["version"])))


def signature_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(library_id, point) of the points whose signatures differ.

    recorded (library_id, point, signature, versions), current (point, signature, versions): extractor points compare the versions
    of plugins that both have, others their signatures; a point on one side only differs, unless it is an extractor's.
    """
    libraries = recorded.select("library_id").distinct()
    now = libraries.crossJoin(F.broadcast(current.select("point", F.col("signature").alias("now"), F.col("versions").alias("now_versions"))))  # points are a few
    x = recorded.join(now, ["library_id", "point"], "full_outer")
    differs = F.when(F.startswith("point", F.lit(EXTRACTOR)), F.coalesce(_version_changed(F.col("versions"), F.col("now_versions")), F.lit(False))).otherwise(~F.equal_null("signature", "now"))
    return x.filter(differs).select("library_id", "point")


def stale_formats(drifted: DataFrame) -> DataFrame:
    """(library_id, ext) of the formats whose extractor's code has changed."""
    return drifted.filter(F.startswith("point", F.lit(EXTRACTOR))).select("library_id", F.substr("point", F.lit(len(EXTRACTOR) + 1)).alias("ext")).distinct()


def rebuild_reasons(libraries: DataFrame, drifted: DataFrame, counts: DataFrame) -> DataFrame:
    """(library_id, reason): signatures first, then missing chunks, else null."""
    s = drifted.select("library_id").distinct().withColumn("__s", F.lit(True))
    x = libraries.select("library_id").distinct().join(s, "library_id", "left").join(counts.select("library_id", "drift"), "library_id", "left")
    return x.select("library_id", F.when(F.col("__s"), "signature-upgrade").when(F.col("drift"), "missing-chunks").alias("reason"))


def freshness(libraries: DataFrame, listing: DataFrame, manifest: DataFrame, drifted: DataFrame, counts: DataFrame) -> DataFrame:
    """(library_id, reason, stale): the first that holds, fresh if none.

    libraries (library_id, root_exists, indexed), listing (library_id, path, size, mtime_ns, included, readable), manifest (…, retry, outdated).
    """
    key = ["library_id", "path"]
    old = manifest.select(*key, F.col("size").alias("o_size"), F.col("mtime_ns").alias("o_mtime"), "retry", "outdated", F.lit(True).alias("known"))
    j = listing.join(old, key, "full_outer")
    listed, inc = F.col("size").isNotNull(), F.coalesce(F.col("included"), F.lit(False))
    touched = inc & F.col("known") & (F.coalesce("retry", F.lit(False)) | F.coalesce("outdated", F.lit(False)) | ~F.coalesce("readable", F.lit(True)) | (F.col("size") != F.col("o_size")) | (F.col("mtime_ns") != F.col("o_mtime")))
    s = j.groupBy("library_id").agg(F.count_if(listed).alias("listed"), F.count_if("known").alias("recorded"), F.count_if(inc != F.coalesce("known", F.lit(False))).alias("differ"), F.count_if(F.coalesce(touched, F.lit(False))).alias("touched"))
    x = libraries.join(s, "library_id", "left").join(drifted.select("library_id").distinct().withColumn("__s", F.lit(True)), "library_id", "left").join(counts.select("library_id", "drift"), "library_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = (
        F.when(~F.col("root_exists"), "missing").when(~F.col("indexed"), F.when(n("listed") > 0, "never-indexed")).when((n("listed") == 0) & (n("recorded") > 0), "emptied")
        .when(F.col("__s"), "signatures").when(n("differ") > 0, "files").when(n("touched") > 0, "contents").when(F.col("drift"), "chunks")
    )
    return x.select("library_id", reason.alias("reason")).withColumn("stale", F.col("reason").isNotNull())


def to_sync(fresh: DataFrame) -> DataFrame:
    """Libraries that are indexed again before a search: stale ones whose folder is there and not suddenly empty."""
    return fresh.filter("stale and reason not in ('missing', 'emptied')").select("library_id")


def retries(manifest: DataFrame, current: Column) -> DataFrame:
    """manifest with retry; current: the signature of what can be extracted now."""
    return manifest.withColumn("retry", R.will_retry(F.col("status"), F.coalesce("failure_state", "failure_reason"), F.col("signature"), current, F.col("missing_pages"), F.col("missing_reason")))


def library_rows(files: DataFrame, at: str = "mtime_ns") -> DataFrame:
    """A row for each library of its records (library_id, status, chunk_ids, at): files, those indexed and failed, chunks, the newest time, and whether it has anything to search."""
    ok = F.col("status") == "indexed"
    g = files.groupBy("library_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("indexed"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.greatest(F.size("chunk_ids"), F.lit(0)))), F.lit(0)).alias("chunks"), F.max(at).alias("newest"))
    return g.withColumn("searchable", F.col("chunks") > 0)
