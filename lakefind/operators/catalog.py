"""Selection rules, manifests, incremental actions, publishing, freshness and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.records import failure_state, will_retry


def decide(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (library_id, path) with included and reason.

    rules (library_id, selection_in, selection_out, exclude_dirs, exclude_files, exclude_patterns, enabled_extensions,
    new_file_default). The nearest ancestor (or the path) that is named decides, out before in at equal depth, unless an
    excluded folder lies deeper; then file names, name prefixes and the default for new files; last the formats.
    """
    x = files.join(rules, "library_id")
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    depth_of = lambda names: F.array_max(F.transform(prefixes, lambda p, i: F.when(F.array_contains(names, p), i + 1).otherwise(0)))
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    dir_depth = F.coalesce(F.array_max(F.transform(folders, lambda p, i: F.when(F.exists("exclude_dirs", lambda e: F.contains(p, e)), i + 1).otherwise(0))), F.lit(0))
    x = x.withColumns({"d_in": depth_of(F.col("selection_in")), "d_out": depth_of(F.col("selection_out")), "d_dir": dir_depth, "name": name})
    ext = F.lower(F.concat(F.lit("."), F.element_at(F.split("name", r"\."), -1)))
    by_rule = (
        F.when((F.col("d_out") > 0) & (F.col("d_out") >= F.col("d_in")) & (F.col("d_out") >= F.col("d_dir")), "selected out")
        .when((F.col("d_in") > 0) & (F.col("d_in") >= F.col("d_dir")), "selected in")
        .when(F.col("d_dir") > 0, "excluded folder")
        .when(F.array_contains("exclude_files", F.col("name")), "excluded file")
        .when(F.exists("exclude_patterns", lambda p: F.startswith(F.col("name"), p)), "excluded pattern")
        .when(F.col("new_file_default") == "exclude", "default out")
        .otherwise("default in")
    )
    x = x.withColumn("reason", by_rule).withColumn("ext", ext)
    x = x.withColumn("reason", F.when(F.col("reason").isin("selected in", "default in") & ~F.array_contains("enabled_extensions", F.col("ext")), "format off").otherwise(F.col("reason")))
    return x.select("library_id", "path", F.col("reason").isin("selected in", "default in").alias("included"), "reason")


def plan(listing: DataFrame, manifest: DataFrame, rebuild: Column | None = None, allowed: list[str] | None = None, rebuild_failed: bool = False) -> DataFrame:
    """(library_id, path, action): what an incremental round does with each file, removed ones included.

    listing (library_id, path, size, mtime_ns, content_hash, included [, signature]), manifest (…, status, failure_state [, signature,
    missing_pages, missing_reason, outdated]). rebuild: whether an indexed file is made anew; allowed: formats that may be
    read now (files of others keep what they have: frozen); rebuild_failed: failures are tried again whatever they are.
    """
    optional = {"signature": "string", "missing_pages": "array<int>", "missing_reason": "string", "outdated": "boolean"}
    for c, t in optional.items():
        manifest = manifest if c in manifest.columns else manifest.withColumn(c, F.lit(None).cast(t))
    listing = listing if "signature" in listing.columns else listing.withColumn("signature", F.lit(None).cast("string"))
    new = listing.select("library_id", "path", "size", "mtime_ns", "content_hash", "included", F.col("signature").alias("now"))
    old = manifest.select("library_id", "path", F.col("size").alias("o_size"), F.col("mtime_ns").alias("o_mtime"), F.col("content_hash").alias("o_hash"), F.col("status").alias("o_status"), F.col("failure_state").alias("o_state"), *optional)
    j = new.join(old, ["library_id", "path"], "full_outer")
    same = F.coalesce((F.col("size") == F.col("o_size")) & (F.col("mtime_ns") == F.col("o_mtime")), F.lit(False)) | F.coalesce(F.col("content_hash") == F.col("o_hash"), F.lit(False))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    frozen = F.col("o_status").isNotNull() & ~ext.isin([x.lower() for x in allowed]) if allowed is not None else F.lit(False)
    indexed = F.col("o_status") == "indexed"
    again = indexed & will_retry(F.col("o_status"), F.col("o_state"), F.col("signature"), F.col("now"), F.col("missing_pages"), F.col("missing_reason"))
    made = rebuild if rebuild is not None else F.lit(False)
    state = failure_state(F.col("o_state"))
    changed = F.coalesce("signature", F.lit("")) != F.coalesce("now", F.lit(""))
    stable = F.col("o_status").isin("failed", "terminal") & (F.col("o_state") != "deferred") & F.when(state.isin("scanned", "extract-failed"), ~changed).when(state == "unreadable", False).otherwise(True)
    action = (
        F.when(F.col("included").isNull(), "removed")
        .when(~F.col("included"), F.when(frozen, "frozen").otherwise("excluded"))
        .when(F.col("o_status").isNull(), "added")
        .when(again & (made | same), "retried")
        .when(indexed & (made | (same & F.coalesce("outdated", F.lit(False)))), "rebuilt")
        .when(indexed & same, "unchanged")
        .when(indexed, "changed")
        .when(F.lit(rebuild_failed) | ~F.coalesce(stable, F.lit(False)), "retried")
        .when(same, "unchanged")
        .otherwise("retried")
    )
    return j.select("library_id", "path", action.alias("action"))


def report(actions: DataFrame) -> DataFrame:
    """Per library: files added, changed (or made anew), removed, unchanged, retried."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return actions.groupBy("library_id").agg(n("added").alias("added"), n("changed", "rebuilt").alias("changed"), n("removed").alias("removed"), n("unchanged").alias("unchanged"), n("retried").alias("retried"))


def needs(actions: DataFrame, force_chunks: bool = False, force_vectors: bool = False, force_extract: bool = False) -> DataFrame:
    """actions with what a file needs: its source read, its text cut again, its chunks embedded again."""
    source = F.col("action").isin("added", "changed", "retried") | (F.lit(force_extract) & ~F.col("action").isin("removed", "excluded", "frozen"))
    kept = ~F.col("action").isin("removed", "excluded", "frozen")
    cut = source | (F.lit(force_chunks or force_vectors) & kept)
    return actions.withColumn("needs_source", source).withColumn("needs_chunks", cut).withColumn("needs_vectors", cut)


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The newest row of each key over segments with a generation column."""
    both = old.unionByName(new)
    return both.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("generation")))).filter("__n = 1").drop("__n")


def fingerprint(files: DataFrame) -> DataFrame:
    """(library_id, fingerprint) of the sorted path:hash pairs of each library."""
    line = F.concat_ws(":", "path", "content_hash")
    return files.groupBy("library_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256), 1, 16).alias("fingerprint"))


def runs(pages: DataFrame, by: str, page: str, gap: int) -> DataFrame:
    """(by, first, last): runs of pages with at most `gap` missing between neighbours."""
    w = W.partitionBy(by).orderBy(page)
    x = pages.withColumn("__new", F.when(F.col(page) - F.lag(page).over(w) <= gap + 1, 0).otherwise(1))
    x = x.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(by, "__run").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("__run")


def split_runs(r: DataFrame, most: int) -> DataFrame:
    cut = F.explode(F.sequence("first", "last", F.lit(most).cast("long")))
    return r.withColumn("__at", cut).select(*[c for c in r.columns if c not in ("first", "last")], F.col("__at").alias("first"), F.least("last", F.col("__at") + most - 1).alias("last"))


def splice(pages: DataFrame, runs_: DataFrame, by: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(texts, missing): pages (doc, page, text, image) put together again with what was recognised.

    runs_ (doc, first, last, text): a run with text stands for its pages, one without leaves theirs, and its image pages are missing.
    """
    r = runs_.withColumn("ok", F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")) != "", F.lit(False))).withColumnRenamed("text", "__run")
    at = r.select(by, F.explode(F.sequence("first", "last")).alias("page"), "first", "ok", "__run")
    x = pages.join(at, [by, "page"], "left")
    missing = x.filter("image and not ok").groupBy(by).agg(F.array_sort(F.collect_list("page")).alias("missing"))
    text = F.when(F.coalesce("ok", F.lit(False)), F.when(F.col("page") == F.col("first"), F.concat(F.regexp_replace("__run", r"\n+\z", ""), F.lit("\n\n")))).otherwise(F.coalesce("text", F.lit("")))
    each = x.withColumn("__t", text).filter("__t is not null")
    out = each.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "__t"))), lambda s: s["__t"]), "").alias("text"))
    done = x.filter("ok").groupBy(by).agg(F.array_sort(F.collect_list("page")).alias("recognised"))
    return out.join(done, by, "left"), missing
