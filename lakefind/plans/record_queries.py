"""Queries of the rules on pages, failures, libraries and anchors, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import near_duplicates
from ..sources.tables import read
from ..streaming import progress
from .registry import query


@query("""select page_id, case when c < 10 then (case when i > 0 then 'image' else 'blank' end) when i * 0.1 >= 0.2 and c < 200 then 'image' else 'text' end as kind
from (select page_id, length(html) % 300 as c, page_id % 4 as i from pages)""")
def page_classifier(spark, d):
    p = read(spark, d, "pages").select("page_id", (F.length("html") % 300).alias("c"), (F.col("page_id") % 4).alias("i"))
    return p.select("page_id", R.page_kind(F.col("c"), F.col("i") * 0.1, F.col("i") > 0).alias("kind"))


@query(r"""select conv_id, count(*) >= 2 and count(distinct trim(regexp_replace(role, '\s+', ' ', 'g'))) = 1 and max(length(trim(role))) <= 40 as watermark from conversations group by 1""")
def watermark_test(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("t"))
    return c.select("conv_id", R.watermark(F.col("t")).alias("watermark"))


@query("select doc_id, case doc_id % 6 when 0 then 'unreadable' when 1 then 'empty' when 2 then 'scanned' when 3 then 'tbd' else 'extract-failed' end as state from documents")
def failure_states(spark, d):
    reasons = F.array(*map(F.lit, ("Unreadable: no access", " empty", "SCANNED:12 pages", "tbd", "scanned pages", None)))
    return read(spark, d, "documents").select("doc_id", R.failure_state(F.get(reasons, (F.col("doc_id") % 6).cast("int"))).alias("state"))


@query("select distinct source as library_id, regexp_replace(source, '[^A-Za-z0-9_-]', '_', 'g')[1:48] || '-' || substr(sha256(source), 1, 16) as folder from documents")
def library_folders(spark, d):
    return read(spark, d, "documents").select(F.col("source").alias("library_id")).distinct().withColumn("folder", R.storage_key(F.col("library_id")))


@query("select doc_id, case when lower(lang) = lower(source) then lang else lang || ' / ' || source end as anchor from documents")
def anchor_contexts(spark, d):
    return read(spark, d, "documents").select("doc_id", R.anchor_context(F.array("lang", F.upper("lang"), F.lit("  "), "source", "source", F.lit(None))).alias("anchor"))


def _size_sql(n: str) -> str:
    scaled = lambda power, unit: f"case when n / {1024.0**power}::double < 10 then printf('%.1f', n / {1024.0**power}::double) else printf('%.0f', n / {1024.0**power}::double) end || ' {unit}'"
    return f"(select case when n < 1024 then n::bigint || ' B' when n < 1048576 then {scaled(1, 'KB')} when n < 1073741824 then {scaled(2, 'MB')} else {scaled(3, 'GB')} end from (select greatest(coalesce({n}, 0), 0) as n))"


@query(f"select doc_id, {_size_sql('n_chars')} as size, {_size_sql('n_chars * 1000')} as size_1000, {_size_sql('n_chars * 1500000')} as size_1500000 from documents")
def human_sizes(spark, d):
    size = lambda k: R.human_bytes(F.col("n_chars") * k)
    return read(spark, d, "documents").select("doc_id", size(1).alias("size"), size(1000).alias("size_1000"), size(1500000).alias("size_1500000"))


@query("select event_type, time_bucket(interval 10 minute, ts) as at, arg_max(value, ts) as value, count(*)::bigint as n from events group by all")
def throttled_states(spark, d):
    return progress.throttled(read(spark, d, "events"), ["event_type"], value="value", every="10 minutes")


@query()
def duplicate_groups_near(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("library_id"), F.col("doc_id").alias("id"), "text")
    return near_duplicates.duplicate_groups(docs)
