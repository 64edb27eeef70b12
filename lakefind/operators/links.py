"""Links between notes: targets resolved to files, in- and outlinks, the graph of files, pages and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..conf import CONF
from ..functions.text import theme, wikilink_targets

#: A document with more page nodes than this has one node for all of them.
PAGE_NODES = 24


def stem(path: Column) -> Column:
    """A path's file name without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^[^.].*\.[^.]*$|^\..+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def wikilinks(files: DataFrame) -> DataFrame:
    """files (library_id, path, text) -> (library_id, path, target), each target once."""
    return files.select("library_id", "path", F.explode(wikilink_targets(F.col("text"))).alias("target"))


def resolved(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (library_id, path, target) with to: the file of that path, else of that stem (of several the last path). Links to nothing and to oneself go."""
    paths = files.select("library_id", "path").distinct()
    by_path = paths.select("library_id", F.col("path").alias("target"), F.col("path").alias("exact"))
    by_stem = paths.groupBy("library_id", stem(F.col("path")).alias("__stem")).agg(F.max("path").alias("named"))
    x = links.join(by_path, ["library_id", "target"], "left").withColumn("__stem", stem(F.col("target"))).join(by_stem, ["library_id", "__stem"], "left")
    return x.withColumn("to", F.coalesce("exact", "named")).filter("to is not null and to <> path").select("library_id", "path", "target", "to")


def edges(links: DataFrame, files: DataFrame) -> DataFrame:
    """Undirected edges (library_id, source, target) between files, each once."""
    r = resolved(links, files)
    return r.select("library_id", F.least("path", "to").alias("source"), F.greatest("path", "to").alias("target")).distinct()


def relations(links: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: sorted outlinks and inlinks."""
    r = resolved(links, files).select("library_id", "path", "to").distinct()
    out = r.groupBy("library_id", "path").agg(F.array_sort(F.collect_list("to")).alias("outlinks"))
    into = r.groupBy("library_id", F.col("to").alias("path")).agg(F.array_sort(F.collect_list("path")).alias("inlinks"))
    none = F.array().cast("array<string>")
    f = files.select("library_id", "path").distinct().join(out, ["library_id", "path"], "left").join(into, ["library_id", "path"], "left")
    return f.select("library_id", "path", F.coalesce("outlinks", none).alias("outlinks"), F.coalesce("inlinks", none).alias("inlinks"))


def node_id(library: Column, path: Column) -> Column:
    return F.concat_ws("|", library, path)


def document_nodes(included: DataFrame, manifest: DataFrame, themes: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Nodes of included files (library_id, path). manifest (library_id, path, status, failure_state, failure_reason, chunks, mtime_ns): files without a record are nodes only if they are PDFs."""
    x = included.select("library_id", "path").distinct().join(manifest.withColumn("__known", F.lit(True)), ["library_id", "path"], "left")
    kind = F.coalesce(F.nullif(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)), F.lit("")), F.lit("md"))
    state = F.when(F.col("__known").isNull(), "none").when(F.col("status") == "indexed", "done").when(F.col("failure_state").isin("scanned", "deferred"), "queued").otherwise("failed")
    x = x.filter(F.col("__known").isNotNull() | F.lower("path").endswith(".pdf")).withColumn("kind", kind).withColumn("state", state)
    chunks = F.when((F.col("kind") == "pdf") & (F.col("state") != "done"), 0).otherwise(F.coalesce("chunks", F.lit(0)))
    return x.select(node_id(F.col("library_id"), F.col("path")).alias("node_id"), "library_id", "path", "kind", theme(F.col("path"), themes or []).alias("theme"), "state", chunks.cast("int").alias("chunks"), F.col("mtime_ns").alias("updated_ns"), "failure_reason")


def page_nodes(nodes: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with page_state and page_count and the page nodes, page edges). pages (library_id, path, provider_id, status, pages, failure_reason): one row for each document and provider."""
    p = pages.withColumn("pages", F.array_sort(F.array_distinct(F.filter("pages", lambda x: x > 0)))).withColumnRenamed("failure_reason", "page_failure")
    seen = F.when(F.col("status").isin("indexed", "partial") & (F.size("pages") > 0), "done").when(F.col("status") == "failed", "failed").otherwise("none")
    p = p.withColumn("page_state", seen).withColumn("page_count", F.nullif(F.size("pages"), F.lit(0)))
    pdf = nodes.filter("kind = 'pdf'").select("library_id", "path", F.col("node_id").alias("parent"), "theme")
    # of several providers the last one speaks for the document
    last = p.groupBy("library_id", "path").agg(F.max_by(F.struct("page_state", "page_count", "page_failure"), "provider_id").alias("s")).select("library_id", "path", "s.*")
    d = nodes.join(last.join(pdf.select("library_id", "path"), ["library_id", "path"]), ["library_id", "path"], "left")
    d = d.withColumn("failure_reason", F.coalesce("failure_reason", "page_failure")).drop("page_failure").withColumn("page_state", F.coalesce("page_state", F.lit("none")))
    many = F.size("pages") > PAGE_NODES
    each = p.join(pdf, ["library_id", "path"]).filter(F.size("pages") > 0).withColumn("page", F.explode(F.when(many, F.array(F.size("pages"))).otherwise(F.col("pages")))).withColumn("many", many)
    ident = F.concat_ws("|", "library_id", F.regexp_replace("provider_id", r"[^\w.-]", "_"), "path", F.when(F.col("many"), "grp").otherwise(F.concat(F.lit("p"), F.col("page").cast("string"))))
    each = each.withColumn("node_id", ident)
    extra = each.select("node_id", "library_id", "path", F.when(F.col("many"), "pagegroup").otherwise("page").alias("kind"), "theme", F.lit("done").alias("state"), F.lit(0).alias("chunks"), F.lit(None).cast("bigint").alias("updated_ns"), F.lit(None).cast("string").alias("failure_reason"), F.lit("done").alias("page_state"), F.when(F.col("many"), F.col("page")).alias("page_count"))
    return d.select(extra.columns).unionByName(extra), each.select("library_id", F.col("parent").alias("source"), F.col("node_id").alias("target"), F.lit("page").alias("kind"))


def link_edges(e: DataFrame, included: DataFrame) -> DataFrame:
    """Edges whose ends are both included, by node id."""
    inc = included.select("library_id", "path").distinct()
    for end in ("source", "target"):
        e = e.join(inc.withColumnRenamed("path", end), ["library_id", end], "left_semi")
    a, b = node_id(F.col("library_id"), F.col("source")), node_id(F.col("library_id"), F.col("target"))
    return e.select("library_id", F.least(a, b).alias("source"), F.greatest(a, b).alias("target"), F.lit("link").alias("kind"))


def hubs(e: DataFrame, most: int = CONF.hubs) -> DataFrame:
    """(node_id, degree) of the nodes with most ends of edges, ties by id."""
    ends = e.select(F.col("source").alias("node_id")).unionByName(e.select(F.col("target").alias("node_id")))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node_id").limit(most)


def graph(included: DataFrame, manifest: DataFrame, links: DataFrame, pages: DataFrame, themes: list[tuple[str, list[str]]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with is_hub, edges, stats: nodes and edges counted)."""
    nodes, page_edges = page_nodes(document_nodes(included, manifest, themes), pages)
    e = link_edges(links, included).unionByName(page_edges)
    top = hubs(e).select("node_id", F.lit(True).alias("is_hub"))
    nodes = nodes.join(F.broadcast(top), "node_id", "left").withColumn("is_hub", F.coalesce("is_hub", F.lit(False)))
    stats = nodes.agg(F.count(F.lit(1)).alias("nodes")).join(e.agg(F.count(F.lit(1)).alias("edges")))
    return nodes, e, stats


def first_semantic(pairs: DataFrame, order: DataFrame, per_node: int = CONF.semantic_per_node, cap: int = 2000) -> DataFrame:
    """Semantic edges in node order: of directed pairs (query_id, id, score) each node's best, an edge where it is met first, at most cap. order (id, place)."""
    best = pairs.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= per_node)
    best = best.join(order.select(F.col("id").alias("query_id"), "place"), "query_id")
    e = best.groupBy(F.least("query_id", "id").alias("source"), F.greatest("query_id", "id").alias("target")).agg(F.min_by("score", F.struct("place", "n")).alias("similarity"), F.min(F.struct("place", "n")).alias("at"))
    return e.orderBy("at", "source", "target").limit(cap).select("source", "target", F.round("similarity", 3).alias("similarity"))
