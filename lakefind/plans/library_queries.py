"""Queries of chunks, notes, maps, search, rounds, selection and reports over the driver tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html_tables, markdown
from ..functions import records as R
from ..functions import text as X
from ..functions.front_matter import front_matter
from ..operators import archive, chunking, content_map, conversion, integrity, links, near_duplicates, progress, search, selection, vector
from ..sources import extract
from ..sources.tables import files, read
from .driver_queries import BM25_ALL, COS, D2, FILES, SNAP, _snapshots
from .registry import query

# notes: links to two other documents, by folder and by name

NOTES = f"""{FILES}, t as (select library_id, path, doc_id, unnest(list_distinct([(doc_id * 7 % 1000)::varchar, (doc_id * 3 % 1000)::varchar])) as target from f),
r as (select t.library_id, t.path, t.target, o.path as to from t join f o on o.library_id = t.library_id and o.doc_id::varchar = t.target and o.path <> t.path)"""


def _notes(spark, d):
    text = F.expr("'[[' || lang || '/' || (doc_id * 7 % 1000) || '#part|seen]] ![[x.png]] [[#^b]] [[' || (doc_id * 3 % 1000) || ']] '")
    return files(spark, d).select("library_id", "path", text.alias("text"))


@query(f"with {NOTES} select library_id, path, target from t")
def wikilink_targets(spark, d):
    return links.wikilinks(_notes(spark, d))


@query(f"with {NOTES} select doc_id, 'seen   ' || (doc_id * 3 % 1000) || ' ' as body from f")
def wikilinks_cleaned(spark, d):
    n = _notes(spark, d).join(files(spark, d).select("path", "doc_id"), "path")
    return n.select("doc_id", X.clean_wikilinks(F.col("text")).alias("body"))


@query(f"with {NOTES} select distinct library_id, least(path, \"to\") as source, greatest(path, \"to\") as target from r")
def note_edges(spark, d):
    n = _notes(spark, d)
    return links.edges(links.wikilinks(n), n)


@query(f"""with {NOTES}, o as (select library_id, path, string_agg(distinct "to", ',' order by "to") as s from r group by all), i as (select library_id, "to" as path, string_agg(distinct path, ',' order by path) as s from r group by all)
select f.library_id, f.path, coalesce(o.s, '') as outlinks, coalesce(i.s, '') as inlinks from f left join o using (library_id, path) left join i using (library_id, path)""")
def note_relations(spark, d):
    n = _notes(spark, d)
    r = links.relations(links.wikilinks(n), n)
    return r.select("library_id", "path", F.array_join("outlinks", ",").alias("outlinks"), F.array_join("inlinks", ",").alias("inlinks"))


GRAPH = f"""{NOTES}, inc as (select * from f where doc_id % 5 <> 0), x as (select *, case when doc_id % 3 = 0 then 'pdf' else 'md' end as kind from inc),
n as (select *, library_id || '|' || path || (case when kind = 'pdf' then '.pdf' else '' end) as id, doc_id % 4 <> 3 as known from x),
e as (select distinct least(a.id, b.id) as source, greatest(a.id, b.id) as target from r join n a on a.library_id = r.library_id and a.path = r.path join n b on b.library_id = r.library_id and b.path = r."to")"""


def _graph(spark, d):
    f = files(spark, d)
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("path", F.lit(".pdf"))).otherwise(F.col("path"))
    f = f.withColumn("name", name)
    inc = f.filter("doc_id % 5 <> 0").select("library_id", F.col("name").alias("path"))
    status = F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("indexed")
    man = f.filter("doc_id % 4 <> 3").select("library_id", F.col("name").alias("path"), status.alias("status"), F.when(F.col("doc_id") % 8 == 0, "scanned").alias("failure_state"), F.lit(None).cast("string").alias("failure_reason"), F.expr("int(n_chars div 600 + 1)").alias("chunks"), F.col("doc_id").alias("mtime_ns"))
    n = _notes(spark, d)
    names = f.select("library_id", "path", "name")
    e = links.edges(links.wikilinks(n), n)
    for end in ("source", "target"):
        e = e.join(names.select("library_id", F.col("path").alias(end), F.col("name").alias("__n")), ["library_id", end]).drop(end).withColumnRenamed("__n", end)
    pages = f.filter("doc_id % 6 = 0").select("library_id", F.col("name").alias("path"), F.lit("p").alias("provider_id"), F.lit("indexed").alias("status"), F.expr("sequence(1, cast(doc_id % 30 as int) + 1)").alias("pages"), F.lit(None).cast("string").alias("failure_reason"))
    return links.graph(inc, man, e, pages)


@query(f"""with {GRAPH}, docs as (select id as node_id, kind, case when not known then 'none' when doc_id % 8 = 0 then 'queued' when doc_id % 4 = 0 then 'failed' else 'done' end as state, (case when not known then 0 when kind = 'pdf' and doc_id % 4 = 0 then 0 else n_chars // 600 + 1 end)::int as chunks from n where known or kind = 'pdf'),
pg as (select library_id, path || '.pdf' as path, (doc_id % 30 + 1)::int as m from n where doc_id % 6 = 0 and (known or kind = 'pdf')),
ps as (select library_id || '|p|' || path || '|' || (case when m > 24 then 'grp' else 'p' || k end) as node_id, case when m > 24 then 'pagegroup' else 'page' end as kind, 'done' as state, 0 as chunks from (select *, unnest(case when m > 24 then [m] else range(1, m + 1) end) as k from pg))
select * from docs union all select * from ps""")
def graph_nodes(spark, d):
    return _graph(spark, d)[0].select("node_id", "kind", "state", "chunks")


@query(f"with {GRAPH} select source, target from e")
def graph_links(spark, d):
    return _graph(spark, d)[1].filter("kind = 'link'").select("source", "target")


# texts

META = "'---' || chr(10) || 'title: \"' || source || '\"' || chr(10) || 'tags: [' || lang || ', ''x'', ]' || chr(10) || 'aliases:' || chr(10) || '  - a' || doc_id || chr(10) || chr(10) || '  - b' || chr(10) || '!' || chr(10) || '  - lost' || chr(10) || '---'"


@query("select doc_id, source as title, lang || ', x' as tags, 'a' || doc_id || ', b' as aliases, 3 as n, sha256(chr(10) || text) as body from documents")
def front_matter_fields(spark, d):
    f = read(spark, d, "documents").withColumn("f", front_matter(F.concat(F.expr(META.replace("''x''", "\\'x\\'")), F.lit("\n"), F.col("text"))))
    return f.select("doc_id", *(F.col("f.meta")[k].alias(k) for k in ("title", "tags", "aliases")), F.size("f.meta").alias("n"), F.sha2("f.body", 256).alias("body"))


@query(r"select doc_id, coalesce(length(regexp_replace(text, '\s+', '', 'g')), 0)::bigint as chars, coalesce(text, '') <> '' and regexp_replace(text, '\s+', '', 'g') <> '' as some from documents")
def chunks_lose_nothing(spark, d):
    f = files(spark, d)
    c = chunking.pieces(f).groupBy("library_id", "path").agg(F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).alias("chars"))
    return f.select("library_id", "path", "doc_id").join(c, ["library_id", "path"], "left").select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), F.col("chars").isNotNull().alias("some"))


@query()
def chunk_documents(spark, d):
    return chunking.chunks(chunking.pieces(chunking.cleaned(files(spark, d).select("library_id", "path", "text"))))


@query()
def chunk_sections(spark, d):
    return chunking.sections(chunking.pieces(files(spark, d)))


TABLE = "'<table><tr><td rowspan=2>' || lang || '</td><td colspan=\"2\">' || source || '|</td></tr><tr><td>' || doc_id || '<sup>2</sup></td><td>b<br>c</td></tr></table>'"


@query("select doc_id, '| ' || lang || ' | ' || source || '\\|' || ' |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || lang || ' | ' || doc_id || '^2 | b c |' || chr(10) as flat from documents")
def html_tables_flat(spark, d):
    return read(spark, d, "documents").select("doc_id", html_tables.flatten(F.expr(TABLE)).alias("flat"))


@query("select doc_id, unnest([lang, source || '|', doc_id || '^2', 'b c']) as text, unnest([0, 0, 1, 1])::int as row, unnest([0, 1, 0, 1])::int as col, unnest([1, 2, 1, 1])::int as colspan, unnest([2, 1, 1, 1])::int as rowspan from documents")
def html_table_cells(spark, d):
    c = read(spark, d, "documents").select("doc_id", F.explode(html_tables.cells(F.expr(TABLE))).alias("c"))
    return c.select("doc_id", "c.text", "c.row", "c.col", "c.colspan", "c.rowspan")


@query("select doc_id, '<h2>' || source || ' <em>x</em></h2>' || chr(10) || '<ul><li>' || lang || '</li><li>&lt;b&gt;</li></ul>' || chr(10) || '<p>' || doc_id || '</p>' as html from documents")
def markdown_render(spark, d):
    text = F.expr("'## ' || source || ' *x*' || chr(10) || '- ' || lang || chr(10) || '- <b>' || chr(10) || chr(10) || doc_id")
    return read(spark, d, "documents").select("doc_id", markdown.rendered(text).alias("html"))


@query("select doc_id, case doc_id % 3 when 0 then text when 1 then text else 'h' || chr(10) || text end as body from documents")
def anchors_stripped(spark, d):
    t = read(spark, d, "documents").withColumn("a", F.when(F.col("doc_id") % 3 == 0, F.lit("A / B")).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.lit("other")))
    t = t.withColumn("e", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("A / B\n"), "text")).when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("h\n"), "text")))
    return t.select("doc_id", X.strip_anchor(F.col("e"), F.col("a")).alias("body"))


@query("select doc_id, case when n_chars % 3 = 0 then '' when n_chars % 3 = 1 then (n_chars % 7 + 1) || '–' || (n_chars % 7 + 3) || '、' || (n_chars % 7 + 9) else '4' end as pages from documents")
def page_range_texts(spark, d):
    p = F.expr("case when n_chars % 3 = 0 then array(0, -1) when n_chars % 3 = 1 then array(n_chars % 7 + 9, n_chars % 7 + 3, n_chars % 7 + 1, n_chars % 7 + 2, n_chars % 7 + 2) else array(4) end")
    return read(spark, d, "documents").select("doc_id", R.page_ranges(p).alias("pages"))


@query("select doc_id, lang = 'en' or n_chars % 4 = 0 as inside from documents")
def folder_filter(spark, d):
    f = files(spark, d).withColumn("folder", F.when(F.col("n_chars") % 4 == 0, "").otherwise("/en/"))
    return f.select("doc_id", X.in_folder(F.col("path"), F.col("folder")).alias("inside"))


# search

HYBRID = f"""with {BM25_ALL},
lex as (select query_id, id, row_number() over (partition by query_id order by score desc, id::varchar) as rank from sc qualify rank <= 200),
dense as (select a.vec_id as query_id, b.vec_id as id, row_number() over (partition by a.vec_id order by round(1 / (1 + {D2}), 6) desc, b.vec_id::varchar) as rank from embeddings a join benchmark m on a.vec_id = m.item_id join embeddings b on b.vec_id in (select doc_id from documents) qualify rank <= 200),
fused as (select query_id, id, round(sum(s), 9) as score from (select query_id, id, 1.0::double / (2 + rank) as s from lex union all select query_id, id, 0.5::double / (2 + rank) from dense) group by all),
place as (select *, row_number() over (partition by query_id order by score desc, id::varchar) as place from fused)"""


def _corpus(spark, d):
    f = files(spark, d)
    key = F.col("doc_id").cast("string")
    c = f.select(F.lit("all").alias("library_id"), "path", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit("s0").alias("section_id"), F.lit("").alias("heading"), key.alias("id"), "text", F.col("text").alias("embedded"), F.lit("").alias("anchor"))
    v = read(spark, d, "embeddings").select(F.lit("all").alias("library_id"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("v")).join(c.select("id"), "id", "left_semi")
    q = read(spark, d, "benchmark").join(read(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id"), "left").select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("q"))
    return q, c, v, c.select("library_id", "path", F.lit("indexed").alias("status"))


@query(HYBRID + " select query_id, place::int as position, id::varchar as id, round(least(1.0, score / (1.5 / 3)), 6) as confidence from place where place <= 10 and place <= 40")
def hybrid_search(spark, d):
    q, c, v, m = _corpus(spark, d)
    sections = spark.createDataFrame([], "library_id string, path string, section_id string, chunk_count long, text string")
    r = search.search(q, c, v, sections, m, search.Options(top_k=10, vector_weight=0.5, cap=99))
    return r.select("query_id", "position", "id", F.round("confidence", 6).alias("confidence"))


@query(f"with s as (select a.vec_id as query_id, b.label, b.vec_id, round({COS}, 6) as s from embeddings a join embeddings b on a.vec_id % 50 = 0), t as (select *, row_number() over (partition by query_id order by s desc, vec_id) as r from s) select query_id, count(*)::bigint as n, max(round(s, 4)) as best from t where r <= 5 group by 1")
def navigate_pages(spark, d):
    e = read(spark, d, "embeddings")
    pages = e.select(F.lit("l").alias("library_id"), F.col("label").cast("string").alias("path"), F.col("vec_id").alias("page"), F.col("embedding").alias("v"))
    r = search.navigate(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), pages, 5)
    return r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


# maps: vectors in order of their ids

DOT = "list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::double * b[i]::double))"


def _placed(spark, d):
    e = read(spark, d, "embeddings")
    return e.select(F.lit("l").alias("library_id"), F.col("vec_id").alias("place"), F.col("embedding").alias("v"), F.col("label").alias("group_no"))


@query(f"with p as (select vec_id, embedding as a, coalesce(lag(embedding) over (order by vec_id), last_value(embedding) over (order by vec_id rows between unbounded preceding and unbounded following)) as b from embeddings) select vec_id as place, round(greatest(0, least(2, 1 - {DOT})), 4) as gap from p")
def neighbour_gaps(spark, d):
    return content_map.gaps(_placed(spark, d)).select("place", "gap")


@query("""with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), s as (select *, sum(x) over (partition by i order by vec_id rows between 4 preceding and 4 following) as s from e)
select vec_id as place, round(greatest(-1, least(1, sum(x * s) / greatest(sqrt(sum(s * s)), 1e-12))), 4) as loose from s group by 1""")
def looseness(spark, d):
    return content_map.looseness(_placed(spark, d), 4).select("place", "loose")


CENTRES = """e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, sum(x) as s from e group by all),
c as (select label, list(s order by i) as v from m group by 1), z as (select label, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) as c from c), n as (select label, count(*) as size from embeddings group by 1)"""


@query(f"with {CENTRES} select n.label as group_no, size::bigint as size, (row_number() over (order by size desc, n.label) - 1)::int as rank, list_transform(c, lambda x: round(x, 6)) as centre from z join n using (label)")
def group_centres(spark, d):
    c = content_map.centres(_placed(spark, d))
    return c.select("group_no", "size", F.col("rank").cast("int").alias("rank"), F.transform("centre", lambda x: F.round(x, 6)).alias("centre"))


@query(f"with {CENTRES}, s as (select label, vec_id, embedding as a, c as b from embeddings join z using (label)), t as (select label, vec_id, round({DOT} / greatest(sqrt(list_sum(list_transform(a, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b, lambda x: x * x))), 1e-12), 9) as s from s), r as (select *, row_number() over (partition by label order by s desc, vec_id) as nth from t) select label as group_no, nth::int as nth, vec_id as place from r where nth <= 3")
def group_samples(spark, d):
    return content_map.samples(_placed(spark, d), ["place"])


@query()
def content_map_order(spark, d):
    e = read(spark, d, "embeddings").select(F.concat(F.lit("l"), (F.col("label") % 2).cast("string")).alias("library_id"), F.col("vec_id").alias("path"), F.col("embedding").alias("v"))
    return content_map.ordered(e).select("library_id", "path", "place", "group_no")


@query()
def farthest_sample(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return spark.createDataFrame(list(enumerate(content_map.farthest(e, 6))), "n int, id long")


@query(f"""with s as (select a.vec_id as a, b.vec_id as b, round({COS}, 6) as s from embeddings a join embeddings b on a.vec_id <> b.vec_id),
t as (select *, row_number() over (partition by a order by s desc, b) as r from s where s >= 0.3), e as (select least(a, b) as source, greatest(a, b) as target, arg_min(s, (a, r)) as s, min((a, r)) as met from t where r <= 4 group by all)
select source, target, round(s, 3) as similarity from e order by met, source, target limit 300""")
def semantic_edges_first(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = vector.knn(v.select(F.col("id").alias("query_id"), F.col("v").alias("q")), v, 5, "cosine").filter("query_id <> id and score >= 0.3")
    return links.first_semantic(near, v.select("id", F.col("id").alias("place")), 4, 300)


# rounds

@query(f"""with {SNAP}, s as (select library_id, count(*) as n from new group by 1), o as (select library_id, count(*) as n from old group by 1),
j as (select coalesce(n.library_id, o.library_id) as library_id, coalesce(included, false) as inc, o.path is not null as known, n.path is not null as listed, n.size <> o.size or n.mtime_ns <> o.mtime_ns as touched from new n full join old o on n.library_id = o.library_id and n.path = o.path),
g as (select library_id, count_if(listed) as listed, count_if(known) as recorded, count_if(inc <> known) as differ, count_if(inc and known and coalesce(touched, false)) as touched from j group by 1),
l as (select distinct library_id from f)
select l.library_id, case when l.library_id = 'src1' then 'missing' when l.library_id = 'src2' then case when coalesce(listed, 0) > 0 then 'never-indexed' end when coalesce(listed, 0) = 0 and coalesce(recorded, 0) > 0 then 'emptied' when l.library_id = 'src4' then 'signatures' when coalesce(differ, 0) > 0 then 'files' when coalesce(touched, 0) > 0 then 'contents' when l.library_id = 'src5' then 'chunks' end as reason from l left join g using (library_id)""")
def library_freshness(spark, d):
    new, old = _snapshots(spark, d)
    libs = files(spark, d).select("library_id").distinct()
    one = F.col("library_id")
    man = old.withColumn("retry", F.lit(False)).withColumn("outdated", F.lit(False))
    drifted = libs.filter(one == "src4").withColumn("point", F.lit("chunker"))
    counts = libs.withColumn("drift", one == "src5")
    f = integrity.freshness(libs.withColumn("root_exists", one != "src1").withColumn("indexed", one != "src2"), new.withColumn("readable", F.lit(True)), man, drifted, counts)
    return f.select("library_id", "reason")


@query("select distinct source as library_id, unnest(case when source = 'src1' then ['extractor:docx'] when source = 'src2' then ['chunker', 'extractor:docx'] else ['extractor:docx'] end) as point from documents")
def signature_points(spark, d):
    libs = read(spark, d, "documents").select(F.col("source").alias("library_id")).distinct()
    kind = "point string, signature string, versions array<struct<plugin string, version string>>"
    old = libs.crossJoin(F.broadcast(spark.createDataFrame([("chunker", "1", None), ("extractor:pdf", None, [("p", "selected:x")]), ("extractor:docx", None, [("w", "1"), ("z", "1")])], kind)))  # three points
    old = old.withColumn("signature", F.when((F.col("library_id") == "src2") & (F.col("point") == "chunker"), "0").otherwise(F.col("signature")))
    now = spark.createDataFrame([("chunker", "1", None), ("extractor:pdf", None, [("p", "2")]), ("extractor:docx", None, [("w", "2")])], kind)
    return integrity.signature_drift(old, now)


@query("""select doc_id, case when doc_id % 4 = 0 then true when doc_id % 4 = 1 then doc_id % 3 = 0 and (doc_id % 5 = 0 or doc_id % 2 = 1) else (doc_id % 4 = 2 or doc_id % 7 <> 0) and doc_id % 2 = 1 end as retry from documents""")
def retry_rules(spark, d):
    t = read(spark, d, "documents")
    c = F.col("doc_id")
    status = F.when(c % 4 == 0, "deferred").when(c % 4 == 1, "indexed").otherwise("failed")
    state = F.when((c % 4 == 3) & (c % 7 == 0), "empty").when(c % 4 == 3, "scanned: x").otherwise("odd")
    pages = F.when(c % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    why = F.when(c % 5 == 0, "ocr-deferred").otherwise("ocr-off")
    return t.select("doc_id", R.will_retry(status, state, F.lit("s"), F.when(c % 2 == 1, "s2").otherwise("s"), pages, why).alias("retry"))


@query(f"with {FILES} select library_id, path, 'old' as side from f where doc_id % 6 = 0 union all select library_id, path, 'new' from f where doc_id % 10 = 0 and doc_id % 6 <> 0")
def listing_differences(spark, d):
    f = files(spark, d)
    a, b = f.filter("doc_id % 3 = 0").select("library_id", "path"), f.filter("doc_id % 6 = 3 or doc_id % 10 = 0 and doc_id % 6 <> 0").select("library_id", "path").distinct()
    return archive.differences(a, b)


# selection

@query("select distinct source as library_id, 'b,c' as selection_in, case when source = 'src1' then 'd,x' else 'd' end as selection_out from documents")
def selection_changes(spark, d):
    libs = read(spark, d, "documents").select(F.col("source").alias("library_id")).distinct()
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    s = libs.select("library_id", arr("a", "b").alias("selection_in"), arr("c", "d").alias("selection_out"))
    c = libs.select("library_id", F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(p).alias("path"), F.lit(a).alias("action")) for i, (p, a) in enumerate([("c", "in"), ("a", "neutral"), ("x", "in"), ("x", "out")])))).alias("s")).select("library_id", "s.*")
    c = c.withColumn("action", F.when((F.col("path") == "x") & (F.col("action") == "out") & (F.col("library_id") != "src1"), "neutral").otherwise(F.col("action")))
    r = selection.applied(s, c)
    return r.select("library_id", F.array_join("selection_in", ",").alias("selection_in"), F.array_join("selection_out", ",").alias("selection_out"))


@query(f"with {FILES} select library_id, lang as path, case lang when 'fr' then 'out' when 'en' then 'in' when 'es' then 'auto_out' else 'auto_in' end as state, count(*)::bigint as files from f group by all")
def selection_tree(spark, d):
    f = files(spark, d)
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    rules = f.select("library_id").distinct().select("library_id", arr("en").alias("selection_in"), arr("fr").alias("selection_out"), arr("es").alias("exclude_dirs"), arr().alias("exclude_files"), arr().alias("exclude_patterns"), arr(".md").alias("enabled_extensions"), F.lit("include").alias("new_file_default"))
    return selection.tree(f, rules).select("library_id", "path", "state", "files")


@query("select doc_id, case doc_id % 6 when 0 then 'not relative' when 1 then 'blank or dotted part' when 2 then 'empty' when 3 then 'not relative' end as fault from documents")
def selection_paths(spark, d):
    p = F.element_at(F.array(*map(F.lit, ("/a", "a/../b", "  ", "C:\\x", "a\\b/", "c/d.md"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", selection.path_fault(p).alias("fault"))


@query(f"with {FILES}, x as (select library_id, path, doc_id, case doc_id % 3 when 0 then '.pdf' when 1 then '.docx' else '.md' end as ext from f) select library_id, path || ext as path from x where ext = '.md' or (ext = '.pdf' and library_id <> 'src2')")
def granted_rows(spark, d):
    f = files(spark, d)
    kind = F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".docx").otherwise(".md")
    allowed = f.select("library_id").distinct().select("library_id", F.explode(F.when(F.col("library_id") == "src2", F.array(F.lit(".md"))).otherwise(F.array(F.lit(".md"), F.lit(".PDF")))).alias("ext"))
    return selection.granted(f.select("library_id", F.concat("path", kind).alias("path")), allowed)


# conversion

CONVERSION = f"""{FILES}, x as (select library_id, path || case doc_id % 3 when 0 then '.pdf' when 1 then '.docx' else '' end as path, doc_id, n_chars, case doc_id % 3 when 0 then 'pdf' when 1 then 'docx' else 'md' end as ext from f),
e as (select *, case when doc_id % 11 = 0 then 'pending' when doc_id % 7 = 0 then 'pending' when doc_id % 13 = 0 then 'failed' when doc_id % 17 = 0 then 'missing' when doc_id % 5 = 0 then 'partial' else 'done' end as state,
 case when doc_id % 11 = 0 then 'not-indexed' when doc_id % 7 = 0 then 'scanned' when doc_id % 13 = 0 then 'too-many-pages' when doc_id % 17 = 0 then 'cache-missing' when doc_id % 5 = 0 then 'ocr-off' end as reason,
 case when ext <> 'pdf' then 'n/a' when doc_id % 4 = 0 then 'none' when doc_id % 4 = 1 then 'partial' when doc_id % 4 = 2 then 'failed' else 'done' end as pstate from x where ext <> 'md')"""


def _conversion(spark, d):
    c = F.col("doc_id")
    x = files(spark, d).withColumn("path", F.concat("path", F.when(c % 3 == 0, ".pdf").when(c % 3 == 1, ".docx").otherwise("")))
    none = F.lit(None).cast("string")
    man = x.filter("doc_id % 11 <> 0").select("library_id", "path", F.when((c % 7 == 0) | (c % 13 == 0), "failed").otherwise("indexed").alias("status"), F.when(c % 7 == 0, " Scanned").alias("failure_state"), none.alias("failure_reason"), F.when((c % 13 == 0) & (c % 7 != 0), "too-many-pages: 9").alias("failure_detail"), F.concat(F.lit("r"), (c % 2).cast("string")).alias("extractor_id"), F.when(c % 5 == 0, F.array(F.lit(3), F.lit(1))).alias("missing_pages"), F.lit("ocr-off").alias("missing_reason"), F.when(c % 2 == 0, F.array(F.lit(1))).alias("ocr_pages"), none.alias("ocr_by"))
    cache = x.filter("doc_id % 17 <> 0").select("library_id", "path", F.concat(F.lit("t/"), c.cast("string")).alias("text_file"), F.col("n_chars").alias("text_bytes"), F.lit(0).alias("text_updated"))
    pages = x.filter("doc_id % 3 = 0 and doc_id % 4 <> 0").select("library_id", "path", F.lit("p").alias("provider_id"), F.when(c % 4 == 1, "partial").when(c % 4 == 2, "failed").otherwise("indexed").alias("status"), F.array(F.lit(2), F.lit(1)).alias("pages"), F.lit(2).alias("page_count"), F.lit("g").alias("built_in"), none.alias("failure_reason"))
    return conversion.entries(x.select("library_id", "path"), man, cache, pages, generation="g")


@query(f"with {CONVERSION} select library_id, path, state as text_state, reason as text_reason, pstate as pages_state, state <> 'done' or pstate in ('none', 'partial', 'failed') as attention from e")
def conversion_entries(spark, d):
    e = _conversion(spark, d)
    return e.select("library_id", "path", "text_state", "text_reason", "pages_state", conversion.needs_attention(e).alias("attention"))


@query(f"""with {CONVERSION}, s as (select *, state in ('done', 'partial') as ok, doc_id % 2 = 0 as fresh, pstate in ('done', 'partial') as built from e)
select library_id, count_if(ok and not fresh)::bigint as text_reused, count_if(ok and fresh)::bigint as text_new, count_if(not ok)::bigint as text_missing, 0::bigint as pages_reused, count_if(built)::bigint as pages_new, count_if(ext = 'pdf' and not built)::bigint as pages_missing,
 sum(case when state = 'partial' then 2 else 0 end)::bigint as pages_unrecognised, count_if(state = 'partial')::bigint as files_unrecognised, coalesce(sum(case when ok then n_chars end), 0)::bigint as text_bytes from s group by 1""")
def conversion_round(spark, d):
    fresh = files(spark, d).filter("doc_id % 2 = 0")
    c = F.col("doc_id")
    fresh = fresh.select("library_id", F.concat("path", F.when(c % 3 == 0, ".pdf").when(c % 3 == 1, ".docx").otherwise("")).alias("path"))
    return conversion.summary(_conversion(spark, d), fresh)


@query(f"with {CONVERSION} select library_id, reason, count(*)::bigint as files from e where reason is not null group by all")
def conversion_issues(spark, d):
    return conversion.issues(_conversion(spark, d)).select("library_id", "reason", "files")


@query("select page_id % 10 as doc, (case when page_id % 10 < 3 then 'ocr' when page_id % 10 < 6 then 'text' else 'overflow' end) as route, count_if(page_id % 7 < 4)::bigint as n from pages group by all having count_if(page_id % 7 < 4) > 0")
def image_page_routes(spark, d):
    p = read(spark, d, "pages").select(F.when(F.col("page_id") % 7 < 4, "image").otherwise("text").alias("kind"), F.lit("l").alias("library_id"), (F.col("page_id") % 10).alias("doc"), F.col("page_id").alias("page"))
    p = p.withColumn("path", F.col("doc").cast("string"))
    big = extract.routed(p.filter("doc < 3"), 10**6).unionByName(extract.routed(p.filter("doc >= 3 and doc < 6"), 1)).unionByName(extract.routed(p.filter("doc >= 6"), 1, overflow=True))
    return big.select(F.col("path").cast("bigint").alias("doc"), "route", "n")


@query(f"""with recursive {FILES}, n as (select library_id, path, n_chars % 90 as pages, row_number() over (partition by library_id order by path) as i from f),
b as (select library_id, path, pages, i, 0 as batch, 1 as n, pages as s from n where i = 1
  union all select n.library_id, n.path, n.pages, n.i, b.batch + (b.n >= 20 or b.s + n.pages > 200)::int, case when b.n >= 20 or b.s + n.pages > 200 then 1 else b.n + 1 end, case when b.n >= 20 or b.s + n.pages > 200 then n.pages else b.s + n.pages end
  from b join n on n.library_id = b.library_id and n.i = b.i + 1)
select library_id, path, pages, batch::int as batch from b""")
def recognition_batches(spark, d):
    f = files(spark, d).select("library_id", "path", (F.col("n_chars") % 90).alias("pages"))
    return extract.batches(f, 20, 200)


@query()
def duplicate_links_near(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("library_id"), F.col("doc_id").alias("id"), "text")
    return near_duplicates.duplicate_links(docs)


@query("select user_id, count(*)::bigint as n, max(event_id) as last from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 3 group by 1")
def last_lines(spark, d):
    e = read(spark, d, "events")
    users = e.select(F.lit("l").alias("library_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("path")).distinct()
    log = e.select(F.col("event_id").alias("line_no"), F.concat(F.lit("failed dir/u"), F.col("user_id").cast("string"), F.lit(".pdf: "), "event_type").alias("line"))
    r = conversion.log_lines(users, log)
    return r.groupBy(F.regexp_extract("path", r"u(\d+)", 1).cast("bigint").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"))


@query("select source as library_id, case when doc_id % 6 = 0 then 'removed' when doc_id % 6 = 1 then 'added' when doc_id % 6 = 2 then 'kept' when doc_id % 6 = 3 then 'retried' when doc_id % 6 = 4 then 'changed' else 'changed' end as action, count(*)::bigint as n from documents group by all")
def page_index_plan(spark, d):
    f = files(spark, d)
    now = f.filter("doc_id % 6 <> 0").select("library_id", "path", F.when(F.col("doc_id") % 6 == 4, "h2").otherwise("h").alias("content_hash"), F.when(F.col("doc_id") % 6 == 5, "s2").otherwise("s").alias("signature"))
    old = f.filter("doc_id % 6 <> 1").select("library_id", "path", F.lit("h").alias("content_hash"), F.lit("s").alias("signature"), F.when(F.col("doc_id") % 6 == 3, "partial").otherwise("indexed").alias("status"))
    return conversion.page_plan(now, old).groupBy("library_id", "action").agg(F.count(F.lit(1)).alias("n"))


# progress: a user's events are a run

RUN = "case event_id % 6 when 0 then 'done' when 1 then 'embedding' when 2 then 'visual' when 3 then 'failed' when 4 then 'writing' else 'extracting' end"
LATEST = f"with r as (select user_id, max((ts, event_id)) as m from events group by 1), e as (select e.*, {RUN} as stage, (select max(ts) from events) as now from events e join r on r.user_id = e.user_id and r.m = (e.ts, e.event_id))"


def _runs_now(spark, d):
    e = read(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return progress.latest(e.withColumn("stage", F.expr(RUN)), "user_id", "ts", "event_id").join(F.broadcast(now))


@query(LATEST + " select user_id, stage, case when stage in ('done', 'failed') then 'healthy' when user_id % 7 = 0 then 'orphaned' when now - ts > interval 6 hour then 'stalled_no_heartbeat' when now - ts > interval 3 hour and user_id % 2 = 0 then 'stalled_no_progress' else 'healthy' end as health from e")
def run_health(spark, d):
    r = _runs_now(spark, d)
    ts, now = F.col("ts"), F.col("now")
    hours = lambda n: F.expr(f"interval {n} hours")
    # the heartbeat is three hours younger than the progress; a run of an odd number began just now
    h = progress.health(F.col("stage"), F.col("user_id") % 7 != 0, now, ts + hours(3), ts, F.when(F.col("user_id") % 2 == 0, ts).otherwise(now), hours(3), hours(1))
    return r.select("user_id", "stage", h.alias("health"))


@query(LATEST + """, p as (select *, case when stage = 'done' then 100 when stage = 'visual' then null when stage = 'embedding' then least(100, floor((event_id % 90) * 100 / 80.0)) else least(100, floor((event_id % 50) * 100 / 60.0)) end::int as percent from e)
select user_id, percent, case when stage in ('writing', 'extracting', 'visual') and stage <> 'writing' and percent > 0 then round(30.0::double * (100 - percent) / percent, 1) end as seconds from p""")
def run_percent(spark, d):
    r = _runs_now(spark, d)
    p = progress.percent(F.col("stage"), F.col("event_id") % 50, F.lit(60), F.col("event_id") % 90, F.lit(80))
    r = r.withColumn("percent", p)
    return r.select("user_id", "percent", progress.seconds_left(F.col("stage"), F.lit(30.0), F.col("percent")).alias("seconds"))


@query(LATEST + """, b as (select user_id % 4 as batch_id, 'l' || user_id as library_id, stage, event_id % 50 as done from e)
select batch_id, sum(done)::bigint as files_done, count(*)::bigint * 60 as files, max(done) as elapsed, coalesce(string_agg(library_id, ', ' order by library_id) filter (stage not in ('done', 'failed')), '') as active, coalesce(string_agg(library_id, ', ' order by library_id) filter (stage = 'failed'), '') as failed,
 case when count_if(stage not in ('done', 'failed')) > 0 then 'running' when count_if(stage = 'failed') > 0 then 'failed' else 'done' end as stage from b group by 1""")
def merged_progress(spark, d):
    r = _runs_now(spark, d).select((F.col("user_id") % 4).alias("batch_id"), F.concat(F.lit("l"), F.col("user_id").cast("string")).alias("library_id"), "stage", (F.col("event_id") % 50).alias("files_done"), F.lit(60).alias("files"), F.lit(0).alias("chunks_done"), F.lit(0).alias("chunks"), (F.col("event_id") % 50).alias("elapsed"))
    return progress.merged(r).drop("chunks_done", "chunks")


@query("select count(*)::bigint as files, sum(n_chars // 600 + 1)::bigint as chunks, case when count_if(source = 'src1') > 0 then 'stale' else 'ok' end as state from documents")
def snapshot_totals(spark, d):
    f = files(spark, d).groupBy("library_id").agg(F.count(F.lit(1)).alias("files"), F.sum(F.expr("n_chars div 600 + 1")).alias("chunks"))
    return progress.snapshot(f.withColumn("indexed", F.lit(True)).withColumn("stale", F.col("library_id") == "src1"))


@query(f"with {FILES} select library_id, path, (row_number() over (partition by library_id, lang order by doc_id))::int as nth, count(*) over (partition by library_id, lang)::bigint as total from f")
def chunk_positions(spark, d):
    c = files(spark, d).select("library_id", F.col("lang").alias("path"), F.col("doc_id").alias("chunk_index"), F.col("path").alias("p"))
    return progress.positions(c).select("library_id", F.col("p").alias("path"), "nth", "total")
