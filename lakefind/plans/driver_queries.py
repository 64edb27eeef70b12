"""Queries over the driver tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import advice, archive, catalog, delivery, integrity, lexical, links, progress, selection, vector
from ..sources.tables import files, read
from .registry import query

TOK = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9._+-]{1,}', 0), lambda x: x <> '')"
FILES = "f as (select source as library_id, lang || '/' || doc_id || '.md' as path, doc_id, lang, text, n_chars from documents)"
BM25 = f"""
t as (select source as library_id, doc_id as id, unnest({TOK}) as term from documents),
l as (select source as library_id, doc_id as id, len({TOK}) as dl from documents),
s as (select library_id, count(*) as n_docs, avg(dl) as avgdl from l group by 1),
p as (select library_id, id, term, count(*) as tf from t group by all),
df as (select library_id, term, count(*) as df from p group by all),
q as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest({TOK}) as term from benchmark) group by all),
sc as (select q.query_id, p.library_id, p.id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from p join q using (term) join df using (library_id, term) join l using (library_id, id) join s using (library_id) group by all)"""
BM25_ALL = BM25.replace("source as library_id", "'all' as library_id")


def _all(spark, d):
    return read(spark, d, "documents").withColumn("library_id", F.lit("all"))


@query(f"select source as library_id, doc_id, len({TOK})::bigint as n_tokens, len(list_distinct({TOK}))::bigint as n_terms from documents")
def tokenize_counts(spark, d):
    t = read(spark, d, "documents").select(F.col("source").alias("library_id"), "doc_id", X.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("library_id", "doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(f"with {BM25} select library_id, term, df::bigint as df from df")
def doc_freq(spark, d):
    return lexical.postings(files(spark, d)).groupBy("library_id", "term").agg(F.count(F.lit(1)).alias("df"))


@query(f"with {BM25} select library_id, n_docs::bigint as n_docs, round(avgdl, 6) as avgdl from s")
def doc_length_stats(spark, d):
    return lexical.library_stats(files(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"with {BM25_ALL} select query_id, id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc) where rank <= 10")
def bm25_topk(spark, d):
    return lexical.bm25(read(spark, d, "benchmark"), _all(spark, d), 10).select("query_id", "id", "score", "rank")


@query(f"with {BM25} select query_id, library_id, id, score, rank::int as rank from (select *, row_number() over (partition by query_id, library_id order by score desc, id) as rank from sc) where rank <= 10")
def bm25_per_library(spark, d):
    return lexical.bm25(read(spark, d, "benchmark"), files(spark, d), 10)


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("folder"))


def _vector_queries(spark, d):
    return _vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "folder")


def _knn_sql(score, where="true", k=10):
    return f"""with s as (select a.vec_id as query_id, b.vec_id as id, round({score}, 6) as score from embeddings a join embeddings b on a.vec_id % 50 = 0 and {where})
select query_id, id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= {k}"""


D2 = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(a.embedding[i]::double - b.embedding[i]::double, 2)))"
COS = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double * b.embedding[i]::double)) / greatest(sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double))), 1e-12)"


@query(_knn_sql(f"1 / (1 + {D2})"))
def knn_l2_topk(spark, d):
    return vector.knn(_vector_queries(spark, d), _vectors(spark, d), 10, "l2")


@query(_knn_sql(COS))
def knn_cosine_topk(spark, d):
    return vector.knn(_vector_queries(spark, d), _vectors(spark, d), 10, "cosine")


@query(_knn_sql(f"1 / (1 + {D2})", "a.label = b.label"))
def knn_folder_filtered(spark, d):
    return vector.knn(_vector_queries(spark, d), _vectors(spark, d), 10, "l2", same_folder=True)


RRF = f"""with {BM25_ALL},
lex as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from sc qualify rank <= 50),
dense as (select a.vec_id as query_id, b.vec_id as id, row_number() over (partition by a.vec_id order by round(1 / (1 + {D2}), 6) desc, b.vec_id) as rank from embeddings a join benchmark m on a.vec_id = m.item_id join embeddings b on true qualify rank <= 50),
fused as (select query_id, id, round(sum(s), 9) as score from (select query_id, id, 1.0::double / (2 + rank) as s from lex union all select query_id, id, 0.5::double / (2 + rank) from dense) group by all)"""


def _fused(spark, d):
    lex = lexical.bm25(read(spark, d, "benchmark"), _all(spark, d), 50)
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    q = _vectors(spark, d).select(F.col("id").alias("query_id"), F.col("v").alias("q")).join(items, "query_id", "left_semi")
    return lexical.rrf([(lex, 1.0), (vector.knn(q, _vectors(spark, d), 50, "l2"), 0.5)], ["query_id", "id"])


@query(RRF + " select query_id, id, score from fused")
def rrf_weighted(spark, d):
    return _fused(spark, d)


@query(RRF + " select query_id, id, score, round(score / max(score) over (partition by query_id), 6) as norm from fused")
def fallback_normalised_merge(spark, d):
    return delivery.normalised(_fused(spark, d), ["query_id"])


CONFIDENT = RRF + """, c as (select f.query_id, f.id, f.score, round(least(1.0, f.score / (1.5 / 3)), 6) as confidence from fused f),
r as (select c.query_id, d.source as library_id, d.lang || '/' || d.lang as path, d.n_chars // 500 as section_id, d.n_chars % 2 = 0 as backfilled, c.confidence, c.id, row_number() over (partition by c.query_id order by c.score desc, c.id) as rank from c join documents d on d.doc_id = c.id)"""


def _ranked(spark, d):
    c = delivery.fallback_confidence(_fused(spark, d), 1.5)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("library_id"), F.concat_ws("/", "lang", "lang").alias("path"), F.floor(F.col("n_chars") / 500).alias("section_id"), (F.col("n_chars") % 2 == 0).alias("backfilled"))
    return c.join(docs, "id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))


@query(CONFIDENT + " select query_id, id, confidence, case when confidence >= 0.75 then 'high' when confidence >= 0.3 then 'mid' else 'weak' end as tier from r")
def confidence_tiers(spark, d):
    return _ranked(spark, d).select("query_id", "id", "confidence", X.confidence_tier(F.col("confidence")).alias("tier"))


@query(CONFIDENT + """, w as (select * from r where rank <= 40 and confidence >= 0.05),
fo as (select * from (select *, row_number() over (partition by query_id, library_id, path, section_id, backfilled order by rank) as nth from w) where not backfilled or nth = 1),
ca as (select * from (select *, row_number() over (partition by query_id, library_id, path order by rank) as in_file from fo) where in_file <= 3)
select query_id, id, position::int as position from (select *, row_number() over (partition by query_id order by rank) as position from ca) where position <= 10""")
def delivery_fold_cap(spark, d):
    return delivery.deliver(_ranked(spark, d), 10, drop=0.05).select("query_id", "id", "position")


@query(CONFIDENT + " select query_id, id, position::int as position from (select *, row_number() over (partition by query_id order by rank) as position from r where rank <= 40) where position <= 10")
def delivery_list_mode(spark, d):
    return delivery.deliver(_ranked(spark, d), 10, fold=False).select("query_id", "id", "position")


GOLD = f"""with {BM25_ALL}, r as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from sc qualify rank <= 10),
g as (select b.item_id as query_id, d.doc_id as id from benchmark b join documents d on contains(d.text, b.text)),
h as (select b.item_id as query_id, min(r.rank) as rank from benchmark b left join g on g.query_id = b.item_id left join r on r.query_id = g.query_id and r.id = g.id group by 1)"""


@query(GOLD + " select count(*)::bigint as n, count_if(rank <= 1)::bigint as top1, count_if(rank <= 3)::bigint as top3, count_if(rank <= 5)::bigint as top5, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr from h")
def eval_topk_hits(spark, d):
    b = read(spark, d, "benchmark")
    r = lexical.bm25(b, _all(spark, d), 10).select("query_id", "id", "rank")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    # only delivered documents can be hits, so only they are searched for the passage
    hit = r.join(docs, "id").join(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("gold")), "query_id").filter(F.contains("text", "gold")).groupBy("query_id").agg(F.min("rank").alias("rank"))
    h = b.select(F.col("item_id").alias("query_id")).join(hit, "query_id", "left")
    return h.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in (1, 3, 5)), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


@query(f"with {FILES} select library_id || ':' || path || ':' || n_chars as chunk_id, library_id, path, n_chars::int as chunk_index from f")
def chunk_id_parsing(spark, d):
    c = files(spark, d).select(X.chunk_id(F.col("library_id"), F.col("path"), F.col("n_chars")).alias("chunk_id"))
    a, b, i = X.parse_chunk_id(F.col("chunk_id"))
    return c.select("chunk_id", a.alias("library_id"), b.alias("path"), i.alias("chunk_index"))


@query("""with h as (select doc_id, text, substr(text, 1, 2000) as head, strpos(substr(text, 2001), chr(10)) as nxt from documents),
b as (select *, case when contains(head, chr(10)) then length(head) - strpos(reverse(head), chr(10)) else -1 end as before from h),
c as (select *, case when before > 0 and before >= 1700 then before when nxt > 0 and nxt - 1 <= 300 then 2000 + nxt - 1 else 2000 end as cut from b)
select doc_id, case when length(text) <= 2000 then text else substr(text, 1, cut) || chr(10) || '…' end as body, length(text) > 2000 as truncated from c""")
def truncate_at_line(spark, d):
    return read(spark, d, "documents").select("doc_id", X.truncate_at_line(F.col("text")).alias("body"), (F.length("text") > 2000).alias("truncated"))


LINES = r"""l as (select doc_id, text, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') as a from documents),
b as (select doc_id, text, case when a[-1] = '' then a[:len(a) - 1] else a end as ls from l)"""
REPEATED = LINES + r""", r as (select doc_id, text, unnest(ls) as raw, generate_subscripts(ls, 1) as i from b),
c as (select *, regexp_replace(raw, '^\s+|\s+$', '', 'g') as s from r),
m as (select *, length(s) >= 4 and not regexp_matches(s, '^[\s\-*_#>|~`]+$') and not regexp_matches(s, '^[#|>]') and not regexp_matches(raw, '^(\s*)([-*+]|\d+[.)])\s') as may from c),
n as (select *, may and sum(case when may then 1 else 0 end) over (partition by doc_id, s) >= 3 as gone from m)"""


@query(f"with {REPEATED} select distinct doc_id, s as line from n where gone")
def boilerplate_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(X.boilerplate(F.col("text"))).alias("line"))


@query(f"with {REPEATED}, k as (select doc_id, count_if(gone) as n, string_agg(raw, chr(10) order by i) filter (not gone) as kept from n group by 1) select d.doc_id, sha256(case when coalesce(k.n, 0) = 0 then d.text else coalesce(kept, '') end) as body from documents d left join k on k.doc_id = d.doc_id")
def boilerplate_stripped(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(X.strip_boilerplate(F.col("text")), 256).alias("body"))


@query(f"with {LINES}" + r""", c as (select *, len(list_distinct(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^\s*\d{1,4}\s*$')), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')))) >= 2 as several from b)
select doc_id, array_to_string(list_filter(ls, lambda x: not regexp_matches(x, '(?i)^\s*(?:第\s*\d+\s*页|page\s*\d+)\s*$') and not regexp_matches(x, '^\s*[-–—_·•*]+\s*\d{1,4}\s*[-–—_·•*]+\s*$') and not (several and regexp_matches(x, '^\s*\d{1,4}\s*$'))), chr(10)) as body from c""")
def page_number_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", X.strip_page_numbers(F.col("text")).alias("body"))


IMAGES = """case doc_id % 5 when 0 then '![a b](x/y.png) ' when 1 then '![](https://h/i.png) ' when 2 then '<img src=q alt=''one''> ' when 3 then '<IMG ALT=two> <img src=z> ' else '' end || text"""


@query(f"with t as (select doc_id, {IMAGES} as text from documents)," + r"""
a as (select doc_id, regexp_replace(text, '!(\[[^\]]*\]\(\s*(?i:https?://|data:)[^)]+\))', chr(1) || '\1', 'g') as t from t),
b as (select doc_id, replace(regexp_replace(t, '!\[\s*([^\]]*?)\s*\]\([^)]+\)', '\1', 'g'), chr(1), '!') as t from a),
c as (select doc_id, regexp_replace(t, '(?i)<img\b[^>]*?alt\s*=\s*(?:"\s*([^">]*?)\s*"|''\s*([^''>]*?)\s*''|([^\s>"'']+))[^>]*>', '\1\2\3', 'g') as t from b)
select doc_id, regexp_replace(t, '(?i)<img\b[^>]*>', '', 'g') as body from c""")
def dead_images(spark, d):
    return read(spark, d, "documents").select("doc_id", X.strip_dead_images(F.expr(IMAGES.replace("''one''", "\\'one\\'"))).alias("body"))


@query(f"with {LINES}" + r""", f as (select doc_id, list_filter(ls, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') as ls from b)
select doc_id, len(ls) > 0 and len(list_filter(ls, lambda x: regexp_matches(x, '(?i)\[TBD|TBD\s*[—-]|\[todo\]|TODO\s*[—-]'))) >= len(ls) * 0.1 as tbd from f""")
def tbd_heavy(spark, d):
    return read(spark, d, "documents").select("doc_id", X.tbd_heavy(F.col("text")).alias("tbd"))


@query(r"""with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)
select doc_id, length(t)::bigint as n, md5(t) as squeezed from t""")
def squeezed_text(spark, d):
    t = read(spark, d, "documents").select("doc_id", X.squeeze(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("squeezed"))


@query(r"""with t as (select source as library_id, doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as h from documents),
g as (select library_id, h, min(doc_id) as first, count(*) as n from t group by all having count(*) >= 2)
select t.library_id, t.doc_id, g.first as group_id, g.n::bigint as n from t join g using (library_id, h)""")
def duplicate_groups_exact(spark, d):
    t = read(spark, d, "documents").select(F.col("source").alias("library_id"), "doc_id", F.md5(X.squeeze(F.col("text"))).alias("h"))
    g = t.groupBy("library_id", "h").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return t.join(g, ["library_id", "h"]).select("library_id", "doc_id", "group_id", "n")


LINKS = """e as (select distinct page_id, unnest(regexp_extract_all(html, 'href="/([^"#?]+)"', 1)) as target from pages)"""


def _links(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"#?]+)"'), F.lit(1)))).alias("target"))


@query(f"with {LINKS} select page_id, target from e")
def link_edges(spark, d):
    return _links(spark, d)


@query(f"with {LINKS} select target, count(*)::bigint as inlinks from e group by 1")
def inlink_counts(spark, d):
    return _links(spark, d).groupBy("target").agg(F.count(F.lit(1)).alias("inlinks"))


@query(f"with {LINKS} select node, degree from (select node, count(*)::bigint as degree, row_number() over (order by count(*) desc, node) as r from (select 'p' || page_id as node from e union all select target from e) group by 1) where r <= 5")
def graph_hubs(spark, d):
    e = _links(spark, d).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source"), "target")
    return links.hubs(e).select(F.col("node_id").alias("node"), "degree")


@query(f"with {LINKS} select (select count(*) from (select 'p' || page_id from e union select target from e))::bigint as nodes, (select count(*) from e)::bigint as edges")
def graph_stats(spark, d):
    e = _links(spark, d).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source"), "target")
    ends = e.select(F.explode(F.array("source", "target")).alias("node")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    return ends.join(e.agg(F.count(F.lit(1)).alias("edges")))  # one row each


@query(f"""with s as (select a.vec_id as a, b.vec_id as b, round({COS}, 6) as s from embeddings a join embeddings b on a.vec_id <> b.vec_id),
t as (select *, row_number() over (partition by a order by s desc, b) as r from s where s >= 0.3)
select distinct least(a, b) as source, greatest(a, b) as target, s as similarity from t where r <= 4""")
def semantic_edges(spark, d):
    return vector.semantic_edges(_vectors(spark, d), 0.3, 4)


@query("""with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
m as (select label, i, avg(x) as m from e group by all), n as (select label, list(m order by i) as v from m group by 1)
select label, list_transform(v, lambda x: round(x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12), 6)) as vec from n""")
def file_mean_vectors(spark, d):
    return vector.file_means(_vectors(spark, d).withColumnRenamed("folder", "label"), "label")


def _rules(spark, d):
    libs = read(spark, d, "documents").select(F.col("source").alias("library_id")).distinct()
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return libs.select("library_id", arr("de/20.md", "en").alias("selection_in"), arr("fr", "en/5.md").alias("selection_out"), arr("es").alias("exclude_dirs"), arr("24.md").alias("exclude_files"), arr("9").alias("exclude_patterns"), arr(".md", ".txt").alias("enabled_extensions"), F.when(F.col("library_id") == "src3", "exclude").otherwise("include").alias("new_file_default"))


@query(f"""with {FILES} select library_id, path, reason in ('selected in', 'default in') as included, reason from (select library_id, path, case
 when lang = 'fr' or path = 'en/5.md' then 'selected out' when path = 'de/20.md' or lang = 'en' then 'selected in' when lang = 'es' then 'excluded folder'
 when doc_id = 24 then 'excluded file' when doc_id::varchar like '9%' then 'excluded pattern' when library_id = 'src3' then 'default out' else 'default in' end as reason from f)""")
def decide_included(spark, d):
    return catalog.decide(files(spark, d).select("library_id", "path"), _rules(spark, d))


@query(f"with {FILES}, x as (select library_id, case doc_id % 3 when 0 then 'pdf' when 1 then 'docx' else 'md' end as ext, library_id = 'src3' as granted from f) select library_id, ext, count(*)::bigint as n from x where ext <> 'md' and not (ext = 'docx' and granted) group by all")
def pending_formats(spark, d):
    f = files(spark, d)
    kind = F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".docx").otherwise(".md")
    rules = f.select("library_id").distinct().withColumn("enabled_extensions", F.array(F.lit(".pdf"), F.lit("docx"))).withColumn("agent_formats", F.when(F.col("library_id") == "src3", F.array(F.lit("docx"))).otherwise(F.array().cast("array<string>")))
    return selection.pending_formats(f.select("library_id", F.concat("path", kind).alias("path")), rules)


SNAP = f"""{FILES},
new as (select library_id, path, n_chars as size, doc_id * 10 as mtime_ns, md5(text) as content_hash, doc_id % 11 <> 0 as included from f where doc_id % 7 <> 0),
old as (select library_id, path, n_chars + (case when doc_id % 5 = 0 then 1 else 0 end) as size, doc_id * 10 + (case when doc_id % 6 = 0 then 1 else 0 end) as mtime_ns, case when doc_id % 10 = 0 then 'x' else md5(text) end as content_hash, case when doc_id % 13 = 0 then 'failed' else 'indexed' end as status, case when doc_id % 26 = 0 then 'deferred' when doc_id % 13 = 0 then 'empty' end as failure_state from f where doc_id % 3 <> 0)"""
PLAN = SNAP + """, j as (select coalesce(n.library_id, o.library_id) as library_id, coalesce(n.path, o.path) as path, n.included, o.status, o.failure_state, (n.size = o.size and n.mtime_ns = o.mtime_ns) or n.content_hash = o.content_hash as same from new n full join old o on n.library_id = o.library_id and n.path = o.path),
p as (select library_id, path, case when included is null then 'removed' when not included then 'excluded' when status is null then 'added' when status = 'indexed' and same then 'unchanged' when status = 'indexed' then 'changed' when failure_state = 'deferred' then 'retried' when same then 'unchanged' else 'retried' end as action from j)"""


def _snapshots(spark, d):
    f = files(spark, d).withColumn("h", F.md5("text"))
    new = f.filter("doc_id % 7 <> 0").selectExpr("library_id", "path", "n_chars as size", "doc_id * 10 as mtime_ns", "h as content_hash", "doc_id % 11 <> 0 as included")
    old = f.filter("doc_id % 3 <> 0").selectExpr("library_id", "path", "n_chars + if(doc_id % 5 = 0, 1, 0) as size", "doc_id * 10 + if(doc_id % 6 = 0, 1, 0) as mtime_ns", "if(doc_id % 10 = 0, 'x', h) as content_hash", "if(doc_id % 13 = 0, 'failed', 'indexed') as status", "case when doc_id % 26 = 0 then 'deferred' when doc_id % 13 = 0 then 'empty' end as failure_state")
    return new, old


@query(f"with {PLAN} select library_id, path, action from p")
def incremental_actions(spark, d):
    return catalog.plan(*_snapshots(spark, d))


@query(f"with {PLAN} select library_id, action, count(*)::bigint as n from p group by all")
def manifest_diff(spark, d):
    return catalog.plan(*_snapshots(spark, d)).groupBy("library_id", "action").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {PLAN} select library_id, count_if(action not in ('unchanged', 'excluded')) > 0 as stale, count_if(action = 'removed')::bigint as removed from p group by 1")
def freshness(spark, d):
    p = catalog.plan(*_snapshots(spark, d))
    return p.groupBy("library_id").agg((F.count_if(~F.col("action").isin("unchanged", "excluded")) > 0).alias("stale"), F.count_if(F.col("action") == "removed").alias("removed"))


@query(f"with {FILES}, e as (select library_id, sum(n_chars // 600 + 1)::bigint as expected from f group by 1), a as (select library_id, sum(n_chars // 600 + (case when doc_id % 17 = 0 then 0 else 1 end))::bigint as actual from f group by 1) select library_id, expected, actual, actual < expected as drift from e join a using (library_id)")
def count_drift(spark, d):
    f = files(spark, d)
    manifest = f.select("library_id", "path", F.lit("indexed").alias("status"), F.expr("transform(sequence(0, n_chars div 600), i -> cast(i as string))").alias("chunk_ids"))
    stored = f.groupBy("library_id").agg(F.sum(F.expr("n_chars div 600 + if(doc_id % 17 = 0, 0, 1)")).alias("actual"))
    return integrity.drift(manifest, stored)


@query(f"with {FILES} select library_id, substr(sha256(string_agg(path || ':' || md5(text), '|' order by path || ':' || md5(text))), 1, 16) as fingerprint from f group by 1")
def content_fingerprint(spark, d):
    return catalog.fingerprint(files(spark, d).select("library_id", "path", F.md5("text").alias("content_hash")))


STATE = "case when n_chars < 200 then 'empty' when doc_id % 9 = 0 then 'scanned' when doc_id % 14 = 0 then 'deferred' else 'done' end"


@query(f"with {FILES}, s as (select library_id, {STATE} as reason from f) select library_id, reason, count(*)::bigint as n, reason in ('scanned', 'deferred') as will_retry from s where reason <> 'done' group by all")
def failure_summary(spark, d):
    s = files(spark, d).select("library_id", F.expr(STATE).alias("reason")).filter("reason <> 'done'")
    return s.groupBy("library_id", "reason").agg(F.count(F.lit(1)).alias("n")).withColumn("will_retry", F.col("reason").isin("scanned", "deferred"))


@query(f"with {FILES}, s as (select library_id, n_chars, {STATE} as state from f) select library_id, count(*)::bigint as files, count_if(state = 'done')::bigint as done, coalesce(sum(case when state = 'done' then n_chars end), 0)::bigint as bytes, count_if(state in ('scanned', 'deferred'))::bigint as pending from s group by 1")
def conversion_summary(spark, d):
    s = files(spark, d).select("library_id", "n_chars", F.expr(STATE).alias("state"))
    return s.groupBy("library_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("state") == "done").alias("done"), F.coalesce(F.sum(F.when(F.col("state") == "done", F.col("n_chars"))), F.lit(0)).alias("bytes"), F.count_if(F.col("state").isin("scanned", "deferred")).alias("pending"))


@query("with r as (select user_id, arg_max(event_type, (ts, event_id)) as stage, max(ts) as last from events group by 1), m as (select max(ts) as now from events) select user_id, stage, case when now - last > interval 2 day then 'stalled' else 'healthy' end as health from r, m")
def latest_status(spark, d):
    e = read(spark, d, "events")
    r = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("last"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return r.crossJoin(F.broadcast(now)).select("user_id", "stage", F.when(F.col("now") - F.col("last") > F.expr("interval 2 days"), "stalled").otherwise("healthy").alias("health"))


@query("select date_trunc('hour', ts) as at, arg_max(event_type, (ts, event_id)) as last_type, count(*)::bigint as n from events group by 1")
def progress_throttle(spark, d):
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("at")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n"))


@query("select user_id, event_id, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as shown from events")
def monotone_progress(spark, d):
    return progress.monotone(read(spark, d, "events"), "user_id", "value", "ts", "event_id").select("user_id", "event_id", "shown")


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*)::bigint as files, round(sum(value), 4) as pages from events group by all")
def quota_per_day(spark, d):
    return read(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("value"), 4).alias("pages"))


PAGES = "p as (select page_id % 10 as doc, page_id as page from pages where page_id % 7 < 4), x as (select *, case when page - lag(page) over (partition by doc order by page) <= 13 then 0 else 1 end as n from p), g as (select *, sum(n) over (partition by doc order by page) as run from x), r as (select doc, min(page) as first, max(page) as last from g group by doc, run)"


def _runs(spark, d):
    p = read(spark, d, "pages").filter("page_id % 7 < 4").selectExpr("page_id % 10 as doc", "page_id as page")
    return catalog.runs(p, "doc", "page", 12)


@query(f"with {PAGES} select doc, first, last from r")
def page_runs(spark, d):
    return _runs(spark, d)


@query(f"with {PAGES}, s as (select doc, last, unnest(generate_series(first, last, 8)) as first from r) select doc, first, least(last, first + 7) as last from s")
def split_page_runs(spark, d):
    return catalog.split_runs(_runs(spark, d), 8)


@query(f"with {PAGES}, b as (select page_id % 10 as doc, page_id as page, 't' || page_id || '.' as text, page_id % 7 < 4 as image from pages), j as (select b.*, r.first, r.first % 2 = 0 as ok from b left join r on r.doc = b.doc and b.page between r.first and r.last), k as (select *, case when coalesce(ok, false) then case when page = first then 'run' || first || chr(10) || chr(10) end else text end as t from j) select doc, coalesce(string_agg(t, '' order by page), '') as text, coalesce(array_to_string(list(page order by page) filter (ok), ','), '') as recognised, coalesce(array_to_string(list(page order by page) filter (image and not ok), ','), '') as missing from k group by 1")
def splice_pages(spark, d):
    b = read(spark, d, "pages").selectExpr("page_id % 10 as doc", "page_id as page", "'t' || page_id || '.' as text", "page_id % 7 < 4 as image")
    runs = _runs(spark, d).withColumn("text", F.when(F.col("first") % 2 == 0, F.concat(F.lit("run"), F.col("first").cast("string"))))
    text, missing = catalog.splice(b, runs)
    shown = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")).alias(c)
    return text.join(missing, "doc", "left").select("doc", "text", shown("recognised"), shown("missing"))


@query(f"with {FILES}, s as (select library_id, path, 1 as generation, n_chars as v from f where doc_id % 2 = 0 union all select library_id, path, 2, n_chars + 1 from f where doc_id % 3 = 0) select library_id, path, generation::int as generation, v from s qualify row_number() over (partition by library_id, path order by generation desc) = 1")
def compaction_newest_wins(spark, d):
    f = files(spark, d)
    one = f.filter("doc_id % 2 = 0").select("library_id", "path", F.lit(1).alias("generation"), F.col("n_chars").alias("v"))
    two = f.filter("doc_id % 3 = 0").select("library_id", "path", F.lit(2).alias("generation"), (F.col("n_chars") + 1).alias("v"))
    return catalog.merged(one, two, ["library_id", "path"])


@query(f"with {FILES} select library_id || ':' || path || ':0' as id, 'orphan' as problem from f where doc_id % 5 = 0 and doc_id % 2 <> 0 union all select library_id || ':' || path || ':0', 'missing' from f where doc_id % 2 = 0 and doc_id % 5 <> 0")
def archive_reference_check(spark, d):
    f = files(spark, d).withColumn("id", X.chunk_id(F.col("library_id"), F.col("path"), F.lit(0)))
    manifest = f.select(F.when(F.col("doc_id") % 2 == 0, "indexed").otherwise("failed").alias("status"), F.array("id").alias("chunk_ids"))
    return archive.reference_faults(manifest, f.filter("doc_id % 5 = 0"))


@query(f"with {FILES} select 'copy:' || path || ':' || n_chars as id, n_chars as tf from f where doc_id % 4 <> 0")
def import_id_remap(spark, d):
    f = files(spark, d).withColumn("id", X.chunk_id(F.col("library_id"), F.col("path"), F.col("n_chars")))
    ids = archive.id_map(f.filter("doc_id % 4 <> 0").select("id", "path", F.col("n_chars").alias("chunk_index")), "copy")
    return archive.remapped(f.select("id", F.col("n_chars").alias("tf")), ids)


@query("select source as library_id, count(*)::bigint as files, sum(n_chars)::bigint as chars, max(doc_id) as last from documents group by 1")
def library_rows(spark, d):
    return read(spark, d, "documents").groupBy(F.col("source").alias("library_id")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("last"))


@query("select url, case when url like '%/en/%' then 'english' when url like '%/fr/%' then 'french' when contains(lower(url), 'page') or contains(lower(url), 'post') then 'paged' else 'general' end as theme from pages")
def theme_classifier(spark, d):
    return read(spark, d, "pages").select("url", X.theme(F.col("url"), [("english", ["/en/"]), ("french", ["/fr/"]), ("paged", ["page", "post"])]).alias("theme"))


@query(f"with {BM25_ALL}, r as (select query_id, id, score / 100 as c, row_number() over (partition by query_id order by score desc, id) as rank from sc qualify rank <= 10), a as (select query_id, count(*) as n, max(c) as top, count_if(c >= 0.75) as strong from r group by 1) select b.item_id as query_id, case when n is null then 'empty' when top < 0.3 then 'all-weak' when strong = 1 and n > 1 then 'one-strong' when strong = 0 and top < 0.75 then 'no-strong' when strong >= 3 or (strong >= 1 and top >= 0.9 and n >= 10) then 'many-strong' when n <= 2 then 'few' when length(trim(b.text)) <= 12 and not contains(b.text, '?') then 'keywords' end as rule from benchmark b left join a on a.query_id = b.item_id")
def advice_first_rule(spark, d):
    b = read(spark, d, "benchmark")
    r = lexical.bm25(b, _all(spark, d), 10)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    res = r.join(docs, "id").select("query_id", "library_id", "path", (F.col("score") / 100).alias("confidence"), F.lit(0).alias("folded"), F.lit(False).alias("capped"), F.lit(False).alias("backfilled"))
    none = spark.createDataFrame([], "query_id long, reason string")
    return advice.advise(b.select(F.col("item_id").alias("query_id"), "text"), res, none, 10, most=1).select("query_id", F.get("rules", F.lit(0)).alias("rule"))
