"""Queries on what searches are built of: words of texts without spaces, vectors by cell, segments of postings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..library import TABLES, bucket
from ..operators import lexical, search, segmentation, vector_index
from ..segments import KEY, Segments
from ..sources.tables import files, read
from ..storage import shared_root, staged
from .driver_queries import BM25
from .registry import query

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Each letter as a CJK character: the documents' words become words of a text without spaces.
SIGNS = "".join(chr(0x4E00 + 131 * k + 7) for k in range(len(LETTERS)))


def spaceless(spark, d, name="documents"):
    """A table whose texts are written with SIGNS, the spaces between words left out."""
    text = F.regexp_replace(F.translate(F.lower(F.coalesce("text", F.lit(""))), LETTERS, SIGNS), "[ \t\r\n]", "")
    return read(spark, d, name).withColumn("text", text)


RUNS = f"""r as (select unnest(regexp_extract_all(regexp_replace(translate(lower(coalesce(text, '')), '{LETTERS}', '{SIGNS}'), '[ \\t\\r\\n]', '', 'g'), '[\\x{{4E00}}-\\x{{9FFF}}]+')) as r from documents),
h as (select h, count(*) as c from (select substr(r, i, 5) as h from r, unnest(range(1, length(r) + 1)) as t(i)) group by h),
g as (select gram, sum(c)::bigint as c from (select substr(h, 1, k) as gram, c from h, unnest(range(1, length(h) + 1)) as t(k)) group by gram),
w as (select gram as word, c from g where length(gram) between 2 and 4 and c >= 5),
j as (select w.word, min(ln(w.c / (a.c::double * b.c / (select sum(c) from g where length(gram) = 1)))) as cohesion from w, unnest(range(1, length(word))) as t(k), g a, g b
  where a.gram = substr(word, 1, k) and b.gram = substr(word, k + 1) group by w.word),
rt as (select substr(gram, 1, length(gram) - 1) as word, sum(c * ln(c)) as s from g where length(gram) >= 3 group by 1),
lt as (select substr(gram, 2) as word, sum(c * ln(c)) as s from g where length(gram) >= 3 group by 1),
m as (select word, w.c, round(cohesion, 6) as cohesion, round(ln(w.c) - coalesce(lt.s, 0) / w.c, 6) as "left", round(ln(w.c) - coalesce(rt.s, 0) / w.c, 6) as "right" from w join j using (word) left join lt using (word) left join rt using (word))"""


@query(f"with {RUNS} select gram, c from g")
def cjk_grams(spark, d):
    return segmentation.grams(spaceless(spark, d))


@query(f'with {RUNS} select word, c, cohesion, "left", "right" from m where cohesion >= 1.0')
def cjk_measures(spark, d):
    return segmentation.measured(staged(segmentation.grams(spaceless(spark, d)))).filter("cohesion >= 1.0")


@query()
def cjk_words(spark, d):
    """Words of each document by the best path over the lexicon of all of them."""
    docs = spaceless(spark, d)
    cut = segmentation.cutter(segmentation.learnt(docs, staged))
    words = cut(segmentation.runs(F.col("text")))
    return docs.select("doc_id", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(words, " ")).alias("words_md5"))


@query()
def cjk_bm25(spark, d):
    """Benchmark questions against all documents by words and two-character grams."""
    docs = spaceless(spark, d).withColumn("library_id", F.lit("all"))
    cut = segmentation.Tokens(segmentation.learnt(docs, staged))
    return lexical.bm25(spaceless(spark, d, "benchmark"), docs, 10, cut=cut).select("query_id", "id", "score", "rank")


def _index(spark, d, metric):
    index = vector_index.VectorIndex(spark, f"{shared_root(spark)}/index-{uuid.uuid4().hex}")
    index.build(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), metric)
    return index


EXACT = "v as (select vec_id as id, embedding::double[] as v from embeddings)"
ALL_PAIRS = f"""with {EXACT}, s as (select a.id as query_id, b.id, round(list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 1e-12), 6) as score from v a, v b where a.id <> b.id),
k as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= 4)
select distinct least(query_id, id) as source, greatest(query_id, id) as target, score as similarity from k where score >= 0.3"""


@query(ALL_PAIRS)
def indexed_semantic_edges(spark, d):
    """Every row asks the index; with all cells probed the edges are those of all pairs."""
    index = _index(spark, d, "cosine")
    return vector_index.semantic_edges(index, 0.3, 4, probes=index.about()["cells"])


@query(f"""with {EXACT}, s as (select a.id as query_id, b.id, round(1 / (1 + greatest(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 0)), 6) as score from v a, v b where a.id % 50 = 0)
select query_id, id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 10""")
def indexed_nearest(spark, d):
    """Rows of ids divisible by 50 against all rows of the index, all cells probed."""
    index = _index(spark, d, "l2")
    q = read(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return index.search(q, 10, probes=index.about()["cells"])


@query()
def indexed_recall(spark, d):
    """Share of the ten nearest rows that the measured number of probes finds, for all rows; the share of rows that a query reads."""
    index = _index(spark, d, "cosine")
    about = index.about()
    whole, some = (index.neighbours(10, p).select("query_id", "id") for p in (about["cells"], None))
    found = whole.join(some.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return found.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"), F.lit(about["probes"]).alias("probes"), F.lit(about["cells"]).alias("cells"))


def _written(store, docs, marks):
    """A segment of the postings of docs that hides older rows of the files in marks."""
    name = store.new()
    words = staged(docs.select(*KEY, F.col("doc_id").alias("id"), X.tokens(F.coalesce("text", F.lit(""))).alias("ts")).withColumn("dl", F.size("ts")))
    store.write(name, "lengths", words.select(*KEY, "id", "dl"))
    post = words.select(*KEY, "id", "dl", F.explode("ts").alias("term")).groupBy(*KEY, "term", "id", "dl").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", bucket())
    store.write(name, "postings", post.select(*KEY, "term", "id", "tf", "dl", "bucket").repartition("bucket").sortWithinPartitions("bucket", "term", "id"), "bucket")
    store.write(name, "gone", marks.select(*KEY, F.lit(False).alias("record")))
    return {"name": name, "gone": marks.count(), "rows": words.count()}


@query(f"with {BM25} select query_id, library_id, id, score, rank::int as rank from (select *, row_number() over (partition by query_id, library_id order by score desc, id) as rank from sc) where rank <= 10")
def stored_bm25(spark, d):
    """BM25 over stored segments (see stored)."""
    return stored(spark, d).search(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


def stored(spark, d) -> search.Stored:
    """Segments of postings: all documents, half of them with words that aren't theirs; then those made anew; then merged or not, as sizes say."""
    schemas = {k: TABLES[k].replace("id string, tf", "id long, tf").replace("id string, dl", "id long, dl") for k in ("lengths", "postings")}
    store = Segments(spark, f"{shared_root(spark)}/segments-{uuid.uuid4().hex}", schemas)
    docs = files(spark, d)
    later = docs.filter("doc_id % 2 = 0")
    first = _written(store, docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("before "), F.reverse("text"))).otherwise(F.col("text"))), later.limit(0))
    listed = store.merged([first, _written(store, later, later)], {"postings": "bucket"}, set())
    n = store.read("lengths", listed).groupBy("library_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return search.Stored(store.read("postings", listed), staged(n), bucket)
