"""Postings, BM25 and rank fusion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..conf import CONF
from ..functions.text import tokens
from ..storage import staged


#: A function from a text to its tokens.
Tokenise = Callable[[Column], Column]


def postings(docs: DataFrame, library: str = "library_id", ident: str = "doc_id", text: str = "text", cut: Tokenise = tokens) -> DataFrame:
    """(library_id, id, term, tf, dl): one row for each term of each document."""
    t = docs.select(F.col(library).alias("library_id"), F.col(ident).alias("id"), cut(F.coalesce(text, F.lit(""))).alias("ts"))
    return t.select("library_id", "id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("library_id", "id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def library_stats(docs: DataFrame, cut: Tokenise = tokens) -> DataFrame:
    """(library_id, n_docs, avgdl); documents without tokens count."""
    t = docs.select("library_id", F.size(cut(F.coalesce("text", F.lit("")))).alias("dl"))
    return t.groupBy("library_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, ident: str = "item_id", text: str = "text", cut: Tokenise = tokens) -> DataFrame:
    """(query_id, term, qtf): a term that is repeated in the query scores as often."""
    return queries.select(F.col(ident).alias("query_id"), F.explode(cut(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


#: Rows (query, term) of a batch of queries, and rows (library, term, df), that are sent to every task; with more, postings are joined by shuffles.
TERMS, FREQUENCIES = 200_000, 2_000_000
#: Products of postings and query terms that a task works out at once; rows it holds before it gives them on.
PRODUCTS, HELD = 1 << 20, 1 << 20


def bm25(queries: DataFrame, docs: DataFrame, top_k: int, cut: Tokenise = tokens) -> DataFrame:
    """(query_id, library_id, id, score, rank): the top_k of each query in each library, ties by id."""
    q = query_terms(queries, cut=cut)
    text = F.coalesce("text", F.lit(""))
    t = docs.select("library_id", F.col("doc_id").alias("id"), cut(text).alias("ts"))
    if (asked := Asked.of(q)) is not None:
        if getattr(cut, "sent", None) is not None:
            c = asked.counted(docs.select("library_id", F.col("doc_id").alias("id"), cut.latin(text).alias("ts"), text.alias("text")), cut.further(asked.terms.to_pylist()))
        else:
            c = asked.counted(t)
        if (found := asked.best(c, top_k)) is not None:
            return found
    terms = q.select("term").distinct()
    small = terms.limit(TERMS + 1).count() <= TERMS
    sent = F.broadcast if small else lambda d: d
    # only the queries' terms get as far as the first shuffle
    each = t.select("library_id", "id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(sent(terms), "term", "left_semi")
    p = each.groupBy("library_id", "id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return ranked(q, p, library_stats(docs, cut), top_k, sent)


def most_terms(queries: DataFrame, docs: DataFrame, top_k: int, cut: Tokenise = tokens) -> DataFrame:
    """(query_id, id, n, rank): the top_k documents that have the most of a query's terms, ties by id. docs (library_id, doc_id, text) of one library."""
    q = query_terms(queries, cut=cut)
    t = docs.select("library_id", F.col("doc_id").alias("id"), cut(F.coalesce("text", F.lit(""))).alias("ts"))
    if (asked := Asked.of(q)) is not None and (found := asked.best(asked.counted(t), top_k, counts=True)) is not None:
        return found.select("query_id", "id", F.col("score").cast("long").alias("n"), "rank")
    n = postings(docs, cut=cut).join(q, "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return top(n, ["query_id"], [F.desc("n"), F.asc("id")], top_k)


def _matched(sent, further=None):
    """(library_id, id, ts) -> (library_id, id, dl, terms, tfs): numbers of the queries' terms that a document has, and how often. further: finds those tokens of a column text that ts hasn't."""

    def run(batches):
        for b in batches:
            ts = b.column("ts")
            flat, n = ts.flatten(), pc.list_value_length(ts).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.index_in(flat, value_set=pa.array(sent.value, flat.type))
            on = at.is_valid().to_numpy(zero_copy_only=False)
            row, at = np.repeat(np.arange(len(n)), n)[on], at.drop_null().to_numpy()
            if further is not None:
                rows, ats, more = further(b.column("text"))
                row, at, n = np.concatenate((row, rows)), np.concatenate((at, ats)), n + more
            key = row * len(sent.value) + at
            key, tf = np.unique(key, return_counts=True)
            lists = np.searchsorted(key, np.arange(len(n) + 1) * len(sent.value)).astype(np.int32)
            terms, tfs = (pa.ListArray.from_arrays(pa.array(lists), pa.array(x.astype(np.int32))) for x in (key % max(1, len(sent.value)), tf))
            yield pa.RecordBatch.from_arrays([b.column("library_id"), b.column("id"), pa.array(n.astype(np.int32)), terms, tfs], names=["library_id", "id", "dl", "terms", "tfs"])

    return run


class _Best:
    """The k best rows of each query in one library so far: those that reach a query's k-th score are held until there are enough to sort."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.rows, self.n = k, np.full(n, -np.inf), [], 0

    def put(self, q: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.rows.append((q, score, ids))
        self.n += len(q)
        if self.n > 2 * self.k * len(self.least):
            self.sorted()

    def sorted(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        q, score, ids = (f([r[i] for r in self.rows]) for i, f in enumerate((np.concatenate, np.concatenate, pa.concat_arrays)))
        o = pc.sort_indices(pa.table({"q": q, "s": -score, "id": ids}), sort_keys=[("q", "ascending"), ("s", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        q = q[o]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < self.k
        o, q = o[keep], q[keep]
        score = score[o]
        full = nth[keep] == self.k - 1
        self.least[q[full]] = score[full]
        self.rows, self.n = [(q, score, ids.take(pa.array(o)))], len(q)
        return self.rows[0]


def _scored(sent, k: int):
    """(library_id, id, dl, terms, tfs) -> a task's k best for each query and library: what a term adds is worked out once for a document and added up for the queries that have it."""

    def run(batches):
        qid, start, asks, weight, libraries = sent.value
        best: dict = {}

        def given():
            for name, x in best.items():
                q, score, ids = x.sorted()
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(q)), pa.array([name] * len(q), kind), ids, pa.array(score)], names=["query_id", "library_id", "id", "score"])
            best.clear()

        kind = None
        for b in batches:
            kind, names = b.column("library_id").type, np.array(b.column("library_id").to_pylist(), object)
            for name in dict.fromkeys(x for x in names.tolist() if x is not None):
                some = b.take(pa.array(np.flatnonzero(names == name)))
                if name not in libraries:
                    continue
                idf, mean = libraries[name]
                size = pc.list_value_length(some.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
                term, tf = (some.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
                doc = np.repeat(np.arange(len(size)), size)
                if mean is None:
                    s = np.ones(len(term))
                else:
                    s = idf[term] * tf * (CONF.k1 + 1) / (tf + CONF.k1 * (1 - CONF.b + CONF.b * some.column("dl").to_numpy()[doc] / mean))
                n = start[term + 1] - start[term]
                upto, ends = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(size)))
                a = 0
                while a < len(size):
                    z = max(a + 1, int(np.searchsorted(upto[ends], upto[ends[a]] + PRODUCTS, "right")) - 1)
                    z = min(z, a + max(1, 2 * PRODUCTS // len(qid)), len(size))
                    lo, hi = ends[a], ends[z]
                    of = np.repeat(start[term[lo:hi]] - upto[lo:hi], n[lo:hi]) + np.arange(upto[lo], upto[hi])
                    key = asks[of] * (z - a) + np.repeat(doc[lo:hi] - a, n[lo:hi])
                    total = np.bincount(key, np.repeat(s[lo:hi], n[lo:hi]) * (1.0 if mean is None else weight[of]), len(qid) * (z - a)).reshape(len(qid), z - a)
                    score = np.floor(total * 1e6 + 0.5) / 1e6
                    x = best.setdefault(name, _Best(len(qid), k))
                    q, at = np.nonzero((total > 0) & (score >= x.least[:, None]))
                    if len(q):
                        x.put(q, score[q, at], some.column("id").take(pa.array(at + a)))
                    elif not x.rows:
                        del best[name]
                    a = z
                if sum(x.n + len(x.least) for x in best.values()) > HELD:
                    yield from given()
        yield from given()

    return run


class Asked:
    """Terms of a batch of queries as every task holds them: by number, with the queries that have each."""

    def __init__(self, rows: pa.Table, kind: str):
        self.kind = kind
        self.terms = pc.unique(rows["term"].combine_chunks()).sort()
        self.qid = pc.unique(rows["query_id"].combine_chunks())
        term, query = pc.index_in(rows["term"], value_set=self.terms).to_numpy(), pc.index_in(rows["query_id"], value_set=self.qid).to_numpy()
        o = np.argsort(term, kind="stable")
        self.start = np.searchsorted(term[o], np.arange(len(self.terms) + 1))
        self.asks, self.weight = query[o].astype(np.int64), rows["qtf"].to_numpy()[o].astype(np.float64)

    @classmethod
    def of(cls, q: DataFrame) -> Asked | None:
        """q (query_id, term, qtf); None if they are too many to be sent to every task, or none at all."""
        q = q.select("query_id", "term", "qtf").limit(TERMS + 1)
        rows = q.toArrow()
        return cls(rows, dict(q.dtypes)["query_id"]) if 0 < len(rows) <= TERMS else None

    def counted(self, t: DataFrame, further=None) -> DataFrame:
        """(library_id, id, ts) -> (library_id, id, dl, terms, tfs), staged: texts are read and cut once. further: as in _matched."""
        sent = t.sparkSession.sparkContext.broadcast(self.terms.to_pylist())
        kinds = dict(t.dtypes)
        return staged(t.mapInArrow(_matched(sent, further), f"library_id {kinds['library_id']}, id {kinds['id']}, dl int, terms array<int>, tfs array<int>"))

    def gathered(self, postings: DataFrame, bucket: Callable[[str], Column]) -> DataFrame:
        """postings (library_id, term, id, tf, dl, bucket) -> as counted(), staged: only the folders of the queries' terms are read. Documents without any aren't there."""
        spark = postings.sparkSession
        terms = spark.createDataFrame(list(enumerate(self.terms.to_pylist())), "n int, term string")
        buckets = [r[0] for r in terms.select(bucket("term")).distinct().collect()]
        p = postings.filter(F.col("bucket").isin(buckets)).join(F.broadcast(terms), "term").select("library_id", "id", "dl", F.struct("n", F.col("tf").cast("int").alias("tf")).alias("x"))
        g = p.groupBy("library_id", "id", "dl").agg(F.collect_list("x").alias("x"))
        return staged(g.select("library_id", "id", F.col("dl").cast("int").alias("dl"), F.transform("x", lambda x: x["n"]).alias("terms"), F.transform("x", lambda x: x["tf"]).alias("tfs")))

    def best(self, c: DataFrame, top_k: int, stats: DataFrame | None = None, counts: bool = False) -> DataFrame | None:
        """c as counted() gives it -> (query_id, library_id, id, score, rank), or None where a document comes twice or frequencies are too many: their terms have to be put together by shuffles.

        stats (library_id, n_docs, avgdl), if c hasn't all documents. counts: the score is the number of terms that a document has. A task gives top_k rows a query and library, however many documents it has."""
        one = c.groupBy("library_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not one.isEmpty():
            return None
        df = c.select("library_id", F.explode("terms").alias("term")).groupBy("library_id", "term").agg(F.count(F.lit(1)).alias("df")).limit(FREQUENCIES + 1).toArrow()
        if len(df) > FREQUENCIES:
            return None
        if stats is None:
            stats = c.groupBy("library_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
        libraries = {}
        names, term, n = np.array(df["library_id"].to_pylist(), object), df["term"].to_numpy(), df["df"].to_numpy()
        for r in stats.collect():
            on = names == r.library_id
            idf = np.zeros(len(self.terms))
            idf[term[on]] = np.log(1 + (r.n_docs - n[on] + 0.5) / (n[on] + 0.5))
            libraries[r.library_id] = (idf, None if counts else r.avgdl)
        sent = c.sparkSession.sparkContext.broadcast((self.qid, self.start, self.asks, self.weight, libraries))
        kinds = dict(c.dtypes)
        near = c.filter("size(terms) > 0").mapInArrow(_scored(sent, top_k), f"query_id {self.kind}, library_id {kinds['library_id']}, id {kinds['id']}, score double")
        return top(near, ["query_id", "library_id"], [F.desc("score"), F.asc("id")], top_k)


def ranked(q: DataFrame, p: DataFrame, s: DataFrame, top_k: int, sent=lambda d: d) -> DataFrame:
    """bm25 of query terms q over postings p (all those of the queries' terms) and library statistics s."""
    df = p.groupBy("library_id", "term").agg(F.count(F.lit(1)).alias("df"))
    hit = p.join(df, ["library_id", "term"]).join(F.broadcast(s), "library_id")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - CONF.b + CONF.b * F.col("dl") / F.col("avgdl")
    # what a posting adds for each time that a query has the term
    part = hit.select("library_id", "id", "term", (idf * F.col("tf") * (CONF.k1 + 1) / (F.col("tf") + CONF.k1 * norm)).alias("s"))
    scored = part.join(sent(q), "term").groupBy("query_id", "library_id", "id").agg(F.round(F.sum(F.col("qtf") * F.col("s")), 6).alias("score"))
    return top(scored, ["query_id", "library_id"], [F.desc("score"), F.asc("id")], top_k)


def top(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def fuse(lists: list[DataFrame], keys: list[str], weights: list[float] | None = None, k: int = CONF.rrf_k) -> DataFrame:
    """rrf of lists with a weight for each, or of equal weight."""
    if weights is not None and len(weights) != len(lists):
        raise ValueError(f"{len(lists)} lists, {len(weights)} weights")
    return rrf(list(zip(lists, weights or [1.0] * len(lists), strict=True)), keys, k)


def rrf(ranked: list[tuple[DataFrame, float]], keys: list[str], k: int = CONF.rrf_k) -> DataFrame:
    """keys and the sum of weight / (k + rank) over ranked lists, each with keys and rank."""
    if not ranked:
        raise ValueError("no ranked list")
    parts = [d.select(*keys, (F.lit(float(w)) / (k + F.col("rank"))).alias("s")) for d, w in ranked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.round(F.sum("s"), 9).alias("score"))
