"""Jaccard self-join of documents on their word n-grams, with prefixes of token combinations.

A token is a shingle. Tokens are ordered from rare to frequent by counts over all documents, held in a table of fixed
size. A set must share a signature with any set similar enough to it if its prefix, taken in that order, is so long
that even with all the misses it may have, one signature stays whole: each rare token counts 1 (its signature is the
token alone); frequent tokens are dealt into classes, and a class of m tokens counts m - 1 (its signatures are its
pairs). Every signature also names a band of sizes, that of the smaller set of the pair it is to find.

Equal sets are one set from the start. Sets that share a signature are checked as a star around one of them, which
links most; what a star leaves in different components is checked against the rest, unless the sizes, the places of the
signature in both orders or the triangle inequality of the Jaccard distance rule a link out. So links are complete without all pairs of a group.

Defined results: null text and text without words give an empty set, linked with nothing, its own component. A null id
stays a row (of its own component if its set is empty; as the least id never, unless all ids of a component are null).
The same id on several rows is one document for components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import hashing as H
from .common import fits_broadcast, lean, looked_up, parts, staged, swept, table
from .components import components
from .repeats import repeated

#: log2 of the counters for token frequencies; of the rows they are sent in.
SKETCH, CHUNKS = 21, 5
#: Rounds in which a few members of each group meet the rest; what is then left is checked at once, whatever its size.
ROUNDS = 6


def token_sets(batch: pa.RecordBatch, width: int):
    """(row, sorted distinct token hashes) of each document of a batch."""
    data, offsets = H.utf8(batch.column("text"))
    for a, b in H.groups(offsets):
        lo, hi = offsets[a], offsets[b]
        h, _, _, first = H.words(data[lo:hi], offsets[a : b + 1] - lo, lower=True)
        s = H.WORDS.prefix(h)
        for d in range(a, b):
            f, n = int(first[d - a]), int(first[d - a + 1] - first[d - a])
            w = min(width, n)
            yield d, np.unique(H.windows(h, np.arange(f, f + n - w + 1), w, prefix=s)) if n else np.zeros(0, np.uint64)


def fingerprint(tokens: np.ndarray) -> np.int64:
    return H.mix(H.mix(tokens, 11).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)), 12).view(np.int64)[0]


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (H.mix(tokens, 21) >> np.uint64(64 - SKETCH)).astype(np.int64)


def _profile(width: int, id_type: pa.DataType):
    """A row (id, th, n, set) for each document, and a task's token counts in rows (chunk, counts)."""

    def run(batches):
        counts, held, n_held, any_rows = np.zeros(1 << SKETCH, np.uint32), [], 0, False
        for batch in batches:
            any_rows, ns, fs = True, [], []
            for _, t in token_sets(batch, width):
                ns.append(len(t))
                fs.append(fingerprint(t))
                held.append(t)
                n_held += len(t)
                if n_held > 1 << 18:
                    counts += np.bincount(_bucket(np.concatenate(held)), minlength=len(counts)).astype(np.uint32)
                    held, n_held = [], 0
            k = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(ns, pa.int64()), pa.array(np.array(fs, np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["id", "th", "n", "set", "chunk", "counts"])
        if held:
            counts += np.bincount(_bucket(np.concatenate(held)), minlength=len(counts)).astype(np.uint32)
        if any_rows:
            k = 1 << CHUNKS
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([c.astype(np.uint64).tobytes() for c in np.split(counts, k)], pa.binary())], names=["id", "th", "n", "set", "chunk", "counts"])

    return run


def _sum_counts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b.column("chunk").to_pylist(), b.column("counts"), strict=True):
            v = np.frombuffer(x.as_buffer(), np.uint64)
            total[c] = total[c] + v if c in total else v
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"])


def _token_counts(profile: DataFrame) -> tuple[np.ndarray, float]:
    """The counters over all documents, up to what 32 bits hold: 2**SKETCH numbers, whatever the size of the corpus; and their mean."""
    rows = profile.filter("chunk is not null").select("chunk", "counts")
    rows = rows.mapInArrow(lean(_sum_counts), "chunk int, counts binary").repartition(1 << CHUNKS, "chunk").mapInArrow(lean(_sum_counts), "chunk int, counts binary")
    out, total = np.zeros((1 << CHUNKS, 1 << (SKETCH - CHUNKS)), np.uint32), 0
    for r in rows.collect():
        c = np.frombuffer(r.counts, np.uint64)
        total += int(c.sum())
        out[r.chunk] = np.minimum(c, np.iinfo(np.uint32).max)
    swept(profile.sparkSession)
    return out.ravel(), total / out.size


def signatures(tokens: np.ndarray, count: np.ndarray, frequent: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, reach) of a set: two sets with a Jaccard similarity of percent/100 or more have one in common, unless they are equal.

    reach bounds their overlap if the signature is the first they share: the tokens from there on, and for a pair of
    frequent tokens one for each other class, whose only shared token may come before.
    """
    n = len(tokens)
    least = (percent * n + 99) // 100
    need = n - least + 1
    order = np.lexsort((tokens, count))
    tokens, rare = tokens[order], count[order] < frequent
    single, many = tokens[rare][:need], tokens[~rare]
    out, reach, rest = [], [], need - len(single)
    for band in {n.bit_length() - 1, max(least, 1).bit_length() - 1}:
        out.append(H.mix(single, 100 + band))
        reach.append(n - np.arange(len(single)))
        if rest <= 0:
            continue
        classes = max(1, (1 << band) // 256)
        of = (H.mix(many, 31) % np.uint64(classes)).astype(np.int64)
        new = np.zeros(len(many), np.int64)
        new[np.unique(of, return_index=True)[1]] = 1
        end = int(np.searchsorted(np.cumsum(1 - new), rest)) + 1
        many_, of = many[:end], of[:end]
        for g in np.unique(of):
            at = np.flatnonzero(of == g)
            i, j = np.triu_indices(len(at), 1)
            x, y = many_[at[i]], many_[at[j]]
            out.append(H.mix(H.mix(x, 41) ^ H.mix(y, 41), 200 + band))
            reach.append(n - len(tokens[rare]) - at[i] + classes - 1)
    return np.concatenate(out), np.concatenate(reach)


def _signed(width: int, percent: int, counts, frequent: int):
    def rows(batch):
        table_ = counts.value
        for _, t in token_sets(batch, width):
            if len(t) > 1:
                s, reach = signatures(t, table_[_bucket(t)], frequent, percent)
                yield s.view(np.int64), np.full(len(s), fingerprint(t)), (np.int64(len(t)) << 32) + reach

    return rows


def _sets(width: int):
    def run(batches):
        for batch in batches:
            fs, ts = [], []
            for _, t in token_sets(batch, width):
                fs.append(fingerprint(t))
                ts.append(t.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(fs, np.int64)), pa.array(ts, pa.binary())], names=["set", "tokens"])

    return run


def _overlaps(batches):
    for b in batches:
        inter, size = [], []
        for x, y in zip(b.column("ta"), b.column("tb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            k = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            inter.append(k)
            size.append(len(x) + len(y) - k)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(inter, pa.int64()), pa.array(size, pa.int64())], names=["a", "b", "inter", "size"])


class Join:
    """Links between the distinct sets of a table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.percent, self.width, self.n_parts = percent, width, parts(docs, 4)
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        id_type = dict(self.docs.dtypes)["id"]
        arrow_id = to_arrow_type(self.docs.schema["id"].dataType)
        hashed = self.docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
        both = staged(hashed.mapInArrow(lean(_profile(width, arrow_id)), f"id {id_type}, th long, n long, set long, chunk int, counts binary"))
        counts, mean = _token_counts(both)
        self.profile = both.filter("chunk is null").select("id", "th", "n", "set")
        # frequent: clearly above what chance gives a counter, and in one of 200 documents
        frequent = int(max(4 * mean + 64, self.profile.count() / 200))
        sent = docs.sparkSession.sparkContext.broadcast(counts)
        self.members = staged(repeated(self.docs.select("text"), _signed(width, percent, sent, frequent), self.n_parts).select("key", "id", F.shiftright("pos", 32).alias("n"), F.col("pos").bitwiseAND(F.lit((1 << 32) - 1)).alias("e")).groupBy("key", "id", "n").agg(F.max("e").alias("e")))
        self.sets = self._candidate_sets()

    def _candidate_sets(self) -> DataFrame:
        """Tokens of the sets that share a signature with another: of one document of each."""
        wanted = self.members.select(F.col("id").alias("set")).distinct()
        ids = staged(self.profile.filter("id is not null").groupBy("set").agg(F.min("id").alias("id")).join(wanted, "set").select("id"))
        small = fits_broadcast(ids, 64)
        docs = self.docs.join(F.broadcast(ids) if small else ids, "id", "left_semi").select("text")
        unnamed = self.docs.filter("id is null").select("text")
        return staged(docs.unionByName(unnamed).mapInArrow(lean(_sets(self.width)), "set long, tokens binary"))

    def close(self, size_a: str, size_b: str):
        return (F.least(size_a, size_b) * 100) >= F.greatest(size_a, size_b) * self.percent

    def checked(self, pairs: DataFrame) -> DataFrame:
        """(a, b) -> (a, b, inter, size) by exact intersection."""
        pairs, t = staged(pairs), self.sets
        # only the sets that are asked for go through the shuffle
        for name in ("b", "a"):
            ids = staged(pairs.select(F.col(name).alias("set")).distinct())
            some = t.join(_spread(ids, "set"), "set", "left_semi").select(F.col("set").alias(name), F.col("tokens").alias(f"t{name}"))
            pairs = pairs.join(some, name)
        x = pairs.select("a", "b", "ta", "tb")
        return staged(x.mapInArrow(lean(_overlaps), "a long, b long, inter long, size long").distinct())

    def linked(self, x: DataFrame) -> DataFrame:
        return x.filter(F.col("inter") * 100 >= F.col("size") * self.percent)

    def groups(self) -> DataFrame:
        """(key, id, n, e, o, c) of one signature for each distinct group; o orders sets by how much they share, c has the most in its group."""
        m = self.members
        size = m.groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(5), "id")).alias("x"))
        # groups of the same members say the same
        size = size.filter("w > 1")
        one = size.groupBy("w", "h", "x").agg(F.min("key").alias("one"), F.count(F.lit(1)).alias("same"))
        # groups of the same members say the same
        size = staged(size.join(_spread(staged(one), "one"), ["w", "h", "x"]).select("key", "one", (F.col("w") * F.col("same")).alias("w")))
        m = m.join(_spread(size, "key"), "key").groupBy(F.col("one").alias("key"), "id", "n", "w").agg(F.max("e").alias("e"))
        m = staged(m)
        weight = m.groupBy("id").agg(F.sum("w").alias("w"))
        weight = staged(weight.select("id", F.shiftleft("w", 20).bitwiseOR(F.xxhash64("id").bitwiseAND(F.lit((1 << 20) - 1))).alias("o")))
        rows = staged(m.drop("w").join(_spread(weight, "id"), "id"))
        return rows.join(_spread(staged(rows.groupBy("key").agg(F.max_by("id", "o").alias("c"))), "key"), "key")

    def labels(self) -> DataFrame:
        """(node, label) of the sets that are linked with another.

        In each round a few members of every group meet all of it that lies in other components, and leave it. First
        that is the centre, which links most. A group is done when what is left of it is one component. As soon as the
        pairs that are left are in proportion to the rows of all groups, those that may be links are checked at once.
        """
        rows = staged(self.groups().withColumn("d", F.lit(None).cast("double")))
        bound, labels = 100 * self.members.count(), None
        for k in range(ROUNDS):
            swept(self.docs.sparkSession)
            if labels is None:
                at = rows.withColumn("label", F.col("id")).withColumn("lc", F.col("c"))
                orders = [F.col("o")]
            else:
                names = _spread(labels, "node")
                at = rows.join(names.select(F.col("node").alias("id"), "label"), "id", "left").join(names.select(F.col("node").alias("c"), F.col("label").alias("lc")), "c", "left")
                at = staged(at.withColumn("label", F.coalesce("label", "id")).withColumn("lc", F.coalesce("lc", "c")))
                orders = [F.col("o"), *(F.xxhash64(F.lit(100 * k + j), "id") for j in range(4 if k == 1 else 8))]
            groups = at.groupBy("key").agg(F.array_distinct(F.array(*(F.max_by("id", o) for o in orders))).alias("fs"), F.count_if(F.col("label") != F.col("lc")).alias("apart"), F.count(F.lit(1)).alias("all"), F.min("label").alias("x"), F.max("label").alias("y"))
            groups = staged(groups.filter("x <> y"))
            work = groups.agg(F.sum(F.col("apart").cast("double") * F.col("all"))).first()[0]
            if work is None:
                break  # every group is one component
            last = k > 0 and (work <= bound or k == ROUNDS - 1)
            at = at.join(_spread(groups.select("key", "fs"), "key"), "key")
            f = at.filter("label <> lc" if last else "array_contains(fs, id)").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("d").alias("da"), F.col("e").alias("ea"))
            most = F.least("e", "ea")
            pairs = at.join(f, "key").filter("label <> la").filter(self.close("n", "na")).filter(most * 100 >= (F.col("n") + F.col("na") - most) * self.percent)
            pairs = pairs.filter((F.col("a") < F.col("id")) | (F.col("label") == F.col("lc") if last else ~F.array_contains("fs", F.col("id"))))
            reach = 1 - self.percent / 100 + 1e-9
            pairs = pairs.filter(F.coalesce(F.abs(F.col("d") - F.col("da")) <= reach, F.lit(True)))
            got = self.checked(pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct())
            labels = components(self.linked(got), labels)
            if last:
                break
            rows = at.filter(~F.array_contains("fs", F.col("id"))).drop("label", "lc", "fs")
            if k == 0:  # distances from the centres, for the triangle inequality
                far = F.lit(1.0) - F.col("inter") / F.col("size")
                d = got.select(F.col("a").alias("c"), F.col("b").alias("id"), far.alias("e")).unionByName(got.select(F.col("b").alias("c"), F.col("a").alias("id"), far.alias("e")))
                rows = rows.drop("d").join(d.withColumnRenamed("e", "d"), ["c", "id"], "left")
            rows = staged(rows)
        return labels if labels is not None else self.profile.limit(0).selectExpr("set as node", "set as label")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """df, marked for broadcast if it is small."""
    return F.broadcast(df) if fits_broadcast(df.select(key), 64) else df


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Per row of docs: id, th (hash of the text), n (size of its set), label (the same for all rows of a component; null if the set is empty)."""
    j = Join(docs, id_col, text_col, width, percent)
    labels = j.labels()
    # equal sets may be very many: how many rows each has decides how it is looked up
    names = staged(labels.withColumnRenamed("node", "set").join(j.profile.groupBy("set").agg(F.count(F.lit(1)).alias("c")), "set"))
    p = looked_up(j.profile, names, ["set"], j.n_parts, "left")
    return staged(p.select("id", "th", "n", F.when(F.col("n") > 0, F.coalesce("label", "set")).alias("label")))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id."""
    p = classes(docs, id_col, text_col, width, percent)
    some = p.filter("label is not null")
    least = staged(some.groupBy("label").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("c")))
    out = looked_up(some, least, ["label"], parts(docs)).select("id", "n", "component_id")
    out = out.unionByName(p.filter("label is null").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each component the row of the least id stays (null ids last, then by the text's hash), once."""
    p = classes(docs, id_col, text_col, width, percent).filter("label is not null")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    best = staged(p.groupBy("label").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("c")).filter("c > 1"))
    p = looked_up(p, best, ["label"], parts(docs))
    gone = staged(p.filter(rank != F.col("best")).select("id", "th").distinct())
    again = staged(p.filter(rank == F.col("best")).groupBy("id", "th").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    d = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))

    def among(rows: DataFrame):
        rows = rows.select(F.col("id").alias("__id"), F.col("th").alias("__h"))
        return (F.broadcast(rows) if fits_broadcast(rows, 64) else rows), F.equal_null(F.col(id_col), F.col("__id")) & (F.col("__th") == F.col("__h"))

    d = d.join(*among(gone), "left_anti")
    if not again.isEmpty():  # equal rows: one of them
        same = d.join(*among(again), "left_semi")
        one = same.groupBy(F.col(id_col).alias("__k"), "__th").agg(F.min(F.struct(*docs.columns)).alias("s")).select("s.*")
        return d.join(*among(again), "left_anti").drop("__th").unionByName(one)
    return d.drop("__th")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) end as sh from w),
n as (select doc_id, len(sh)::bigint as n_shingles from s),
sets as (select min(doc_id) as rep, hash_ as k from (select doc_id, md5(array_to_string(list_sort(sh), '|')) as hash_ from s where len(sh) > 0) group by hash_),
member as (select s.doc_id, sets.rep from s join sets on sets.k = md5(array_to_string(list_sort(sh), '|')) where len(sh) > 0),
tok as (select s.doc_id, unnest(sh) as t from s where doc_id in (select rep from sets)),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as c from tok a join tok b on a.t = b.t and a.doc_id < b.doc_id group by all),
link as (select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
sym as (select a, b from link union all select b, a from link),
reach as (select rep as node, rep as root from sets union select sym.b, reach.root from reach join sym on sym.a = reach.node),
comp as (select node, min(root) as component_id from reach group by node)
select n.doc_id, n.n_shingles, coalesce(comp.component_id, n.doc_id) as component_id
from n left join member on member.doc_id = n.doc_id left join comp on comp.node = member.rep
"""
