"""Hard negatives by dual-tree search.

Rows are indexed by label and by the cell of a tree over a bounded sample, so that rows near each other lie in one file; every row is in it.
Anchors go in rounds of bounded bytes. A task reads blocks of the index, builds a ball tree over each and goes down this tree and the anchors' tree at
once: the centres and radii of two nodes bound all their inner products, and a pair of nodes goes no further if the interval holds nothing that any of
its anchors still needs. Pairs of leaves that are left are scored exactly, the most promising first, and what has been found raises the anchors' floors.
A first pass over the sample gives floors that hold for the whole table; they only spare work. There are two searches: for each anchor the best rows of its label,
then for each of those (a positive) the best rows of other labels whose scores lie in the positive's window.

Scores are integers: products are made in doubles while they are exact, else in 64-bit integers.

Defined results: rows with a null label or vector, or with a null, NaN or infinite component, take no part; a shorter vector counts as filled up with zeros;
the same row twice is two rows (the one is a positive of the other), equal scores and ids are told apart by nothing that shows; a null id can be found but is no anchor, and comes after other ids.
Windows of negative positives' scores are empty if the lower end is above the upper one. An anchor without positives, or a positive without negatives, gives no rows; so does an empty table.
Scores that don't fit a 64-bit integer are an error. Extra columns go.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, lean, parts, staged, table

#: Rows of the sample that cells and first floors come from; rows of a block; bytes of anchors in a round; rows of leaves of the anchors' and of a block's tree.
SAMPLE, BLOCK, ROUND, LEAVES = 4096, 8192, 16 << 20, (64, 128)
LEAST, MOST = -(1 << 62), 1 << 62


class Tree:
    """Ball tree: halves along the line between two far points, down to `leaf` rows. Nodes are ranges of `order`; children follow their parents."""

    def __init__(self, x: np.ndarray, leaf: int):
        x = x.astype(np.float64)
        self.order = np.arange(len(x))
        lo, hi, child, centre, radius, self.cut = [0], [len(x)], [], [], [], []
        k = 0
        while k < len(lo):
            at = self.order[lo[k] : hi[k]]
            v = x[at]
            c = v.mean(0) if len(v) else np.zeros(x.shape[1])
            far = np.sqrt(((v - c) ** 2).sum(1)) if len(v) else np.zeros(1)
            centre.append(c)
            radius.append(float(far.max()))
            if len(at) <= leaf:
                child.append(-1)
                self.cut.append(None)
            else:
                p = v[far.argmax()]
                way = v[((v - p) ** 2).sum(1).argmax()] - p
                on, half = v @ way, len(at) // 2
                part = np.argpartition(on, half)
                self.order[lo[k] : hi[k]] = at[part]
                child.append(len(lo))
                self.cut.append((way, float(on[part[half]])))
                lo += [lo[k], lo[k] + half]
                hi += [lo[k] + half, hi[k]]
            k += 1
        self.lo, self.hi, self.child = np.array(lo), np.array(hi), np.array(child)
        self.centre, self.radius = np.array(centre).reshape(-1, x.shape[1]), np.array(radius)
        self.norm = np.sqrt((self.centre**2).sum(1))

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.lo[node] : self.hi[node]]

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value below each node."""
        out = np.zeros(len(self.lo))
        for k in range(len(out) - 1, -1, -1):
            out[k] = values[self.rows(k)].min(initial=MOST) if self.child[k] < 0 else min(out[self.child[k]], out[self.child[k] + 1])
        return out

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.lo)):
            if self.child[k] >= 0 and (here := np.flatnonzero(out == k)).size:
                way, cut = self.cut[k]
                out[here] = self.child[k] + (x[here] @ way >= cut)
        return out


def leaf_pairs(a: Tree, c: Tree, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf of a, leaf of c, upper bound) of the pairs whose interval meets [low, high] of the node of a; the greatest bounds first."""
    at = np.zeros((1, 2), np.int64)
    done: list[tuple] = []
    while len(at):
        i, j = at.T
        mid = np.einsum("ij,ij->i", a.centre[i], c.centre[j])
        wide = a.norm[i] * c.radius[j] + c.norm[j] * a.radius[i] + a.radius[i] * c.radius[j]
        wide += 1e-9 * (a.norm[i] + a.radius[i]) * (c.norm[j] + c.radius[j]) + 1e-6
        keep = (mid + wide >= low[i]) & (mid - wide <= high[i])
        i, j, top = i[keep], j[keep], (mid + wide)[keep]
        end = (a.child[i] < 0) & (c.child[j] < 0)
        done.append((i[end], j[end], top[end]))
        i, j = i[~end], j[~end]
        # the wider node is opened
        first = (a.child[i] >= 0) & ((c.child[j] < 0) | (a.radius[i] >= c.radius[j]))
        left = np.stack((np.where(first, a.child[i], i), np.where(first, j, c.child[j])), 1)
        right = np.stack((np.where(first, a.child[i] + 1, i), np.where(first, j, c.child[j] + 1)), 1)
        at = np.concatenate((left, right))
    i, j, top = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(-top, kind="stable")
    return i[order], j[order], top[order]


class Best:
    """The `k` best (score, then least id) of each key, with the score that a newcomer needs."""

    def __init__(self, keys: int, k: int, kind: type, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(keys, LEAST, kind) if floor is None else floor.copy()
        self.held = [np.zeros(0, t) for t in (np.int64, kind, np.int64, np.int64)]
        self.new: list[tuple] = []
        self.n = 0

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray, uid: np.ndarray) -> None:
        self.new.append((key, score, ident, uid))
        self.n += len(key)
        if self.n > max(1 << 10, len(self.held[0])):
            self.settle()

    def settle(self) -> None:
        if not self.n:
            return
        key, score, ident, uid = (np.concatenate((h, *x)) for h, x in zip(self.held, zip(*self.new, strict=True), strict=True))
        order = np.lexsort((uid, ident, -score, key))
        key = key[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.held = [np.concatenate((h, *x))[order] for h, x in zip(self.held, zip(*self.new, strict=True), strict=True)]
        full, scores = key[rank == self.k - 1], score[last]
        self.floor[full] = np.maximum(self.floor[full], scores)
        self.new, self.n = [], 0


class Anchors:
    """The anchors of a round, with their tree, one tree for each label, and later their positives' windows."""

    def __init__(self, uid: np.ndarray, ident: np.ndarray, label: np.ndarray, x: np.ndarray):
        self.uid, self.ident, self.label, self.x = uid, ident, label, x
        self.name = uuid.uuid4().hex
        self.low = self.high = None
        self.floor: np.ndarray | None = None

    def windows(self, low: np.ndarray, high: np.ndarray) -> None:
        """Windows of scores, `per` for each anchor; low above high where there is none."""
        self.low, self.high, self.floor, self.name = low, high, None, uuid.uuid4().hex

    def trees(self) -> None:
        """Of each label while positives are looked for, of all together afterwards."""
        groups = [np.arange(len(self.uid))] if self.low is not None else np.split(order := np.argsort(self.label, kind="stable"), np.flatnonzero(np.diff(self.label[order])) + 1)
        self.groups = {(None if self.low is not None else int(self.label[g[0]])): (g, Tree(self.x[g], LEAVES[0])) for g in groups if len(g)}


class Search:
    """What one task has found for the anchors of a round; scored counts pairs of leaves."""

    def __init__(self, anchors: Anchors, per: int):
        self.a, self.per = anchors, per
        self.best = Best(len(anchors.uid) * (1 if anchors.low is None else anchors.low.shape[1]), per, anchors.x.dtype.type, anchors.floor)
        self.scored = self.possible = 0

    def block(self, uid: np.ndarray, ident: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        for kind, (group, tree) in self.a.groups.items():
            rows = np.flatnonzero(label == kind) if kind is not None else np.arange(len(uid))
            if len(rows):
                self._dual(group, tree, rows, Tree(x[rows], LEAVES[1]), uid, ident, label, x)

    def _dual(self, group, tree, rows, other, uid, ident, label, x) -> None:
        a, best = self.a, self.best
        n = 1 if a.low is None else a.low.shape[1]
        needs = lambda: best.floor.reshape(-1, n)[group] if a.low is None else np.where(a.low[group] > a.high[group], MOST, np.maximum(a.low[group], best.floor.reshape(-1, n)[group]))
        need = needs().min(1)
        high = np.full(len(group), MOST, float) if a.low is None else a.high[group].max(1)
        i, j, top = leaf_pairs(tree, other, tree.least(need), -tree.least(-high))
        self.possible += int((tree.child < 0).sum() * (other.child < 0).sum())
        for p, q, bound in zip(i.tolist(), j.tolist(), top.tolist(), strict=True):
            on = group[tree.rows(p)]
            floor = best.floor.reshape(-1, n)[on]
            low = floor if a.low is None else np.maximum(floor, a.low[on])
            if bound < (low if a.low is None else np.where(a.low[on] > a.high[on], MOST, low)).min():
                continue  # floors have risen since
            self.scored += 1
            to = rows[other.rows(q)]
            s = a.x[on] @ x[to].T
            fits = uid[to] != a.uid[on][:, None] if a.low is None else label[to] != a.label[on][:, None]
            for k in range(n):
                hit = fits & (s >= low[:, k : k + 1])
                if a.low is not None:
                    hit &= s <= a.high[on, k][:, None]
                r, c = np.nonzero(hit)
                if len(r):
                    best.add(on[r] * n + k, s[r, c], ident[to[c]], uid[to[c]])
        best.settle()


def _matrix(column: pa.Array, dim: int, exact: bool) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    return v.astype(np.float64 if exact else np.int64)


#: A null id stands after all others.
NO_ID = np.iinfo(np.int64).max


def _columns(b: pa.RecordBatch, dim: int, exact: bool) -> tuple:
    return b.column("uid").to_numpy(), b.column("id").fill_null(NO_ID).to_numpy(), b.column("label").to_numpy(), _matrix(b.column("v"), dim, exact)


def _grown(a: Anchors) -> Anchors:
    a.trees()
    return a


def _searcher(sent, per: int, dim: int, exact: bool):
    def run(batches):
        a = sent.value
        search, held, n = Search(kept(f"anchors {a.name}", lambda: _grown(a)), per), [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                search.block(*(np.concatenate(c) for c in zip(*(_columns(h, dim, exact) for h in held), strict=True)))
                held, n = [], 0
        if n:
            search.block(*(np.concatenate(c) for c in zip(*(_columns(h, dim, exact) for h in held), strict=True)))
        key, score, ident, uid = search.best.held
        for k in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(v[k : k + (1 << 16)].astype(np.int64)) for v in (key, score, ident, uid)], names=["key", "score", "id", "uid"])

    return run


FOUND = "key long, score long, id long, uid long"


def _best(found: DataFrame, per: int) -> DataFrame:
    """The best of each key over all tasks: a task sends `per` rows of a key at most."""
    by = W.partitionBy("key").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= per)


def _packed(dim: int, exact: bool):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in _columns(b, dim, exact)], names=["uid", "id", "label", "v"])

    return run


def _gathered(rows: DataFrame, dim: int, exact: bool) -> tuple:
    """A bounded number of the index' rows on the driver."""
    got = rows.select("uid", "id", "label", "v").mapInArrow(lean(_packed(dim, exact)), "uid binary, id binary, label binary, v binary").collect()
    ints = [np.frombuffer(b"".join(bytes(r[c]) for r in got), np.int64) for c in ("uid", "id", "label")]
    return *ints, np.frombuffer(b"".join(bytes(r.v) for r in got), np.float64 if exact else np.int64).reshape(-1, dim)


def _cells(tree: Tree, dim: int):
    def run(batches):
        for b in batches:
            cell = tree.leaf_of(_matrix(b.column("v"), dim, True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return run


def usable(rows: DataFrame, ident: Column, label: Column, vector: Column, anchor: Column) -> DataFrame:
    """(id, label, v: floors of 256 times the components, anchor) of the rows that take part."""
    d = rows.select(ident.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("x"), F.coalesce(anchor & ident.isNotNull(), F.lit(False)).alias("anchor"))
    real = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return d.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & real).select("id", "label", F.transform("x", lambda c: F.floor(256 * c).cast("double")).alias("v"), "anchor")


def mined(rows: DataFrame, per: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """rows (usable) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its `per` best rows of the same label
    the `per` best rows of other labels whose score lies between `low` and `high` percent of the positive's."""
    spark = rows.sparkSession
    d = staged(rows.withColumn("uid", F.monotonically_increasing_id()))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    about = d.agg(F.max(F.size("v")).alias("dim"), F.min(F.size("v")).alias("least"), F.max(square).alias("square"), F.count_if("anchor").alias("anchors")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not about.anchors:
        return spark.createDataFrame([], schema)
    dim, exact = max(about.dim, 1), about.square < 2**53  # no inner product is beyond the greatest square
    if about.square >= 2**61:
        raise ValueError("scores don't fit a 64-bit integer")
    if about.least < dim:
        d = d.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))
    sample = _gathered(d.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE), dim, exact)
    cells = d.mapInArrow(lean(_cells(Tree(sample[3], max(1, len(sample[0]) // 64)), dim)), "id long, label long, v array<double>, anchor boolean, uid long, cell long")
    # a label or cell with most of the rows is many files: the row's number is part of the range
    index = staged(cells.repartitionByRange(parts(d), "label", "cell", "uid").sortWithinPartitions("label", "cell", "uid"))
    rounds, out = -(-about.anchors * dim * 8 // ROUND), []
    chosen = staged(index.filter("anchor").withColumn("round", F.pmod(F.xxhash64("uid"), F.lit(rounds))))
    for r in range(rounds):
        got = _gathered(chosen.filter(F.col("round") == r), dim, exact)
        if len(got[0]):
            out.append(_round(index, Anchors(*got), sample, per, low, high, dim, exact))
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2], strict=False)] + out[len(out) // 2 * 2 :]
    return out[0]


def _floors(a: Anchors, sample: tuple, per: int) -> None:
    """The first pass: what the sample's rows give is there for certain."""
    a.trees()
    search = Search(a, per)
    search.block(*sample)
    a.floor = search.best.floor


def _round(index: DataFrame, a: Anchors, sample: tuple, per: int, low: int, high: int, dim: int, exact: bool) -> DataFrame:
    sc = index.sparkSession.sparkContext
    run = lambda: _best(index.select("uid", "id", "label", "v").mapInArrow(lean(_searcher(sc.broadcast(a), per, dim, exact), keeps=True), FOUND), per)
    _floors(a, sample, per)
    found = run().collect()  # `per` rows for each anchor of the round
    score = np.full((len(a.uid), per), -1, object)
    ident = np.full((len(a.uid), per), None, object)
    there = np.zeros((len(a.uid), per), bool)
    for f in found:
        score[f.key, f["rank"] - 1], ident[f.key, f["rank"] - 1], there[f.key, f["rank"] - 1] = f.score, f.id, True
    kind = a.x.dtype
    lows = np.where(there, -((-low * score) // 100), MOST).astype(kind)
    highs = np.where(there, high * score // 100, LEAST).astype(kind)
    a.windows(lows, highs)
    _floors(a, sample, per)
    negatives = run()
    spark = index.sparkSession
    rows = [(int(f.key * per + f["rank"] - 1), int(a.ident[f.key]), None if f.id == NO_ID else f.id, f.score) for f in found]
    positives = F.broadcast(spark.createDataFrame(rows, "key long, anchor_id long, positive_id long, positive_score long"))
    out = negatives.join(positives, "key")
    return staged(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NO_ID, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(usable(e, F.col("vec_id"), label, F.col("embedding"), F.col("vec_id") % 100 == 0))


ORACLE_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, x -> floor(256 * cast(x as double))) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, x -> x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, cast(list_dot_product(a.e, b.e) as bigint) as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where label = anchor_label qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id) where label <> anchor_label and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5
"""
