"""Near-duplicate groups of a library by MinHash of character shingles and banding.

Texts that share a band of their signatures are candidates; a group is what candidates connect, at least two documents.
Members of a band meet in a star around its least id, which connects the same documents as all pairs would.
Null and blank texts are in no group.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import shared_root

PERMUTATIONS, SHINGLE = 128, 5
#: Shingles hashed at a time: the matrix of their permuted hashes stays in a core's cache.
BLOCK = 128
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@cache
def bands(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows) whose collision curve 1 - (1 - s**rows)**bands errs least on both sides of threshold, by area."""
    s = (np.arange(1000) + 0.5) / 1000
    below = s < threshold

    def error(b: int, r: int) -> float:
        p = 1 - (1 - s**r) ** b
        return float(np.where(below, p, 1 - p).sum())

    return min(((b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)), key=lambda x: error(*x))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


@cache
def _seeds() -> np.ndarray:
    return _mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * BASE)


def signature(text: str) -> np.ndarray:
    """Least permuted hashes of the shingles of the squeezed text; a shorter text is its own shingle."""
    c = np.frombuffer(" ".join(text.split()).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    width = min(SHINGLE, len(c))
    h = np.zeros(len(c) - width + 1, np.uint64)
    for k in range(width):
        h = h * BASE + c[k : k + len(h)]
    h, least = np.unique(_mix(h)), np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    # _mix(h ^ seed) in place; its first step is linear, so it is done to both sides before
    h, seeds = h ^ (h >> np.uint64(30)), _seeds() ^ (_seeds() >> np.uint64(30))
    x, y = np.empty((2, min(BLOCK, len(h)), PERMUTATIONS), np.uint64)
    for a in range(0, len(h), BLOCK):
        some = h[a : a + BLOCK, None]
        x, y = x[: len(some)], y[: len(some)]
        np.bitwise_xor(some, seeds, out=x)
        np.multiply(x, MIX[0], out=x)
        np.bitwise_xor(x, np.right_shift(x, np.uint64(27), out=y), out=x)
        np.multiply(x, MIX[1], out=x)
        np.bitwise_xor(x, np.right_shift(x, np.uint64(31), out=y), out=x)
        np.minimum(least, x.min(0), out=least)
    return least


def _signatures(batches):
    for batch in batches:
        sigs = [signature(t) if t and t.strip() else None for t in (x.as_py() for x in batch.column("text"))]
        keep = pa.array([i for i, s in enumerate(sigs) if s is not None], pa.int64())
        rows = pa.array([s.view(np.int64).tolist() for s in sigs if s is not None], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("library_id").take(keep), batch.column("id").take(keep), rows], names=["library_id", "id", "sig"])


def _connected(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label), label the least node reachable; rounds are checkpoints."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")).checkpoint()
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        least = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label")).checkpoint()
        if new.join(labels.withColumnRenamed("label", "was"), "node").filter("label <> was").isEmpty():
            return new
        labels = new


def _signed(docs: DataFrame) -> DataFrame:
    """(node, sig): a node is a document of a library."""
    shared_root(docs.sparkSession)
    d = docs.select("library_id", "id", F.col("text").cast("string")).filter("id is not null")
    types = dict(d.dtypes)
    sigs = d.mapInArrow(_signatures, f"library_id {types['library_id']}, id {types['id']}, sig array<long>")
    return sigs.select(F.struct("library_id", "id").alias("node"), "sig").dropDuplicates(["node"]).checkpoint()


def _stars(sigs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the members of each band with its least one, of the same library."""
    n, rows = bands(threshold)
    keys = F.array(*(F.xxhash64(F.lit(k), F.slice("sig", k * rows + 1, rows)) for k in range(n)))
    each = sigs.select("node", F.col("node.library_id").alias("library_id"), F.posexplode(keys).alias("band", "key"))
    bucket = ["library_id", "band", "key"]
    star = each.groupBy(*bucket).agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return each.join(star, bucket).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _similarity(x: str, y: str) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda v: v)) / PERMUTATIONS


def duplicate_groups(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs (library_id, id, text) -> (library_id, id, group_id, similarity): group_id the group's least id, similarity the estimate to it.

    Libraries are looked at each for itself. Null ids are left out; of rows with the same id any one counts.
    """
    sigs = _signed(docs)
    labels = _connected(_stars(sigs, threshold))
    m = labels.join(sigs, "node")
    head = sigs.select(F.col("node").alias("label"), F.col("sig").alias("head")).join(labels.select("label").distinct(), "label")
    return m.join(head, "label").select("node.library_id", "node.id", F.col("label.id").alias("group_id"), F.round(_similarity("sig", "head"), 6).alias("similarity"))


def duplicate_links(docs: DataFrame, threshold: float = 0.8, verified: bool = False) -> DataFrame:
    """(library_id, a, b, similarity, rank): links of a < b, most similar first: each document with the least one of a band it shares.

    They connect what all pairs would connect; groups of copies aren't spread into their pairs. Candidates of a band may be less
    similar than threshold; verified leaves these out.
    """
    sigs = _signed(docs)
    pairs = _stars(sigs, threshold)
    for side in ("a", "b"):
        pairs = pairs.join(sigs.select(F.col("node").alias(side), F.col("sig").alias(f"s{side}")), side)
    x = pairs.select("a.library_id", F.col("b.id").alias("a"), F.col("a.id").alias("b"), F.round(_similarity("sa", "sb"), 3).alias("similarity"))
    x = x.filter(F.col("similarity") >= threshold) if verified else x
    return x.withColumn("rank", F.row_number().over(W.partitionBy("library_id").orderBy(F.desc("similarity"), "a", "b")))
