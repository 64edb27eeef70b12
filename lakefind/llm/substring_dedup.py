"""Substring deduplication by difference-cover anchors.

Short windows are hashed only where the word position modulo a period lies in a difference cover. For any two positions
there is a shift below the period that brings both into the cover, so two equal windows of `width` words share an anchor
of width - period + 1 words at aligned cover positions. Repeated anchors name candidate windows; those are hashed
whole and the ones whose 128-bit key also starts anywhere else are what counts. The key's halves come from two independent hashes of
each word; equal keys stand for equal words.

Defined results: null text is empty; a document of fewer than `width` words loses nothing; equal documents are
copies of each other (both lose everything from `width` words on); the same row twice is two documents, as are rows of null ids.
Extra columns go; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import parts, staged, swept, table, text_or_empty
from .repeats import repeated

#: Perfect difference sets: every residue modulo the period is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    period = max(p for p in COVERS if p == 1 or p <= 0.65 * width)
    return period, COVERS[period]


def _grouped(batch: pa.RecordBatch, second: bool = False):
    """Hashed words of each group of documents: (first row, row after the last, hashes, second hashes, first word of each document)."""
    data, offsets = H.utf8(batch.column("text"))
    for a, b in H.groups(offsets):
        lo, hi = offsets[a], offsets[b]
        h, start, end, first = H.words(data[lo:hi], offsets[a : b + 1] - lo)
        yield a, b, h, H.spelled(data[lo:hi], start, end, H.BYTES2) if second else None, first


def _anchors(width: int):
    period, cover = cover_for(width)
    size, member = width - period + 1, np.isin(np.arange(period), cover)

    def rows(batch):
        ident = batch.column("t1").to_numpy()
        for a, b, h, _, first in _grouped(batch):
            n = np.diff(first)
            doc = np.repeat(np.arange(b - a), n)
            pos = np.arange(len(h)) - first[doc]
            at = np.flatnonzero(member[pos % period] & (pos + size <= n[doc]) & (n[doc] >= width))
            if len(at):
                yield H.windows(h, at, size).view(np.int64), ident[a + doc[at]], pos[at]

    return rows


def _candidates(width: int):
    """Windows around repeated anchors: the first half of their hash, id of document, start, the second half."""
    period, _ = cover_for(width)

    def rows(batch):
        t1, hits = batch.column("t1").to_numpy(), batch.column("hits")
        for a, b, h, h2, first in _grouped(batch, second=True):
            s1, s2 = H.WORDS.prefix(h), H.WORDS2.prefix(h2)
            for d in range(a, b):
                n = int(first[d - a + 1] - first[d - a])
                p = hits[d].values.to_numpy()
                p = p[p < n]
                mark = np.zeros(n + 1, np.int32)
                np.add.at(mark, np.maximum(p - period + 1, 0), 1)
                np.add.at(mark, np.minimum(p + 1, n), -1)
                at = np.flatnonzero(np.cumsum(mark)[: max(n - width + 1, 0)] > 0)
                if len(at):
                    g = at + first[d - a]
                    one, two = H.windows(h, g, width, H.WORDS, s1), H.windows(h2, g, width, H.WORDS2, s2)
                    yield one.view(np.int64), np.full(len(at), t1[d]), at, two.view(np.int64)

    return rows


def _kept(width: int):
    def run(batches):
        for batch in batches:
            text, starts, copies = batch.column("text").to_pylist(), batch.column("starts"), batch.column("copies").to_pylist()
            n_words, n_removed, sha = [], [], []
            for k, t in enumerate(text):
                w = (t or "").encode().split()
                if copies[k] and copies[k] > 1 and len(w) >= width:
                    kept = []
                elif starts[k].is_valid and len(starts[k]):
                    mark = np.zeros(len(w) + 1, np.int32)
                    at = np.unique(starts[k].values.to_numpy())
                    mark[at] += 1
                    np.subtract.at(mark, np.minimum(at + width, len(w)), 1)
                    kept = [w[i] for i in np.flatnonzero(np.cumsum(mark)[:-1] == 0)]
                else:
                    kept = w
                n_words.append(len(w))
                n_removed.append(len(w) - len(kept))
                out = b" ".join(kept)
                sha.append(hashlib.sha256(out).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(17), text).alias("t2"))


def removed_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """Per distinct text (t1, t2): how many rows hold it, and the starts of its windows that occur anywhere else."""
    d = keyed(docs, id_col, text_col)
    n = parts(docs)
    copies = d.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    hits = repeated(d.select("t1", "text"), _anchors(width), n).groupBy(F.col("id").alias("t1")).agg(F.collect_set("pos").alias("hits"))
    hits = staged(hits)
    swept(docs.sparkSession)  # the anchors' shuffle is done with
    # which row of equal texts is read doesn't matter: equal (text, start) counts once
    found = repeated(d.join(hits, "t1").select("t1", "text", "hits"), _candidates(width), n)
    found = found.groupBy(F.col("id").alias("t1")).agg(F.collect_set("pos").alias("starts"))
    found = staged(found)
    swept(docs.sparkSession)
    return copies.select("t1", "t2", "copies").join(found, "t1", "left")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256."""
    info = removed_windows(docs, id_col, text_col, width).filter("copies > 1 or starts is not null")
    d = keyed(docs, id_col, text_col).join(info, ["t1", "t2"], "left").select("id", "text", "starts", "copies")
    out = d.mapInArrow(_kept(width), f"id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
