"""The order in which texts are embedded: texts of like length together, the longest first, so that a batch's padding stays small.

Texts are dealt to tasks by ranges of length; a length that very many texts have is spread by a hash. A task packs its texts into batches of bounded
padded size. Equal texts are embedded once. What a text's vector is doesn't depend on its batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a batch; characters of a batch when each text is as long as the longest (a longer text is a batch of its own).
TEXTS, PADDED = 64, 1 << 17

Embed = Callable[[list[str]], list[list[float]]]


def packed(sizes: Iterator[int], texts: int = TEXTS, padded: int = PADDED) -> Iterator[int]:
    """How many of a falling sequence of sizes each batch takes."""
    n, longest = 0, 0
    for size in sizes:
        longest = longest if n else size
        if n and (n == texts or max(longest, 1) * (n + 1) > padded):
            yield n
            n, longest = 0, size
        n += 1
    if n:
        yield n


def ordered(texts: DataFrame) -> DataFrame:
    """texts (key, text) in tasks by length, each from the longest to the shortest."""
    d = texts.withColumn("__n", F.length("text"))
    return d.repartitionByRange(F.desc("__n"), F.xxhash64("key")).sortWithinPartitions(F.desc("__n"), "key").drop("__n")


def _batches(rows, texts: int, padded: int) -> Iterator[pa.RecordBatch]:
    for b in rows:
        sizes, at = [len(t) for t in b.column("text").to_pylist()], 0
        for n in packed(iter(sizes), texts, padded):
            yield b.slice(at, n)
            at += n


def embedded(docs: DataFrame, embed: Embed, ident: str = "id", text: str = "text", texts: int = TEXTS, padded: int = PADDED) -> DataFrame:
    """docs (ident, text) -> (ident, v). Null texts get no vector; rows of equal texts share one."""
    d = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), F.sha2(F.col(text), 256).alias("key"))
    once = d.filter("text is not null").groupBy("key").agg(F.any_value("text").alias("text"))

    def run(rows):
        for b in _batches(rows, texts, padded):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(embed(b.column("text").to_pylist()), pa.list_(pa.float64()))], names=["key", "v"])

    made = ordered(once).mapInArrow(run, "key string, v array<double>")
    return d.join(made, "key", "left").select(F.col("id").alias(ident), "v")


def padding(docs: DataFrame, text: str = "text", texts: int = TEXTS, padded: int = PADDED) -> DataFrame:
    """(batches, texts, chars, padded) of the order that embedded() takes: characters of all distinct texts, and with the padding."""
    d = docs.filter(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("key")).agg(F.any_value(text).alias("text"))

    def run(rows):
        for b in _batches(rows, texts, padded):
            sizes = [len(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (1, len(sizes), sum(sizes), max(sizes) * len(sizes))], names=["batches", "texts", "chars", "padded"])

    return ordered(d).mapInArrow(run, "batches long, texts long, chars long, padded long").agg(*(F.sum(c).alias(c) for c in ("batches", "texts", "chars", "padded")))
