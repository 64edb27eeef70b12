"""Searches by words keep a bounded number of rows in each task, and find what joins find."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lakefind.operators import lexical


def _tables(spark, n=3000, twice=False):
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    docs = [(f"l{k % 3}" if k % 50 else None, f"d{k:04d}", None if k % 97 == 0 else " ".join(r.choices(words, range(60, 0, -1), k=r.randint(0, 40)))) for k in range(n)]
    docs += [("l1", "d0001", "w1 w1 w2"), ("l1", "d0001", "w1 w3")] if twice else []
    docs += [("l0", f"copy{k}", "w1 w2 w3") for k in range(40)]
    asked = [(k, " ".join(r.choices(words, k=6))) for k in range(12)] + [(99, None), (98, "absent"), (97, "w5 w5 w6")]
    return spark.createDataFrame(asked, "item_id long, text string"), spark.createDataFrame(docs, "library_id string, doc_id string, text string").repartition(6)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _both(monkeypatch, f):
    new = _rows(f())
    with monkeypatch.context() as m:
        m.setattr(lexical.Asked, "of", classmethod(lambda cls, q: None))
        return new, _rows(f())


def test_the_same_as_by_joins(spark, monkeypatch):
    for twice in (False, True):
        q, d = _tables(spark, twice=twice)
        new, old = _both(monkeypatch, lambda: lexical.bm25(q, d, 7))  # noqa: B023
        assert new == old and new
    q, d = _tables(spark)
    d = d.withColumn("library_id", F.lit("all"))
    new, old = _both(monkeypatch, lambda: lexical.most_terms(q, d, 7))
    assert new == old and new


def test_small_steps_find_the_same(spark, monkeypatch):
    q, d = _tables(spark)
    want = _rows(lexical.bm25(q, d, 7))
    asked = lexical.Asked.of(lexical.query_terms(q))
    c = asked.counted(d.select("library_id", F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), " ").alias("ts")))
    monkeypatch.setattr(lexical, "FREQUENCIES", 3)
    assert asked.best(c, 7) is None
    monkeypatch.undo()
    assert _rows(lexical.bm25(q, d, 7)) == want


def test_a_task_gives_no_more_rows_than_are_wanted(spark):
    """Rows that are shuffled are in proportion to the queries, not to the pairs of queries and documents."""
    q, d = _tables(spark)
    asked = lexical.Asked.of(lexical.query_terms(q))
    c = d.filter("library_id is not null").select("library_id", F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), " ").alias("ts"))
    lists = [r.asDict() for r in asked.counted(c).filter("size(terms) > 0").collect()]
    batch = pa.RecordBatch.from_pylist(lists, pa.schema([("library_id", pa.string()), ("id", pa.string()), ("dl", pa.int32()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))]))

    class Sent:
        value = (asked.qid, asked.start, asked.asks, asked.weight, {x: (np.ones(len(asked.terms)), 20.0) for x in ("l0", "l1", "l2")})

    out = pa.Table.from_batches(lexical._scored(Sent, 5)(iter([batch.slice(0, 900), batch.slice(900)])))
    assert len(lists) * 5 > len(out) and len(out) <= 3 * len(asked.qid) * 5
