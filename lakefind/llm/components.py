"""Connected components by minimum labels with pointer jumping; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]


def components(edges: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """edges (a, b) -> (node, label), label the least node that is reachable. seed: labels of an earlier call, whose edges then needn't come again."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if seed is not None:
        tree = seed.filter("node <> label")
        both = both.unionByName(tree.select(F.col("node").alias("u"), F.col("label").alias("v"))).unionByName(tree.select(F.col("label").alias("u"), F.col("node").alias("v")))
    both = staged(both.distinct())
    labels = staged(both.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("m")).select("node", F.least("node", "m").alias("label")))
    before = _total(labels)
    while before is not None:
        near = both.join(labels.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("node"), "label")
        least = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        least = staged(least)
        far = least.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = staged(least.join(far, "label").select("node", F.least("label", "far").alias("label")))
        after = _total(labels)
        if after == before:
            break
        before = after
    return labels
