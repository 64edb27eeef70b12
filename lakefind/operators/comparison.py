"""Ranked lists side by side: what two searches have in common, and how far down relevant results stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How likely a reader goes on to the next rank, in rank-biased overlap.
ON = 0.9


def side_by_side(a: DataFrame, b: DataFrame, item: str = "id") -> DataFrame:
    """a and b (query_id, item, rank) by rank: (query_id, rank, a, b, same); a side that is shorter is null there."""
    left, right = (d.select("query_id", "rank", F.col(item).alias(n)) for d, n in ((a, "a"), (b, "b")))
    return left.join(right, ["query_id", "rank"], "full_outer").withColumn("same", F.equal_null("a", "b"))


def compared(a: DataFrame, b: DataFrame, k: int = 10, item: str = "id", p: float = ON) -> DataFrame:
    """For each query of either list: n_a, n_b (results within k), common, kept (the same result at the same rank), top1, moved (mean change of rank of what is common), and rbo.

    rbo is rank-biased overlap, carried on from depth k as if the share in common stayed as it is there: 1 for equal full lists, 0 for lists without a common result.
    """
    left, right = (d.filter(F.col("rank") <= k).select("query_id", F.col(item).alias("item"), F.col("rank").alias(n)) for d, n in ((a, "ra"), (b, "rb")))
    j = left.join(right, ["query_id", "item"], "full_outer")
    both = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    # a common result counts at every depth from the deeper of its ranks on
    tails = [0.0] * (k + 2)
    for d in range(k, 0, -1):
        tails[d] = tails[d + 1] + p**d / d
    tail = F.element_at(F.array(*(F.lit(x) for x in tails[1 : k + 1])), F.greatest("ra", "rb").cast("int"))
    weight = F.when(both, (1 - p) / p * tail + p**k / k).otherwise(0.0)
    g = j.groupBy("query_id").agg(
        F.count("ra").alias("n_a"), F.count("rb").alias("n_b"), F.count_if(both).alias("common"), F.count_if(F.col("ra") == F.col("rb")).alias("kept"),
        F.count_if((F.col("ra") == 1) & (F.col("rb") == 1)).alias("top1"), F.round(F.avg(F.when(both, F.abs(F.col("ra") - F.col("rb")))), 6).alias("moved"), F.round(F.sum(weight), 6).alias("rbo"),
    )
    return g


def summary(c: DataFrame) -> DataFrame:
    """One row of compared(): queries, shares of a's results that are common and kept, share of equal first results, mean rbo."""
    share = lambda x: F.round(F.sum(x) / F.sum("n_a"), 6)
    return c.agg(F.count(F.lit(1)).alias("queries"), share("common").alias("common_share"), share("kept").alias("kept_share"), F.round(F.avg("top1"), 6).alias("top1_share"), F.round(F.avg("rbo"), 6).alias("rbo"))


def reciprocal_rank(results: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 10, item: str = "id") -> DataFrame:
    """(query_id, rank, rr) of queries (query_id): the rank of the first result of gold (query_id, item) within k, and one over it; 0 if there is none."""
    hit = results.filter(F.col("rank") <= k).join(gold.select("query_id", item).distinct(), ["query_id", item], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").join(hit, "query_id", "left").withColumn("rr", F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 6))
