"""From ranked candidates to delivered results: tiers, drop, fold, cap, stop, and batch signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..conf import CONF


def fallback_confidence(fused: DataFrame, weights: float = 2.0) -> DataFrame:
    """Confidence where no reranker ran: the fused score over its largest possible value."""
    return fused.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("score") / (weights / (CONF.rrf_k + 1))), 6))


def normalised(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("norm", F.round(F.col("score") / F.max("score").over(W.partitionBy(*by)), 6))


def deliver(ranked: DataFrame, top_k: int, cap: int = CONF.cap_per_file, drop: float = CONF.drop, fold: bool = True) -> DataFrame:
    """ranked (query_id, library_id, path, section_id, backfilled, confidence, rank) -> delivered rows with position.

    In order: rows beyond the window of top_k * 4 go, then those under the drop threshold, later hits of a
    backfilled section, hits of a file beyond its cap, and what comes after top_k.
    """
    r = ranked.filter(F.col("rank") <= top_k * CONF.fold_window).filter(F.col("confidence") >= drop)
    if fold:
        w = W.partitionBy("query_id", "library_id", "path", "section_id", "backfilled").orderBy("rank")
        r = r.withColumn("nth", F.row_number().over(w)).filter(~F.col("backfilled") | (F.col("nth") == 1)).drop("nth")
        r = r.withColumn("in_file", F.row_number().over(W.partitionBy("query_id", "library_id", "path").orderBy("rank"))).filter(F.col("in_file") <= cap).drop("in_file")
    return r.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("position") <= top_k)
