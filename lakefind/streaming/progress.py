"""Progress events as a stream: the last state of each interval, late ones up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throttled(events: DataFrame, by: list[str], time: str = "ts", value: str = "state", every: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(by, at, value, n): for each key and interval its newest value; state older than the watermark is dropped.

    Runs on streams and on tables alike; state holds one row for each key and open interval.
    """
    w = events.withWatermark(time, late).groupBy(*by, F.window(time, every).alias("w"))
    return w.agg(F.max_by(value, time).alias(value), F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("at"), value, "n")
