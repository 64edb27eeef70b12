"""Running sums over any number of rows, without a window that holds a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import staged


def running(df: DataFrame, by: list[str], order: list, value: Column | int, name: str) -> DataFrame:
    """df with the sum of value over the rows of its key before it, in an order that should be total. Rows are dealt by ranges of (by, order); a range's sums begin where the ones before end."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = value if isinstance(value, Column) else F.lit(value)
    d = staged(df.withColumn("__v", v).repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    # a row for each range and each key that lies in it
    sums = d.groupBy(*by, "__part").agg(F.sum("__v").alias("__s"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inner = F.coalesce(F.sum("__v").over(W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = d.withColumn("__inner", inner).join(sums, [*by, "__part"])
    return out.withColumn(name, F.col("__before") + F.col("__inner")).drop("__v", "__part", "__before", "__inner")
