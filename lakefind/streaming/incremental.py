"""The incremental plan as a stream: each micro-batch of file changes makes a new generation of the manifest.

A generation is a folder of its batch's number under root; it counts once Spark's commit marker is in it. A batch
that runs again after a failure writes the same generation from the same older one, so each change takes effect once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog

KEY = ["library_id", "path"]
MANIFEST = "library_id string, path string, size long, mtime_ns long, content_hash string, status string, failure_state string"


def active(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The newest whole generation (older than `before`)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath() for s in fs.listStatus(path)]
    whole = [int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((n for n in whole if before is None or n < before), default=None)


def manifest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    n = active(spark, root, before)
    return spark.createDataFrame([], MANIFEST) if n is None else spark.read.schema(MANIFEST).parquet(f"{root}/{n}")


def advanced(changes: DataFrame, old: DataFrame) -> DataFrame:
    """The next manifest. changes (MANIFEST's columns, included, deleted), one row a file; files without a change keep their record.

    Deferred files keep the old record if it was indexed, deleted and excluded ones lose it.
    """
    seen = changes.select(*KEY, "deleted")
    action = catalog.plan(changes, old.join(seen, KEY, "left_semi"))
    c = changes.join(action, KEY)
    before = old.select(*KEY, F.col("status").alias("was"))
    c = c.join(before, KEY, "left")
    gone = F.col("deleted") | (F.col("action") == "excluded")
    keep = ~gone & ((F.col("action") == "unchanged") | (F.coalesce(F.col("was") == "indexed", F.lit(False)) & F.equal_null("failure_state", F.lit("deferred"))))
    c = c.withColumn("keep", keep).withColumn("gone", gone)
    fresh = c.filter("not gone and not keep").select(*old.columns)
    kept = old.join(c.filter("not keep").select(*KEY), KEY, "left_anti").select(*old.columns)
    return kept.unionByName(fresh)


def run(changes: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream; trigger as for DataStreamWriter.trigger."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in KEY]), F.struct("mtime_ns", "content_hash")).alias("s")).select(*KEY, "s.*")
        advanced(newest, manifest(spark, root, number)).write.mode("overwrite").parquet(f"{root}/{number}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
