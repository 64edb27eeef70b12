"""What status rows of rounds say: the latest of each run, its health, how far it is, several runs as one, totals of libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stages after which nothing more comes; that can't tell how far they are; that are counted in chunks; that say no time left.
ENDED, OPEN, CHUNKED, TIMELESS = ["done", "failed", "stopped"], ["visual", "finalizing"], ["embedding"], ["embedding", "writing"]


def latest(status: DataFrame, by: str = "run_id", time: str = "ts", tie: str = "seq") -> DataFrame:
    """The newest row of each run."""
    rest = [c for c in status.columns if c != by]
    return status.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("s")).select(by, "s.*")


def health(stage: Column, alive: Column, now: Column, heartbeat: Column, progressed: Column, started: Column, timeout: Column, grace: Column) -> Column:
    """orphaned if a run goes on without its worker, else stalled without a heartbeat or without progress (which a run may lack in its first time), else healthy."""
    active = ~stage.isin(ENDED)
    still = (now - progressed > timeout) & (now - started > grace)
    return F.when(active & ~alive, "orphaned").when(active & (now - heartbeat > timeout), "stalled_no_heartbeat").when(active & still, "stalled_no_progress").otherwise("healthy")


def percent(stage: Column, files_done: Column, files: Column, chunks_done: Column, chunks: Column) -> Column:
    """0 to 100, rounded down; null where a stage can't tell."""
    share = lambda a, b: F.when(b > 0, F.least(F.lit(100), F.floor(a * 100 / b))).otherwise(F.lit(0))
    return F.when(stage == "done", 100).when(stage.isin(OPEN), None).when(stage.isin(CHUNKED), share(chunks_done, chunks)).otherwise(share(files_done, files)).cast("int")


def seconds_left(stage: Column, elapsed: Column, done: Column) -> Column:
    """elapsed seconds carried on to 100 percent; null without a percentage and while time can't be told."""
    return F.when(~stage.isin(TIMELESS) & ~stage.isin(ENDED) & (done > 0), F.round(elapsed * (100 - done) / done, 1))


def monotone(events: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """events with shown: what was shown never falls."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("shown", F.max(value).over(w))


def merged(runs: DataFrame, by: str = "batch_id") -> DataFrame:
    """Runs of several libraries as one: sums, the longest time, names of those that go on, those that failed. runs (by, library_id, stage, files_done, files, chunks_done, chunks, elapsed)."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("library_id")))), ", ")
    stage = F.col("stage")
    g = runs.groupBy(by).agg(
        *(F.sum(c).alias(c) for c in ("files_done", "files", "chunks_done", "chunks")), F.max("elapsed").alias("elapsed"), names(~stage.isin(ENDED)).alias("active"),
        names(stage == "failed").alias("failed"), F.count_if(~stage.isin(ENDED)).alias("__n"), F.count_if(stage == "failed").alias("__f"),
    )
    return g.withColumn("stage", F.when(F.col("__n") > 0, "running").when(F.col("__f") > 0, "failed").otherwise("done")).drop("__n", "__f")


def snapshot(libraries: DataFrame) -> DataFrame:
    """One row: files, chunks and the state of all libraries (files, chunks, indexed, stale): none without an index, stale if any is, else ok."""
    t = libraries.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.max("indexed"), F.lit(False)).alias("__i"), F.coalesce(F.max(F.col("stale") & F.col("indexed")), F.lit(False)).alias("__s"))
    return t.select("files", "chunks", F.when(~F.col("__i"), "none").when(F.col("__s"), "stale").otherwise("ok").alias("state"))


def quota(used: DataFrame, time: str = "ts") -> DataFrame:
    """(day, files, pages) of uses (ts, pages): what a day has taken of its quota."""
    return used.groupBy(F.date_format(time, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("files"), F.sum("pages").alias("pages"))


def positions(chunks: DataFrame) -> DataFrame:
    """chunks (library_id, path, chunk_index) with nth of total: 1 of 3."""
    w = W.partitionBy("library_id", "path")
    return chunks.withColumn("nth", F.row_number().over(w.orderBy("chunk_index"))).withColumn("total", F.count(F.lit(1)).over(w))
