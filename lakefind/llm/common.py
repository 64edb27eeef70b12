"""What the operators of this subpackage share: tables, shared storage, partition counts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_root
from . import hashing as H


#: Rows in an Arrow batch, where the session keeps Spark's own number: texts may be long.
ARROW_ROWS = "1000"
#: Bytes in an Arrow batch: rows may hold whole texts or sets.
ARROW_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share; it goes when the application ends."""
    root = f"{shared_root(spark)}/lakefind-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return root


_ROOTS: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written to a table in the shared folder and read back: lineage ends there, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that isn't used any more goes back to the system: in a worker when a task ends, in the driver after a model is trained or counters were gathered."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def swept(spark: SparkSession) -> None:
    """Between rounds: the driver collects its garbage, so that what Spark holds for tables and broadcasts of finished rounds goes, on executors too.

    Twice: what the scheduler still holds when a job has just ended goes the second time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()
    give_back()


#: What a worker keeps from task to task, one thing at a time: what is dear to make.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """The thing of that name, made unless the worker still has it; another one goes."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def lean(run, keeps: bool = False):
    """A function for mapInArrow that gives its memory back when a task ends: workers are used again by later stages. What a worker has kept goes before a task that keeps nothing."""

    def f(batches):
        if not keeps:
            _KEPT.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return f


def slices(batch: pa.RecordBatch, size: int = 1 << 20):
    """The batch in slices of about `size` bytes of text, so that what Python makes of them stays small; a longer text is a slice of its own."""
    n = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for a, b in H.groups(np.concatenate(([0], np.cumsum(n, dtype=np.int64))), size):
        yield batch.slice(a, b - a)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, mb: float = 8.0) -> int:
    """Shuffle partitions that keep what one task gathers near `mb` MB of the input df is read from."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    if size > 1e17:  # rows that aren't read from files have no size
        return least
    return int(max(least, min(size / (mb * 1e6), 2e6)))


def fits_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int = 16 << 20) -> bool:
    """Whether df (staged, so counting is cheap) is small enough to be sent to every executor."""
    most = limit_bytes // row_bytes
    return df.limit(most + 1).count() <= most


#: The most keys that are sent to every executor because very many rows have them; rows of a key that are never many.
HOT_KEYS, FEW = 1 << 16, 1000


def looked_up(rows: DataFrame, table_: DataFrame, on: list[str], n_parts: int, how: str = "inner", row_bytes: int = 96) -> DataFrame:
    """rows joined (inner or left) with table_ (staged), which has one row for each key, and c, how many rows have that key (dropped).

    A small table is broadcast. Of a larger one only the keys with more rows than a fair part of them all are: at most
    HOT_KEYS, as that many parts is the most that are counted. So the shuffle has no hot key left.
    """
    if fits_broadcast(table_, row_bytes):
        return rows.join(F.broadcast(table_.drop("c")), on, how)
    total = table_.agg(F.sum("c")).first()[0] or 0
    cut = max(FEW, total // max(1, min(n_parts, HOT_KEYS)))
    hot = F.broadcast(table_.filter(F.col("c") > cut).drop("c"))
    rest = rows.join(hot.select(*on), on, "left_anti").join(table_.filter(F.col("c") <= cut).drop("c"), on, how)
    return rows.join(hot, on).unionByName(rest)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))
