import pytest
from pyspark.sql import functions as F

from lakefind.operators import progress as P


@pytest.mark.parametrize(
    ("row", "health"),
    [
        (("done", False, 100, 0, 0, 0), "healthy"), (("embedding", False, 100, 100, 100, 0), "orphaned"), (("embedding", True, 100, 50, 100, 0), "stalled_no_heartbeat"),
        (("embedding", True, 100, 95, 50, 0), "stalled_no_progress"), (("embedding", True, 100, 95, 50, 90), "healthy"), (("embedding", True, 100, 95, 95, 0), "healthy"),
    ],
)
def test_health(spark, row, health):
    d = spark.createDataFrame([row], "stage string, alive boolean, now int, beat int, moved int, began int")
    c = F.col
    assert d.select(P.health(c("stage"), c("alive"), c("now"), c("beat"), c("moved"), c("began"), F.lit(20), F.lit(30))).first()[0] == health


def test_percent(spark):
    rows = [("done", 0, 0, 0, 0, 100), ("visual", 1, 2, 1, 2, None), ("embedding", 1, 2, 1, 3, 33), ("extracting", 1, 2, 0, 0, 50), ("extracting", 0, 0, 0, 0, 0), ("extracting", 5, 2, 0, 0, 100)]
    d = spark.createDataFrame(rows, "stage string, a int, b int, c int, e int, want int")
    got = d.select(P.percent(*(F.col(x) for x in ("stage", "a", "b", "c", "e"))).alias("p"), "want").collect()
    assert [r.p for r in got] == [r.want for r in got]
    left = d.select("stage", P.seconds_left(F.col("stage"), F.lit(10.0), F.col("want")).alias("s")).collect()
    assert [r.s for r in left] == [None, None, None, 10.0, None, 0.0]


def test_latest_and_merged(spark):
    s = spark.createDataFrame([("r", 1, 1, "a"), ("r", 2, 1, "b"), ("r", 2, 2, "c"), ("q", 1, 1, "d")], "run_id string, ts int, seq int, stage string")
    assert {(r.run_id, r.stage) for r in P.latest(s).collect()} == {("r", "c"), ("q", "d")}
    runs = spark.createDataFrame([(1, "x", "done", 2, 2, 5, 5, 9.0), (1, "y", "embedding", 1, 4, 0, 9, 3.0), (2, "z", "failed", 0, 1, 0, 0, 1.0)], "batch_id int, library_id string, stage string, files_done int, files int, chunks_done int, chunks int, elapsed double")
    got = {r.batch_id: (r.files_done, r.files, r.elapsed, r.active, r.failed, r.stage) for r in P.merged(runs).collect()}
    assert got == {1: (3, 6, 9.0, "y", "", "running"), 2: (0, 1, 1.0, "", "z", "failed")}


def test_snapshot(spark):
    d = spark.createDataFrame([(2, 5, True, False), (1, 1, False, True)], "files int, chunks int, indexed boolean, stale boolean")
    assert tuple(P.snapshot(d).first()) == (3, 6, "ok") and P.snapshot(d.filter("not indexed")).first().state == "none"
    assert tuple(P.snapshot(d.limit(0)).first()) == (0, 0, "none") and P.snapshot(d.withColumn("stale", F.lit(True))).first().state == "stale"
    u = spark.createDataFrame([("2024-01-01 01:00:00", 3), ("2024-01-01 05:00:00", 4)], "t string, pages int").select(F.col("t").cast("timestamp").alias("ts"), "pages")
    assert [tuple(r) for r in P.quota(u).collect()] == [("2024-01-01", 2, 7)]
    c = spark.createDataFrame([("l", "p", 4), ("l", "p", 0)], "library_id string, path string, chunk_index int")
    assert {(r.chunk_index, r.nth, r.total) for r in P.positions(c).collect()} == {(0, 1, 2), (4, 2, 2)}
