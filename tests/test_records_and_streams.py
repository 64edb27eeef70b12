import pytest
from pyspark.sql import functions as F

from lakefind.functions import front_matter as M
from lakefind.functions import records as R
from lakefind.streaming import incremental, progress


def test_front_matter(spark):
    text = "---\ntitle: \"A b\"\naliases: [x, 'y']\ntags:\n  - one\n\n  - two\n!\n  - lost\n---\nbody"
    rows = spark.createDataFrame([(text,), ("---\nopen",), (None,), ("plain",)], "t string").select(M.front_matter("t").alias("f")).select("f.*").collect()
    assert rows[0].meta == {"title": "A b", "aliases": "x, y", "tags": "one, two"} and rows[0].body == "\nbody"
    assert [(r.meta, r.body) for r in rows[1:]] == [({}, "---\nopen"), ({}, None), ({}, "plain")]


def test_pages(spark):
    p = spark.createDataFrame([(5, 0.0, True), (5, 0.0, False), (50, 0.3, True), (500, 0.3, True), (500, 0.1, True)], "c int, v double, i boolean")
    got = p.select(R.page_kind(F.col("c"), F.col("v"), F.col("i")).alias("a"), R.page_kind(F.col("c"), F.col("v"), F.col("i"), True).alias("b")).collect()
    assert [r.a for r in got] == ["image", "blank", "image", "text", "text"] and got[3].b == "image"
    w = spark.createDataFrame([(["Scan  er", "Scan er"],), (["a"],), (["a", "b"],), (["x" * 41] * 2,)], "t array<string>")
    assert [r[0] for r in w.select(R.watermark(F.col("t"))).collect()] == [True, False, False, False]


def test_libraries(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    pick = lambda names, ex, dflt=(): spark.range(1).select(R.chosen_libraries(arr(*names), arr(*ex), arr("a", "b", "c"), arr(*dflt))).first()[0]
    assert pick(["b", "a", "b"], []) == ["b", "a"] and pick(["ALL"], ["b"]) == ["a", "c"] and pick([], [], ["z", "c"]) == ["c"] and pick([], []) == ["a", "b", "c"]
    for names, ex in ((["z"], []), (["a"], ["a"])):
        with pytest.raises(Exception):
            pick(names, ex)


def test_incremental_stream(spark, tmp_path):
    schema = incremental.MANIFEST + ", included boolean, deleted boolean"
    src, root = str(tmp_path / "in"), str(tmp_path / "gen")

    def round_(*rows):
        spark.createDataFrame([("l", p, s, m, h, st, f, inc, d) for p, s, m, h, st, f, inc, d in rows], schema).coalesce(1).write.mode("append").parquet(src)
        incremental.run(spark.readStream.schema(schema).parquet(src), root, str(tmp_path / "cp")).awaitTermination()
        return {r.path: r.content_hash for r in incremental.manifest(spark, root).collect()}

    ok = ("indexed", None, True, False)
    assert round_(("a", 1, 1, "h1", *ok), ("b", 1, 1, "h2", *ok)) == {"a": "h1", "b": "h2"}
    assert round_(("a", 2, 2, "h3", *ok), ("c", 1, 1, "h4", *ok)) == {"a": "h3", "b": "h2", "c": "h4"}
    assert round_(("a", 3, 3, "h5", "failed", "deferred", True, False), ("b", 1, 1, "h2", "indexed", None, True, True), ("c", 1, 2, "h6", "indexed", None, False, False)) == {"a": "h3"}


def test_throttle_stream(spark, tmp_path):
    rows = [("r", f"2024-01-01 00:00:0{s}", v) for s, v in ((0, 1), (1, 2), (9, 3))]
    spark.createDataFrame(rows, "run string, ts string, state int").select("run", F.col("ts").cast("timestamp").alias("ts"), "state").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("run string, ts timestamp, state int").parquet(str(tmp_path / "e"))
    q = progress.throttled(s, ["run"], every="5 seconds").writeStream.format("memory").queryName("throttled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.state, r.n) for r in spark.table("throttled").collect()) == [(2, 2), (3, 1)]
