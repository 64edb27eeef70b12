"""Ranked lists compared, texts in the order of their lengths, log lines by bytes, values by timers: each against a plain computation."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakefind.operators import comparison, embedding
from lakefind.sources import tail
from lakefind.streaming import timers


def rbo(a, b, k, p):
    x = [len(set(a[:d]) & set(b[:d])) for d in range(1, k + 1)]
    return (1 - p) / p * sum(x[d - 1] / d * p**d for d in range(1, k + 1)) + x[k - 1] / k * p**k


def test_lists_compared(spark):
    r = random.Random(3)
    lists = {q: [r.sample(range(14), r.choice((0, 3, 10, 12))) for _ in "ab"] for q in range(30)} | {40: [list(range(10)), list(range(10))], 41: [[1, 2], [3, 4]]}
    a, b = (spark.createDataFrame([(q, i, n) for q, both in lists.items() for n, i in enumerate(both[k], 1)], "query_id long, id long, rank int") for k in (0, 1))
    got = {x.query_id: x for x in comparison.compared(a, b, 10).collect()}
    for q, (x, y) in lists.items():
        if not x and not y:
            assert q not in got
            continue
        x, y = x[:10], y[:10]
        g = got[q]
        assert (g.n_a, g.n_b, g.common, g.kept, g.top1) == (len(x), len(y), len(set(x) & set(y)), sum(m == n for m, n in zip(x, y, strict=False)), int(bool(x and y) and x[0] == y[0]))
        assert abs(g.rbo - rbo(x, y, 10, 0.9)) < 1e-5
    assert got[40].rbo == 1 and got[41].rbo == 0
    s = comparison.summary(comparison.compared(a, b, 10)).first()
    assert s.queries == len(got) and 0 < s.kept_share < s.common_share < 1
    gold = spark.createDataFrame([(40, 3), (40, 7), (41, 9)], "query_id long, id long")
    rr = {x.query_id: (x["rank"], x.rr) for x in comparison.reciprocal_rank(a, gold, spark.createDataFrame([(40,), (41,), (99,)], "query_id long")).collect()}
    assert rr == {40: (4, 0.25), 41: (None, 0.0), 99: (None, 0.0)}
    side = comparison.side_by_side(a.filter("query_id = 41"), b.filter("query_id = 41")).orderBy("rank").collect()
    assert [(x.a, x.b, x.same) for x in side] == [(1, 3, False), (2, 4, False)]


def test_texts_by_length(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.choice((0, 1, 7, 80, 300, 301, 302, 5000))) for i in range(800)] + [(900, None), (901, "y" * 300_000), (902, "only one")]
    d = spark.createDataFrame(rows, "id long, text string").repartition(5)
    embed = lambda texts: [[float(len(t)), float(t.count("y"))] for t in texts]
    got = {x.id: x.v for x in embedding.embedded(d, embed, padded=4000, texts=16).collect()}
    assert got == {i: None if t is None else [float(len(t)), float(t.count("y"))] for i, t in rows}
    many = spark.createDataFrame([(i, f"{i} " + "z" * r.randint(0, 400)) for i in range(3000)], "id long, text string")
    p = embedding.padding(many, texts=32, padded=16_000).first()
    assert p.texts == 3000 and p.chars <= p.padded <= 1.1 * p.chars and p.batches >= 3000 / 32
    assert list(embedding.packed(iter([9, 9, 5, 1, 1]), 3, 20)) == [2, 3] and list(embedding.packed(iter([]))) == [] and list(embedding.packed(iter([50, 1]), 9, 20)) == [1, 1]
    sizes = sorted((r.randint(0, 60) for _ in range(200)), reverse=True)
    at = 0
    for n in embedding.packed(iter(sizes), 8, 200):
        assert n == 1 or n <= 8 and sizes[at] * n <= 200
        at += n
    assert at == 200


def test_log_lines_by_bytes(spark, tmp_path, monkeypatch):
    spark.dataSource.register(tail.TailSource)
    log, out, r = tmp_path / "log", str(tmp_path / "out"), random.Random(8)
    text = "".join(f"line {i} äöü{'x' * r.randint(0, 90)}\n" for i in range(60)).encode()
    log.write_bytes(b"")

    def step():
        q = spark.readStream.format("lakefind_tail").load(str(log)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return [x.line for x in spark.read.schema("at long, line string").parquet(out).orderBy("at").collect()]

    done = 0
    for cut in [*sorted(r.sample(range(len(text)), 3)), len(text)]:
        with open(log, "ab") as f:
            f.write(text[done:cut])
        done = cut
        assert step() == text[: text[:cut].rfind(b"\n") + 1].decode().splitlines(), "each whole line once"
    log.write_bytes(b"begun anew\n")
    got = [x.line for x in spark.read.parquet(out).collect()]
    step()
    assert sorted(x.line for x in spark.read.parquet(out).collect()) == sorted([*got, "begun anew"])
    monkeypatch.setattr(tail, "PART", 50)
    log.write_bytes(text)
    every = [x for p in tail.parts(0, len(text)) for x in tail.lines(str(log), p.a, p.b)]
    assert [line for _, line in every] == text.decode().splitlines() and all(text[at:].startswith(line.encode()) for at, line in every)


def test_last_lines_and_lines_behind_a_place(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    log = tmp_path / "log"
    log.write_text("".join(f"l{i}\n" for i in range(1000)) + "half")
    read = lambda **o: [x.line for x in spark.read.format("lakefind_tail").options(**o).load(str(log)).orderBy("at").collect()]
    assert read() == [f"l{i}" for i in range(700, 1000)]
    assert read(after=sum(len(f"l{i}\n") for i in range(995))) == [f"l{i}" for i in range(995, 1000)]
    log.write_text("")
    assert read() == []


START = datetime(2024, 1, 1)


def fed(spark, tmp_path, rounds, schema, plan):
    """The rows of a streamed plan after each round of events went in as a file and the stream was started anew."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in rounds:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = plan(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    return spark.read.parquet(out).collect()


@pytest.mark.parametrize("seed", range(2))
def test_throttle_is_the_sequence_of_events(spark, tmp_path, seed):
    r = random.Random(seed)
    at = lambda ms: START + timedelta(milliseconds=ms)
    events = sorted((r.randint(0, 6000), k, f"{k}{n}") for k in "ab" for n in range(40))
    # events come up to a second late; the last round moves time on
    arrival = sorted(events, key=lambda e: e[0] + r.randint(0, 900))
    cut = [arrival[:30], arrival[30:55], arrival[55:]]
    rounds = [[(k, at(ms), v) for ms, k, v in part] for part in cut] + [[("z", at(60_000), "end")], [("z", at(120_000), "end")]]
    got = fed(spark, tmp_path, rounds, "run string, ts timestamp, state string", lambda s: timers.throttled(s, "run", late="2 seconds"))
    for k in "ab":
        last, waiting, want = None, None, []
        mine = [(ms, v) for ms, x, v in events if x == k]
        for ms in range(0, 7000):
            if waiting is not None and ms - last >= 250:
                want.append((at(ms), waiting))
                last, waiting = ms, None
            for t, v in mine:
                if t == ms:
                    if last is None or ms - last >= 250:
                        want.append((at(ms), v))
                        last, waiting = ms, None
                    else:
                        waiting = v
        assert sorted((x["at"], x.state) for x in got if x.run == k) == want and want[-1][1] == mine[-1][1], "the last one isn't lost"


def test_halted_runs_fire_without_an_event(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [("goes", at(0), 1, False), ("halts", at(0), 1, False), ("ends", at(0), 1, False), ("goes", at(50), 2, False), ("halts", at(20), 1, False), ("ends", at(30), 1, True)]
    rounds = [rows, [("goes", at(100), 3, False)], [("other", at(130), 1, False), ("halts", at(125), 5, False)], [("other", at(300), 2, False), ("goes", at(140), 4, True)], [("other", at(301), 3, True)]]
    got = fed(spark, tmp_path, rounds, "run_id string, ts timestamp, done long, ended boolean", lambda s: timers.halted(s, late="5 seconds"))
    assert sorted((x.run_id, x.since, x["at"]) for x in got) == [("halts", at(0), at(60)), ("halts", at(125), at(185)), ("other", at(130), at(190))]
    assert F.lit(1) is not None
