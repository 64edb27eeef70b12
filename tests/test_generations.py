"""Publishing by compare and swap, segments against a full rebuild, rounds that open only what changed, the stash, listing."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from lakefind import library as L
from lakefind.generations import Conflict, Log
from lakefind.library import Catalogue, Library
from lakefind.operators import search
from lakefind.sources import extract, folder
from test_rounds import RULES, counted, write


def rules(spark):
    return spark.createDataFrame([("l", [], [], ["out"], [], [], [".md", ".txt"], "follow")], RULES)


def test_one_of_two_writers_wins(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.newest() == {}
    first = log.append({}, {"a": 1})
    assert log.append(first, {"a": 2})["generation"] == 2
    with pytest.raises(Conflict):
        log.append(first, {"a": 3})
    # two who both saw the same state: the step that takes the number decides
    won, both = [], [Log(spark, str(tmp_path / "log")) for _ in range(4)]
    parent = log.newest()

    def write_(w, k):
        try:
            won.append(w.append(parent, {"a": k}))
        except Conflict:
            pass

    ts = [threading.Thread(target=write_, args=(w, k)) for k, w in enumerate(both)]
    for t in ts:
        t.start()
    for t in ts:
        t.join()
    assert len(won) == 1 and log.newest() == won[0] and log.numbers() == [1, 2, 3]
    assert not [n for n in os.listdir(tmp_path / "log") if n.startswith("draft")]


def test_torn_entries_are_passed_over(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    e = log.append({}, {"x": 1})
    (tmp_path / "log" / "2.json").write_text('{"generation": 2, "x"')
    (tmp_path / "log" / "draft-1").write_text("left by a writer that died")
    assert log.newest() == e
    with pytest.raises(Conflict):
        log.append(e, {"x": 2})  # the number is taken, if by a torn entry


def test_rounds_equal_a_rebuild(spark, tmp_path):
    r, src = random.Random(6), str(tmp_path / "src")
    words = ["engine", "garden", "river", "boat", "house", "stone"]
    text = lambda: "# Head\n" + " ".join(r.choice(words) for _ in range(r.randint(3, 60)))
    for i in range(8):
        write(src, f"d{i % 3}/f{i}.md", text())
    lib = Library(spark, str(tmp_path / "index"), "l", counted)
    lib.index(src, rules(spark))
    for step in range(3):
        write(src, f"d0/new{step}.md", text())
        write(src, f"d1/f{1 + 3 * (step % 2)}.md", text() + " changed")
        gone = os.path.join(src, f"d2/f{2 + 3 * step}.md")
        if os.path.exists(gone):
            os.remove(gone)
        got = lib.index(src, rules(spark))
        assert got["added"] == 1 and got["changed"] == 1
    again = Library(spark, str(tmp_path / "again"), "l", counted)
    again.index(src, rules(spark))
    for name in L.TABLES:
        columns = [c.split()[0] for c in L.TABLES[name].split(", ")]
        rows = lambda x: sorted(str(t) for t in x.table(name).select(*columns).collect())  # noqa: B023, E731
        assert rows(lib) == rows(again), name
    assert lib.state()["lexical"] == again.state()["lexical"] and len(lib.state()["segments"]) <= 3
    q = spark.createDataFrame([(1, "engine river"), (2, "stone")], "query_id long, text string")
    found = [sorted(str(t) for t in Catalogue([x]).search(q, options=search.Options(top_k=4)).collect()) for x in (lib, again)]
    assert found[0] == found[1] and found[0]
    ls = [lib]
    stored = search.Stored(lib.postings(), lib.lexical_stats(), L.bucket)
    chunks = lib.table("chunks").select("library_id", F.col("id").alias("doc_id"), F.col("embedded").alias("text"))
    from lakefind.operators import lexical

    want = sorted(str(t) for t in lexical.bm25(q.withColumnRenamed("query_id", "item_id"), chunks, 5).collect())
    assert sorted(str(t) for t in stored.search(q, 5).collect()) == want and ls
    # between the scan of postings and their meeting with the terms there is no exchange
    plan = stored.postings.filter(F.col("bucket").isin([1, 2])).join(F.broadcast(q.select(F.col("text").alias("term"))), "term", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "Exchange hashpartitioning" not in plan


def test_a_round_opens_only_what_changed(spark, tmp_path, monkeypatch):
    src, notes = str(tmp_path / "src"), str(tmp_path / "opened")
    os.makedirs(notes)
    real = folder.opened

    def noted(root, path):
        with open(os.path.join(notes, f"{os.getpid()}-{random.random()}-{path.replace('/', '_')}"), "w"):
            pass
        return real(root, path)

    monkeypatch.setattr(folder, "opened", noted)
    how = lambda rows: rows.mapInPandas(lambda bs: (b.assign(content=[noted(src, p) for p in b["path"]])[["library_id", "path", "content_hash", "content"]] for b in bs), "library_id string, path string, content_hash string, content binary")
    import hashlib

    import pandas as pd

    monkeypatch.setattr(folder, "contents", lambda rows, root: how(rows))
    monkeypatch.setattr(folder, "hashes", lambda rows, root: rows.select("path").mapInPandas(lambda bs: (pd.DataFrame({"path": b["path"], "content_hash": [hashlib.sha256(noted(src, p)).hexdigest() for p in b["path"]]}) for b in bs), "path string, content_hash string"))
    took = lambda: sorted(n.split("-", 2)[2] for n in os.listdir(notes)) if (names := os.listdir(notes)) or not names else []

    def clear():
        for n in os.listdir(notes):
            os.remove(os.path.join(notes, n))

    for n in ("a.md", "b.md", "out/c.md"):
        write(src, n, f"text of {n}")
    lib = Library(spark, str(tmp_path / "index"), "l", counted)
    assert lib.index(src, rules(spark))["added"] == 2
    assert set(took()) == {"a.md", "b.md"}
    clear()
    assert lib.index(src, rules(spark))["unchanged"] == 2 and took() == []
    os.utime(os.path.join(src, "a.md"), ns=(1, 1))
    r = lib.index(src, rules(spark))
    # its time is another, its content isn't: it is hashed, its record is made anew, its chunks stay
    assert r["unchanged"] == 2 and took() == ["a.md"] and r["generation"] == 2
    assert lib.table("files").filter("path = 'a.md'").first().mtime_ns == 1 and lib.table("chunks").count() == 2 and lib.table("files").count() == 2
    clear()
    assert lib.index(src, rules(spark))["generation"] == 2 and took() == []
    write(src, "b.md", "other words now")
    assert lib.index(src, rules(spark))["changed"] == 1 and set(took()) == {"b.md"}


def test_a_round_that_dies_leaves_the_old_state_and_its_texts(spark, tmp_path, monkeypatch):
    src, runs = str(tmp_path / "src"), str(tmp_path / "runs")
    os.makedirs(runs)

    def read(data):
        with open(os.path.join(runs, f"{os.getpid()}-{random.random()}"), "w"):
            pass
        return data.decode()

    lib = Library(spark, str(tmp_path / "index"), "l", counted, [extract.Provider("slow", ("md",), read)])
    write(src, "a.md", "the engine")
    lib.index(src, rules(spark))
    before, n = lib.state(), len(os.listdir(runs))
    write(src, "b.md", "the garden")
    real = L.chunking.cleaned
    monkeypatch.setattr(L.chunking, "cleaned", lambda d: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        lib.index(src, rules(spark))
    assert lib.state() == before and lib.table("files").count() == 1 and len(os.listdir(runs)) == n + 1
    monkeypatch.setattr(L.chunking, "cleaned", real)
    assert lib.index(src, rules(spark))["added"] == 1
    assert len(os.listdir(runs)) == n + 1, "what was extracted isn't extracted again"
    assert lib.table("texts").filter("path = 'b.md'").first().text == "the garden" and lib._stash().count() == 0


def test_a_lost_race_begins_again(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "src")
    write(src, "a.md", "the engine")
    lib, other = (Library(spark, str(tmp_path / "index"), "l", counted) for _ in range(2))
    real, raced = Log.append, []

    def late(self, parent, entry):
        if not raced:
            raced.append(1)
            other.index(src, rules(spark))
        return real(self, parent, entry)

    monkeypatch.setattr(Log, "append", late)
    assert lib.index(src, rules(spark))["generation"] == 1 and lib.log.numbers() == [1] and lib.table("files").count() == 1


def test_listing_takes_filters_down(spark, tmp_path):
    src = str(tmp_path / "src")
    for n in ("a/x.md", "a/b/y.txt", "c/z.md", "c/.hidden.md", "_tmp/q.md", "top.MD"):
        write(src, n, n)
    os.utime(os.path.join(src, "c/z.md"), ns=(5, 5))
    d = folder.listing(spark, src)
    assert sorted(r.path for r in d.collect()) == ["a/b/y.txt", "a/x.md", "c/z.md", "top.MD"]
    assert {r.path: (r.folder, r.extension, r["size"]) for r in d.collect()}["a/b/y.txt"] == ("a/b", ".txt", 9)
    for condition, want in (("folder = 'a'", ["a/x.md"]), ("startswith(folder, 'a')", ["a/b/y.txt", "a/x.md"]), ("extension in ('.md')", ["a/x.md", "c/z.md", "top.MD"]), ("mtime_ns > 5", ["a/b/y.txt", "a/x.md", "top.MD"]), ("folder = 'c' and mtime_ns >= 5", ["c/z.md"]), ("size > 8", ["a/b/y.txt"])):
        assert sorted(r.path for r in d.filter(condition).collect()) == want, condition
    r = folder.FolderReader(src)
    from pyspark.sql.datasource import EqualTo

    assert list(r.pushFilters([EqualTo(("folder",), "a"), EqualTo(("size",), 3)])) == [EqualTo(("size",), 3)]
    assert {p.folder for p in r.partitions()} == {"", "a"} and [x[0] for p in r.partitions() for x in r.read(p)] == ["a/x.md"]


def test_sync_before_search(spark, tmp_path):
    src = str(tmp_path / "src")
    write(src, "a.md", "the engine of the boat")
    cat = Catalogue([Library(spark, str(tmp_path / "index"), "l", counted)])
    assert cat.sync() == {"l": {"skipped": "never-indexed"}}
    cat.libraries["l"].index(src, rules(spark))
    write(src, "b.md", "a garden garden garden")
    q = spark.createDataFrame([(1, "garden")], "query_id long, text string")
    best = lambda **k: [r.path for r in cat.search(q, options=search.Options(top_k=1), **k).collect()]
    assert best() == ["a.md"] and best(sync=True) == ["b.md"]
    for n in ("a.md", "b.md"):
        os.remove(os.path.join(src, n))
    assert cat.sync()["l"] == {"skipped": "emptied"} and best() == ["b.md"]
    odd = spark.createDataFrame([(1, "zzz")], "query_id long, text string")
    assert cat.search(odd, rewrite=lambda t: F.lit("engine")).count() > 0


def test_ask_and_preview(spark, tmp_path):
    src = str(tmp_path / "src")
    write(src, "a.md", "the engine of the boat")
    write(src, "x.docx", "broken")
    lib = Library(spark, str(tmp_path / "index"), "l", counted)
    tried = {r.path: (r.ok, r.chars, r.reason, r.route) for r in lib.preview({"a.md": src, "x.docx": src, "none.md": src, "b.zip": src}).collect()}
    assert tried == {"a.md": (True, 22, None, "text"), "x.docx": (False, 0, "extract-failed", "docx"), "none.md": (False, 0, "unreadable", "text"), "b.zip": (False, 0, "no provider for .zip", "-")}
    assert lib.preview({"a.md": src}, only="docx").first().reason == "no provider for .md" and lib.state() == {}
    lib.index(src, rules(spark))
    write(src, "b.md", "a garden of stones")
    q = spark.createDataFrame([(1, "garden"), (2, "")], "query_id long, text string")
    results, advice = Catalogue([lib]).ask(q, options=search.Options(top_k=2))
    assert "b.md" in {r.path for r in results.collect()} and {r.query_id for r in advice.collect()} == {1, 2}
    nothing = Catalogue([lib]).ask(q, options=search.Options(top_k=2, drop=1.1))
    assert nothing[0].count() == 0 and {r.query_id: r.rules[0] for r in nothing[1].collect()}[1] == "empty-dropped"


def test_pages_that_are_pictures_are_recorded(spark, tmp_path):
    from test_pdf import LINES, content, objects, plain_file, stream

    src = tmp_path / "src"
    src.mkdir()
    picture = {8: stream("/Type /XObject /Subtype /Image /Width 1 /Height 1", b"\0")}
    shown = b"q 600 0 0 800 0 0 cm /Im Do Q"
    file = lambda pages: plain_file(objects(pages, more=picture, xobjects="/Im 8 0 R"))
    (src / "mixed.pdf").write_bytes(file([content(LINES[0]), shown, content(LINES[1])]))
    (src / "scan.pdf").write_bytes(file([shown, shown]))
    (src / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (src / "a.md").write_text("the engine")
    some = spark.createDataFrame([("l", [], [], [], [], [], [".md", ".pdf"], "follow")], RULES)
    lib = Library(spark, str(tmp_path / "index"), "l", counted)
    r = lib.index(str(src), some)
    assert (r["indexed"], r["failed"]) == (2, 2)
    got = {x.path: (x.status, x.failure_state, x.missing_pages, x.missing_reason, x.extractor_id) for x in lib.table("files").collect()}
    assert got == {"mixed.pdf": ("indexed", None, [2], "ocr-off", "pdf-text"), "scan.pdf": ("failed", "scanned", [1, 2], "ocr-off", "pdf-text"), "bad.pdf": ("failed", "extract-failed", None, None, "pdf-text"), "a.md": ("indexed", None, None, None, "text")}
    assert lib.index(str(src), some)["generation"] == 1, "what can be done is the same, so nothing is tried again"
    seen = extract.Provider("pictures", ("pdf",), lambda data: "recognised text")
    more = Library(spark, str(tmp_path / "index"), "l", counted, [*lib.providers, seen])
    assert more.index(str(src), some)["indexed"] == 4
    assert {x.path: x.extractor_id for x in more.table("files").collect()} == {"mixed.pdf": "pdf-text", "scan.pdf": "pictures", "bad.pdf": "pictures", "a.md": "text"}
