"""Search, advice, integrity, conversion, selection, archives, stores, extraction, gate and settings on small inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lakefind import gate, settings
from lakefind.operators import advice, archive, catalog, conversion, integrity, search, selection, store
from lakefind.sources import extract

CHUNKS = "library_id string, path string, chunk_index int, total_chunks int, section_id string, heading string, id string, text string, embedded string, anchor string"


@pytest.fixture(scope="module")
def library(spark):
    rows = []
    for lib, path, n, word in (("l", "long.md", 6, "engine"), ("l", "short.md", 1, "engine"), ("m", "other.md", 1, "engine"), ("l", "gone.md", 1, "engine"), ("l", "dir/sub.md", 1, "weather")):
        for i in range(n):
            t = f"{word} text {i} " + "filler " * i
            rows.append((lib, path, i, n, "s0", "Head", f"{lib}:{path}:{i}", t, f"Head\n{t}", "Head"))
    chunks = spark.createDataFrame(rows, CHUNKS)
    vec = chunks.select("library_id", "id", F.array(F.when(F.contains("text", F.lit("engine")), 1.0).otherwise(0.0), F.lit(0.5), F.col("chunk_index") * 0.01).alias("v"))
    sections = chunks.groupBy("library_id", "path", "section_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    manifest = chunks.select("library_id", "path").distinct().withColumn("status", F.when(F.col("path") == "gone.md", "failed").otherwise("indexed"))
    q = spark.createDataFrame([(1, "engine text", [1.0, 0.5, 0.0]), (2, "nothing known", None)], "query_id long, text string, q array<double>")
    return q, chunks, vec, sections, manifest


def paths(d):
    return [(r.library_id, r.path, r.chunk_index) for r in d.filter("query_id = 1").orderBy("position").collect()]


def test_search(library):
    q, chunks, vec, sections, manifest = library
    got = paths(search.search(q, chunks, vec, sections, manifest, search.Options(top_k=10, backfill=False)))
    assert ("l", "gone.md", 0) not in got and sum(p == "long.md" for _, p, _ in got) == 3 and ("m", "other.md", 0) in got
    one = search.search(q, chunks, vec, sections, manifest, search.Options(top_k=2, backfill=False, folder="dir"))
    assert paths(one) == [("l", "dir/sub.md", 0)]
    formats = chunks.select("library_id").distinct().withColumn("ext", F.lit(".txt"))
    assert paths(search.search(q, chunks, vec, sections, manifest, formats=formats)) == []
    # weak ones go, and nothing at all is said with its reason
    none = search.Options(drop=1.1)
    found = search.candidates(q, chunks, vec, search.active(chunks, manifest), none)
    s = search.scored(found, q, chunks, none)
    r = search.delivered(s, chunks, sections, none)
    assert r.count() == 0 and {(x.query_id, x.reason) for x in search.empty_reasons(q, s, r).collect()} == {(1, "all-below-drop-threshold"), (2, "no-score")}


def test_rerank_fold_and_cut(library):
    q, chunks, vec, sections, manifest = library
    # a reranker that likes the long file
    like = lambda query, text: F.when(F.contains(text, F.lit("filler")), F.length(text) / 100.0).otherwise(0.1)
    sections = sections.withColumn("text", F.when(F.col("path") == "long.md", F.repeat(F.lit("whole section "), 40)).otherwise(F.col("text")))
    rows = search.search(q, chunks, vec, sections, manifest, search.Options(top_k=3), reranker=like).filter("query_id = 1").orderBy("position").collect()
    assert rows[0].path == "long.md" and rows[0].backfilled and rows[0].text.startswith("whole section") and rows[0].folded == 5 and sum(r.path == "long.md" for r in rows) == 1
    cut = search.search(q, chunks, vec, sections, manifest, search.Options(top_k=3, limit=12, backfill=False)).filter("path = 'short.md'").first()
    assert cut.truncated and cut.text == "engine text \n…"


def test_capped_before_the_last_result(spark):
    rows = [("l", "a.md", i, 5, "s0", "", f"a{i}", "t", "t", "") for i in range(5)] + [("l", "b.md", 0, 1, "s0", "", "b0", "t", "t", "")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    s = spark.createDataFrame([(1, "l", r[6], 0.9, i + 1, True) for i, r in enumerate(rows)], "query_id long, library_id string, id string, confidence double, place int, pooled boolean")
    none = spark.createDataFrame([], "library_id string, path string, section_id string, chunk_count long, text string")
    r = search.delivered(s, chunks, none, search.Options(top_k=4)).orderBy("position").collect()
    assert [x.id for x in r] == ["a0", "a1", "a2", "b0"] and r[0].capped and not r[0].folded
    assert not search.delivered(s, chunks, none, search.Options(top_k=3)).first().capped
    assert search.delivered(s, chunks, none, search.Options(top_k=5, body=False)).count() == 5


def test_second_pass(spark):
    first = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.2), (3, "c", 0.3)], "query_id long, id string, confidence double")
    q = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "w")], "query_id long, text string")
    again = spark.createDataFrame([(2, "b2", 0.8), (3, "c2", 0.1), (4, "d2", 0.4)], "query_id long, id string, confidence double")
    asked = []

    def other(weak):
        asked.extend(r.query_id for r in weak.collect())
        return again

    got = {(r.query_id, r.id) for r in search.second_pass(first, other, q).collect()}
    assert sorted(asked) == [2, 3, 4] and got == {(1, "a"), (2, "b2"), (3, "c"), (4, "d2")}


def test_pages(spark):
    p = spark.createDataFrame([("l", "a.pdf", 1, [1.0, 0.0]), ("m", "b.pdf", 2, [0.6, 0.8])], "library_id string, path string, page int, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    assert [(r.path, r.page, r.score) for r in search.navigate(q, p, 2).orderBy("rank").collect()] == [("a.pdf", 1, 1.0), ("b.pdf", 2, 0.6)]


RESULT = "query_id long, library_id string, path string, confidence double, folded int, capped boolean, backfilled boolean"


@pytest.mark.parametrize(
    ("rows", "text", "rule"),
    [
        ([("l", "a.md", 0.2)] * 3, "why?", "all-weak"),
        ([("l", "a.md", 0.8), ("l", "b.md", 0.4)], "why?", "one-strong"),
        ([("l", "a.md", 0.5), ("l", "b.md", 0.4)], "why?", "no-strong"),
        ([("l", "x/a.md", 0.8), ("l", "y/a.md", 0.8)], "why?", "same-name"),
        ([("my-skills", "a.md", 0.8), ("l", "b.md", 0.8)], "why?", "not-notes"),
        ([("l", f"{i}.md", 0.8) for i in range(3)], "why?", "many-strong"),
        ([("l", "a.md", 0.8), ("l", "a.md", 0.8), ("l", "b.md", 0.4)], "why?", "one-file"),
        ([("l", "a.pdf", 0.8), ("l", "b.md", 0.8)], "why?", "binary"),
        ([("l", "a.md", 0.8), ("l", "b.md", 0.8)], "why?", "few"),
        ([("l", f"{i}.md", 0.75 if i < 2 else 0.4) for i in range(3)], "short words", "keywords"),
        ([], "why?", "empty"),
    ],
)
def test_advice(spark, rows, text, rule):
    r = spark.createDataFrame([(1, *x, 0, False, False) for x in rows], RESULT)
    q = spark.createDataFrame([(1, text)], "query_id long, text string")
    none = spark.createDataFrame([], "query_id long, reason string")
    assert advice.advise(q, r, none, 10, defaults=["l"], most=1).first().rules == [rule]


def test_advice_order(spark):
    q = spark.createDataFrame([(1, "why?"), (2, "x")], "query_id long, text string")
    r = spark.createDataFrame([(1, "l", "a.pdf", 0.2, 1, True, False)], RESULT)
    why = spark.createDataFrame([(2, "all-below-drop-threshold")], "query_id long, reason string")
    got = {x.query_id: (x.rules, len(x.lines)) for x in advice.advise(q, r, why, 10, body=False).collect()}
    assert got == {1: (["all-weak", "binary"], 2), 2: (["empty-dropped"], 1)}
    assert advice.advise(q, r, why, 10, body=False, most=9).filter("query_id = 1").first().rules == ["all-weak", "binary", "folded", "capped", "list"]


def test_integrity(spark):
    m = spark.createDataFrame([("a", "x", "indexed", ["1", "2", None]), ("a", "y", "failed", ["3"]), ("b", "x", "indexed", ["1"]), ("c", "x", "failed", None)], "library_id string, path string, status string, chunk_ids array<string>")
    n = spark.createDataFrame([("a", 1), ("b", None), ("c", 0)], "library_id string, actual long")
    c = integrity.drift(m, n)
    assert {(r.library_id, r.expected, r.drift) for r in c.collect()} == {("a", 2, True), ("b", 1, False), ("c", 0, False)}
    point = "point string, signature string, versions array<struct<plugin string, version string>>"
    old = spark.createDataFrame([(lib, *x) for lib in ("a", "b") for x in (("chunker", "1", None), ("extractor:pdf", None, [("p", "1" if lib == "a" else "selected:x"), ("q", "9")]))], f"library_id string, {point}")
    now = spark.createDataFrame([("chunker", "1", None), ("extractor:pdf", None, [("p", "2")])], point)
    d = integrity.signature_drift(old, now)
    assert [tuple(r) for r in d.collect()] == [("a", "extractor:pdf")] and integrity.stale_formats(d).first().ext == "pdf"
    assert {(r.library_id, r.reason) for r in integrity.rebuild_reasons(m, d, c).collect()} == {("a", "signature-upgrade"), ("b", None), ("c", None)}


def test_freshness(spark):
    libs = spark.createDataFrame([(x, x != "gone", x != "new") for x in ("gone", "new", "emptied", "same", "more", "touched", "short")], "library_id string, root_exists boolean, indexed boolean")
    row = lambda lib, p, m=1, inc=True: (lib, p, 1, m, inc, True)
    listing = spark.createDataFrame([row("new", "a"), row("same", "a"), row("same", "z", inc=False), row("more", "a"), row("more", "b"), row("touched", "a", 2), row("short", "a")], "library_id string, path string, size long, mtime_ns long, included boolean, readable boolean")
    man = spark.createDataFrame([(x, "a", 1, 1, False, False) for x in ("gone", "emptied", "same", "more", "touched", "short")], "library_id string, path string, size long, mtime_ns long, retry boolean, outdated boolean")
    counts = spark.createDataFrame([("short", True)], "library_id string, drift boolean")
    none = spark.createDataFrame([], "library_id string, point string")
    f = integrity.freshness(libs, listing, man, none, counts)
    assert {r.library_id: r.reason for r in f.collect()} == {"gone": "missing", "new": "never-indexed", "emptied": "emptied", "same": None, "more": "files", "touched": "contents", "short": "chunks"}
    assert sorted(r.library_id for r in integrity.to_sync(f).collect()) == ["more", "new", "short", "touched"]


def test_plan(spark):
    new = [("in", 1, "h", True, "s"), ("same-stat", 1, "x", True, "s"), ("edit", 2, "n", True, "s"), ("out", 1, "h", False, "s"), ("cold.pdf", 1, "h", False, "s"), ("pages", 1, "h", True, "s2"), ("old-set", 1, "h", True, "s"), ("late", 1, "h", True, "s"), ("empty", 1, "h", True, "s"), ("scan", 1, "h", True, "s2"), ("scan2", 1, "h", True, "s"), ("bad", 1, "h", True, "s")]
    old = [("same-stat", "y", "indexed", None, "s", None, False), ("edit", "o", "indexed", None, "s", None, False), ("cold.pdf", "h", "indexed", None, "s", None, False), ("pages", "h", "indexed", None, "s", [2], False), ("old-set", "h", "indexed", None, "s", None, True), ("late", "h", "deferred", "deferred", "s", None, False), ("empty", "h", "failed", "empty", "s", None, False), ("scan", "h", "failed", "scanned", "s", None, False), ("scan2", "h", "failed", "scanned", "s", None, False), ("bad", "h", "failed", "unreadable", "s", None, False), ("left", "h", "indexed", None, "s", None, False)]
    listing = spark.createDataFrame([("l", p, s, 1, h, i, g) for p, s, h, i, g in new], "library_id string, path string, size long, mtime_ns long, content_hash string, included boolean, signature string")
    manifest = spark.createDataFrame([("l", p, 1, 1, h, st, f, g, mp, o, None) for p, h, st, f, g, mp, o in old], "library_id string, path string, size long, mtime_ns long, content_hash string, status string, failure_state string, signature string, missing_pages array<int>, outdated boolean, missing_reason string")
    a = catalog.plan(listing, manifest, allowed=[".md"]).cache()
    assert {r.path: r.action for r in a.collect()} == {"in": "added", "same-stat": "unchanged", "edit": "changed", "out": "excluded", "cold.pdf": "frozen", "pages": "retried", "old-set": "rebuilt", "late": "retried", "empty": "unchanged", "scan": "retried", "scan2": "unchanged", "bad": "retried", "left": "removed"}
    assert tuple(catalog.report(a).first())[1:] == (1, 2, 1, 3, 4)
    need = {r.path: (r.needs_source, r.needs_chunks) for r in catalog.needs(a, force_chunks=True).collect()}
    assert need["same-stat"] == (False, True) and need["cold.pdf"] == (False, False) and need["in"] == (True, True)
    assert {r.path: r.action for r in catalog.plan(listing, manifest, F.lit(True)).collect()}["same-stat"] == "rebuilt"


def test_conversion(spark):
    inc = spark.createDataFrame([("l", p) for p in ("a.pdf", "b.docx", "c.md", "d.pdf", "e.pdf", "f.pdf", "g.docx")], "library_id string, path string")
    man = spark.createDataFrame([("a.pdf", "indexed", None, None, None, "x", [3], "", [1], "ocr"), ("b.docx", "failed", "scanned", None, None, "x", None, None, None, None), ("d.pdf", "failed", None, "odd", "too-many-pages: 900", "x", None, None, None, None), ("e.pdf", "indexed", None, None, None, "x", None, None, None, None), ("g.docx", "indexed", None, None, None, "w", None, None, None, None)], "path string, status string, failure_state string, failure_reason string, failure_detail string, extractor_id string, missing_pages array<int>, missing_reason string, ocr_pages array<int>, ocr_by string").withColumn("library_id", F.lit("l"))
    cache = spark.createDataFrame([("l", "a.pdf", "t/a", 2048, 1), ("l", "g.docx", "t/g", 10, 1)], "library_id string, path string, text_file string, text_bytes long, text_updated long")
    pages = spark.createDataFrame([("l", "a.pdf", "p", "indexed", [1, 2, 3], 3, "g1", None), ("l", "d.pdf", "p", "partial", [1], 4, "g0", "x")], "library_id string, path string, provider_id string, status string, pages array<int>, page_count int, built_in string, failure_reason string")
    e = conversion.entries(inc, man, cache, pages, generation="g1").cache()
    assert {r.path: (r.text_state, r.text_reason, r.pages_state) for r in e.collect()} == {"a.pdf": ("partial", "ocr-failed", "done"), "b.docx": ("pending", "scanned", "n/a"), "d.pdf": ("failed", "too-many-pages", "partial"), "e.pdf": ("missing", "cache-missing", "none"), "f.pdf": ("pending", "not-indexed", "none"), "g.docx": ("done", None, "n/a")}
    fresh = spark.createDataFrame([("l", "g.docx")], "library_id string, path string")
    s = conversion.summary(e, fresh).first()
    assert (s.text_reused, s.text_new, s.text_missing, s.pages_reused, s.pages_new, s.pages_missing, s.pages_unrecognised) == (1, 1, 4, 1, 1, 2, 1)
    assert [(r.route, r.files) for r in conversion.by_route(e, fresh).collect()] == [("w", 1)]
    lines = {r.path: r.line for r in conversion.catalogue(e).collect()}
    assert lines["a.pdf"].startswith("| a.pdf | pages 3 missing:") and "2.0 KB" in lines["a.pdf"] and lines["a.pdf"].endswith("| 3/3 |")
    assert [r.reason for r in conversion.issues(e).orderBy("place").collect()] == ["not-indexed", "scanned", "too-many-pages", "ocr-failed", "cache-missing"]
    log = spark.createDataFrame([(i, f"line {i} of dir/b.docx: failed") for i in range(5)] + [(9, "e.pdf")], "line_no long, line string")
    got = conversion.log_lines(inc, log).collect()
    assert sorted((r.path, r.line_no) for r in got) == [("b.docx", 2), ("b.docx", 3), ("b.docx", 4), ("e.pdf", 9)]


def test_page_plan(spark):
    row = "library_id string, path string, content_hash string, signature string"
    now = spark.createDataFrame([("l", p, "h", "s") for p in ("new", "same", "again")] + [("l", "edit", "h2", "s")], row)
    old = spark.createDataFrame([("l", "same", "h", "s", "indexed"), ("l", "again", "h", "s", "partial"), ("l", "edit", "h", "s", "indexed"), ("l", "gone", "h", "s", "indexed")], row + ", status string")
    assert {r.path: r.action for r in conversion.page_plan(now, old).collect()} == {"new": "added", "same": "kept", "again": "retried", "edit": "changed", "gone": "removed"}


RULES = "library_id string, selection_in array<string>, selection_out array<string>, exclude_dirs array<string>, exclude_files array<string>, exclude_patterns array<string>, enabled_extensions array<string>, new_file_default string"


@pytest.mark.parametrize(("path", "fault"), [("a/b", None), ("/a", "not relative"), ("C:x", "not relative"), ("~/a", "not relative"), ("a/../b", "blank or dotted part"), ("a//b", "blank or dotted part"), (" ", "empty"), (None, "empty"), ("a\\b/", None)])
def test_paths(spark, path, fault):
    d = spark.createDataFrame([(path,)], "p string")
    assert d.select(selection.path_fault(F.col("p"))).first()[0] == fault
    if fault is None:
        assert d.select(selection.chosen_path(F.col("p"))).first()[0] == "a/b"


def test_selection(spark):
    s = spark.createDataFrame([("l", ["a", "b.pdf"], ["c", "d.docx"])], "library_id string, selection_in array<string>, selection_out array<string>")
    c = spark.createDataFrame([("l", 1, "c", "in"), ("l", 2, "x", "out"), ("l", 3, "x", "in"), ("l", 4, "a", "neutral")], "library_id string, seq int, path string, action string")
    assert tuple(selection.applied(s, c).first())[1:] == (["b.pdf", "c", "x"], ["d.docx"])
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    r = selection.formats_switched(s, arr("pdf", "md"), arr("md", "docx")).first()
    assert (r.selection_in, r.selection_out, r.moved) == (["a"], ["c", "b.pdf"], 2)
    rules = spark.createDataFrame([("l", [], [], ["a/"], [], [], [".md"], "follow")], RULES)
    assert selection.blocked(spark.createDataFrame([("l", "a", "in"), ("l", "b", "in")], "library_id string, path string, action string"), rules).count() == 1
    assert spark.range(1).select(selection.allowed_extensions(arr("PDF", "exe"), arr(".pdf", "docx"))).first()[0] == [".md", ".txt", ".pdf"]


def test_tree(spark):
    rules = spark.createDataFrame([("l", ["d/in"], ["d/out", "x.md"], [], [], [], [".md"], "exclude")], RULES)
    f = spark.createDataFrame([("l", p) for p in ("x.md", "y.md", "d/in/a.md", "d/out/b.md", "d/c.md")], "library_id string, path string")
    top = {r.path: (r.is_dir, r.state, r.files, r.chosen) for r in selection.tree(f, rules).collect()}
    assert top == {"x.md": (False, "out", 1, 0), "y.md": (False, "auto_out", 1, 0), "d": (True, "auto_in", 3, 1)}
    assert {r.path: r.state for r in selection.tree(f, rules, "d").collect()} == {"d/in": "in", "d/out": "out", "d/c.md": "auto_out"}


def test_registration(spark):
    rows = [("a", "ok", "/r/A/", ["md"], [], [], []), ("b", "b?d", "/r/a", ["md"], ["pdf"], ["x"], ["x"]), ("c", "n" * 65, "/r/c", [], [], [], [])]
    d = spark.createDataFrame(rows, "library_id string, name string, root_path string, enabled_extensions array<string>, agent_formats array<string>, exclude_dirs array<string>, selection_in array<string>")
    assert {tuple(r) for r in selection.registration_faults(d).collect()} == {("a", "folder taken"), ("b", "folder taken"), ("b", "name"), ("b", "chosen and excluded"), ("b", "grant of a format that is off"), ("c", "name too long")}
    old = spark.createDataFrame([("My Notes!", 1), ("my notes", 2), ("笔记", 3), ("??", 4)], "name string, seq int")
    assert [r.library_id for r in selection.migrated(old).orderBy("seq").collect()] == ["my-notes", "my-notes-2", "笔记", "library"]


def tables(spark):
    v = spark.createDataFrame([("l", f"l:a.md:{i}", "a.md", i, [1.0 * i, 2.0]) for i in range(3)], "library_id string, id string, path string, chunk_index int, v array<float>")
    p = spark.createDataFrame([("l", "word", "l:a.md:0", 1), ("l", "word", "l:lost:0", 1)], "library_id string, term string, id string, tf long")
    f = spark.createDataFrame([("l", "a.md", "indexed", [f"l:a.md:{i}" for i in range(3)], ["pdf"])], "library_id string, path string, status string, chunk_ids array<string>, agent_formats array<string>")
    return {"vectors": v, "postings": p, "files": f}


def test_archive(spark, tmp_path):
    t, root = tables(spark), str(tmp_path / "a")
    archive.export(t, {"library_id": "l", "name": "L"}, root)
    plan = archive.plan_import(spark, root, "new", ["l"])
    assert not plan["taken"] and plan["dropped"] == {"vectors": 0, "postings": 1}
    got = archive.imported(spark, root, "new", ["l"])
    assert sorted(r.id for r in got["vectors"].collect()) == ["new:a.md:0", "new:a.md:1", "new:a.md:2"] and got["postings"].count() == 1
    f = got["files"].first()
    assert f.chunk_ids == ["new:a.md:0", "new:a.md:1", "new:a.md:2"] and f.library_id == "new" and "agent_formats" not in got["files"].columns
    for target in ("l", "a:b", ""):
        with pytest.raises(archive.ArchiveError):
            archive.imported(spark, root, target, ["l"])


def test_archive_faults(spark, tmp_path):
    t = tables(spark)
    for tabs, man in ((t | {"vectors": t["vectors"].limit(0)}, {}), (t | {"odd": t["files"]}, {}), ({"vectors": t["vectors"]}, {}), (t, {"api_key": "x"})):
        with pytest.raises(archive.ArchiveError):
            archive.export(tabs, {"library_id": "l", "name": "L"} | man, str(tmp_path / "x"))
    with pytest.raises(archive.ArchiveError):
        archive.verify(spark, str(tmp_path / "none"))
    for k, change in enumerate(("rows", "refs", "version")):
        root = str(tmp_path / f"b{k}")
        tabs = t | ({"files": t["files"].withColumn("chunk_ids", F.array(F.lit("l:a.md:9")))} if change == "refs" else {})
        archive.export(tabs, {"library_id": "l", "name": "L"}, root)
        if change == "rows":
            t["vectors"].limit(2).write.mode("append").parquet(f"{root}/vectors")
        if change == "version":
            m = spark.read.text(f"{root}/manifest").first().value.replace('"version": 2', '"version": 3')
            archive._write(spark, f"{root}/m2", m)
            archive._write(spark, f"{root}/manifest", m)
        with pytest.raises(archive.ArchiveError):
            archive.verify(spark, root)


def test_store(spark, tmp_path):
    root = str(tmp_path / "v")
    row = lambda i, x: ("l", i, [x], "t", "p", 0, "s0", "")
    cols = ", ".join(c for c in store.VECTORS.split(", ") if not c.startswith("gone"))
    assert store.vectors(spark, root).count() == 0
    store.upsert(spark.createDataFrame([row("a", 1.0), row("b", 1.0)], cols), root)
    store.upsert(spark.createDataFrame([row("a", 2.0)], cols), root)
    assert not store.compact(spark, root)
    store.delete(spark.createDataFrame([("l", "b")], "library_id string, id string"), root)
    want = [("a", [2.0])]
    assert [(r.id, r.v) for r in store.vectors(spark, root, "l").collect()] == want and store.vectors(spark, root, "m").count() == 0
    assert store.compact(spark, root) and len(store.segments(spark, root)) == 1
    assert [(r.id, r.v) for r in store.by_ids(spark, root, spark.createDataFrame([("l", "a"), ("l", "b")], "library_id string, id string")).collect()] == want
    gens = "library_id string, generation long"
    miss, old = store.live(spark.createDataFrame([("l", 1), ("l", 2)], gens), spark.createDataFrame([("l", 2), ("l", 3)], gens))
    assert miss.first().generation == 1 and old.first().generation == 3


def test_lexical_store(spark, tmp_path):
    from lakefind.operators import lexical

    docs = spark.createDataFrame([("l", str(i), f"alpha beta{i % 3} " * (i % 4 + 1)) for i in range(30)] + [("m", "x", None)], "library_id string, doc_id string, text string")
    q = spark.createDataFrame([(1, "alpha beta1"), (2, "beta2")], "item_id long, text string")
    s = store.LexicalStore(spark, str(tmp_path / "lex"))
    assert s.search(q, 5).count() == 0
    s.save(docs)
    want = sorted(tuple(r) for r in lexical.bm25(q, docs, 5).collect())
    assert sorted(tuple(r) for r in s.search(q, 5).collect()) == want and want


def word_file():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Name", "T") + p("Deep", "H5") + p("plain") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + p("end")
    styles = f'<w:styles {w}><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="H5"><w:name w:val="heading 5"/></w:style></w:styles>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    return b.getvalue()


def test_extract(spark):
    rows = [("a.docx", word_file()), ("b.md", b"\xef\xbb\xbfx\r\ny\xff"), ("c.txt", b"  \n"), ("d.docx", b"broken"), ("e.pdf", b"%PDF"), ("f.md", None)]
    d = spark.createDataFrame([("l", p, f"h{p}", None if c is None else bytearray(c)) for p, c in rows], "library_id string, path string, content_hash string, content binary")
    first = extract.Provider("first", ("md",), lambda data: None if data.startswith(b"\xef") else "first")
    got = {r.path: (r.text, r.failure_state, r.provider) for r in extract.extracted(d, [first, extract.PLAIN, extract.DOCX]).collect()}
    assert got["a.docx"][0] == "# Name\n\n### Deep\n\nplain\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nend"
    assert got["b.md"] == ("x\ny�", None, "text") and got["c.txt"] == (None, "empty", "text") and got["d.docx"] == (None, "extract-failed", "docx") and got["e.pdf"] == (None, "extract-failed", None) and got["f.md"][1] == "unreadable"
    cache = spark.createDataFrame([("hb.md", "text:1", "cached")], "content_hash string, route string, text string")
    assert {r.path: r.text for r in extract.extracted(d, [extract.PLAIN], cache).collect()}["b.md"] == "cached"
    assert extract.extracted(d, []).filter("failure_state = 'extract-failed'").count() == 6


def test_routes_and_batches(spark):
    pages = spark.createDataFrame([("l", p, i, "image" if i <= n else "text") for p, n in (("a", 0), ("b", 2), ("c", 9)) for i in range(1, 11)], "library_id string, path string, page int, kind string")
    route = lambda **k: {r.path: (r.route, r.missing_reason) for r in extract.routed(pages, 5, **k).collect()}
    assert route() == {"a": ("text", None), "b": ("ocr", None), "c": ("text", "too-many-pages")}
    assert route(overflow=True)["c"] == ("overflow", None) and route(ocr=False)["b"] == ("text", "ocr-off")
    f = spark.createDataFrame([("l", str(i), p) for i, p in enumerate([3, 4, 5, None, 1, 20, 1, 1, 1])], "library_id string, path string, pages int")
    got = [(r.path, r.batch) for r in extract.batches(f, 3, 8).orderBy("path").collect()]
    assert [b for _, b in got] == [0, 0, 1, 2, 3, 4, 5, 5, 5]


def test_documents(spark):
    listing = spark.createDataFrame([("l", "a/x.md", True, ""), ("l", "b/x.pdf", True, ""), ("l", "y.md", False, "out"), ("l", "z.pdf", True, "")], "library_id string, path string, included boolean, reason string")
    src = spark.createDataFrame([("l", "a/x.md", 1, 1, "h", bytearray(b"live"))], "library_id string, path string, size long, mtime_ns long, content_hash string, content binary")
    cache = spark.createDataFrame([("l", "z.pdf", "cached")], "library_id string, path string, text string")
    assert extract.read_document(listing, src, cache, "l", "a/x.md")["text"] == "live" and extract.read_document(listing, src, cache, "l", "z")["text"] == "cached"
    for path, error in (("x", KeyError), ("none", KeyError), ("y.md", ValueError), ("b/x.pdf", ValueError)):
        with pytest.raises(error):
            extract.read_document(listing, src, cache, "l", path)
    log = spark.createDataFrame([(i, f"l{i}") for i in range(400)], "at long, line string")
    assert extract.tail(log).count() == 300 and [r.at for r in extract.tail(log, 398).collect()] == [398, 399]


def test_gate():
    now = [0.0]
    g = gate.Gate(lambda: now[0])
    t = g.propose({"x": 1})
    with pytest.raises(gate.GateError):
        g.confirm(t.proposal, "0" if t.code != "0" else "1")
    assert g.confirm(t.proposal, t.code) == {"x": 1}
    with pytest.raises(gate.GateError):
        g.confirm(t.proposal, t.code)
    t = g.propose(2, ttl=5)
    now[0] = 6
    with pytest.raises(gate.GateError):
        g.confirm(t.proposal, t.code)
    g.propose(3, ttl=1)
    now[0] = 9
    assert g.sweep() == 1 and g.pending() == 0


def test_settings():
    s = settings.Settings({"n": "5", "b": 1, "f": 2, "l": [1]})
    assert s.get("n", 3) == 3 and s.get("b", True) is True and s.get("f", 1.5) == 2 and s.get("l", []) == [1] and s.get("z") is None
    assert settings.coerce("bool", " On ") is True and settings.coerce("int", "7.0") == 7 and settings.coerce("list", "a, b\nc,") == ["a", "b", "c"] and settings.coerce("float", "1.5", least=1) == 1.5
    for kind, raw, k in (("bool", "maybe", {}), ("int", "1.5", {}), ("int", True, {}), ("text", "x", {"choices": ["y"]}), ("int", "9", {"most": 5})):
        with pytest.raises(ValueError):
            settings.coerce(kind, raw, **k)
    assert settings.shown("list", [1, 2]) == "1, 2" and settings.shown("bool", False) == "off" and settings.shown("text", None) == ""
