"""Rounds of indexing over a folder, and what is asked of the published index."""

import os

import pytest
from pyspark.sql import functions as F

from lakefind.library import Catalogue, Library
from lakefind.operators import search

WORDS = ("engine", "garden", "river")
RULES = "library_id string, selection_in array<string>, selection_out array<string>, exclude_dirs array<string>, exclude_files array<string>, exclude_patterns array<string>, enabled_extensions array<string>, new_file_default string"


def counted(text):
    """Counts of a few words stand for an embedding."""
    return F.array(*(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("double") for w in WORDS))


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_rounds(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "index")
    write(src, "a.md", "# Notes\nThe engine of the boat. See [[b]].")
    write(src, "sub/b.md", "---\ntitle: Green\n---\nA garden behind the house. " * 2)
    write(src, "c.txt", " \n")
    write(src, "out/d.md", "never read")
    rules = spark.createDataFrame([("l", [], [], ["out"], [], [], [".md", ".txt"], "follow")], RULES)
    lib = Library(spark, root, "l", counted)
    assert lib.table("files").count() == 0
    r = lib.index(src, rules)
    assert (r["added"], r["indexed"], r["failed"], r["generation"]) == (3, 2, 1, 1)
    assert [(x.failure_state, x.files) for x in lib.failures().collect()] == [("empty", 1)] and not lib.drift().first().drift
    rel = {x.path: (x.outlinks, x.inlinks) for x in lib.relations().collect()}
    assert rel == {"a.md": (["sub/b.md"], []), "sub/b.md": ([], ["a.md"])}
    cat = Catalogue([lib])
    q = spark.createDataFrame([(1, "engine"), (2, "garden")], "query_id long, text string")
    best = lambda: {x.query_id: x.path for x in cat.search(q, options=search.Options(top_k=1)).collect()}
    assert best() == {1: "a.md", 2: "sub/b.md"}
    same = lib.index(src, rules)
    assert (same["unchanged"], same["added"], same["changed"]) == (3, 0, 0) and best() == {1: "a.md", 2: "sub/b.md"}
    write(src, "a.md", "# Notes\nThe river now. " * 3)
    write(src, "e.md", "The engine moved here.")
    os.remove(os.path.join(src, "sub/b.md"))
    r = lib.index(src, rules)
    assert (r["added"], r["changed"], r["removed"]) == (1, 1, 1) and best()[1] == "e.md" and lib.stats().first().indexed == 2
    assert lib.index(str(tmp_path / "gone"), rules) == {"skipped": "missing"} and best()[1] == "e.md"
    out = cat.index({"l": src, "zz": src}, rules)
    assert "error" in out["zz"] and out["l"]["unchanged"] == 3
    assert lib.log.numbers() == [1, 2], "rounds without anything to do publish nothing"
    assert lib.export(str(tmp_path / "archive"))["library_id"] == "l"
    pages = spark.createDataFrame([], "library_id string, path string, provider_id string, status string, pages array<int>, page_count int, built_in string, failure_reason string")
    assert lib.conversions(pages).count() == 0 and lib.duplicates().count() == 0
    with pytest.raises(ValueError):
        lib.duplicates(0)
    for names, without in (("zz", ""), ("l", "l")):
        with pytest.raises(ValueError):
            cat.chosen(names, without)
