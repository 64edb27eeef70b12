"""Command line: index, search, read, relations, duplicates, failures, stats, export, verify. Exit code 1 where something is wrong."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashed import hashed
from .library import Catalogue, Library
from .operators import archive, search

RULES = "library_id string, selection_in array<string>, selection_out array<string>, exclude_dirs array<string>, exclude_files array<string>, exclude_patterns array<string>, enabled_extensions array<string>, new_file_default string"


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakefind", description=__doc__)
    p.add_argument("--root", required=True, help="folder of the indexes")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "read", "relations", "duplicates", "failures", "stats", "export", "verify"):
        c = sub.add_parser(name)
        if name != "verify":
            c.add_argument("library", help="library id; for search several with commas, or all")
        if name in ("index", "export", "verify"):
            c.add_argument("folder")
        if name == "search":
            c.add_argument("query")
            c.add_argument("--top-k", type=int, default=10)
            c.add_argument("--folder", default="")
            c.add_argument("--list", action="store_true")
        if name == "read":
            c.add_argument("path")
        if name == "index":
            c.add_argument("--full", action="store_true")
            c.add_argument("--formats", default=".md,.txt,.docx")
            c.add_argument("--exclude", default="", help="folders with commas")
        if name == "duplicates":
            c.add_argument("--threshold", type=float, default=0.8)
    return p


def _shown(d: DataFrame, most: int = 1000) -> None:
    for row in d.toJSON().take(most):
        print(row)


def libraries(spark: SparkSession, root: str) -> list[str]:
    """Ids of the libraries that have an index under root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    a = _arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lakefind").getOrCreate()
    try:
        if a.command == "verify":
            m, _ = archive.verify(spark, a.folder)
            print(json.dumps(m))
            return 0
        if a.command == "search":
            known = Catalogue(Library(spark, a.root, x, hashed) for x in libraries(spark, a.root))
            q = spark.createDataFrame([(0, a.query)], "query_id long, text string")
            r = known.search(q, a.library, options=search.Options(top_k=a.top_k, folder=a.folder, body=not a.list))
            _shown(r.orderBy("position").select("library_id", "path", "chunk_index", "total_chunks", "confidence", "tier", *([] if a.list else ["text"])))
            return 0
        lib = Library(spark, a.root, a.library, hashed)
        if a.command == "index":
            split = lambda s: [x.strip() for x in s.split(",") if x.strip()]
            rules = spark.createDataFrame([(a.library, [], [], split(a.exclude), [], [], split(a.formats), "follow")], RULES)
            r = lib.index(a.folder, rules, full=a.full)
            print(json.dumps(r))
            return 1 if "skipped" in r else 0
        if not lib.state():
            raise ValueError(f"{a.library} has no index")
        if a.command == "read":
            rows = lib.table("texts").filter(F.col("path") == a.path).select("text").take(1)
            if not rows:
                raise ValueError(f"{a.path} has no text")
            print(rows[0].text)
        elif a.command == "export":
            print(json.dumps(lib.export(a.folder)))
        elif a.command == "duplicates":
            _shown(lib.duplicates(a.threshold))
        else:
            _shown({"relations": lib.relations, "failures": lib.failures, "stats": lib.stats}[a.command]())
        return 0
    except (ValueError, KeyError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
