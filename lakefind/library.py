"""Libraries of files on shared storage: rounds of indexing, search, duplicates, links, reports, archives.

A round lists the folder without opening a file, opens the files whose size or time differ, and writes a segment: the rows of what it made, and which
files' older rows don't count any more. Publishing is an entry in a log of generations, made by compare and swap: of two rounds from one state one
wins and the other begins again. A round without anything to do publishes nothing. Texts are stashed by content as they are extracted, so a round that
died doesn't cost them again. Failures are rows of the manifest and never end a round.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import advice, archive, catalog, chunking, conversion, integrity, links, near_duplicates, search, selection
from .functions.text import tokens
from .generations import Conflict, Log
from .segments import KEY, Segments
from .storage import staged
from .sources import extract, folder as folders, pdf

FILES = "library_id string, path string, size long, mtime_ns long, content_hash string, status string, failure_state string, extractor_id string, chunk_ids array<string>, targets array<string>, signature string, missing_pages array<int>, missing_reason string"
TABLES = {
    "files": FILES,
    "texts": "library_id string, path string, text string",
    "chunks": "library_id string, path string, chunk_index int, total_chunks int, section_id string, heading string, id string, text string, embedded string, anchor string",
    "sections": "library_id string, path string, section_id string, heading string, chunk_count long, text string",
    "vectors": "library_id string, path string, id string, v array<double>",
    "postings": "library_id string, path string, term string, id string, tf long, dl int, bucket int",
    "lengths": "library_id string, path string, id string, dl int",
}
#: Folders that postings lie in by a hash of their terms; files of a wave of extraction; seconds that data no newest entry names is kept for readers.
BUCKETS, WAVE, RETAIN = 64, 5000, 24 * 3600
STASH = f"{extract.TEXT_ROW}, image_pages array<int>, route string, written timestamp"
#: Versions of what makes chunks and texts: another one makes a library anew.
SIGNATURES = {"chunker": "1", "cleaning": "1"}

RULES = "library_id string, selection_in array<string>, selection_out array<string>, exclude_dirs array<string>, exclude_files array<string>, exclude_patterns array<string>, enabled_extensions array<string>, new_file_default string"

Embed = Callable[[Column], Column]


def bucket(term: str = "term") -> Column:
    """The folder of a term's postings."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Library:
    def __init__(self, spark: SparkSession, root: str, library_id: str, embed: Embed, providers: list[extract.Provider] | None = None):
        """embed: text to a vector column; a pandas UDF in practice."""
        self.spark, self.root, self.id, self.embed = spark, f"{root.rstrip('/')}/{library_id}", library_id, embed
        self.providers = providers if providers is not None else [extract.PLAIN, extract.DOCX, pdf.PDF]

    # storage

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.root}/log")

    @property
    def segments(self) -> Segments:
        return Segments(self.spark, f"{self.root}/segments", TABLES)

    def state(self) -> dict:
        """The newest published entry; empty before the first round."""
        return self.log.newest()

    def table(self, name: str, generation: int | None = None) -> DataFrame:
        e = self.state() if generation is None else self.log.entry(generation) or {}
        return self.segments.read(name, e.get("segments", []), records=name == "files")

    def signatures(self) -> dict[str, str]:
        return SIGNATURES | {f"extractor:{e}": ",".join(f"{p.name}:{p.version}" for p in self.providers if p.active and e in p.formats) for e in sorted({e for p in self.providers for e in p.formats})}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    # rounds

    def index(self, folder: str, rules: DataFrame, full: bool = False, allowed: list[str] | None = None, tries: int = 3) -> dict:
        """One round over the files of a folder; what was done with how many. A folder that is gone is skipped, its index stays."""
        fs, path = self._fs(folder)
        if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
            return {"skipped": "missing"}
        base = fs.getFileStatus(path).getPath().toString().rstrip("/")
        while True:
            try:
                return self._round(base, rules, full, allowed)
            except Conflict:
                tries -= 1
                if tries <= 0:
                    raise

    def _round(self, base: str, rules: DataFrame, full: bool, allowed: list[str] | None) -> dict:
        parent = self.state()
        old_segments = parent.get("segments", [])
        signature = json.dumps(self.signatures())
        drift = parent.get("signatures", self.signatures()) != self.signatures()
        name = self.segments.new()
        work = f"{self.root}/work/{name}"
        try:
            seen, actions = self._planned(base, rules, work, parent, full, drift, allowed)
            todo = self._kept(catalog.needs(actions, force_chunks=full or drift, force_extract=full), f"{work}/actions")
            done = catalog.report(todo).first()
            report = (done.asDict() if done else {"library_id": self.id}) | {"generation": parent.get("generation", 0)}
            # rows of files that are made or go; and records of files whose content is as it was, but not their size or time
            out = todo.filter("action in ('removed', 'excluded')").select(*KEY).join(self.table("files").select(*KEY), KEY, "left_semi")
            gone = todo.filter("needs_chunks").select(*KEY).unionByName(out)
            touched = seen.filter("touched").join(todo.filter("action = 'unchanged' and not needs_chunks").select(*KEY), KEY, "left_semi")
            if parent and gone.isEmpty() and touched.isEmpty() and not drift:
                return report | self._statuses()
            segment = self._made(name, seen, todo, touched, gone, signature, base, old_segments)
            lasting = [] if full and allowed is None else old_segments
            stats = self._lexical_stats(parent if lasting else {}, segment, gone)
            listed = self.segments.merged([*lasting, segment], {"postings": "bucket"}, {"files"})
            entry = self.log.append(parent, {"segments": listed, "signatures": self.signatures(), "lexical": stats, "folder": base, "rules": [json.loads(x) for x in rules.filter(F.col("library_id") == self.id).toJSON().collect()]})
        finally:
            f, p = self._fs(work)
            f.delete(p, True)
        self._settle(entry)
        return report | {"generation": entry["generation"]} | self._statuses()

    def _kept(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _planned(self, base: str, rules: DataFrame, work: str, parent: dict, full: bool, drift: bool, allowed: list[str] | None) -> tuple[DataFrame, DataFrame]:
        """(listing with hashes, actions). Only files that are chosen and whose size or time differ from their record's are opened; others keep their hash."""
        seen = folders.listing(self.spark, base).select("path", "size", "mtime_ns").withColumn("library_id", F.lit(self.id))
        seen = seen.join(catalog.decide(seen.select(*KEY), rules), KEY)
        old = self.table("files")
        was = old.select(*KEY, F.col("size").alias("o_size"), F.col("mtime_ns").alias("o_mtime"), F.col("content_hash").alias("o_hash"))
        same = F.coalesce((F.col("size") == F.col("o_size")) & (F.col("mtime_ns") == F.col("o_mtime")) & F.col("o_hash").isNotNull(), F.lit(False))
        seen = self._kept(seen.join(was, KEY, "left").withColumn("touched", ~same & F.col("o_size").isNotNull()).withColumn("open", ~same & F.col("included")), f"{work}/seen")
        found = self._kept(folders.hashes(seen.filter("open"), base), f"{work}/hashes")
        seen = seen.join(found, "path", "left").withColumn("content_hash", F.when(F.col("open"), F.col("content_hash")).otherwise(F.col("o_hash"))).withColumn("signature", F.lit(json.dumps(self.signatures())))
        seen = self._kept(seen.select(*KEY, "size", "mtime_ns", "content_hash", "included", "reason", "touched", "signature"), f"{work}/listing")
        return seen, catalog.plan(seen, old, rebuild=F.lit(full or drift), allowed=allowed, rebuild_failed=full)

    def _texts(self, fresh: DataFrame, base: str, name: str) -> DataFrame:
        """Texts of files, from the stash where it has them; what is extracted goes there wave by wave."""
        cache = self._stash()
        known = cache.filter("text is not null").select("content_hash", "route", "text", "image_pages").dropDuplicates(["content_hash", "route"])
        waves, out = max(1, -(-fresh.count() // WAVE)), None
        ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
        routes = F.create_map(*(x for p in self.providers for x in (F.lit(p.name), F.lit(f"{p.name}:{p.version}")))) if self.providers else F.create_map().cast("map<string,string>")
        lookup = self.spark.createDataFrame([(e, f"{p.name}:{p.version}", p.name, n) for n, p in enumerate(self.providers) if p.active for e in p.formats], "ext string, route string, provider string, n int")
        have = fresh.withColumn("ext", ext).join(F.broadcast(lookup), "ext").join(known, ["content_hash", "route"])
        have = have.groupBy(*KEY, "content_hash").agg(F.min_by(F.struct("text", "provider", "image_pages"), "n").alias("t")).select(*KEY, "content_hash", "t.text", F.lit(None).cast("string").alias("failure_state"), "t.provider", "t.image_pages")
        rest = fresh.join(have.select(*KEY), KEY, "left_anti")
        for w in range(waves):
            part = folders.contents(folders.split(rest, waves, w), base)
            rows = self._extracted(part).withColumn("route", F.try_element_at(routes, F.col("provider"))).withColumn("written", F.current_timestamp())
            made = self._kept(rows, f"{self.root}/stash/{name}-{w}").drop("route", "written")
            out = made if out is None else out.unionByName(made)
        return have.unionByName(out)

    def _extracted(self, files: DataFrame) -> DataFrame:
        """Texts of files, and of PDF files whose text layer is read first the pages that are pictures. Files that have none are left to other providers, if there are any."""
        none = F.lit(None).cast("array<int>").alias("image_pages")
        active = [p for p in self.providers if p.active and "pdf" in p.formats]
        if not active or active[0] is not pdf.PDF:
            return extract.extracted(files, self.providers).select("*", none)
        is_pdf = F.lower("path").endswith(".pdf")
        read = pdf.documents(pdf.classified(pdf.pages(files))).select(*KEY, "content_hash", "text", "failure_state", F.lit(pdf.PDF.name).alias("provider"), "image_pages")
        out = extract.extracted(files.filter(~is_pdf), self.providers).select("*", none)
        if len(active) > 1:
            left = files.join(read.filter("text is null").select(*KEY), KEY, "left_semi")
            read = read.filter("text is not null").unionByName(extract.extracted(left, [p for p in self.providers if p is not pdf.PDF]).select("*", none))
        return out.unionByName(read)

    def _stash(self) -> DataFrame:
        fs, path = self._fs(f"{self.root}/stash")
        whole = [s.getPath().toString() for s in fs.listStatus(path) if fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])] if fs.exists(path) else []
        return self.spark.read.schema(STASH).parquet(*whole) if whole else self.spark.createDataFrame([], STASH)

    def _made(self, name: str, seen: DataFrame, todo: DataFrame, touched: DataFrame, gone: DataFrame, signature: str, base: str, old: list[dict]) -> dict:
        """The new segment: rows of what is read or cut again, marks of what they replace."""
        put = lambda kind, rows, *by: self.segments.write(name, kind, rows.select(*[c.split()[0] for c in TABLES[kind].split(", ")]), *by)
        fresh = seen.select(*KEY, "content_hash").join(todo.filter("needs_source").select(*KEY), KEY, "left_semi")
        texts = self._texts(fresh, base, name)
        # texts that are only cut again come from the published ones
        again = self.segments.read("texts", old).join(todo.filter("needs_chunks and not needs_source").select(*KEY), KEY, "left_semi")
        records = self.segments.read("files", old, records=True)
        known = records.select(*KEY, "content_hash", F.col("extractor_id").alias("provider"), "missing_pages")
        texts = texts.unionByName(again.join(known, KEY).select(*KEY, "content_hash", "text", F.lit(None).cast("string").alias("failure_state"), "provider", F.col("missing_pages").alias("image_pages")))
        texts = self._kept(texts, f"{self.root}/work/{name}/texts")
        full = texts.filter("text is not null").select(*KEY, "text")
        put("texts", full)
        clean = chunking.cleaned(full)
        parts = self._kept(chunking.pieces(clean), f"{self.root}/work/{name}/parts")
        chunks = put("chunks", chunking.anchored(chunking.chunks(parts), clean).withColumnRenamed("chunk_id", "id"))
        put("sections", chunking.sections(parts))
        put("vectors", chunks.select(*KEY, "id", self.embed(F.col("embedded")).alias("v")))
        words = self._kept(chunks.select(*KEY, "id", tokens(F.coalesce("embedded", F.lit(""))).alias("ts")).withColumn("dl", F.size("ts")), f"{self.root}/work/{name}/tokens")
        put("lengths", words)
        post = words.select(*KEY, "id", "dl", F.explode("ts").alias("term")).groupBy(*KEY, "term", "id", "dl").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", bucket())
        put("postings", post.repartition("bucket").sortWithinPartitions("bucket", "term", "id"), "bucket")
        ids = chunks.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda s: s["id"]).alias("chunk_ids"))
        out = links.wikilinks(full).groupBy(*KEY).agg(F.array_sort(F.collect_set("target")).alias("targets"))
        # no provider here recognises pictures, so their pages wait for what can
        pictured = F.size("image_pages") > 0
        lacks = (F.when(pictured, F.col("image_pages")).alias("missing_pages"), F.when(pictured, F.lit("ocr-off")).alias("missing_reason"))
        f = texts.select(*KEY, "failure_state", F.col("provider").alias("extractor_id"), (F.col("text").isNotNull()).alias("ok"), *lacks).join(seen.select(*KEY, "size", "mtime_ns", "content_hash", "signature"), KEY).join(ids, KEY, "left").join(out, KEY, "left")
        none = F.array().cast("array<string>")
        f = f.withColumn("status", F.when(F.col("ok"), "indexed").otherwise("failed")).withColumn("chunk_ids", F.coalesce("chunk_ids", none)).withColumn("targets", F.coalesce("targets", none))
        now = touched.select(*KEY, "size", "mtime_ns", "content_hash")
        moved = records.drop("size", "mtime_ns", "content_hash").join(now, KEY)
        columns = [c.split()[0] for c in FILES.split(", ")]
        put("files", f.select(*columns).unionByName(moved.select(*columns)))
        marks = gone.withColumn("record", F.lit(False)).unionByName(touched.select(*KEY).withColumn("record", F.lit(True)))
        n = self.segments.write(name, "gone", marks).count()
        return {"name": name, "gone": n, "rows": chunks.count()}

    def _lexical_stats(self, parent: dict, segment: dict, gone: DataFrame) -> dict:
        """Chunks and tokens of the library: what was there, without what goes, with what comes. Postings aren't read."""
        total = lambda d: tuple(x or 0 for x in d.agg(F.count(F.lit(1)), F.sum("dl")).first())
        was = parent.get("lexical", {"n": 0, "dl": 0})
        less = total(self.segments.read("lengths", parent.get("segments", [])).join(gone, KEY, "left_semi")) if parent else (0, 0)
        more = total(self.segments.one(segment["name"], "lengths"))
        return {"n": was["n"] - less[0] + more[0], "dl": was["dl"] - less[1] + more[1]}

    def _settle(self, entry: dict) -> None:
        """Stashed texts of published files go; so does data that neither the newest entry nor the one before names, once it is old."""
        stash, fs = self._stash(), self._fs(self.root)[0]
        left = extract.pruned(stash.select("content_hash", "route", "text", "written", *KEY, "failure_state", "provider", "image_pages"), self.table("files", entry["generation"]), F.current_timestamp())
        path = self._fs(f"{self.root}/stash")[1]
        before = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        if before:
            if not left.filter("text is not null").isEmpty():
                self._kept(left.filter("text is not null").select(*[c.split()[0] for c in STASH.split(", ")]), f"{self.root}/stash/left-{uuid.uuid4().hex}")
            for p in before:
                fs.delete(p, True)
        named = {s["name"] for n in self.log.numbers()[-2:] for s in (self.log.entry(n) or {}).get("segments", [])}
        for p in self.segments.unused(named, int((time.time() - RETAIN) * 1000)):
            fs.delete(p, True)

    def _statuses(self) -> dict:
        return {x.status: x["count"] for x in self.table("files").groupBy("status").count().collect()}

    def preview(self, files: dict[str, str], only: str = "") -> DataFrame:
        """What the providers make of files anywhere ({name: folder it lies in}), without touching the index (see extract.preview)."""
        out = None
        for name, folder in files.items():
            one = self.spark.createDataFrame([(self.id, name, None)], "library_id string, path string, content_hash string")
            got = extract.preview(folders.contents(one, folder), self.providers, only)
            out = got if out is None else out.unionByName(got)
        return out

    def sync(self) -> dict:
        """A round over the folder and with the rules of the published one; skipped where none is known or the folder is suddenly empty."""
        e = self.state()
        if "folder" not in e:
            return {"skipped": "never-indexed"}
        if folders.listing(self.spark, e["folder"]).isEmpty() and not self.table("files").isEmpty():
            return {"skipped": "emptied"}
        return self.index(e["folder"], self.spark.createDataFrame([[r.get(c.split()[0]) for c in RULES.split(", ")] for r in e["rules"]], RULES))

    def postings(self) -> DataFrame:
        return self.table("postings")

    def lexical_stats(self) -> DataFrame:
        """(library_id, n_docs, avgdl) from the published entry."""
        s = self.state().get("lexical", {"n": 0, "dl": 0})
        return self.spark.createDataFrame([(self.id, s["n"], s["dl"] / s["n"] if s["n"] else 0.0)], "library_id string, n_docs long, avgdl double")

    # questions

    def failures(self) -> DataFrame:
        """(library_id, failure_state, files) of what couldn't be indexed."""
        return self.table("files").filter("status <> 'indexed'").groupBy("library_id", "failure_state").agg(F.count(F.lit(1)).alias("files"))

    def stats(self) -> DataFrame:
        """(library_id, files, indexed, failed, chunks, newest, searchable) of the published generation."""
        return integrity.library_rows(self.table("files"))

    def drift(self) -> DataFrame:
        have = self.table("vectors").groupBy("library_id").agg(F.count(F.lit(1)).alias("actual"))
        return integrity.drift(self.table("files"), have)

    def duplicates(self, threshold: float = 0.8) -> DataFrame:
        if not 0 < threshold <= 1:
            raise ValueError("a threshold lies above 0 and up to 1")
        return near_duplicates.duplicate_groups(self.table("texts").select("library_id", F.col("path").alias("id"), "text"), threshold)

    def relations(self) -> DataFrame:
        f = self.table("files").filter("status = 'indexed'")
        return links.relations(f.select(*KEY, F.explode("targets").alias("target")), f)

    def conversions(self, pages: DataFrame) -> DataFrame:
        f = self.table("files")
        more = {"failure_reason": "string", "failure_detail": "string", "ocr_pages": "array<int>", "ocr_by": "string"}
        cache = self.table("texts").select(*KEY, F.col("path").alias("text_file"), F.octet_length("text").alias("text_bytes"), F.lit(None).cast("timestamp").alias("text_updated"))
        return conversion.entries(f.select(*KEY), f.select(*KEY, "status", "failure_state", "extractor_id", "missing_pages", "missing_reason", *(F.lit(None).cast(t).alias(c) for c, t in more.items())), cache, pages)

    def export(self, root: str) -> dict:
        v = self.table("vectors").drop("path").join(self.table("chunks").select("id", "path", "chunk_index", "text"), "id")
        return archive.export({"vectors": v, "postings": self.postings().drop("path", "bucket"), "files": self.table("files"), "extracted": self.table("texts")}, {"library_id": self.id, "name": self.id}, root)


class Catalogue:
    """Several libraries asked together."""

    def __init__(self, libraries: Iterable[Library]):
        self.libraries = {x.id: x for x in libraries}

    def chosen(self, names: str = "", exclude: str = "") -> list[Library]:
        """Libraries by a list with commas; empty or all: every one. Unknown names and an empty choice are errors."""
        split = lambda s: [x.strip() for x in s.split(",") if x.strip()]
        want, out = split(names), split(exclude)
        if unknown := [x for x in (*want, *out) if x not in self.libraries and x.lower() != "all"]:
            raise ValueError(f"unknown libraries: {', '.join(unknown)}")
        want = list(self.libraries) if not want or any(x.lower() == "all" for x in want) else list(dict.fromkeys(want))
        left = [self.libraries[x] for x in want if x not in out]
        if not left:
            raise ValueError("no library is left")
        return left

    def _all(self, name: str, libraries: list[Library]) -> DataFrame:
        parts = [x.table(name) for x in libraries]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def sync(self, names: str = "", exclude: str = "") -> dict[str, dict]:
        """Rounds of libraries whose folders have changed; a library that fails doesn't stop the others."""
        out = {}
        for x in self.chosen(names, exclude):
            try:
                out[x.id] = x.sync()
            except Exception as e:  # reported, so that the search goes on with what is published
                out[x.id] = {"error": f"{type(e).__name__}: {e}"}
        return out

    def search(self, queries: DataFrame, names: str = "", exclude: str = "", options: search.Options = search.Options(), formats: DataFrame | None = None, reranker: search.Reranker | None = None, sync: bool = False, rewrite: Callable[[Column], Column] | None = None) -> DataFrame:
        """Results of queries (query_id, text) over libraries, from their stored postings.

        sync: folders that have changed are indexed first. rewrite: queries that find nothing good are asked again in these words."""
        if sync:
            self.sync(names, exclude)
        ls = self.chosen(names, exclude)
        stored = search.Stored(self._all("postings", ls), self._stats(ls), bucket)
        tables = [self._all(n, ls) for n in ("chunks", "vectors", "sections", "files")]

        def asked(q: DataFrame) -> DataFrame:
            q = q.select("query_id", "text", ls[0].embed(F.col("text")).alias("q"))
            return search.search(q, tables[0], tables[1].drop("path"), *tables[2:], options, formats, reranker, stored)

        first = asked(queries)
        return search.second_pass(first, lambda q: asked(q.withColumn("text", rewrite(F.col("text")))), queries) if rewrite else first

    def ask(self, queries: DataFrame, names: str = "", exclude: str = "", options: search.Options | None = None, **how) -> tuple[DataFrame, DataFrame]:
        """(results, advice) of queries: what search finds, folders that have changed indexed first, and what to make of it (query_id, rules, lines)."""
        options = options or search.Options()
        results = staged(self.search(queries, names, exclude, options, **({"sync": True} | how)))
        everything = replace(options, drop=0.0, top_k=1)
        none = queries.join(results.select("query_id").distinct(), "query_id", "left_anti")
        # of queries without results: whether anything was found below the limit
        seen = self.search(none, names, exclude, everything).select("query_id").distinct().withColumn("n", F.lit(1)) if options.drop > 0 else none.limit(0).select("query_id").withColumn("n", F.lit(1))
        empty = none.select("query_id").join(seen, "query_id", "left").select("query_id", F.when(F.col("n") > 0, "all-below-drop-threshold").otherwise("no-score").alias("reason"))
        return results, advice.advise(queries, results, empty, options.top_k, options.body)

    def _stats(self, ls: list[Library]) -> DataFrame:
        out = ls[0].lexical_stats()
        for x in ls[1:]:
            out = out.unionByName(x.lexical_stats())
        return out

    def index(self, folders: dict[str, str], rules: DataFrame, **options) -> dict[str, dict]:
        """Rounds of libraries one after another; one that fails doesn't stop the next."""
        out = {}
        for name, folder in folders.items():
            try:
                out[name] = self.libraries[name].index(folder, rules, **options)
            except Exception as e:  # reported, so that the queue goes on
                out[name] = {"error": f"{type(e).__name__}: {e}"}
        return out

    def granted(self, rows: DataFrame, allowed: DataFrame) -> DataFrame:
        return selection.granted(rows, allowed)


def list_mode(o: search.Options) -> search.Options:
    return replace(o, body=False)
