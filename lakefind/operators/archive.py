"""Archives of a library: a folder of Parquet tables with checksums; verified as a whole, imported under another id."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The version that is written, and the newest that is read; entries that must be there; words of keys that may hold credentials.
VERSION, NEEDED = 2, ["vectors", "postings"]
ENTRIES = [*NEEDED, "files", "extracted", "relations", "failures", "pages"]
CREDENTIALS = ["key", "token", "secret", "password", "credential"]


class ArchiveError(ValueError):
    pass


def checksum(d: DataFrame) -> dict:
    """Rows and an order-free checksum of a table, from every column of every row; one row reaches the driver."""
    h = [F.xxhash64(F.lit(seed), *(F.to_json(F.struct(c)) for c in sorted(d.columns))) for seed in (1, 2)]
    r = d.select(*(x.alias(f"h{i}") for i, x in enumerate(h))).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col(f"h{i}").cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"s{i}") for i in range(2))).first()
    return {"rows": r.n, "sum": f"{r.s0}/{r.s1}"}


def _write(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export(tables: dict[str, DataFrame], manifest: dict, root: str) -> dict:
    """Write the tables and a manifest. Empty libraries, unknown entries and keys that look like credentials are refused."""
    bad = [k for k in manifest if any(w in k.lower() for w in CREDENTIALS)]
    if bad:
        raise ArchiveError(f"keys that may hold credentials: {', '.join(sorted(bad))}")
    if set(tables) - set(ENTRIES) or set(NEEDED) - set(tables):
        raise ArchiveError("an archive holds vectors, postings and known entries")
    if tables["vectors"].isEmpty():
        raise ArchiveError("the library is empty")
    spark, sums = tables["vectors"].sparkSession, {}
    for name, d in tables.items():
        d.write.mode("overwrite").parquet(f"{root}/{name}")
        sums[name] = checksum(spark.read.parquet(f"{root}/{name}"))
    out = manifest | {"version": VERSION, "entries": sums, "chunk_count": sums["vectors"]["rows"]}
    _write(spark, f"{root}/manifest", json.dumps(out, sort_keys=True))
    return out


def read_manifest(spark: SparkSession, root: str) -> dict:
    try:
        m = json.loads("\n".join(r.value for r in spark.read.text(f"{root}/manifest").limit(1000).collect()))
    except Exception as e:
        raise ArchiveError("no manifest that can be read") from e
    if not isinstance(m, dict) or not m.get("library_id") or not m.get("name"):
        raise ArchiveError("the manifest names no library")
    if not isinstance(m.get("version"), int) or m["version"] > VERSION:
        raise ArchiveError(f"version {m.get('version')} can't be read")
    if any(x not in ENTRIES for x in m.get("entries", {})) or any(x not in m.get("entries", {}) for x in NEEDED):
        raise ArchiveError("entries are missing, or of unknown names")
    return m


def reference_faults(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, problem): chunks that indexed files name and vectors lack (missing), and the other way round (orphan)."""
    named = files.filter("status = 'indexed'").select(F.explode("chunk_ids").alias("id")).filter("id is not null and id <> ''").distinct()
    have = vectors.select("id").distinct()
    return named.join(have, "id", "left_anti").withColumn("problem", F.lit("missing")).unionByName(have.join(named, "id", "left_anti").withColumn("problem", F.lit("orphan")))


def verify(spark: SparkSession, root: str) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, tables) of an archive whose rows, checksums, vectors and references are right; ArchiveError otherwise."""
    m = read_manifest(spark, root)
    tables = {}
    for name, said in m["entries"].items():
        try:
            tables[name] = spark.read.parquet(f"{root}/{name}")
        except Exception as e:
            raise ArchiveError(f"{name} can't be read") from e
        if checksum(tables[name]) != said:
            raise ArchiveError(f"{name} isn't what was written")
    v = tables["vectors"]
    if m.get("chunk_count") != m["entries"]["vectors"]["rows"]:
        raise ArchiveError("chunk_count isn't the number of vectors")
    bad = v.agg(F.count_if(F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull())).alias("bad"), F.count_distinct(F.size("v")).alias("sizes"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("again")).first()
    if bad.bad or bad.sizes > 1 or bad.again:
        raise ArchiveError("vectors are missing, of several sizes or repeated")
    if "files" in tables and not (faults := reference_faults(tables["files"], v)).isEmpty():
        raise ArchiveError("files and vectors differ: " + ", ".join(f"{r.id} {r.problem}" for r in faults.orderBy("id").limit(3).collect()))
    return m, tables


def id_map(chunks: DataFrame, target: str) -> DataFrame:
    """(id, new_id) for chunks (id, path, chunk_index)."""
    return chunks.select("id", F.concat_ws(":", F.lit(target), "path", F.col("chunk_index").cast("string")).alias("new_id"))


def remapped(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (id, …) under their new ids; rows that the map doesn't know go."""
    return rows.join(ids, "id").withColumn("id", F.col("new_id")).drop("new_id")


def plan_import(spark: SparkSession, root: str, target: str, existing: list[str]) -> dict:
    """What an import would do: counts by entry, rows that would be dropped, and whether the id is taken."""
    m, t = verify(spark, root)
    ids = id_map(t["vectors"], target)
    lost = {n: d.join(ids, "id", "left_anti").count() for n, d in t.items() if "id" in d.columns}
    return {"library_id": target, "from": m["library_id"], "taken": target in existing, "entries": {n: s["rows"] for n, s in m["entries"].items()}, "dropped": lost}


def imported(spark: SparkSession, root: str, target: str, existing: list[str]) -> dict[str, DataFrame]:
    """The tables of a verified archive as those of the library `target`. Grants to agents aren't taken over; an id that is there is refused."""
    if target in existing or ":" in target or not target:
        raise ArchiveError(f"the id {target!r} can't be used")
    _, tables = verify(spark, root)
    ids = id_map(tables["vectors"], target)
    out = {}
    for name, d in tables.items():
        d = remapped(d, ids) if "id" in d.columns else d
        if "chunk_ids" in d.columns:  # a file's chunks keep their order
            each = d.select("path", F.posexplode("chunk_ids").alias("at", "id")).join(ids, "id").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new_id"))), lambda s: s["new_id"]).alias("__ids"))
            d = d.join(each, "path", "left").withColumn("chunk_ids", F.coalesce("__ids", F.array().cast("array<string>"))).drop("__ids")
        d = d.withColumn("library_id", F.lit(target)) if "library_id" in d.columns else d
        out[name] = d.drop("agent_formats")
    return out


def same_tables(a: DataFrame, b: DataFrame) -> bool:
    return checksum(a) == checksum(b)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one listing that the other lacks, with the side they are on; repeated rows count."""
    sides = [a.exceptAll(b).withColumn("side", F.lit("old")), b.exceptAll(a).withColumn("side", F.lit("new"))]
    return reduce(DataFrame.unionByName, sides)
