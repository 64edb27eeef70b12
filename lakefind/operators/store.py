"""Tables of vectors and of postings in generations: a folder for each, of which those with a commit marker count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lexical

#: Kinds of tables and their columns.
VECTORS = "library_id string, id string, v array<float>, text string, path string, chunk_index int, section_id string, heading string, gone boolean"
POSTINGS = "library_id string, term string, id string, tf long, dl int"
LENGTHS = "library_id string, id string, dl int"
#: A segment is merged with the others once there are so many.
SEGMENTS = 3


def _path(spark: SparkSession, *names: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(names))


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def segments(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the whole segments, oldest first. A missing or unreadable store has none."""
    p = _path(spark, root)
    fs = _fs(spark, p)
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(x.getName()) for x in names if x.getName().isdigit() and fs.exists(_path(spark, x.toString(), "_SUCCESS")))


def _next(spark: SparkSession, root: str) -> str:
    return f"{root}/{max(segments(spark, root), default=0) + 1}"


def upsert(rows: DataFrame, root: str) -> None:
    """Rows of VECTORS (without gone) as a new segment; they hide older rows of the same id."""
    rows.withColumn("gone", F.lit(False)).write.mode("overwrite").partitionBy("library_id").parquet(_next(rows.sparkSession, root))


def delete(ids: DataFrame, root: str) -> None:
    """(library_id, id) as a segment of marks that hide older rows."""
    spark = ids.sparkSession
    types = dict(x.split() for x in VECTORS.split(", "))
    gone = ids.select("library_id", "id", *(F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in ("library_id", "id", "gone")), F.lit(True).alias("gone"))
    gone.write.mode("overwrite").partitionBy("library_id").parquet(_next(spark, root))


def vectors(spark: SparkSession, root: str, library: str | None = None) -> DataFrame:
    """The newest row of each id that isn't gone; of one library only its folders are read."""
    parts = None
    for n in segments(spark, root):
        d = spark.read.schema(VECTORS).parquet(f"{root}/{n}").withColumn("__n", F.lit(n))
        d = d if library is None else d.filter(F.col("library_id") == library)
        parts = d if parts is None else parts.unionByName(d)
    if parts is None:
        return spark.createDataFrame([], VECTORS).drop("gone")
    w = W.partitionBy("library_id", "id").orderBy(F.desc("__n"))
    return parts.withColumn("__r", F.row_number().over(w)).filter("__r = 1 and not gone").drop("__r", "__n", "gone")


def by_ids(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    return vectors(spark, root).join(ids.select("library_id", "id").distinct(), ["library_id", "id"], "left_semi")


def compact(spark: SparkSession, root: str, force: bool = False) -> bool:
    """Merge all segments into one if there are SEGMENTS or more; the older ones go once the new one is whole."""
    old = segments(spark, root)
    if len(old) < (1 if force else SEGMENTS):
        return False
    vectors(spark, root).withColumn("gone", F.lit(False)).write.mode("overwrite").partitionBy("library_id").parquet(_next(spark, root))
    for n in old:
        p = _path(spark, root, str(n))
        _fs(spark, p).delete(p, True)
    return True


def live(referenced: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missing, prunable) of (library_id, generation): what manifests name but isn't there, and what no manifest names."""
    keys = ["library_id", "generation"]
    return referenced.select(*keys).distinct().join(existing, keys, "left_anti"), existing.select(*keys).distinct().join(referenced, keys, "left_anti")


class LexicalStore:
    """Postings of a corpus written once, sorted by term, and searched many times. A missing or broken store is an empty one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def save(self, docs: DataFrame) -> None:
        """docs (library_id, doc_id, text), each tokenised once."""
        t = docs.select("library_id", F.col("doc_id").cast("string").alias("id"), lexical.tokens(F.coalesce("text", F.lit(""))).alias("ts"))
        t = t.withColumn("dl", F.size("ts"))
        t.write.mode("overwrite").parquet(f"{self.root}/tokens")
        t = self.spark.read.parquet(f"{self.root}/tokens")
        t.select("library_id", "id", "dl").write.mode("overwrite").parquet(f"{self.root}/lengths")
        p = t.select("library_id", "id", "dl", F.explode("ts").alias("term")).groupBy("library_id", "term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
        # sorted files let a search skip what its terms aren't in
        p.select("library_id", "term", "id", "tf", "dl").repartitionByRange("term", "id").sortWithinPartitions("term", "library_id", "id").write.mode("overwrite").parquet(f"{self.root}/postings")

    def _read(self, name: str, schema: str) -> DataFrame:
        p = _path(self.spark, self.root, name, "_SUCCESS")
        if not _fs(self.spark, p).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def lengths(self) -> DataFrame:
        return self._read("lengths", LENGTHS)

    def search(self, queries: DataFrame, top_k: int, active: DataFrame | None = None) -> DataFrame:
        """As lexical.bm25; active (library_id, id): the documents that count."""
        q = lexical.query_terms(queries)
        p, n = self.postings(), self.lengths()
        if active is not None:
            p, n = p.join(active, ["library_id", "id"], "left_semi"), n.join(active, ["library_id", "id"], "left_semi")
        terms = q.select("term").distinct()
        small = terms.limit(lexical.TERMS + 1).count() <= lexical.TERMS
        sent = F.broadcast if small else lambda d: d
        s = n.groupBy("library_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
        return lexical.ranked(q, p.join(sent(terms), "term", "left_semi"), s, top_k, sent)
