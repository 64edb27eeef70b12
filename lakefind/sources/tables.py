"""Driver tables and their views as libraries of files: library = source, path = lang/doc_id.md, folder = lang."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes in an Arrow batch, where the session keeps Spark's own number: texts may be long.
ARROW_ROWS, ARROW_BYTES = "1000", "8m"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("library_id"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "doc_id", "lang", "text", "n_chars")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files under root with size, modification time and content hash."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("content_hash"), "content")


def text_documents(listed: DataFrame) -> DataFrame:
    """md and txt files decoded (byte order mark dropped, bad bytes replaced, line ends unified); blank ones are failures."""
    raw = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    text = F.regexp_replace(raw, "\r\n?", "\n")
    blank = F.trim(F.regexp_replace(text, r"\s+", " ")) == ""
    return listed.filter(F.lower("path").rlike(r"\.(md|txt)$")).select("path", "size", "mtime_ns", "content_hash", F.when(~blank, text).alias("text"), F.when(blank, F.lit("empty")).alias("failure_state"))
