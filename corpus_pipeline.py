"""Corpus pipeline over `documents`: each stage's rows are written as Parquet and read back as the next one's input.

Toxic documents go; later copies of line runs are cut out (a document of which nothing is left goes); one document of
each group of near duplicates stays (five words, 0.8); documents that hold benchmark items go; the rest is encoded.

Defined results: rows are judged one by one, not by their id, so a null id is no shelter. Null and empty texts pass every
filter but a toxicity model that rejects them. The same row twice is one document for line dedup, and one of the two stays
after near duplicates, as of any group: the row of the least id, null ids last. Extra columns of the input are dropped; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from lakefind.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL has a trained classifier's decisions.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learnt(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.harmless(docs.select(*COLUMNS), model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup(docs.select(*COLUMNS))
    d = d.filter((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_lines")))
    d = d.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("__kept").cast("long")).otherwise(F.col("n_chars")))
    return d.withColumn("text", F.col("__kept")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.flagged(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter(F.size("__items") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near), ("benchmark decontamination", leaks), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
