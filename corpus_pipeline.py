"""A corpus pipeline of the operators: each stage's result is written as Parquet and read as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, jaccard_join, langid, mixing, packing
from quarry.llm.common import crc_bucket, shared_dir
from quarry.llm.queries import vocabulary


#: Rows that Spark hands to a Python worker at once. Texts are long: fewer rows keep both sides' buffers small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told stay."""
    small_batches(spark)
    return langid.keep_known(docs, crc_bucket(F.col("doc_id"), 5) != 0)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or parts of them, as often as their source's target asks for."""
    small_batches(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token stream, cut into windows."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("mixing sources to target weights", mix), ("packing", pack)]

#: Language ID, mixing and packing can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark, "pipeline")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    return out
