"""The folder that a job's executors share, and tables stored there."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset and everything runs in one process, one in the
    working directory is set; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.abspath("spark-warehouse/shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: its lineage ends here, and a lost executor costs no rerun."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df with what value sums to over all rows before it in order (whose values are distinct): sums inside ranges of the
    order, which are stored once, and of the ranges before; no task sees all rows."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    rows = stored(ranged, "ranged")
    sums = rows.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__base"))  # one row a partition
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn(out, F.coalesce(inside, F.lit(0))).join(F.broadcast(bases), F.col("__part") == F.col("__p"))
    return rows.withColumn(out, F.col(out) + F.col("__base")).drop("__part", "__p", "__base")


def give_back() -> None:
    """For the end of a task in Python: workers live on, so what they freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers name it."""
    at, files = _place(spark, path)
    return files.makeQualified(at).toString()


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _place(spark, path)
    return files.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none if it isn't there."""
    at, files = _place(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()) if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, files = _place(spark, path)
    files.delete(at, True)
