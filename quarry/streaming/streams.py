"""Streams over the event log without state of their own: node counts, deduplication, compensated increments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import fingerprint
from quarry.sources import shared


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by window and type, with a watermark for late ones. events: ts (timestamp), event_type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def deduplicated(news: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first article of each fingerprint, whose window bounds the state. news: title, published (timestamp)."""
    return news.withColumn("fp", fingerprint(F.col("title"), F.col("published"))).withWatermark("published", late).dropDuplicatesWithinWatermark(["fp"])


def compensated_sink(path: str, keys: list[str], day: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into a table by day: of a key the later batch counts, and inside a
    batch the row of the largest ``version``. Only the days that a batch touches are written anew, and a batch that is
    repeated leaves the table as it was."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        best = Window.partitionBy(*keys).orderBy(F.desc("version"))
        new = shared.stored(batch.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n"), "increment")
        days = new.select(day).distinct()
        if shared.exists(spark, path):
            old = spark.read.schema(new.schema).parquet(path)
            kept = old.join(days, day, "left_semi").join(new.select(*keys), keys, "left_anti").select(*new.columns)
            new = shared.stored(kept.unionByName(new), "merged")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of each key the row of the latest batch."""
    rows = spark.read.parquet(path)
    best = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n", "batch")


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str) -> None:
    """Runs a stream over what is there and ends; progress is kept in the shared folder."""
    place = shared.folder(stream.sparkSession, "stream-progress")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", place).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def result(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """The result of a stream over what is there: all rows (append), the last state (complete), or each key's last row (update)."""
    spark = stream.sparkSession
    path = shared.folder(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_to_end(stream, write, mode)
    rows = spark.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(path)
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("__last"))  # one row
        return rows.join(F.broadcast(last), F.col("batch") == F.col("__last")).drop("batch", "__last")
    return latest(spark, path, keys) if mode == "update" else rows.drop("batch")


def drained(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Runs a stream over what is there, to Parquet, and ends."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
