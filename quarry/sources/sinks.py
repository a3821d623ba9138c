"""Sinks: upserts into stored tables, index and matrix artifacts with manifests, reports, trace exports, digests."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources import shared


def upsert_table(path: str, changes: DataFrame, keys: list[str], version: str | None = None) -> str:
    """The path of a table as it is after changes; readers of the old one keep it. Rows of changes replace those of
    their key; of two with one key in changes the one of the larger version stays, and of equal ones (or without a
    version) the larger row, column by column."""
    spark = changes.sparkSession
    current = spark.read.parquet(path)
    rest = ([version] if version else []) + [c for c in changes.columns if c not in keys and c != version]
    best = changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__row")).select(*keys, "__row.*")
    kept = current.join(best.select(*keys), keys, "left_anti").unionByName(best)
    to = shared.folder(spark, "upsert")
    kept.write.parquet(to)
    return to


def raw_rows(assets: DataFrame) -> DataFrame:
    """Assets as the raw layer stores them: an id of ticker, date, source and version, and metadata as JSON with sorted
    keys. Parquet compresses the content."""
    named = F.sha2(F.concat_ws("|", "ticker", F.col("reference_date").cast("string"), "source_type", F.lit("v1")), 256)
    meta = F.to_json(F.struct(F.length("body").alias("chars"), F.col("source_type").alias("source"), F.col("ticker")))
    return assets.select(named.alias("raw_id"), "asset_id", "ticker", "source_type", "reference_date", F.col("body").alias("content_raw"), meta.alias("metadata_json"))


def write_index(postings: DataFrame, path: str) -> None:
    """The inverted index, replacing the one that was there; a term's postings lie together."""
    postings.repartition("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def matrix_manifest(vectors: DataFrame, dim: int) -> DataFrame:
    """One row about a matrix of vectors (id, embedding): rows, dimension, whether ids are 0 to n - 1 once each, whether
    every row has that dimension and finite values, and a digest that doesn't depend on order."""
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    row = F.crc32(F.concat_ws(",", F.col("id").cast("string"), F.concat_ws(",", F.transform("embedding", lambda x: F.coalesce(F.round(x.cast("double") * 1e6).try_cast("long").cast("string"), F.lit("none"))))))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.lit(dim).alias("dim"), ((F.min("id") == 0) & (F.max("id") == F.count(F.lit(1)) - 1) & (F.countDistinct("id") == F.count(F.lit(1)))).alias("contiguous"),
                       F.coalesce(F.max((F.size("embedding") != dim).cast("int")) == 0, F.lit(True)).alias("right_dim"), F.coalesce(F.min(finite), F.lit(True)).alias("finite"), F.sum(row).alias("digest"))


def position_join(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """The i-th id in order with row i of a matrix. Positions come from counts of ranges, so no task sees all ids."""
    placed = shared.prefix_sums(ids.select("asset_id", F.lit(1).alias("one")), "asset_id", "one", "id")
    return placed.select("asset_id", "id").join(vectors, "id")


def export_runs(runs: DataFrame, events: DataFrame, keys: str = "run_id") -> DataFrame:
    """A run's header with its events, in order, as one JSON text. A run has few events."""
    body = events.groupBy(keys).agg(F.sort_array(F.collect_list(F.struct("event_seq", *[c for c in events.columns if c not in (keys, "event_seq")]))).alias("events"))
    rows = runs.join(body, keys, "left")
    return rows.select(keys, F.to_json(F.struct(*[c for c in runs.columns], F.coalesce("events", F.array()).alias("events"))).alias("json"))


def report_rows(metrics: DataFrame, required: list[str]) -> DataFrame:
    """A report of metrics (config, metric, value) as one JSON text a config, keys sorted; configs that lack a required
    metric are told."""
    packed = metrics.groupBy("config").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
    lacks = F.array_except(F.array(*map(F.lit, required)), F.map_keys("m"))
    return packed.select("config", F.to_json(F.struct(F.col("m").alias("metrics"), F.lit("1.0").alias("schema_version"))).alias("json"), F.array_join(F.array_sort(lacks), ",").alias("missing"))


def report_markdown(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A report's lines as a Markdown table: nth, line."""
    wide = metrics.groupBy("config").pivot("metric", names).agg(F.first("value"))
    cells = [F.coalesce(F.format_string("%.4f", F.col(n)), F.lit("")) for n in names]
    body = wide.select(F.col("config"), F.concat(F.lit("| "), F.concat_ws(" | ", "config", *cells), F.lit(" |")).alias("line"))
    head = metrics.sparkSession.createDataFrame([(0, f"| config | {' | '.join(names)} |"), (1, "|---|" + "---|" * len(names))], "nth int, line string")
    # A report has a row for each configuration.
    return head.unionByName(body.select((F.row_number().over(Window.orderBy("config")) + 1).alias("nth"), "line"))


def digests(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """name (the path below root) and sha256 of each file below a path. root: the path itself, if not given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = shared.qualified(spark, root or path).rstrip("/")
    cut = lambda c: F.expr(f"substring({c}, {len(base) + 2})").alias("name")
    # Spark lists files without content, but doesn't read them.
    listed = [(re.sub("^file:/+", "file:/", unquote(f)),) for f in files.inputFiles()]
    empty = hashlib.sha256(b"").hexdigest()
    read = files.select(cut("path"), F.sha2("content", 256).alias("sha256"))
    return spark.createDataFrame(listed, "path string").select(cut("path")).join(read, "name", "left").select("name", F.coalesce("sha256", F.lit(empty)).alias("sha256"))


def folder_digest(files: DataFrame) -> DataFrame:
    """One digest of a folder's files (name, sha256): over name, NUL, raw digest, NUL of each, in order of names (bytes), and the
    number of files. Such a digest is one chain, so a single task reads the names in order; it keeps none of them."""
    def run(tables):
        digest, n = hashlib.sha256(), 0
        for t in tables:
            for name, sha in zip(*(c.to_pylist() for c in t.columns)):
                digest.update(name.encode() + b"\0" + bytes.fromhex(sha) + b"\0")
            n += t.num_rows
        yield pa.record_batch([pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], ["sha256", "n_files"])

    return files.select("name", "sha256").repartition(1).sortWithinPartitions("name").mapInArrow(run, "sha256 string, n_files long")


def provenance(tables: dict[str, tuple[DataFrame, DataFrame, list[str], str | None]]) -> DataFrame:
    """A row for each table of a copy: rows of the source and the target, distinct keys that the target lacks and has beyond the
    source, whether it lacks none, and the first and last date of the target (null without a date column). Each
    table: source, target, keys, date column. Keys of the two sides meet in one aggregate; null keys are keys."""
    out = None
    for name, (source, target, keys, day) in tables.items():
        date = F.col(day).cast("date") if day else F.lit(None).cast("date")
        sides = source.select(*keys, F.lit(1).alias("s"), F.lit(0).alias("t"), F.lit(None).cast("date").alias("day")).unionByName(target.select(*keys, F.lit(0).alias("s"), F.lit(1).alias("t"), date.alias("day")))
        met = sides.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.min("day").alias("first"), F.max("day").alias("last"))
        row = met.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n_source"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_target"), F.count_if(F.col("t") == 0).alias("missing"), F.count_if(F.col("s") == 0).alias("extra"), F.min("first").alias("first"), F.max("last").alias("last"))
        row = row.select(F.lit(name).alias("name"), "n_source", "n_target", "missing", "extra", (F.col("missing") == 0).alias("superset"), "first", "last")
        out = row if out is None else out.unionByName(row)
    return out
