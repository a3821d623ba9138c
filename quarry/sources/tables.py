"""Tables: reading the driver's files, and the engine's own tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Logical sources and the endpoints they stand for.
LOGICAL_SOURCES = {
    "fmp_fundamentals": ["income_statement", "balance_sheet", "cash_flow"],
    "yfinance_fundamentals": ["income_statement", "balance_sheet", "cash_flow"],
    "polygon_news": ["news"],
    "polygon_ohlcv": ["ohlcv"],
    "fred_macro": ["DFF", "DGS10", "VIXCLS", "UNRATE", "CPIAUCSL"],
}
# Source types by evidence layer.
LAYERS = {
    "direct": ["polygon_news", "fmp_news", "finnhub_company_news", "fmp_fundamentals", "sec_filing"],
    "macro": ["macro_news", "market_news", "geopolitical_news", "fred_rates", "fred_macro", "gdelt_news", "policy_news"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by symbol: first, largest, least and last value of a day, and how many there were."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))


def long_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long series of closes: the last order of each priority and day."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.max_by("o_totalprice", "o_orderkey").alias("close"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean documents with ticker, source type and reference date. A title is a text's first line."""
    kind = F.element_at(F.array(*map(F.lit, ("polygon_news", "fmp_fundamentals", "fred_macro", "gdelt_news"))), F.expr("cast(doc_id div 20 % 4 + 1 as int)"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("asset_id"), F.col("source").alias("ticker"), kind.alias("source_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("reference_date"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), (F.col("doc_id") % 29 == 0).alias("is_duplicate"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with a publication time (UTC)."""
    minutes = (F.col("asset_id") * 37 % 1440).cast("int")
    return assets(spark, sf_dir).withColumn("published", F.expr("cast(reference_date as timestamp_ntz)") + F.make_dt_interval(mins=minutes))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News as it is stored: Markdown of a header, a source line, the body and references. Some have no source or time."""
    n = news(spark, sf_dir)
    k = F.col("asset_id")
    n = n.select("asset_id", "ticker", "source_type", "reference_date", "title", "body", F.when(k % 37 != 0, F.col("ticker")).alias("source"),
                 F.when(k % 41 != 0, F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published"))
    md = F.concat(F.lit("## "), F.coalesce("ticker", F.lit("")), F.lit(": "), F.col("title"), F.lit("\n*Source: "), F.coalesce("source", F.lit("")), F.lit(" | "), F.coalesce("published", F.lit("")),
                  F.lit(" | Category: news*\n\n"), F.col("body"), F.lit("\n\n## References\n[1] https://example.com/"), k.cast("string"))
    return n.withColumn("content_md", md)


def cases(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Days of a large move: symbol, date, move."""
    move = (F.col("close") - F.col("open")) / F.col("open")
    return bars(spark, sf_dir).filter(F.col("open") != 0).select("symbol", "date", move.alias("move")).filter(F.abs("move") > threshold)


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events: a conversation is a run, its turns are events."""
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("event_seq"), F.col("role").alias("node"),
        (n * 3).alias("latency_ms"), n.alias("input_tokens"), (n % 97).alias("output_tokens"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Non-blank lines of JSON, by schema; bad lines become nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def endpoints(requests: DataFrame, column: str = "source") -> DataFrame:
    """A row per endpoint of each logical source; an unknown name stands for itself."""
    names = F.create_map(*[x for k, v in LOGICAL_SOURCES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return requests.withColumn("endpoint", F.explode(F.coalesce(F.try_element_at(names, F.col(column)), F.array(column))))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Last writer wins by key: rows of changes replace those of current."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "__new")


def superset_check(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys of source target lacks, and how many it has besides."""
    s, t = source.select(*keys).distinct(), target.select(*keys).distinct()
    return s.join(t, keys, "left_anti").agg(F.count(F.lit(1)).alias("missing")).crossJoin(
        t.join(s, keys, "left_anti").agg(F.count(F.lit(1)).alias("extra")))  # one row each
