"""Evidence windows, coverage, deduplication and quality of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.sources.tables import LAYERS


def layer(source_type: Column) -> Column:
    out = F.lit("other")
    for name, kinds in LAYERS.items():
        out = F.when(source_type.isin(kinds), name).otherwise(out)
    return out


def scoped(assets: DataFrame, ticker: str, first: str, last: str, layer_name: str = "direct", top: int | None = None) -> DataFrame:
    """The layer's assets in a window of days, scored 1/rank by latest date, then id; the first top of them. Direct
    evidence is the ticker's own; macro evidence is everybody's. Known duplicates are left out."""
    rows = assets.filter(F.col("reference_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("source_type").isin(LAYERS[layer_name])
                         & ~F.coalesce("is_duplicate", F.lit(False)))
    rows = rows.filter(F.col("ticker") == ticker) if layer_name == "direct" else rows
    # Ranks in two steps, so that no window holds all rows: inside a day, and after the later days.
    days = rows.groupBy("reference_date").agg(F.count(F.lit(1)).alias("__n"))
    later = F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("reference_date")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(F.col("reference_date").alias("__day"), later.alias("__later"))  # one row a day
    inside = F.row_number().over(Window.partitionBy("reference_date").orderBy("asset_id"))
    rows = rows.withColumn("__inside", inside).join(days, F.col("reference_date") == F.col("__day"))
    rows = rows.withColumn("rank", F.col("__later") + F.col("__inside")).drop("__inside", "__day", "__later")
    rows = rows.filter(F.col("rank") <= top) if top else rows
    return rows.withColumn("score", 1 / F.col("rank"))


def window_join(cases: DataFrame, assets: DataFrame, days: int = 3, by_ticker: bool = False) -> DataFrame:
    """Band join of cases with assets up to days before or after: the band is exploded, so it is an equi-join."""
    wide = cases.withColumn("reference_date", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))))
    on = ["reference_date", "ticker"] if by_ticker else ["reference_date"]
    return wide.join(assets, on)


def coverage(cases: DataFrame, assets: DataFrame, days: int = 3) -> DataFrame:
    """Documents by layer in each case's window. Assets are counted by day and layer first: a day's documents
    reach the join as one row."""
    daily = assets.groupBy("reference_date", layer(F.col("source_type")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))
    hits = window_join(cases, daily, days).groupBy("symbol", "date").agg(
        *(F.sum(F.when(F.col("layer") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in LAYERS), F.sum("n").alias("n_any"))
    return cases.select("symbol", "date").join(hits, ["symbol", "date"], "left").na.fill(0)


def first_seen(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in order; rows of null key all stay."""
    seen = Window.partitionBy(key).orderBy(*order)
    return rows.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(seen)).filter("__n = 1").drop("__n").unionByName(rows.filter(F.col(key).isNull()))


def hard_duplicates(news: DataFrame) -> DataFrame:
    """How many articles share a fingerprint, and the one that stays."""
    rows = news.select("asset_id", text.fingerprint(F.col("title"), F.col("published")).alias("fp"))
    return rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("kept"))


def cross_source_pairs(articles: DataFrame, hours: int = 4) -> DataFrame:
    """Links of articles of one URL, or of one title and ticker less than some hours apart: an OR split in two. Not all
    pairs of a group, which grow with its square, but enough to connect what they connect: each article with the first
    of its URL, and with the one before it in time of its title and ticker, if that is near enough."""
    a = articles.select("asset_id", "url", "ticker", text.normalized_title(F.col("title")).alias("t"), F.unix_timestamp(F.col("published").cast("timestamp")).alias("at"))
    firsts = a.filter("url is not null").groupBy(F.col("url").alias("__url")).agg(F.min("asset_id").alias("first"))
    by_url = a.join(firsts, F.col("url") == F.col("__url")).filter("first <> asset_id").select(F.col("first").alias("asset_id"), F.col("asset_id").alias("b_asset_id"))
    # Only neighbours in time meet; the line of a title and ticker is ordered by Spark's sort, not gathered.
    line = Window.partitionBy("t", "ticker").orderBy("at", "asset_id")
    by_title = a.filter("t is not null and ticker is not null").select(F.lag("asset_id").over(line).alias("before"), "asset_id", (F.col("at") - F.lag("at").over(line)).alias("gap"))
    by_title = by_title.filter(F.col("gap") < hours * 3600).select(F.least("before", "asset_id").alias("asset_id"), F.greatest("before", "asset_id").alias("b_asset_id"))
    return by_url.union(by_title).distinct()


def canonical(articles: DataFrame, group: str) -> DataFrame:
    """The best of each group: by source priority, then earliest, then longest body."""
    # Source priority; any other source comes last.
    priority = ["polygon_news", "fmp_news", "finnhub_company_news", "gdelt_news"]
    rank = F.lit(len(priority))
    for k, name in enumerate(priority):
        rank = F.when(F.col("source_type") == name, k).otherwise(rank)
    blank = F.col("body").rlike(r"^\s*$")
    return first_seen(articles.withColumns({"__rank": rank, "__blank": blank}), group, ["__rank", "published", F.desc(F.length("body")), "__blank", "asset_id"]).drop("__rank", "__blank")


def quality_flags(articles: DataFrame, least_chars: int = 200, spam: int = 5) -> DataFrame:
    """The first reason against each article (asset_id, title, source, published, body), or null, and the share of six
    checks it passes. Title counts are joined, so that a common title is one row on its side."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    rows = articles.withColumns({"t": text.normalized_title(F.col("title")), "lang": text.language(F.col("body")), "size": F.coalesce(F.length("body"), F.lit(0))})
    counts = rows.filter("t is not null").groupBy(F.col("t").alias("__t")).agg(F.count(F.lit(1)).alias("same"))
    rows = rows.join(counts, F.col("t") == F.col("__t"), "left").na.fill({"same": 0})
    named = [filled(F.col("title")), filled(F.col("published").cast("string")), filled(F.col("source"))]
    reason = (F.when(F.col("size") == 0, "short_text").when(~(named[0] & named[1] & named[2]), "missing_fields").when(F.col("size") < least_chars, "short_text")
              .when(F.col("lang") != "en", "non_target_language").when(F.col("same") >= spam, "template_spam"))
    checks = [F.col("size") >= least_chars, *named, F.col("lang") == "en", F.col("same") < spam]
    return rows.select("asset_id", "ticker", "source_type", reason.alias("reason"), F.round(sum(c.cast("int") for c in checks) / len(checks), 3).alias("score"))


def chunks(assets: DataFrame, splitter=text.sentences) -> DataFrame:
    """Level-1 rows for every asset and level-2 sentences of news. splitter: an expression from a text to an array of
    sentences, or a UDF of that kind."""
    one = assets.select(F.col("asset_id").cast("string").alias("chunk_id"), "asset_id", F.lit("l1").alias("level"), F.lit(0).alias("nth"), F.col("body").alias("content"))
    two = assets.filter("source_type = 'polygon_news'").select("asset_id", F.posexplode(splitter(F.col("body"))).alias("i", "content"))
    two = two.select(F.concat(F.col("asset_id").cast("string"), F.lit("::l2s"), F.lpad((F.col("i") + 1).cast("string"), 4, "0")).alias("chunk_id"),
                     "asset_id", F.lit("l2").alias("level"), (F.col("i") + 1).alias("nth"), "content")
    return one.unionByName(two)


def fallback_reason(n_articles: Column, failures: Column, move: Column, n_good: Column) -> Column:
    return (F.when((n_articles == 0) & (F.abs(move) >= 0.03), "empty_primary_with_big_move").when(failures >= 3, "connectivity_failures")
            .when((n_articles > 0) & (n_good == 0), "all_articles_fail_quality"))
