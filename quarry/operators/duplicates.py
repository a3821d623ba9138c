"""Groups of duplicates across sources: articles of one address, or of one title and ticker less than some hours apart, and
all that such links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import evidence
from quarry.sources import shared


def connected(links: DataFrame) -> DataFrame:
    """node, group (the least node it reaches), for every node of links (a, b). Rounds of two steps on edges from larger
    to smaller nodes: neighbours above a node hang on to its least neighbour, then all of its neighbours do. A node's
    edges are never gathered, and each step is stored; rounds grow with the logarithm of the nodes."""

    def hung(edges: DataFrame, above: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))) if above else edges
        least = both.groupBy(F.col("high").alias("node")).agg(F.least(F.min("low"), F.first("high")).alias("least"))
        met = both.join(least.repartition(F.xxhash64("node")), F.col("high") == F.col("node"))
        moved = met.filter("low > node").select(F.col("low").alias("high"), F.col("least").alias("low")) if above else met.select(F.col("low").alias("high"), F.col("least").alias("low")).unionByName(
            least.select(F.col("node").alias("high"), F.col("least").alias("low")))
        return shared.stored(moved.filter("high <> low").distinct(), "edges")

    edges = shared.stored(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high <> low").distinct(), "edges")
    seen = None
    while True:
        edges = hung(hung(edges, True), False)
        # A sum over hashes tells whether the edges are still the same.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("high").alias("node"), F.col("low").alias("group")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("group")).distinct())


def within(rows: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """keys, at, near: how many rows of the keys lie less than some seconds from each second that has one (itself
    included). Rows are counted by second, seconds lie in buckets, and a bucket is asked for the part of it that is near:
    no task sees more than the seconds of three buckets of one key."""
    counts = rows.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.expr(f"at div {seconds} - if(at < 0 and at % {seconds} <> 0, 1, 0)")
    asks = counts.select(*keys, "at", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("side"))
    part = F.to_json(F.struct(*keys))
    held = counts.select(part.alias("key"), bucket.alias("bucket"), F.col("at").alias("place"), "n", F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("side"))
    asked = asks.select(part.alias("key"), (bucket + F.col("side")).alias("bucket"), (F.col("at") + F.col("side") * seconds).alias("place"), F.lit(0).cast("long").alias("n"), "at", "side")
    whole = Window.partitionBy("key", "bucket")
    line = whole.orderBy("place")
    upto, below = F.sum("n").over(line.rangeBetween(Window.unboundedPreceding, 0)), F.sum("n").over(line.rangeBetween(Window.unboundedPreceding, -1))
    near = F.when(F.col("side") == 0, F.sum("n").over(whole)).when(F.col("side") < 0, F.sum("n").over(whole) - upto).otherwise(F.coalesce(below, F.lit(0)))
    found = held.unionByName(asked).withColumn("near", near).filter("side is not null").groupBy("key", "at").agg(F.sum("near").alias("near"))
    return counts.select(*keys, "at", part.alias("key")).join(found, ["key", "at"]).select(*keys, "at", "near")


def _counted(rows: DataFrame, counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a count of theirs, 0 where keys are null. The counts stand apart, so that Spark can split a hot key."""
    right = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("n" if "n" in counts.columns else "near").alias(name))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    return rows.join(right.repartition(F.xxhash64(*(f"__{k}" for k in keys))), on, "left").drop(*(f"__{k}" for k in keys)).na.fill({name: 0})


def duplicate_groups(articles: DataFrame, hours: int = 4) -> DataFrame:
    """A row for each article (asset_id, distinct; url, title, ticker, published, source_type, body): group_id (its group's
    least id, itself if nothing is linked to it), size, n_links (other articles that it is a duplicate of by the rule
    itself), kept (the group's choice by source, time and body). Null addresses, titles and tickers link nothing; a
    null time is near to nothing."""
    rows = shared.stored(articles.select("asset_id", "url", "ticker", "source_type", "published", "body", "title", text.normalized_title(F.col("title")).alias("t"),
                                         F.unix_timestamp(F.col("published").cast("timestamp")).alias("at")), "articles")
    groups = connected(evidence.cross_source_pairs(rows, hours).select(F.col("asset_id").alias("a"), F.col("b_asset_id").alias("b")))
    titled = rows.filter("t is not null and ticker is not null and at is not null")
    placed = rows.select("asset_id", "url", "t", "ticker", "at")
    same = rows.filter("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    placed = _counted(placed, same, ["url"], "by_url")
    placed = _counted(placed, within(titled, ["t", "ticker"], hours * 3600), ["t", "ticker", "at"], "by_title")
    placed = _counted(placed, within(titled.filter("url is not null"), ["url", "t", "ticker"], hours * 3600), ["url", "t", "ticker", "at"], "by_both")
    others = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    degrees = placed.select("asset_id", (others("by_url") + others("by_title") - others("by_both")).alias("n_links"))
    grouped = rows.join(groups, F.col("asset_id") == F.col("node"), "left").withColumn("group_id", F.coalesce("group", "asset_id")).drop("node", "group")
    best = evidence.canonical(grouped, "group_id").select(F.col("asset_id").alias("best"))
    sizes = grouped.groupBy(F.col("group_id").alias("__g")).agg(F.count(F.lit(1)).alias("size"))
    out = grouped.select("asset_id", "group_id").join(sizes.repartition(F.xxhash64("__g")), F.col("group_id") == F.col("__g")).join(degrees, "asset_id")
    return out.join(best, F.col("asset_id") == F.col("best"), "left").select("asset_id", "group_id", "size", "n_links", F.col("best").isNotNull().alias("kept"))
