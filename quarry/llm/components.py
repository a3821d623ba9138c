"""Connected components by alternating large-star and small-star steps, all of it joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): every u's neighbours v. Large: the larger ones point at the least; small: all of them do."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = pairs.join(apart(least, "u"), "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node it reaches) for every node with a link. Steps grow with the logarithm of the
    number of nodes; each is written to the shared folder."""
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = stored(_star(both, True), "links")
        edges = stored(_star(grown.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "links")
        # Two sums identify the set of edges; they stop changing when every component is a star around its least node.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
