"""Hybrid search: vectors, reciprocal rank fusion, reranking. Text search is in ranked.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def top_k(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, most: int = 10_000) -> DataFrame:
    """Exact nearest vectors of each query (vectors of unit length), in blocks of about half of most query vectors,
    dealt by id; ids are held to be distinct. Each block is broadcast by itself, and one plan holds them all."""
    n = queries.count()
    blocks = -(-2 * n // most) if n > most else 1
    out = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        scored = vectors.crossJoin(F.broadcast(part)).select("query_id", "doc_id", F.round(dot(F.col("embedding"), F.col("query")), 6).alias("score"))
        best = top_k(scored, k)
        out = best if out is None else out.unionByName(best)
    return out


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: query_id, doc_id, score, n_lists, and where a document was seen first: its list (from 0) and
    rank there. Who orders by score takes ties in the order in which they were first seen: first_list, first_rank, doc_id."""
    rows = None
    for i, ranked in enumerate(lists):
        own = ranked.select("query_id", "doc_id", (1 / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(i).alias("list"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"), F.count(F.lit(1)).alias("n_lists"), F.min(F.struct("list", "rank")).alias("seen")).select(
        "query_id", "doc_id", "score", "n_lists", F.col("seen.list").alias("first_list"), F.col("seen.rank").alias("first_rank"))


def sufficient(fused: DataFrame, least: int = 5, mean: float = 0.02) -> DataFrame:
    return fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score")).withColumn(
        "sufficient", (F.col("n") >= least) & (F.col("mean_score") >= mean))
