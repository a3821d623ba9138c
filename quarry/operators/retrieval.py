"""Layered retrieval: prefiltered candidates, two rankings, fusion, reranking, sufficiency and bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.ranked import TextIndex
from quarry.operators.search import dot, fuse
from quarry.operators.vector_index import VectorIndex
from quarry.sources.tables import LAYERS

RRF_K, TOP, RERANKED, LEAST, MEAN = 60, 12, 5, 5, 0.02


def hashed_embedding(query: Column, dim: int) -> Column:
    """A vector without a model: bytes of the text's SHA-256, over and over, from -0.5 to 0.5."""
    digest = F.sha2(query, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5)


def encode(docs: DataFrame, encoder: Callable[[Column], Column], text_col: str = "text", out: str = "embedding") -> DataFrame:
    """docs with a vector by any encoder: an expression, or a pandas UDF over batches of texts."""
    return docs.withColumn(out, encoder(F.col(text_col)))


def resolved_mode(wanted: Column, has_index: Column) -> Column:
    """The mode a search runs in: without an index there is only sql_only; what isn't asked to rerank doesn't."""
    return F.when((wanted == "sql_only") | ~has_index, "sql_only").when(wanted == "rag_rerank", "rag_rerank").otherwise("rag_only")


def looked_up(graded: DataFrame, chunks: DataFrame, missing: str = "[content not found]") -> DataFrame:
    """graded (chunk_id, ...) with the content of its chunk (chunk_id, content), or a text that says there is none."""
    return graded.join(chunks, "chunk_id", "left").withColumn("content", F.coalesce("content", F.lit(missing)))


def candidates(cases: DataFrame, assets: DataFrame, layer: str, days: int = 3) -> DataFrame:
    """Assets that a layer may show a case: of its source types, within days of it, and for direct evidence of its
    ticker. The band is exploded into days, so the join is an equi-join. cases: case_id, ticker, trade_date, query."""
    if layer not in LAYERS:
        raise ValueError(f"no such layer: {layer}")
    wide = cases.withColumn("reference_date", F.explode(F.sequence(F.date_sub("trade_date", days), F.date_add("trade_date", days))))
    pool = assets.filter(F.col("source_type").isin(LAYERS[layer]) & ~F.coalesce("is_duplicate", F.lit(False)))
    on = ["reference_date", "ticker"] if layer == "direct" else ["reference_date"]
    pool = pool if layer == "direct" else pool.drop("ticker")
    return wide.join(pool, on)


def ranked(hits: DataFrame, score: Column, name: str) -> DataFrame:
    """hits (case_id, asset_id) with their place by score, the best first; null where there is no score."""
    order = Window.partitionBy("case_id").orderBy(F.desc_nulls_last(name), "asset_id")
    return hits.withColumn(name, score).withColumn(f"{name}_rank", F.when(F.col(name).isNotNull(), F.row_number().over(order)))


def fused(hits: DataFrame, top: int = TOP) -> DataFrame:
    """The first top of each case by reciprocal rank fusion of fts_rank and vec_rank, with rank and rrf."""
    part = lambda c: F.coalesce(1 / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    rows = hits.filter("fts_rank is not null or vec_rank is not null").withColumn("rrf", F.round(part("vec_rank") + part("fts_rank"), 9))
    order = Window.partitionBy("case_id").orderBy(F.desc("rrf"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("fts_rank"), "asset_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def reranked(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, top: int = RERANKED) -> DataFrame:
    """The first top of each case by a reranker's score (query, body), ties as they were; without one, as they were."""
    rows = hits.withColumn("rerank", F.round(scorer(F.col("query"), F.col("body")), 6) if scorer else F.lit(None).cast("double"))
    order = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("rerank"), "rank")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def hybrid(cases: DataFrame, assets: DataFrame, vectors: DataFrame, layer: str, dim: int = 64, top: int = TOP, mode: str = "rag_rerank") -> DataFrame:
    """A layer's hits: case_id, asset_id, rank, rrf, fts, vec. mode sql_only ranks by date and id instead. vectors: asset_id, embedding."""
    pool = candidates(cases, assets, layer)
    if mode == "sql_only":
        order = Window.partitionBy("case_id").orderBy(F.desc("reference_date"), "asset_id")
        return pool.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumns({"rrf": F.round(1 / F.col("rank"), 9), "fts": F.lit(None).cast("double"), "vec": F.lit(None).cast("double")})
    pool = pool.join(vectors, "asset_id", "left").withColumn("fts0", F.round(text.overlap(F.col("query"), F.col("body")), 6))
    pool = ranked(pool, F.when(F.col("fts0") > 0, F.col("fts0")), "fts")
    pool = ranked(pool, F.round(dot(F.col("embedding"), hashed_embedding(F.col("query"), dim)), 6), "vec")
    return fused(pool, top)


def bookkeeping(hits: DataFrame, cases: DataFrame, layer: str, top: int = TOP) -> DataFrame:
    """A row per case: how many hits the layer gave, whether fewer than asked, their mean, and why the search stopped."""
    counts = hits.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rrf"), 6).alias("mean"))
    rows = cases.select("case_id").join(counts, "case_id", "left").na.fill({"n": 0, "mean": 0.0})
    enough = (F.col("n") >= LEAST) & (F.col("mean") >= MEAN)
    return rows.select("case_id", F.lit(layer).alias("layer"), "n", (F.col("n") < top).alias("shortfall"), "mean", F.when(enough, "sufficiency_reached").alias("stop_reason"))


def prefiltered(cases: DataFrame, texts: TextIndex, vectors: VectorIndex, match: tuple[str, ...], within: tuple[str, str, str], top: int = TOP) -> DataFrame:
    """query_id, doc_id, rank, score: the first top of each case by reciprocal rank fusion of the exact best top vectors and texts that
    its filters let through. cases: query_id (distinct), text, query (a vector) and the columns of the filters. Only ids and
    scores are carried; bodies are joined to what is left. Ties go to what was seen first: vectors, then texts, by rank."""
    lists = [index.search(cases, top, match=match, within=within, **more) for index, more in ((vectors, {"exact": True}), (texts, {}))]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_list", "first_rank", "doc_id")
    return fuse(lists, RRF_K).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "doc_id", "rank", "score")


def kept_places(hits: DataFrame, cases: DataFrame, bodies: DataFrame, scorer: Callable[[Column, Column], Column], top: int = RERANKED) -> DataFrame:
    """The first top of each case's hits (query_id, doc_id, rank, score) by a scorer of its text and the body: place and rerank are
    added, ties stay as they were. bodies: doc_id, body; a hit without one scores 0."""
    rows = hits.join(bodies, "doc_id", "left").join(cases.select("query_id", "text"), "query_id").withColumn("rerank", F.coalesce(F.round(scorer(F.col("text"), F.col("body")), 6), F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "rank")
    return rows.drop("text", "body").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
