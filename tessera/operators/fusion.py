"""Hybrid retrieval: reciprocal rank fusion of dense and BM25 hits, reranking, and the relative score filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import search_tokens

#: Fixed value: the rank constant of the fusion.
RRF_K = 60


def reciprocal_rank_fusion(dense: DataFrame, bm25: DataFrame, top_k: int | None = 5, keys: tuple[str, ...] = ("item_id",), rrf_k: int = RRF_K) -> DataFrame:
    """(keys, doc_id, dense_rank, bm25_rank, rrf_score, rank) of two ranked lists with (keys, doc_id, rank).

    Equal sums are common (a document found by one side only); then dense hits come first, by dense rank, and BM25-only
    hits by BM25 rank. ``top_k`` None keeps all.
    """
    left = dense.select(*keys, "doc_id", F.col("rank").alias("dense_rank"))
    right = bm25.select(*keys, "doc_id", F.col("rank").alias("bm25_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(c)), F.lit(0.0))
    both = left.join(right, [*keys, "doc_id"], "full_outer").withColumn("rrf_score", share("dense_rank") + share("bm25_rank"))
    order = Window.partitionBy(*keys).orderBy(F.desc("rrf_score"), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "doc_id")
    ranked = both.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)


def lexical_score(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a pair model: shared distinct terms as a share of the question's."""
    asked = F.array_distinct(search_tokens(question))
    shared = F.size(F.array_intersect(asked, F.array_distinct(search_tokens(text))))
    return shared.cast("double") / F.greatest(F.size(asked), F.lit(1)).cast("double")


def rerank(candidates: DataFrame, score: Column, top_k: int | None = None, keys: tuple[str, ...] = ("item_id",), digits: int = 6) -> DataFrame:
    """Order candidates by ``score`` descending, then by their former rank; ``top_k`` None or 0 keeps all."""
    order = Window.partitionBy(*keys).orderBy(F.desc("rerank_score"), "rank")
    scored = candidates.withColumn("rerank_score", F.round(score, digits))
    ranked = scored.withColumn("rerank_rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rerank_rank") <= top_k) if top_k else ranked


def score_gap(hits: DataFrame, gap: float | None = 6.0, keys: tuple[str, ...] = ("item_id",), score: str = "rerank_score") -> DataFrame:
    """Keep hits whose score is no more than ``gap`` below their question's best; None keeps all."""
    if gap is None:
        return hits
    top = F.max(score).over(Window.partitionBy(*keys))
    return hits.withColumn("__top", top).filter(F.col(score) >= F.col("__top") - gap).drop("__top")
