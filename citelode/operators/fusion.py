"""Fusing, reranking and gating ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.operators.keyword import best_first, top_k
from citelode.operators.layout import Keyed
from citelode.operators.sizing import within


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """``qid, chunk_id, rrf_score, rank`` from rankings of ``qid, chunk_id, rank``."""
    if k <= 0:
        raise ValueError("k must be positive")
    stacked = reduce(
        DataFrame.unionByName, [r.select("qid", "chunk_id", "rank") for r in rankings]
    )
    fused = stacked.groupBy("qid", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf_score")
    )
    return top_k(fused, ["qid"], best_first("rrf_score"), 2**31 - 1)


def hybrid_candidates(dense: DataFrame, sparse: DataFrame, pool: int = 20, k: int = 60) -> DataFrame:
    """Full outer merge of both rankings with all stage scores, best ``pool`` kept."""
    left = dense.select("qid", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    right = sparse.select("qid", "chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    merged = left.join(right, ["qid", "chunk_id"], "full_outer")
    share = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    scored = merged.withColumn("rrf_score", share("dense_rank") + share("sparse_rank"))
    return top_k(scored, ["qid"], best_first("rrf_score"), pool)


def hydrate(
    ranked: DataFrame, chunks: DataFrame | Keyed, columns: list[str], rows: int
) -> tuple[DataFrame, DataFrame]:
    """Text and metadata for ranked ids, and the ids the chunk table lacks. ``rows``
    bounds ``ranked``: queries times pool. From a table laid out by chunk id only the slots of
    the ids are read, and no text is shuffled."""
    if isinstance(chunks, Keyed):
        return chunks.attach(ranked, columns, rows), chunks.missing(ranked, rows)
    known = chunks.select("chunk_id", *columns).join(
        within(ranked.select("chunk_id").distinct(), rows), "chunk_id", "left_semi"
    )
    return ranked.join(known, "chunk_id"), ranked.join(known.select("chunk_id"), "chunk_id", "left_anti")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def lexical_score(query_tokens: Column, chunk_tokens: Column) -> Column:
    """Default rerank provider: share of distinct query tokens the chunk holds, as a
    logit between -4 and 4, through a sigmoid."""
    asked = F.array_distinct(query_tokens)
    share = F.size(F.array_intersect(asked, chunk_tokens)) / F.greatest(F.size(asked), F.lit(1))
    return sigmoid(8 * share - 4)


def gate(scored: DataFrame, threshold: float = 0.35, top_n: int = 6, score: str = "rerank_score") -> DataFrame:
    """Candidates at or above the threshold, best ``top_n`` per query. Unscored fail."""
    return top_k(scored.filter(F.col(score) >= threshold).drop("rank"), ["qid"], best_first(score), top_n)


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """``qid, stage, n_chunks, n_documents`` per retrieval stage."""
    file = F.regexp_extract("chunk_id", r"^(.*)#p[^#]*#c\d+$", 1)
    stacked = reduce(
        DataFrame.unionByName,
        [df.select("qid", "chunk_id").withColumn("stage", F.lit(s)) for s, df in stages.items()],
    )
    per_file = stacked.groupBy("qid", "stage", file.alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("qid", "stage").agg(
        F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_documents")
    )


def retry_unfiltered(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """Unfiltered results for the queries whose filtered pool came back empty."""
    answered = filtered.select("qid").distinct()
    return filtered.unionByName(unfiltered.join(answered, "qid", "left_anti"))


def merge_pools(pools: DataFrame) -> DataFrame:
    """Per query and chunk the row with the highest score; the earlier arrival wins a
    tie. ``pools``: qid, chunk_id, rerank_score, arrival and anything else."""
    others = [c for c in pools.columns if c not in ("qid", "chunk_id")]
    best = F.max_by(F.struct(*others), F.struct(F.col("rerank_score"), -F.col("arrival")))
    return pools.groupBy("qid", "chunk_id").agg(best.alias("b")).select("qid", "chunk_id", "b.*")


def pooled_confidence(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Highest rerank score per query, zero where nothing survived."""
    best = pool.groupBy("qid").agg(F.max("rerank_score").alias("best"))
    return queries.select("qid").join(best, "qid", "left").select(
        "qid", F.coalesce("best", F.lit(0.0)).alias("confidence")
    )
