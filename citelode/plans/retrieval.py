"""Retrieval queries: benchmark items searched over the chunked documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.operators import fusion, keyword, postings, vectors
from citelode.operators.sizing import small_side
from citelode.plans import sql_parts as S
from citelode.plans import tables as D
from citelode.providers import provider
from citelode.session import cut_lineage

#: Deepest pool any query asks for.
POOL = 60


@dataclass
class Stages:
    dense: DataFrame
    sparse: DataFrame
    fused: DataFrame
    reranked: DataFrame
    gated: DataFrame


def dense_stage(spark: SparkSession, sf_dir: str, k: int = 20, filters: DataFrame | None = None) -> DataFrame:
    embed = provider("embedder", "hashing", dims=D.DIMS)
    queries = D.benchmark_queries(spark, sf_dir).select("qid", embed(F.col("tokens")).alias("vector"))
    if filters is not None:
        queries = queries.join(filters, "qid", "left")
    stored = D.index(spark, sf_dir).select("chunk_id", "category", "vector")
    return vectors.cosine_search(stored, queries, k)


def sparse_stage(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return postings.search(D.keywords(spark, sf_dir), D.benchmark_queries(spark, sf_dir), k)


def texts_of(spark: SparkSession, sf_dir: str, ranked: DataFrame, *more: str) -> DataFrame:
    """Chunk text for ranked ids, whose number is bounded by queries times pool. Ranking
    moves ids only; text is read for the survivors. The ids are looked at more than once
    (slots, pieces, missing ones), so they are checkpointed instead of searched again."""
    ranked = cut_lineage(ranked)
    rows = D.table(spark, sf_dir, "benchmark").count() * POOL
    columns = ["file", "page", "category", "text", *more]
    return fusion.hydrate(ranked, D.texts(spark, sf_dir), columns, rows)[0]


def rerank(spark: SparkSession, sf_dir: str, fused: DataFrame) -> DataFrame:
    """Text and rerank score of the fused candidates."""
    score = provider("reranker", "lexical")
    queries = D.benchmark_queries(spark, sf_dir).select("qid", F.col("tokens").alias("asked"))
    return (
        texts_of(spark, sf_dir, fused, "tokens")
        .join(small_side(queries), "qid")
        .withColumn("rerank_score", score(F.col("asked"), F.col("tokens")))
        .drop("asked", "tokens")
    )


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    """All stages. The two rankings are k rows per query and read several times, so
    they are checkpointed instead of searched again."""
    dense = cut_lineage(dense_stage(spark, sf_dir))
    sparse = cut_lineage(sparse_stage(spark, sf_dir))
    fused = fusion.hybrid_candidates(dense, sparse, 20)
    reranked = rerank(spark, sf_dir, fused)
    return Stages(dense, sparse, fused, reranked, fusion.gate(reranked))


def fused_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = cut_lineage(dense_stage(spark, sf_dir))
    return fusion.hybrid_candidates(dense, cut_lineage(sparse_stage(spark, sf_dir)), 20)


def score(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


# -- queries ----------------------------------------------------------------------

def hybrid_search(spark, sf_dir):
    found = stages(spark, sf_dir)
    counts = fusion.stage_counts({"fused": found.fused}).select(
        "qid", F.col("n_chunks").alias("pool_chunks"), F.col("n_documents").alias("pool_documents")
    )
    return found.gated.join(small_side(counts), "qid").select(
        "qid", "rank", "chunk_id", "file", "category",
        score("dense_score"), score("sparse_score"), score("rrf_score"), score("rerank_score"),
        "pool_chunks", "pool_documents", F.length("text").cast("long").alias("n_chars"),
    )


def bm25_stats(spark, sf_dir):
    stored = D.keywords(spark, sf_dir)
    terms = keyword.query_terms(D.benchmark_queries(spark, sf_dir))
    return postings.term_statistics(stored, terms).select(
        "token", "df", "cf", F.lit(stored.n).cast("long").alias("n_chunks"), F.round(F.lit(stored.mean_length), 6).alias("avgdl"),
        F.round(F.log(1 + (stored.n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"),
    )


def bm25_topk(spark, sf_dir):
    return sparse_stage(spark, sf_dir).select("qid", "rank", "chunk_id", score("score"))


def dense_text_topk(spark, sf_dir):
    return dense_stage(spark, sf_dir).select("qid", "rank", "chunk_id", score("score"))


def label_centroids(spark, sf_dir):
    """Mean embedding per label; averaged per dimension so a hot label is pre-aggregated."""
    rows = D.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").alias("qid")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector")
    )


def dense_topk(spark, sf_dir):
    stored = D.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = vectors.cosine_search(stored, label_centroids(spark, sf_dir), 20, key="vec_id")
    return found.select("qid", "vec_id", "rank", score("score"))


def dense_topk_filtered(spark, sf_dir):
    """Each label's centroid searched among the two following labels only."""
    stored = D.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector"), F.col("label").cast("string").alias("category")
    )
    queries = label_centroids(spark, sf_dir).withColumn(
        "categories",
        F.array(((F.col("qid") + 1) % 10).cast("string"), ((F.col("qid") + 2) % 10).cast("string")),
    )
    found = vectors.cosine_search(stored, queries, 20, key="vec_id")
    return found.select("qid", "vec_id", "rank", score("score"))


def query_filters(spark, sf_dir):
    """Category set per query: two neighbouring sources, none for every fourth item."""
    queries = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    name = lambda shift: F.concat(F.lit("src"), ((F.col("qid") + shift) % 20).cast("string"))
    return queries.select(
        "qid",
        F.when(F.col("qid") % 4 != 3, F.array_distinct(F.array(name(0), name(7), name(0)))).alias("categories"),
    )


def sparse_postfilter_3x(spark, sf_dir):
    found = postings.filtered_search(
        D.keywords(spark, sf_dir), D.benchmark_queries(spark, sf_dir), query_filters(spark, sf_dir)
    )
    return found.select("qid", "rank", "chunk_id", "category", score("score"))


def rrf_fusion(spark, sf_dir):
    fused = fusion.reciprocal_rank_fusion([dense_stage(spark, sf_dir), sparse_stage(spark, sf_dir)])
    return fused.select("qid", "rank", "chunk_id", score("rrf_score"))


def hybrid_hydrate_outer(spark, sf_dir):
    fused = fused_candidates(spark, sf_dir)
    return texts_of(spark, sf_dir, fused).select(
        "qid", "rank", "chunk_id", "file", "category", score("dense_score"), score("sparse_score"),
        score("rrf_score"), F.md5("text").alias("text_md5"),
    )


def index_skew(spark, sf_dir):
    """Sparse hits whose chunk is absent from the dense store. The store here holds the
    chunks of labelled documents only, so the skew is real."""
    hits = sparse_stage(spark, sf_dir)
    labelled = D.table(spark, sf_dir, "labels").select("doc_id").distinct()
    doc = F.regexp_extract("chunk_id", r"/(\d+)\.txt#", 1).cast("long")
    return (
        hits.withColumn("doc_id", doc)
        .join(labelled, "doc_id", "left_anti")
        .groupBy("qid").agg(F.count(F.lit(1)).alias("missing"), F.min("chunk_id").alias("first_missing"))
    )


def gate_topn(spark, sf_dir):
    return stages(spark, sf_dir).gated.select("qid", "rank", "chunk_id", score("rerank_score"))


def stage_counts(spark, sf_dir):
    found = stages(spark, sf_dir)
    return fusion.stage_counts(
        {"dense": found.dense, "sparse": found.sparse, "fused": found.fused, "gated": found.gated}
    )


def stage_totals(spark, sf_dir):
    """Stage counts summed over all questions."""
    return stage_counts(spark, sf_dir).groupBy("stage").agg(
        F.sum("n_chunks").alias("n_chunks"), F.sum("n_documents").alias("n_documents")
    )


def sub_pools(spark, sf_dir):
    """Filtered and unfiltered rerank pools of the sparse stage."""
    queries = D.benchmark_queries(spark, sf_dir)
    filters = query_filters(spark, sf_dir).filter(F.col("categories").isNotNull())
    wanted = filters.select("qid", "categories")
    hits = postings.search(D.keywords(spark, sf_dir), queries, 60, ("category",))
    narrowed = (
        hits.join(small_side(wanted), "qid")
        .filter(F.array_contains("categories", F.col("category")))
        .drop("rank", "categories")
    )
    narrowed = keyword.top_k(narrowed, ["qid"], keyword.best_first("score"), 20)
    plain = hits.filter(F.col("rank") <= 20)
    columns = ["qid", "chunk_id", "category", "score", "rank"]
    return narrowed.select(columns), plain.select(columns)


def retry_unfiltered(spark, sf_dir):
    narrowed, plain = sub_pools(spark, sf_dir)
    out = fusion.retry_unfiltered(
        narrowed.withColumn("filtered", F.lit(True)), plain.withColumn("filtered", F.lit(False))
    )
    return out.select("qid", "chunk_id", "category", "filtered", score("score"))


def pool_merge(spark, sf_dir):
    narrowed, plain = sub_pools(spark, sf_dir)
    shape = lambda df, arrival, bonus: df.select(
        "qid", "chunk_id", (F.round(F.col("score"), 6) + bonus).alias("rerank_score"), F.lit(arrival).alias("arrival")
    )
    boost = F.when(F.col("rank") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    merged = fusion.merge_pools(shape(narrowed, 1, F.lit(0.0)).unionByName(shape(plain, 2, boost)))
    return merged.select("qid", "chunk_id", "arrival", score("rerank_score"))


def confidence(spark, sf_dir):
    found = stages(spark, sf_dir)
    return fusion.pooled_confidence(D.benchmark_queries(spark, sf_dir), found.gated).select(
        "qid", score("confidence")
    )


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, bm25_stats, bm25_topk, dense_text_topk, dense_topk, dense_topk_filtered,
        sparse_postfilter_3x, rrf_fusion, hybrid_hydrate_outer, index_skew, gate_topn, stage_counts,
        stage_totals, retry_unfiltered, pool_merge, confidence,
    )
}

_CENTROIDS = """
centroids AS (
  SELECT label AS qid, list(m ORDER BY i) AS v FROM (
    SELECT label, i, avg(x::DOUBLE) AS m FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY 1, 2) GROUP BY 1),
sims AS (
  SELECT qid, vec_id, label, list_cosine_similarity(v, embedding::DOUBLE[]) AS score
  FROM centroids, embeddings)"""

_FILTERS = """
qfilters AS (
  SELECT item_id AS qid,
         CASE WHEN item_id % 4 <> 3 THEN ['src' || (item_id % 20), 'src' || ((item_id + 7) % 20)] END AS categories
  FROM benchmark),
fetched AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS r0
    FROM bm25 WHERE score > 0) WHERE r0 <= 60)"""

_POOLS = f"""
{S.BM25},
{_FILTERS},
narrowed AS (
  SELECT * FROM (
    SELECT qid, chunk_id, category, score,
           row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
    FROM fetched JOIN qfilters USING (qid)
    WHERE categories IS NOT NULL AND list_contains(categories, category)) WHERE rank <= 20),
plain AS (SELECT qid, chunk_id, category, score, r0 AS rank FROM fetched WHERE r0 <= 20)"""

_COUNTS = f"""
{S.FUSED},
stacked AS (
  SELECT qid, chunk_id, 'dense' AS stage FROM dense UNION ALL
  SELECT qid, chunk_id, 'sparse' FROM sparse UNION ALL
  SELECT qid, chunk_id, 'fused' FROM fused UNION ALL
  SELECT qid, chunk_id, 'gated' FROM gated),
counts AS (
  SELECT qid, stage, count(*) AS n_chunks,
         count(DISTINCT regexp_extract(chunk_id, '^(.*)#p[^#]*#c[0-9]+$', 1)) AS n_documents
  FROM stacked GROUP BY 1, 2)"""

ORACLES = {
    "hybrid_search": f"""WITH RECURSIVE {S.FUSED}
SELECT g.qid, g.rank::INT AS rank, chunk_id, file, category, round(dense_score, 6) AS dense_score,
       round(sparse_score, 6) AS sparse_score, round(rrf_score, 6) AS rrf_score,
       round(rerank_score, 6) AS rerank_score, pool_chunks, pool_documents, length(text)::BIGINT AS n_chars
FROM gated g JOIN (
  SELECT qid, count(*) AS pool_chunks,
         count(DISTINCT regexp_extract(chunk_id, '^(.*)#p[^#]*#c[0-9]+$', 1)) AS pool_documents
  FROM fused GROUP BY 1) USING (qid)""",
    "bm25_stats": f"""WITH RECURSIVE {S.BM25}
SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf, any_value(n) AS n_chunks, round(any_value(avgdl), 6) AS avgdl,
       round(ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf
FROM postings, corpus GROUP BY token""",
    "bm25_topk": f"""WITH RECURSIVE {S.BM25}
SELECT qid, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM sparse""",
    "dense_text_topk": f"""WITH RECURSIVE {S.TOKEN_CHUNKS}, {S.DENSE}
SELECT qid, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM dense""",
    "dense_topk": f"""WITH {_CENTROIDS}
SELECT qid, vec_id, rank::INT AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sims)
WHERE rank <= 20""",
    "dense_topk_filtered": f"""WITH {_CENTROIDS}
SELECT qid, vec_id, rank::INT AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sims
  WHERE label IN ((qid + 1) % 10, (qid + 2) % 10))
WHERE rank <= 20""",
    "sparse_postfilter_3x": f"""WITH RECURSIVE {S.BM25}, {_FILTERS}
SELECT qid, rank::INT AS rank, chunk_id, category, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM fetched LEFT JOIN qfilters USING (qid)
  WHERE CASE WHEN categories IS NULL THEN r0 <= 20 ELSE list_contains(categories, category) END)
WHERE rank <= 20""",
    "rrf_fusion": f"""WITH RECURSIVE {S.BM25}, {S.DENSE},
stacked AS (SELECT qid, chunk_id, rank FROM dense UNION ALL SELECT qid, chunk_id, rank FROM sparse),
summed AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score FROM stacked GROUP BY 1, 2)
SELECT qid, chunk_id, round(rrf_score, 6) AS rrf_score,
       row_number() OVER (PARTITION BY qid ORDER BY round(rrf_score, 9) DESC, chunk_id)::INT AS rank
FROM summed""",
    "hybrid_hydrate_outer": f"""WITH RECURSIVE {S.FUSED}
SELECT f.qid, f.rank::INT AS rank, chunk_id, file, category, round(dense_score, 6) AS dense_score,
       round(sparse_score, 6) AS sparse_score, round(rrf_score, 6) AS rrf_score, md5(text) AS text_md5
FROM fused f JOIN chunks USING (chunk_id)""",
    "index_skew": f"""WITH RECURSIVE {S.BM25}
SELECT qid, count(*) AS missing, min(chunk_id) AS first_missing FROM sparse
WHERE regexp_extract(chunk_id, '/([0-9]+)\\.txt#', 1)::BIGINT NOT IN (SELECT doc_id FROM labels)
GROUP BY qid""",
    "gate_topn": f"""WITH RECURSIVE {S.FUSED}
SELECT qid, rank::INT AS rank, chunk_id, round(rerank_score, 6) AS rerank_score FROM gated""",
    "stage_counts": f"""WITH RECURSIVE {_COUNTS}
SELECT qid, stage, n_chunks, n_documents FROM counts""",
    "stage_totals": f"""WITH RECURSIVE {_COUNTS}
SELECT stage, sum(n_chunks)::BIGINT AS n_chunks, sum(n_documents)::BIGINT AS n_documents FROM counts GROUP BY 1""",
    "retry_unfiltered": f"""WITH RECURSIVE {_POOLS},
strong AS (SELECT * FROM narrowed)
SELECT qid, chunk_id, category, true AS filtered, round(score, 6) AS score FROM strong
UNION ALL
SELECT qid, chunk_id, category, false, round(score, 6) FROM plain WHERE qid NOT IN (SELECT qid FROM strong)""",
    "pool_merge": f"""WITH RECURSIVE {_POOLS},
pooled AS (
  SELECT qid, chunk_id, round(score, 6) AS rerank_score, 1 AS arrival FROM narrowed UNION ALL
  SELECT qid, chunk_id, round(score, 6) + CASE WHEN rank % 2 = 0 THEN 0.5 ELSE 0 END, 2 FROM plain)
SELECT qid, chunk_id, arrival, round(rerank_score, 6) AS rerank_score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY rerank_score DESC, arrival) AS r FROM pooled)
WHERE r = 1""",
    "confidence": f"""WITH RECURSIVE {S.FUSED}
SELECT q.qid, round(coalesce(max(g.rerank_score), 0), 6) AS confidence
FROM queries q LEFT JOIN gated g USING (qid) GROUP BY 1""",
}
