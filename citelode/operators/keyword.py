"""Keyword search: BM25 over token lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citelode.functions import text as T
from citelode.operators.sizing import small_side
from citelode.operators.topk import RunningTop
from citelode.session import cut_lineage

#: Extra row per chunk that carries its length past the vocabulary join.
LENGTH_MARK = "\u0000"
#: Query terms scored per pass over the chunks, and matrix cells per step of a batch.
TERM_BLOCK = 16_384
MATRIX_CELLS = 4_000_000
#: Decimals that decide a ranking; sums of doubles differ beyond them.
RANK_DECIMALS = 9


def best_first(score: str, tie: str = "chunk_id") -> list[Column]:
    return [F.round(F.col(score), RANK_DECIMALS).desc_nulls_last(), F.col(tie).asc()]


def top_k(df: DataFrame, per: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark keeps k per task before the shuffle, so a hot
    group costs k rows per task."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def query_terms(queries: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``qid, token, qtf``: repeated query tokens count each time."""
    return (
        T.each(queries, ["qid"], F.col(tokens), "token")
        .groupBy("qid", "token")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def matched_postings(chunks: DataFrame, vocabulary: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``chunk_id, dl, token, tf`` for the vocabulary's tokens, plus one LENGTH_MARK row
    per chunk. Rows end up partitioned by chunk, so per-chunk work needs no further
    shuffle."""
    keep = keep or []
    marked = vocabulary.select("token").distinct().union(
        vocabulary.sparkSession.range(1).select(F.lit(LENGTH_MARK).alias("token"))
    )
    exploded = T.each(
        chunks, ["chunk_id", *keep, F.size("tokens").alias("dl")],
        F.array_append("tokens", F.lit(LENGTH_MARK)), "token",
    )
    return (
        exploded.join(small_side(marked), "token")
        .repartition("chunk_id")
        .groupBy("chunk_id", *keep, "dl", "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def token_frequencies(postings: DataFrame) -> DataFrame:
    """``token, df, cf, mean_dl``; the LENGTH_MARK row holds the corpus size and mean
    length. No filter, so every use reads the same shuffled postings."""
    return postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.avg("dl").alias("mean_dl")
    )


def corpus_stats(frequency: DataFrame) -> Column:
    """Scalar struct ``n, avgdl``."""
    mark = F.col("token") == LENGTH_MARK
    return frequency.agg(
        F.struct(
            F.max(F.when(mark, F.col("df"))).alias("n"),
            F.max(F.when(mark, F.col("mean_dl"))).alias("avgdl"),
        ).alias("s")
    ).scalar()


def query_statistics(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """``token, df, mean_dl`` for the queries' tokens and the LENGTH_MARK row. One pass
    over the chunks, summed before a shuffle of one row per token and task."""
    marked = terms.select("token").distinct().union(
        terms.sparkSession.range(1).select(F.lit(LENGTH_MARK).alias("token"))
    )
    seen = T.each(
        chunks, [F.size("tokens").alias("dl")],
        F.array_append(F.array_distinct("tokens"), F.lit(LENGTH_MARK)), "token",
    )
    return seen.join(small_side(marked), "token").groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.avg("dl").alias("mean_dl")
    )


def _query_blocks(terms: DataFrame):
    """Query terms in pieces of bounded size for the driver to broadcast: whole queries,
    split by hash. Query terms are questions times words, far below the corpus."""
    total = terms.count()
    if total <= TERM_BLOCK:
        yield terms.collect()
        return
    pieces = -(-2 * total // TERM_BLOCK)
    for piece in range(pieces):
        yield terms.filter(F.pmod(F.xxhash64("qid"), F.lit(pieces)) == piece).collect()


def bm25_search(
    chunks: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75,
    keep: list[str] | None = None,
) -> DataFrame:
    """Top ``k`` chunks per query with a positive score: ``qid, chunk_id, score, rank``
    and the string columns named in ``keep``.

    ``chunks``: chunk_id, tokens. ``queries``: qid, tokens. Published Lucene variant;
    query tokens the corpus lacks score nothing. Chunks are scored where they are, batch
    by batch; a task forwards its best ``k`` per query and nothing else.
    """
    keep = keep or []
    spark = chunks.sparkSession
    terms = query_terms(queries)
    weighted = terms.join(query_statistics(chunks, terms), "token", "right")
    # The right join keeps the LENGTH_MARK row, which no query owns.
    qid_type = queries.schema["qid"].dataType.simpleString()
    shape = f"qid {qid_type}, chunk_id string, score double" + "".join(f", {c} string" for c in keep)
    result = None
    weighted = cut_lineage(weighted)
    corpus = weighted.filter(F.col("token") == LENGTH_MARK).first()
    for rows in _query_blocks(weighted.filter(F.col("qid").isNotNull())):
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(_scoring_tables(rows, corpus["df"], corpus["mean_dl"], k1, b))
        qid_arrow = to_arrow_type(queries.schema["qid"].dataType)
        scored = chunks.select("chunk_id", "tokens", *keep).mapInArrow(
            _bm25_batches(shared, k, keep, qid_arrow), shape
        )
        result = scored if result is None else result.unionByName(scored)
    if result is None:
        return spark.createDataFrame([], shape + ", rank int")
    return top_k(result, ["qid"], best_first("score"), k)


def _scoring_tables(rows, n_chunks: int, mean_length: float, k1: float, b: float) -> dict:
    """Vocabulary, queries and the term-by-query weight matrix of one block."""
    vocabulary = sorted({r["token"] for r in rows})
    qids = sorted({r["qid"] for r in rows})
    term_no = {t: i for i, t in enumerate(vocabulary)}
    query_no = {q: i for i, q in enumerate(qids)}
    weights = np.zeros((len(vocabulary), len(qids)))
    for r in rows:
        idf = math.log(1 + (n_chunks - r["df"] + 0.5) / (r["df"] + 0.5))
        weights[term_no[r["token"]], query_no[r["qid"]]] = r["qtf"] * idf
    return {
        "vocabulary": vocabulary, "qids": qids, "weights": weights,
        "k1": k1, "b": b, "mean_length": mean_length,
    }


def _bm25_batches(shared, k: int, keep: list[str], qid_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        vocabulary = pa.array(tables["vocabulary"])
        qids, weights = tables["qids"], tables["weights"]
        step = max(1, MATRIX_CELLS // max(1, len(vocabulary)))
        best = RunningTop(k, RANK_DECIMALS, tuple(keep))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists = part.column("tokens")
                lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                found = pc.index_in(lists.flatten(), vocabulary).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), lengths)
                known = ~np.isnan(found.astype(float))
                cell = row[known] * len(vocabulary) + found[known].astype(np.int64)
                tf = np.bincount(cell, minlength=part.num_rows * len(vocabulary)).reshape(part.num_rows, -1)
                norm = tables["k1"] * (1 - tables["b"] + tables["b"] * lengths / tables["mean_length"])
                with np.errstate(invalid="ignore"):
                    scores = (np.where(tf > 0, tf / (tf + norm[:, None]), 0.0) @ weights).T
                text = lambda name: part.column(name).to_numpy(zero_copy_only=False)
                best.add(scores, text("chunk_id"), 0.0, **{name: text(name) for name in keep})
        yield pa.RecordBatch.from_pydict({
            "qid": pa.array([qids[i] for i in best.rows], qid_type),
            "chunk_id": pa.array(best.keys.tolist(), pa.string()),
            "score": pa.array(best.scores),
            **{name: pa.array(best.extras[name].tolist(), pa.string()) for name in keep},
        })

    return run


def category_search(pages: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Top ``k`` pages of the query's own category, pages that score zero included:
    ``qid, page_id, score, rank``.

    ``pages``: page_id, category, tokens. ``queries``: qid, category, tokens. Frequencies and lengths
    are those of the category. Pages without a query term are not paired with the query: the first
    ``k`` pages of the category in id order are all that can fill places left over.
    """
    terms = T.each(queries, ["qid", "category"], F.col("tokens"), "token").groupBy("qid", "category", "token").agg(F.count(F.lit(1)).alias("qtf"))
    corpus = pages.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    asked = small_side(terms.select("category", "token").distinct())
    postings = T.each(pages, ["page_id", "category", F.size("tokens").alias("dl")], F.col("tokens"), "token").join(
        asked, ["category", "token"]
    ).groupBy("page_id", "category", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("category", "token").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(df, ["category", "token"]).join(corpus, "category")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    scored = postings.join(weighted, ["category", "token"]).groupBy("qid", "page_id").agg(
        F.sum(F.col("qtf") * idf * F.col("tf") / (F.col("tf") + norm)).alias("score")
    )
    first = top_k(pages.select("page_id", "category"), ["category"], [F.col("page_id").asc()], k, "__place").drop("__place")
    spare = queries.select("qid", "category").join(first, "category").select("qid", "page_id", F.lit(0.0).alias("score"))
    best = scored.unionByName(spare).groupBy("qid", "page_id").agg(F.max("score").alias("score"))
    return top_k(best, ["qid"], best_first("score", "page_id"), k)


def filtered_sparse_search(
    chunks: DataFrame, queries: DataFrame, filters: DataFrame, k: int = 20, overfetch: int = 3
) -> DataFrame:
    """Sparse stage under a category filter: fetch ``overfetch * k`` over the whole
    corpus, then drop other categories, then keep ``k``. Queries without a filter row
    keep plain top ``k``. The filter must stay behind the first ranking: a rare category
    may fill fewer than ``k`` places.

    ``chunks`` carries category; ``filters``: qid, categories (array).
    """
    return keep_wanted(bm25_search(chunks, queries, overfetch * k, keep=["category"]), filters, k)


def keep_wanted(hits: DataFrame, filters: DataFrame, k: int) -> DataFrame:
    """Hits of the wanted categories, best ``k``; plain top ``k`` where nothing is wanted."""
    filtered = hits.join(small_side(filters.select("qid", "categories")), "qid", "left")
    wanted = filtered.filter(
        F.when(F.size("categories") > 0, F.array_contains("categories", F.col("category")))
        .otherwise(F.col("rank") <= k)
    )
    return top_k(wanted.drop("rank"), ["qid"], best_first("score"), k).drop("categories")
