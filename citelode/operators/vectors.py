"""Dense search: exact cosine top-k as blocked matrix products inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from citelode.operators.keyword import RANK_DECIMALS, best_first, top_k
from citelode.operators.topk import RunningTop

#: Queries scored per pass, at most; a block of 1024 dimensions is 8 MB.
QUERY_BLOCK = 1024
#: Scores held at once, 16 MB.
SCORES = 2_000_000


def hashing_embedder(dims: int = 64):
    """Default embedding provider: unit-length hashed token counts. A batch hashes each different token once."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            coded = lists.flatten().dictionary_encode()
            slots = np.array([int.from_bytes(md5(token.encode()).digest()[:2], "big") % dims for token in coded.dictionary.to_pylist()], dtype=np.int64)
            known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[known].astype(np.int64)
            codes = coded.indices.drop_null().to_numpy(zero_copy_only=False)
            out = np.bincount(rows * dims + slots[codes], minlength=len(lists) * dims).reshape(-1, dims).astype(float)
            norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
            flat = (out / np.where(norms == 0, 1, norms)).reshape(-1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dims, pa.int32()), pa.array(flat))

    return embed


def _query_blocks(queries: DataFrame, has_filter: bool):
    """Query vectors in pieces for the driver to broadcast, one at a time and each of at most
    QUERY_BLOCK rows: a piece of the hash that is larger is cut."""
    columns = ["qid", F.col("vector").cast("array<double>")] + (["categories"] if has_filter else [])
    picked = queries.select(*columns)
    total = picked.count()
    if total <= QUERY_BLOCK:
        yield picked.collect()
        return
    pieces = -(-2 * total // QUERY_BLOCK)
    numbered = picked.withColumn("__piece", F.pmod(F.xxhash64("qid"), F.lit(pieces)))
    for piece in range(pieces):
        rows = numbered.filter(F.col("__piece") == piece).drop("__piece").collect()
        yield from (rows[at : at + QUERY_BLOCK] for at in range(0, len(rows), QUERY_BLOCK))


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "chunk_id") -> DataFrame:
    """Top ``k`` vectors per query: ``qid, <key>, score, rank``.

    ``vectors``: key, vector and, if queries are filtered, category. ``queries``: qid,
    vector, optional categories (array; null or empty means no filter). The filter
    applies before ranking, so a filtered query still fills its ``k`` places.

    Every task multiplies its batches with the broadcast query block and keeps a running
    top ``k`` per query; only ``k`` rows per query and task are shuffled.
    """
    has_filter = "categories" in queries.columns
    spark = vectors.sparkSession
    key_type = vectors.schema[key].dataType.simpleString()
    qid_type = queries.schema["qid"].dataType.simpleString()
    columns = [key, F.col("vector").cast("array<double>").alias("vector")]
    result = None
    for block in _query_blocks(queries, has_filter):
        if not block:
            continue
        ids = [r["qid"] for r in block]
        matrix = np.array([r["vector"] for r in block], dtype=float)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norms == 0, 1, norms)
        wanted = [set(r["categories"] or []) for r in block] if has_filter else []
        shared = spark.sparkContext.broadcast((ids, matrix, wanted))
        scan = vectors
        if has_filter and all(wanted):
            # Every query filters, so categories nobody asked for are never read.
            scan = vectors.filter(F.col("category").isin(sorted(set().union(*wanted))))
        scored = scan.select(*columns, *(["category"] if has_filter else [])).mapInPandas(
            _score_batches(shared, k, key, has_filter),
            f"qid {qid_type}, {key} {key_type}, score double",
        )
        result = scored if result is None else result.unionByName(scored)
    if result is None:
        return spark.createDataFrame([], f"qid {qid_type}, {key} {key_type}, score double, rank int")
    return top_k(result, ["qid"], best_first("score", key), k)


def _score_batches(shared, k: int, key: str, has_filter: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, wanted = shared.value
        best = RunningTop(k, RANK_DECIMALS)
        for batch in batches:
            for start in range(0, len(batch), step := max(1, SCORES // max(1, len(ids)))):
                part = batch.iloc[start : start + step]
                data = np.stack(part["vector"].to_numpy())
                norms = np.linalg.norm(data, axis=1, keepdims=True)
                scores = matrix @ (data / np.where(norms == 0, 1, norms)).T
                if has_filter:
                    category = part["category"].to_numpy()
                    for row, names in enumerate(wanted):
                        if names:
                            scores[row, ~np.isin(category, list(names))] = -np.inf
                best.add(scores, part[key].to_numpy())
        # Empty columns have no type that becomes text, and a split may hold no rows.
        if len(best.rows):
            yield pd.DataFrame({"qid": [ids[i] for i in best.rows], key: best.keys.tolist(), "score": best.scores})

    return run
