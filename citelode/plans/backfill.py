"""Back-filling a cache of parsed documents after a repair.

A cache and what was derived from it (tokens, embeddings) are folders partitioned by a bucket of the document's
key, the same number of them in all. A repair rewrites only the buckets that hold a changed document, and takes the rows derived
from changed documents out of theirs. Derived rows go first: if the job stops in between, they are computed again
from a document that is still the old one, and the next run finds it unrepaired.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.operators.layout import slot_of
from citelode.operators.sizing import small_side
from citelode.session import shared_table
from citelode.sources import sinks

BUCKET = "bucket"


def write_cache(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """A cache folder of ``rows``, partitioned by a hash of ``key``."""
    placed = rows.withColumn(BUCKET, slot_of(F.col(key), buckets))
    placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def _in_buckets(spark: SparkSession, path: str, touched: list[int]) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(BUCKET).isin(touched))


def _rewrite(spark: SparkSession, rows: DataFrame, path: str, touched: list[int], name: str) -> None:
    """Replace the touched buckets by ``rows``; a bucket without rows goes."""
    new = shared_table(rows, name)  # the folder is read and written, so its new rows are written aside first
    kept = {row[0] for row in new.select(BUCKET).distinct().collect()}
    if kept:
        sinks.replace_partitions(new.repartition(BUCKET), path, BUCKET)
    for bucket in set(touched) - kept:
        sinks.remove(spark, f"{path}/{BUCKET}={bucket}")


def backfill(
    spark: SparkSession, cache: str, derived: list[str], present: DataFrame, repair: Callable[[DataFrame], DataFrame],
    changed: Column, key: str = "sha256", dry_run: bool = False,
) -> dict[str, int]:
    """Repair the cached documents whose key is in ``present`` (the corpus). ``repair`` adds to its rows what ``changed``
    tells them by; only changed rows are taken over. Cached documents without a corpus file are left untouched.

    Returns the numbers of documents ``scanned, changed, orphaned``, of derived rows ``invalidated`` and of
    ``buckets`` rewritten. With ``dry_run`` nothing is written."""
    stored = spark.read.parquet(cache)
    known = present.select(key).distinct()
    columns = stored.columns
    in_corpus = stored.join(small_side(known), key, "left_semi")
    repaired = shared_table(repair(in_corpus).filter(changed).select(columns), "repaired")
    sizes = stored.agg(F.count(F.lit(1)).alias("n")).first()["n"], in_corpus.count(), repaired.count()
    touched = sorted(row[0] for row in repaired.select(BUCKET).distinct().collect())
    keys = small_side(repaired.select(key))
    stale = {path: _in_buckets(spark, path, touched).join(keys, key, "left_semi").count() for path in derived}
    found = {"scanned": sizes[1], "changed": sizes[2], "orphaned": sizes[0] - sizes[1], "invalidated": sum(stale.values()), "buckets": len(touched)}
    if dry_run or not touched:
        return found
    for path in derived:
        if stale[path]:
            own = _in_buckets(spark, path, touched)
            hit = sorted(row[0] for row in own.join(keys, key, "left_semi").select(BUCKET).distinct().collect())
            _rewrite(spark, _in_buckets(spark, path, hit).join(keys, key, "left_anti"), path, hit, "derived")
    others = _in_buckets(spark, cache, touched).join(keys, key, "left_anti")
    _rewrite(spark, others.select(columns).unionByName(repaired), cache, touched, "cache")
    return found
