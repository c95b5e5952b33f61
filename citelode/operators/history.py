"""Run histories, reports and incremental work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions import text as T
from citelode.operators.keyword import top_k
from citelode.operators.sizing import small_side, within


def question_index(sources: list[DataFrame]) -> DataFrame:
    """Questions of several sources (``id``, ``ordinal`` and content); of equal ids the
    earlier source wins, then the earlier record."""
    ranked = [s.filter(F.col("id").isNotNull()).withColumn("precedence", F.lit(i)) for i, s in enumerate(sources)]
    stacked = reduce(DataFrame.unionByName, ranked)
    others = [c for c in stacked.columns if c != "id"]
    best = F.min_by(F.struct(*others), F.struct("precedence", "ordinal"))
    return stacked.groupBy("id").agg(best.alias("b")).select("id", "b.*").drop("ordinal")


def history_page(
    records: DataFrame, questions: DataFrame, judgments: DataFrame, offset: int, limit: int
) -> DataFrame:
    """One page of records with question and judgment attached, and the total.

    ``records``: lineno (1, 2, 3 ...), pair_id and content. Dense line numbers make the
    page a range filter, so a far page costs no more than the first, and the left side
    of the joins is ``limit`` rows.
    """
    total = records.agg(F.count(F.lit(1))).scalar()
    page = within(records.filter(F.col("lineno").between(offset + 1, offset + limit)), limit)
    with_question = questions.join(page.select("pair_id"), "pair_id", "left_semi")
    with_judgment = judgments.join(page.select("pair_id"), "pair_id", "left_semi")
    return (
        page.join(with_question, "pair_id", "left").join(with_judgment, "pair_id", "left")
        .withColumn("total", total)
    )


def pair_id(record_id: Column, stem: Column, lineno: Column) -> Column:
    return T.first_present(record_id, F.concat_ws("#", stem, lineno))


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def answers_of_runs(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Runs with the answer file they name, matched by base name; the first file in path
    order stands for a repeated name."""
    named = files.groupBy(basename(F.col("path")).alias("name")).agg(F.min("path").alias("answers_path"))
    return runs.withColumn("name", basename(F.col("recorded"))).join(named, "name", "left").drop("name")


def preview(quote: Column, page_text: Column, chars: int = 600) -> Column:
    return F.coalesce(F.nullif(quote, F.lit("")), F.substring(page_text, 1, chars))


def warning_counts(warnings: DataFrame, top: int = 20) -> DataFrame:
    """Most frequent (logger, first 100 characters) with the earliest full message.
    ``warnings``: ordinal, logger, message."""
    grouped = warnings.groupBy("logger", F.substring("message", 1, 100).alias("head")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"),
        F.min_by("message", "ordinal").alias("example"),
    )
    return grouped.orderBy(F.col("n").desc(), "first").limit(top)


def warning_examples(warnings: DataFrame, cap: int = 50) -> DataFrame:
    """First ``cap`` warnings of every event."""
    return top_k(warnings, ["event"], [F.col("ordinal")], cap, "example_no")


def run_delta(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Counts of two runs side by side; a key the previous run lacks is new."""
    joined = current.select(key, F.col("n").alias("n_now")).join(
        previous.select(key, F.col("n").alias("n_before")), key, "full_outer"
    )
    return joined.select(
        key, F.coalesce("n_now", F.lit(0)).alias("n_now"), F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.col("n_before").isNull().alias("is_new"), F.col("n_now").isNull().alias("is_gone"),
    )


def not_done(work: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Work without a finished record: resume and cache misses."""
    return work.join(small_side(done.select(*on).distinct()), on, "left_anti")


def cache_status(work: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """Every unit of work as cached, stale (known key, other content) or new.
    ``work`` and ``cache`` carry a ``fingerprint`` of content and configuration."""
    known = cache.select(*on, F.col("fingerprint").alias("cached")).groupBy(*on).agg(F.max("cached").alias("cached"))
    status = F.when(F.col("cached").isNull(), "new").when(F.col("cached") == F.col("fingerprint"), "cached").otherwise("stale")
    return work.join(known, on, "left").withColumn("status", status).drop("cached")


def orphans(cache: DataFrame, work: DataFrame, on: list[str]) -> DataFrame:
    """Cache entries whose source is gone."""
    return cache.join(work.select(*on).distinct(), on, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows replaced or joined by incoming ones; the last write of a key wins.
    ``incoming`` carries ``arrival``."""
    others = [c for c in stored.columns if c != key]
    latest = incoming.groupBy(key).agg(F.max_by(F.struct(*others), "arrival").alias("b")).select(key, "b.*")
    return stored.join(latest.select(key), key, "left_anti").unionByName(latest.select(*stored.columns))
