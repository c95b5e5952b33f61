"""The test tables, seen as a document collection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.functions import text as T
from citelode.operators import postings
from citelode.operators.chunking import text_chunks
from citelode.operators.layout import SLOT, SLOT_ROWS, Keyed
from citelode.providers import provider
from citelode.session import application_folder

DIMS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work when a scan has fewer splits than cores,
    hashed on the first column, the key. Large inputs have more splits and pass
    unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain-text files: ``file, category, text``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select(
        F.concat(F.col("source"), F.lit("/pages/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.col("source").alias("category"),
        "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_chunks(files(spark, sf_dir))


#: Characters of a document for each of its chunks, about, and rows of a small slot that still get a task of their own.
CHUNK_CHARS, LEAST_ROWS = 250, 2_000
_TEXTS: dict[tuple[str, str], Keyed] = {}


def texts(spark: SparkSession, sf_dir: str) -> Keyed:
    """Chunks with text, tokens and vector, laid out by chunk id and written to the shared folder by the first
    query of an application that needs them and read by all others: an index is built
    once and searched many times. Only texts are sent to their slots; tokens and vectors are made there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TEXTS:
        tokens = provider("normalizer", "whitespace")
        embed = provider("embedder", "hashing", dims=DIMS)
        chars = table(spark, sf_dir, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
        rows = chars // CHUNK_CHARS + 1
        slot_rows = min(SLOT_ROWS, max(LEAST_ROWS, rows // (4 * spark.sparkContext.defaultParallelism)))
        derived = lambda df: df.withColumn("tokens", tokens(F.col("text"))).withColumn("vector", embed(F.col("tokens")))
        path = f"{application_folder(spark)}/chunks-{uuid.uuid4().hex[:12]}"
        _TEXTS[key] = Keyed.write(chunks(spark, sf_dir), path, "chunk_id", rows, slot_rows, derived)
    return _TEXTS[key]


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of ``texts`` as a table."""
    return texts(spark, sf_dir).rows.drop(SLOT)


def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("chunk_id", "file", "category", "tokens")


_KEYWORDS: dict[tuple[str, str], str] = {}


def keywords(spark: SparkSession, sf_dir: str) -> postings.KeywordIndex:
    """The stored keyword index of the chunks, built once by an application like ``index``."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEYWORDS:
        path = f"{application_folder(spark)}/keywords-{uuid.uuid4().hex[:12]}"
        postings.build(token_chunks(spark, sf_dir), path)
        _KEYWORDS[key] = path
    return postings.open_keywords(spark, _KEYWORDS[key])


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions: ``qid, question, tokens``."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.col("text").alias("question"),
        T.tokens(F.col("text")).alias("tokens"),
    )
