"""A training corpus from raw documents, stage by stage.

Every stage reads what its predecessor kept, written as Parquet, and applies one operator:

1. toxicity: documents that the classifier rejects go;
2. exact duplicates: one document of each group of equal texts stays;
3. near duplicates (five-word shingles, similarity 0.8 or more): one of each component stays;
4. mix: every source as often as its target weight asks, documents repeated accordingly;
5. packing: the mixed documents as pieces of token sequences.

Texts go to Python in small batches. All stages but the last return the columns of ``documents``. Nulls, empty texts, ties,
repeated rows and empty tables are defined in the operators' modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.llm import exact_dedup, mixing, near_dup, pack, toxicity
from citelode.llm.common import table
from citelode.llm.queries import tokenizer_path
from citelode.session import shared_table, small_batches

#: Words that each half of a tokenizing worker's memory holds: fewer than alone, since the executors that pack are the ones
#: that ran the stages before.
REMEMBERED = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pieces = pack.pack(docs, tokenizer_path(), remembered=REMEMBERED)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Tokenizing and the trained classifier are not SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
