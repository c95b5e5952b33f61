"""The registered queries of these operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.llm import (
    exact_dedup, main_text, mixing, near_dup, neighbours, pack, phrases, repetition, substrings, toxicity,
    turns, url_filter, warc,
)
from citelode.llm.common import table
from citelode.session import small_batches


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM plain)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM ranked
"""


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = pages.select("page_id", "url", main_text.main_text(pages).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_dup.link(table(spark, sf_dir, "documents"), width=3, percent=85)
    return linked.select("doc_id", "n_shingles", "component_id", "kept")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.sample(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turns.repair(turns.damage(conversations), conversations)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {
    "op1_pack": op1_pack,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_main_text": op3_main_text,
    "op4_url_filter": op4_url_filter,
    "op5_substrings": op5_substrings,
    "op6_warc": op6_warc,
    "op7_near_dup": op7_near_dup,
    "op8_mix": op8_mix,
    "op9_repetition": op9_repetition,
    "op10_toxicity": op10_toxicity,
    "op11_phrases": op11_phrases,
    "op12_turns": op12_turns,
    "op13_neighbours": op13_neighbours,
}
ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_substrings": substrings.SQL,
    "op6_warc": warc.SQL,
    "op8_mix": mixing.SQL,
    "op9_repetition": repetition.SQL,
    "op11_phrases": phrases.SQL,
}
