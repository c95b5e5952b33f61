"""Question, answer and judgment files: JSON arrays, wrapped arrays and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.operators.scan import blocked_row_number
from citelode.sources.arrays import array_elements


def plain_path(path) -> Column:
    """A file's path without its scheme and with blanks as such, however the source wrote it."""
    decoded = F.url_decode(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//)?", "")


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, start, id, line`` of the non-blank lines: where its split starts, and a number
    in the order of the lines."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), F.trim("value").alias("line"),
    ).filter(F.col("line") != "")


def parsed_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines and ``file, skipped``: lines cut off or not an object are counted,
    not fatal. Records are numbered without gaps, per input split in split order, so that
    one large file still uses many tasks. ``lines``: as from ``raw_lines``."""
    is_object = F.coalesce(F.try_parse_json("line").isNotNull() & F.col("line").startswith("{"), F.lit(False))
    numbered = blocked_row_number(lines.filter(is_object), ["file"], "start", [F.col("id")], "lineno")
    records = numbered.select("file", "lineno", F.from_json("line", schema).alias("r")).select("file", "lineno", "r.*")
    return records, lines.filter(~is_object).groupBy("file").agg(F.count(F.lit(1)).alias("skipped"))


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    return parsed_lines(raw_lines(spark, path), schema)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with an id from ``{"questions": [...]}``, a JSON array or JSON lines. A large array is read by
    several tasks."""
    if path.endswith(".jsonl"):
        return read_lines(spark, path, schema)[0].drop("file", "lineno").filter(F.col("id").isNotNull())
    elements = array_elements(spark, path)
    return elements.select(F.from_json("json", schema).alias("r")).select("r.*").filter(F.col("id").isNotNull())


def first_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, n, first``: non-blank lines and the first of them, of every file that has one."""
    return raw_lines(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("line", F.struct("start", "id")).alias("first"))


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """``file, n`` non-blank lines; nothing is decoded as JSON."""
    return spark.read.text(path).filter(F.trim("value") != "").groupBy(
        F.col("_metadata.file_path").alias("file")
    ).agg(F.count(F.lit(1)).alias("n"))


def predicted_filters(spark: SparkSession, path: str) -> DataFrame:
    """``id, categories`` of a predictions file."""
    return read_lines(spark, path, "id string, categories array<string>")[0].select(
        "id", F.coalesce("categories", F.array().cast("array<string>")).alias("categories")
    )


def candidate_specs(lines: DataFrame) -> DataFrame:
    """Candidate lists given as ids, as objects with an id, or as nested chunks:
    ``qid, ordinal, chunk_id``. ``lines``: qid, spec (JSON array text)."""
    items = F.from_json("spec", "array<variant>")
    path = lambda p: F.try_variant_get(F.col("v"), p, "string")
    return lines.select("qid", F.posexplode(items).alias("ordinal", "v")).select(
        "qid", "ordinal", F.coalesce(path("$.chunk_id"), path("$.chunk.chunk_id"), path("$")).alias("chunk_id")
    )
