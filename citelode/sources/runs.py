"""Finding answer files and judged runs below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.operators.sizing import small_side
from citelode.sources import records
from citelode.sources.corpus import list_files

# Where answer files and judged runs lie.
ANSWERS = r"^((rag_answers[^/]*|team_1_results[^/]*|baseline_answers)\.jsonl|eval_results/(.*/)?answers/[^/]*\.jsonl)$"
JUDGED = r"^eval_results/(.*/)?judgments\.jsonl$"
METRICS = "metrics.json"


def _folder(rel):
    return F.when(F.contains(rel, F.lit("/")), F.regexp_replace(rel, "/[^/]*$", "")).otherwise("")


def _truthy(value):
    """Whether a JSON value (as text) is there and neither false, zero nor empty."""
    return F.coalesce(~F.trim(value).isin("null", "false", "0", "0.0", '""', "[]", "{}", ""), F.lit(False))


def discover_runs(spark: SparkSession, root: str, answers: str = ANSWERS, judged: str = JUDGED) -> DataFrame:
    """``id, label, kind, n_pairs, has_trace, has_judgment, questions_file, modified``, newest first. Files are listed by their
    metadata, those without a byte are left out; contents are read of answer files, judgments and run descriptions only. A run whose
    description is missing or broken is listed without what it would say. The answers of a run are found by
    the base name it recorded, never by opening the recorded path."""
    listed = list_files(spark, root).select("path", "rel", "modified")
    found = listed.withColumn("kind", F.when(F.col("rel").rlike(answers), "answers").when(F.col("rel").rlike(judged), "judged")).filter("kind IS NOT NULL")
    paths = [row["path"] for row in found.select("path").collect()]  # one path per run
    if not paths:
        return spark.createDataFrame([], "id string, label string, kind string, n_pairs long, has_trace boolean, has_judgment boolean, questions_file string, modified timestamp")
    heads = records.first_records(spark, paths).select(records.plain_path("file").alias("path"), F.col("n").alias("n_pairs"), F.col("first").alias("head"))
    traced = _truthy(F.get_json_object("head", "$.trace"))
    known = found.withColumn("path", records.plain_path("path")).join(small_side(heads), "path", "left").select(
        "rel", "kind", "modified", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), traced.alias("own_trace"), _folder(F.col("rel")).alias("folder"),
        F.regexp_extract("rel", r"([^/]*)$", 1).alias("base"),
    )
    metrics = [row["path"] for row in listed.filter(F.col("rel").rlike(rf"(^|/){METRICS}$")).select("path").collect()]
    meta = spark.createDataFrame([], "path string, value string")
    if metrics:
        meta = spark.read.text(metrics, wholetext=True).select(records.plain_path(F.col("_metadata.file_path")).alias("path"), "value")
    described = listed.withColumn("path", records.plain_path("path")).join(small_side(meta), "path").select(
        _folder(F.col("rel")).alias("folder"), F.get_json_object("value", "$.meta.answers_file").alias("answers_file"),
        F.get_json_object("value", "$.meta.questions_file").alias("questions_file"),
    )
    by_base = known.filter("kind = 'answers'").groupBy("base").agg(F.max_by("own_trace", "rel").alias("base_trace"))
    rows = known.join(small_side(described), "folder", "left").withColumn("answers_base", F.regexp_extract("answers_file", r"([^/]*)$", 1))
    rows = rows.join(small_side(by_base.withColumnRenamed("base", "answers_base")), "answers_base", "left")
    is_run = F.col("kind") == "judged"
    return rows.select(
        F.col("rel").alias("id"), F.when(is_run, F.col("folder")).otherwise(F.regexp_replace("base", r"\.[^.]*$", "")).alias("label"), "kind", "n_pairs",
        F.when(is_run, F.coalesce("base_trace", F.lit(False))).otherwise(F.col("own_trace")).alias("has_trace"), is_run.alias("has_judgment"),
        F.when(is_run, F.col("questions_file")).alias("questions_file"), "modified",
    ).orderBy(F.desc("modified"), "id")
