"""Steps around the answer model: citations, evidence, judge jobs, question anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions.replies import json_object
from citelode.operators.keyword import top_k
from citelode.operators.scan import hash_order

# Fixed values -------------------------------------------------------------------
FALLBACK_CITATIONS = 3
EVIDENCE_CHARS = 1500
# --------------------------------------------------------------------------------


def final_citations(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Valid citations of each answer, or its first retrieved chunks when none is valid.

    ``cited``: qid, pos, file, page. ``retrieved``: qid, rank, file, page. Pages compare
    null-safe. Result: qid, pos, file, page, fallback.
    """
    page = F.coalesce(F.col("page").cast("string"), F.lit("-"))
    known = retrieved.select("qid", "file", page.alias("p")).distinct()
    valid = cited.withColumn("p", page).join(known, ["qid", "file", "p"], "left_semi").select("qid", "pos", "file", "page")
    first = retrieved.filter(F.col("rank") <= FALLBACK_CITATIONS).select(
        "qid", (F.col("rank") - 1).alias("pos"), "file", "page"
    )
    spare = first.join(valid.select("qid").distinct(), "qid", "left_anti")
    return valid.withColumn("fallback", F.lit(False)).unionByName(spare.withColumn("fallback", F.lit(True)))


def evidence(ranked: DataFrame, chars: int = EVIDENCE_CHARS) -> DataFrame:
    """One evidence block per query: each chunk's place, source and leading text."""
    line = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), "file", F.lit(" p."),
        F.coalesce(F.col("page").cast("string"), F.lit("-")), F.lit("\n"), F.substring("text", 1, chars),
    )
    return ranked.groupBy("qid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda s: s["l"]), "\n\n").alias("evidence")
    )


def judge_jobs(questions: DataFrame, models: list[str]) -> DataFrame:
    """One job per question and judge; the judges are a short fixed list."""
    return questions.withColumn("judge_model", F.explode(F.array(*[F.lit(m) for m in models])))


def form_anchors(items: DataFrame, wanted: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` example items per wanted (domain, difficulty): same difficulty, other domain,
    seeded order.

    At most ``n`` items per domain can be picked, and with at most ``n`` of them in the
    wanted domain itself the first ``2 n`` of a difficulty suffice; items are cut to that
    before they meet the wanted cells.
    """
    digest = hash_order(F.lit(seed), F.col("id"))
    pool = top_k(items.withColumn("__d", digest), ["domain", "difficulty"], [F.col("__d"), F.col("id")], n, "__r")
    pool = top_k(pool, ["difficulty"], [F.col("__d"), F.col("id")], 2 * n, "__r")
    pairs = wanted.select(F.col("domain").alias("for_domain"), "difficulty").join(pool.drop("__r"), "difficulty")
    others = pairs.filter(F.col("domain") != F.col("for_domain"))
    return top_k(others, ["for_domain", "difficulty"], [F.col("__d"), F.col("id")], n, "place").drop("__d")


def gate_verdict(reply: Column) -> Column:
    """``struct<verdict,reason>`` of a pass/fail reply; null when it is neither."""
    raw = F.from_json(json_object(reply), "verdict string, reason string")
    verdict = F.lower(F.trim(raw["verdict"]))
    return F.when(
        verdict.isin("pass", "fail"),
        F.struct(verdict.alias("verdict"), F.trim(F.coalesce(raw["reason"], F.lit(""))).alias("reason")),
    )


def profile(items: DataFrame) -> Column:
    """Scalar: ``v3`` when there are items and every id starts so, else ``v2``."""
    all_v3 = F.coalesce(F.bool_and(F.col("id").startswith("v3-")), F.lit(False))
    return items.agg(F.when(all_v3, "v3").otherwise("v2")).scalar()


def set_label(path: Column) -> Column:
    return F.when(path.rlike(r"[_-]v2(\.[^./]*)?$"), "v2").otherwise("v1")


def sum_stages(stats: list[DataFrame]) -> DataFrame:
    """Stage counts of several retrievals added up: qid, stage, n_chunks, n_documents."""
    return reduce(DataFrame.unionByName, stats).groupBy("qid", "stage").agg(
        F.sum("n_chunks").alias("n_chunks"), F.sum("n_documents").alias("n_documents")
    )


def latest_report(reports: DataFrame, key: str = "index_name") -> DataFrame:
    """Newest stored report per index (``created_at`` sorts as text)."""
    return reports.groupBy(key).agg(F.max("created_at").alias("created_at"), F.max_by("report", "created_at").alias("report"))
