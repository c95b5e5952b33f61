"""Scoring of answers: citation resolution, committees, metric slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions import text as T
from citelode.functions.replies import LABELS, SUPPORT, VERDICTS
from citelode.operators.order_stats import nearest_rank, order_statistics
from citelode.operators.sizing import lookup_join
from citelode.session import cut_lineage

# Fixed values -------------------------------------------------------------------
CREDIT = {"fully": 1.0, "partially": 0.5, "not_at_all": 0.0}
SCORES = ("correctness", "completeness", "conversational_quality")
#: Score spread in a committee that counts as disagreement.
SPREAD = 3
# --------------------------------------------------------------------------------


def match_files(cited: DataFrame, corpus: DataFrame) -> DataFrame:
    """Resolve cited paths: exact, then normalised, then unique path suffix.

    ``cited``: cited. ``corpus``: file. Result: cited, file, reason (null, ambiguous_file
    or unknown_file).

    Suffix matches are counted, never listed: corpus suffixes are pre-aggregated to a
    count and one file, so a base name shared by a third of the corpus is one row.
    """
    wanted = cited.select("cited").distinct().withColumn("norm", T.norm_file(F.col("cited")))
    files = corpus.select("file").distinct().withColumn("norm", T.norm_file(F.col("file")))
    same = files.select(F.col("file").alias("cited"), F.col("file").alias("exact"))
    normal = files.filter(F.col("norm") != "").groupBy("norm").agg(
        F.max("file").alias("normal"), F.count(F.lit(1)).alias("same_norm")
    )
    longer = (
        files.select("file", F.explode(T.path_suffixes(F.col("norm"))).alias("norm"))
        .groupBy("norm").agg(F.count(F.lit(1)).alias("n_longer"), F.min("file").alias("longer"))
    )
    shorter = (
        wanted.select("cited", F.explode(T.path_suffixes(F.col("norm"))).alias("norm"))
        .join(normal, "norm")
        .groupBy("cited").agg(F.sum("same_norm").alias("n_shorter"), F.min("normal").alias("shorter"))
    )
    joined = (
        wanted.join(same, "cited", "left").join(normal, "norm", "left")
        .join(longer, "norm", "left").join(shorter, "cited", "left")
    )
    hits = F.coalesce("n_longer", F.lit(0)) + F.coalesce("n_shorter", F.lit(0))
    usable = F.col("norm") != ""
    found = F.coalesce("exact", "normal", F.when(usable & (hits == 1), F.coalesce("longer", "shorter")))
    return joined.select(
        "cited", found.alias("file"),
        F.when(found.isNull(), F.when(usable & (hits > 1), "ambiguous_file").otherwise("unknown_file")).alias("reason"),
    )


def resolve_citations(citations: DataFrame, corpus: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach page text or the reason there is none.

    ``citations``: file, page (string or null) and keys. ``corpus``: file, kind.
    ``pages``: file, page (int, null for text files), text; a row per real page.
    """
    kinds = corpus.select("file", "kind").distinct()
    files = match_files(citations.select(F.col("file").alias("cited")), corpus).join(kinds, "file", "left")
    number = F.expr("try_cast(page AS int)")
    resolved = (
        lookup_join(
            citations.withColumnRenamed("file", "cited"),
            files.withColumnRenamed("reason", "file_reason"), ["cited"], "left",
        )
        .withColumn("number", number)
    )
    texts = pages.select(
        "file", F.coalesce("page", F.lit(-1)).alias("__page"), "text", F.lit(True).alias("__real")
    )
    is_text = F.col("kind") == "txt"
    looked_up = resolved.withColumn(
        "__page", F.when(is_text, F.lit(-1)).otherwise(F.col("number"))
    ).join(texts, ["file", "__page"], "left")
    reason = (
        F.when(F.col("file").isNull(), F.col("file_reason"))
        .when(is_text & F.col("page").isNotNull(), "page_on_txt")
        .when(is_text, F.lit(None).cast("string"))
        .when(F.col("page").isNull(), "missing_page")
        .when(F.col("number").isNull() | F.col("__real").isNull(), "page_out_of_range")
        .when(T.strip(F.coalesce("text", F.lit(""))) == "", "empty_page")
    )
    out = looked_up.withColumn("reason", reason)
    return out.withColumn("text", F.when(F.col("reason").isNull(), F.col("text"))).drop(
        "__page", "__real", "number", "kind", "file_reason"
    )


def score_citations(answers: DataFrame, resolved: DataFrame, rulings: DataFrame) -> DataFrame:
    """Citation accuracy per answer: credit times resolved over cited.

    ``answers``: id, answerable. ``resolved``: id, reason per citation. ``rulings``: id,
    support (null when every judge failed). Unanswerable questions score null; citing
    nothing scores zero; a judge failure is flagged.
    """
    counts = resolved.groupBy("id").agg(
        F.count(F.lit(1)).alias("cited_count"), F.count_if(F.col("reason").isNull()).alias("valid_count")
    )
    credit = F.create_map(*[F.lit(x) for pair in CREDIT.items() for x in pair])
    joined = answers.join(counts, "id", "left").join(rulings.select("id", "support"), "id", "left")
    cited = F.coalesce("cited_count", F.lit(0))
    valid = F.coalesce("valid_count", F.lit(0))
    ruled = F.col("answerable") & F.col("support").isNotNull() & (valid > 0)
    given = F.when(ruled, F.try_element_at(credit, F.col("support")))
    return joined.select(
        *answers.columns,
        cited.alias("cited_count"), valid.alias("valid_count"), (cited - valid).alias("invalid_count"),
        F.when(ruled, F.col("support")).alias("support"),
        given.alias("credit"),
        F.when(F.col("answerable"), F.coalesce(given * valid / cited, F.lit(0.0))).alias("accuracy"),
        (F.col("answerable") & F.col("support").isNull() & (valid > 0)).alias("judge_failed"),
    )


def source_hits(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Share of a question's source groups that some citation hits.

    ``citations``: id, file, page. ``sources``: id, group, file, page. Files match as
    equal or as path suffix of one another; null pages match null pages. Both sides are
    joined on the suffix itself, so no citation-source pairs are formed.
    """
    page = F.coalesce(F.col("page").cast("string"), F.lit("-"))
    side = lambda df: df.withColumn("norm", T.norm_file(F.col("file"))).filter(F.col("norm") != "").withColumn("p", page)
    cited, wanted = side(citations), side(sources)
    whole = cited.select("id", "p", "norm").distinct()
    parts = cited.select("id", "p", F.explode(T.path_suffixes(F.col("norm"))).alias("norm")).distinct()
    direct = wanted.join(whole.unionByName(parts).distinct(), ["id", "p", "norm"], "left_semi").select("id", "group")
    inner = (
        wanted.select("id", "group", "p", F.explode(T.path_suffixes(F.col("norm"))).alias("norm"))
        .join(whole, ["id", "p", "norm"], "left_semi").select("id", "group")
    )
    hit = direct.unionByName(inner).distinct().withColumn("hit", F.lit(1))
    groups = sources.select("id", "group").distinct().join(hit, ["id", "group"], "left")
    return groups.groupBy("id").agg(
        F.count(F.lit(1)).alias("groups_total"), F.count("hit").alias("groups_hit"),
        (F.count("hit") / F.count(F.lit(1))).alias("hit_rate"),
    )


def majority(value: str, order: tuple[str, ...], valid: Column) -> Column:
    """Aggregate: most frequent value, the worse one (later in ``order``) on a tie."""
    tallies = [
        F.struct(F.count_if(valid & (F.col(value) == v)).alias("n"), F.lit(i).alias("severity"), F.lit(v).alias("v"))
        for i, v in enumerate(order)
    ]
    return F.greatest(*tallies)["v"]


def committee(ballots: DataFrame, keys: list[str]) -> DataFrame:
    """Ballots of several judges to one judgment per question.

    ``ballots``: keys, failed, verdict, hallucination and the scores. Median scores,
    majority verdict, hallucination when half or more say so.
    """
    ok = ~F.col("failed")
    valid = F.count_if(ok)
    scores = {s: F.when(ok, F.col(s)) for s in SCORES}
    wide = F.lit(False)
    for column in scores.values():
        wide = wide | (F.max(column) - F.min(column) >= SPREAD)
    split = F.lit(0)
    for v in VERDICTS:
        split = split + F.max((ok & (F.col("verdict") == v)).cast("int"))
    out = ballots.groupBy(*keys).agg(
        valid.alias("judges_valid"), F.count_if("failed").alias("judges_failed"),
        *[F.median(c).alias(s) for s, c in scores.items()],
        majority("verdict", VERDICTS, ok).alias("verdict"),
        (F.count_if(ok & F.col("hallucination")) * 2 >= valid).alias("hallucination"),
        ((split > 1) | wide).alias("disagreement"),
    )
    none = F.col("judges_valid") == 0
    return out.select(
        *keys, "judges_valid", "judges_failed", *SCORES,
        *[F.when(~none, F.col(c)).alias(c) for c in ("verdict", "hallucination", "disagreement")],
        none.alias("failed"),
    )


def label_committee(ballots: DataFrame, keys: list[str]) -> DataFrame:
    """Majority label per citation position and majority support, ties to the worse."""
    return ballots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_judges"), majority("label", LABELS, F.lit(True)).alias("label")
    )


def support_committee(ballots: DataFrame, keys: list[str]) -> DataFrame:
    return ballots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_judges"), majority("support", SUPPORT, F.lit(True)).alias("support"),
        (F.count_distinct("support") > 1).alias("disagreement"),
    )


def slices(records: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Every record once overall and once per dimension: ``slice, bucket``. The rows
    are expanded before a single aggregation, as grouping sets are."""
    parts = [F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("bucket"))]
    parts += [
        F.struct(F.lit(name).alias("slice"), value.cast("string").alias("bucket"))
        for name, value in dimensions.items()
    ]
    return records.withColumn("__s", F.explode(F.array(*parts))).select(
        "__s.slice", "__s.bucket", *records.columns
    )


def metric_slices(records: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Summary metrics per slice. ``records``: failed, verdict, hallucination, scores,
    cited_count, invalid_count, accuracy, hit_rate, answerable, latency_ms.

    The records are evaluated once. They are first summed per combination of all dimensions; the slices are
    sums of these cells, so that no record is repeated per dimension."""
    judged = ~F.col("failed")
    scored = F.col("accuracy").isNotNull()
    rate = lambda population, test: F.when(population, test.cast("double"))
    means = {
        **{s: F.when(judged, F.col(s)) for s in SCORES},
        "hallucination_rate": rate(judged, F.col("hallucination")), "refusal_rate": rate(judged, F.col("verdict") == "refusal"),
        "citation_accuracy": F.col("accuracy"), "full_citation_credit_rate": rate(scored, F.col("accuracy") == 1.0),
        "uncited_rate": rate(scored, F.col("cited_count") == 0),
        "abstention_rate": rate(~F.col("answerable") & judged, F.col("verdict") == "correct"),
        "unanswerable_citation_rate": rate(~F.col("answerable"), F.col("cited_count") > 0),
        "gt_source_hit_rate": F.col("hit_rate"), "latency_ms_mean": F.col("latency_ms"),
    }
    totals = {
        "n": F.lit(1), "judged": judged.cast("int"), **{f"n_{v}": (judged & (F.col("verdict") == v)).cast("int") for v in VERDICTS},
        "__invalid": F.when(scored, F.col("invalid_count")), "__cited": F.when(scored, F.col("cited_count")),
    }
    named = {f"__d{i}": value.cast("string") for i, value in enumerate(dimensions.values())}
    narrow = cut_lineage(records.select(
        *[value.alias(name) for name, value in named.items()], *[value.alias(f"__m_{name}") for name, value in means.items()],
        *[value.alias(f"__t_{name}") for name, value in totals.items()], "latency_ms",
    ))
    cells = narrow.groupBy(*named).agg(
        *[F.sum(f"__m_{name}").alias(f"__s_{name}") for name in means], *[F.count(f"__m_{name}").alias(f"__c_{name}") for name in means],
        *[F.coalesce(F.sum(F.coalesce(f"__t_{name}", F.lit(0))), F.lit(0)).alias(f"__t_{name}") for name in totals],
    )
    keys = dict(zip(dimensions, map(F.col, named)))
    summary = slices(cells, keys).groupBy("slice", "bucket").agg(
        *[F.sum(f"__t_{name}").alias(name) for name in totals],
        *[F.try_divide(F.sum(f"__s_{name}"), F.sum(f"__c_{name}")).alias(name) for name in means],
    ).withColumn("invalid_citation_rate", F.try_divide(F.col("__invalid"), F.col("__cited"))).drop("__invalid", "__cited")
    tails = order_statistics(
        slices(narrow.select(*named, "latency_ms"), keys).select("slice", "bucket", "latency_ms"), ["slice", "bucket"], "latency_ms",
        {"latency_ms_p50": nearest_rank(50), "latency_ms_p95": nearest_rank(95)},
    )
    return summary.join(tails, ["slice", "bucket"], "left")


def apply_rules(metrics: DataFrame, rules: list[tuple[int, str, Callable[[], Column], Column]]) -> DataFrame:
    """Suggestions whose condition holds on a one-row metrics table, by priority and
    then rule order. ``rules``: priority, name, condition, message column."""
    fired = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(condition(), F.lit(False)),
                    F.struct(F.lit(p).alias("priority"), F.lit(i).alias("ordinal"), F.lit(name).alias("rule"), message.alias("message")),
                )
                for i, (p, name, condition, message) in enumerate(rules)
            ]
        )
    )
    nothing = F.array(
        F.struct(F.lit(3).alias("priority"), F.lit(999).alias("ordinal"), F.lit("none").alias("rule"),
                 F.lit("no rule fired; read the lowest-scoring questions").alias("message"))
    )
    return metrics.select(F.inline(F.when(F.size(fired) > 0, fired).otherwise(nothing)))


def page_budget(pages: DataFrame, key: str, order: str, per_page: int = 6000, total: int = 40000) -> DataFrame:
    """Characters of each page a judge is shown: at most ``per_page`` each and ``total``
    per answer. An answer's citations are few, so its rows share a task."""
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.least(F.length("text"), F.lit(per_page))
    spent = F.coalesce(F.sum(asked).over(before), F.lit(0))
    return pages.withColumn("shown_chars", F.least(asked, F.greatest(F.lit(total) - spent, F.lit(0))))


def context_budget(ranked: DataFrame, key: str, order: str, tokens: Column, budget: int = 6000) -> DataFrame:
    """Blocks in rank order until the token budget; the first always stays. Everything
    after the first overflow is dropped, since token counts are positive."""
    from pyspark.sql import Window

    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(tokens).over(upto)
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    return ranked.withColumn("used_tokens", used).withColumn("__first", first).filter(
        (F.col("used_tokens") <= budget) | F.col("__first")
    ).drop("__first")
