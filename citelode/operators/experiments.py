"""Classifier experiments: filters, verdicts, arm metrics, paired tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from citelode.operators.order_stats import lower_middle, order_statistics, upper_middle

# Fixed values -------------------------------------------------------------------
FAMILIES = {
    "property": ("apartment", "business", "mortgage"),
    "medical": ("dental", "diseases-disabilities", "health", "long-term-care"),
    "personal-risk": ("diseases-disabilities", "life", "loss-of-working-ability", "personal-accident"),
}
NO_FILTER = "(none)"
HINT_DEPTH = 10
HINT_SNIPPETS = 3
HINT_VOTE_SHARE = 0.6
# --------------------------------------------------------------------------------


def as_categories(categories: Column) -> Column:
    """Ordered distinct names, null when there are none."""
    return F.when(F.size(categories) > 0, F.array_distinct(categories))


def expand_families(categories: Column, families: dict[str, tuple[str, ...]] = FAMILIES) -> Column:
    """Tags plus every member of a family that holds one of them, sorted."""
    out = categories
    for members in families.values():
        family = F.array(*[F.lit(m) for m in members])
        out = F.when(F.arrays_overlap(categories, family), F.array_union(out, family)).otherwise(out)
    return F.sort_array(F.array_distinct(out))


def filter_for(policy: str, categories: Column, gold: Column, families=FAMILIES) -> Column:
    """Category filter under a policy: none, gold, gold-family, predicted,
    predicted-set, predicted-family. Null means no filter."""
    tags = as_categories(categories)
    choices = {
        "none": F.lit(None).cast("array<string>"),
        "gold": F.array(gold),
        "gold-family": expand_families(F.array(gold), families),
        "predicted": F.when(F.size(tags) == 1, tags),
        "predicted-set": tags,
        "predicted-family": F.when(tags.isNotNull(), expand_families(tags, families)),
    }
    return choices[policy]


def effective_filter(categories: Column) -> Column:
    return F.when(F.size(categories) == 1, F.get(categories, F.lit(0)))


def verdict(categories: Column, gold: Column) -> Column:
    chosen = effective_filter(categories)
    return F.when(chosen.isNull(), "none").when(chosen == gold, "useful").otherwise("harmful")


def applied_filters(subs: Column) -> Column:
    """The single tag of every sub-question that has exactly one."""
    single = F.filter(subs, lambda s: F.size(s["categories"]) == 1)
    return F.transform(single, lambda s: F.get(s["categories"], F.lit(0)))


def vote(samples: Column, min_votes: int) -> Column:
    """Categories in at least ``min_votes`` of the sample arrays, each sample once."""
    ballots = F.flatten(F.transform(samples, F.array_distinct))
    return F.filter(
        F.array_distinct(ballots), lambda c: F.size(F.filter(ballots, lambda b: b == c)) >= min_votes
    )


def finish_reason(reasons: Column) -> Column:
    """``length`` if any call was cut, else the first call's reason."""
    return F.when(F.array_contains(reasons, "length"), "length").otherwise(F.get(reasons, F.lit(0)))


def needs_strong_model(difficulty: Column, mode: Column, calculation: Column, dependent: Column) -> Column:
    return (difficulty == "hard") | (mode == "multi") | calculation | dependent


def category_hint(candidates: DataFrame) -> DataFrame:
    """Category histogram of the first fused candidates per query.

    ``candidates``: qid, rank, category. Result: qid, n_hits, histogram (count down,
    first seen first), top_category, top_share.
    """
    seen = candidates.filter(F.col("rank") <= HINT_DEPTH).groupBy("qid", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")
    )
    ordered = seen.groupBy("qid").agg(
        F.sum("n").alias("n_hits"),
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "first", "category", "n"))).alias("h"),
    )
    return ordered.select(
        "qid", "n_hits",
        F.transform("h", lambda e: F.struct(e["category"].alias("category"), e["n"].alias("n"))).alias("histogram"),
        F.get("h", F.lit(0))["category"].alias("top_category"),
        F.round(F.get("h", F.lit(0))["n"] / F.col("n_hits"), 4).alias("top_share"),
    )


def hint_vote(hint: DataFrame) -> Column:
    return F.when(F.col("top_share") >= HINT_VOTE_SHARE, F.array("top_category")).otherwise(F.array().cast("array<string>"))


def arm_summary(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics per bucket. ``predictions``: keys, gold, subs, categories, verdict,
    parse_failed, finish_reason, n_calls, latency_ms, cost_usd."""
    rate = lambda test: F.avg(test.cast("double"))
    filters = applied_filters(F.col("subs"))
    rows = predictions.withColumn("__subs", F.size("subs")).withColumn(
        "__tags", F.aggregate("subs", F.lit(0), lambda a, s: a + F.size(s["categories"]))
    ).withColumn("__filters", F.size(filters)).withColumn(
        "__wrong", F.size(F.filter(filters, lambda f: f != F.col("gold")))
    )
    table = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("verdict") == "harmful").alias("harmful_rate"),
        rate(F.col("verdict") == "useful").alias("filter_correct_rate"),
        rate(F.col("verdict") == "none").alias("no_filter_rate"),
        rate(F.array_contains("categories", F.col("gold"))).alias("recall_any"),
        F.try_divide(F.sum("__tags"), F.sum("__subs")).alias("mean_tags_per_sub"),
        F.avg("__subs").alias("mean_sub_questions"),
        rate(F.col("parse_failed")).alias("parse_fail_rate"),
        F.avg("n_calls").alias("calls_per_question"),
        rate(F.coalesce(F.col("finish_reason") == "length", F.lit(False))).alias("truncation_rate"),
        F.avg("cost_usd").alias("mean_cost_usd"), F.sum("cost_usd").alias("total_cost_usd"),
        F.sum("__filters").alias("sub_filter_count"),
        F.try_divide(F.sum("__wrong"), F.sum("__filters")).alias("sub_harmful_rate"),
    )
    middle = order_statistics(predictions, keys, "latency_ms", {"__a": lower_middle, "__b": upper_middle})
    return (
        table.join(middle, keys)
        .withColumn("net", F.col("filter_correct_rate") - F.col("harmful_rate"))
        .withColumn("p50_ms", (F.col("__a") + F.col("__b")) / 2)
        .drop("__a", "__b")
    )


def by_set(predictions: DataFrame) -> DataFrame:
    """Each prediction under its own set and under ``pooled``."""
    return predictions.withColumn("bucket", F.explode(F.array("set", F.lit("pooled"))))


def confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    predicted = F.coalesce(effective_filter(F.col("categories")), F.lit(NO_FILTER))
    return predictions.groupBy(*keys, "gold", predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def worst_pairs(table: DataFrame, by: list[str], limit: int = 8) -> DataFrame:
    """Most frequent confusions of each group; a confusion table has a row per pair of labels."""
    wrong = table.filter(~F.col("predicted").isin(NO_FILTER) & (F.col("predicted") != F.col("gold")))
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("gold").desc(), F.col("predicted").desc())
    return wrong.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= limit).drop("__place")


def mcnemar_exact(fixed: int, broken: int) -> float:
    """Two-sided exact binomial tail. Terms shrink away from the smaller count, so the
    sum stops when they no longer matter; logarithms keep large counts finite."""
    n, smaller = fixed + broken, min(fixed, broken)
    if n == 0:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(smaller + 1) - math.lgamma(n - smaller + 1) - n * math.log(2)
    term = total = 1.0
    for i in range(smaller, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < total * 1e-17:
            break
    return round(min(1.0, 2 * math.exp(log_term + math.log(total))), 6)


@F.pandas_udf(DoubleType())
def mcnemar_p(fixed: pd.Series, broken: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_exact(int(a), int(b)) for a, b in zip(fixed, broken)])


def paired(predictions: DataFrame, reference: str, keys: list[str]) -> DataFrame:
    """Every arm against the reference arm on the ids both produced: wrong filters
    fixed and broken, right filters gained and lost, exact p for each."""
    columns = ["id", *keys, "verdict"]
    arms = predictions.filter(F.col("arm") != reference).select("arm", *columns)
    base = predictions.filter(F.col("arm") == reference).select("id", *keys, F.col("verdict").alias("base"))
    v, b = F.col("verdict"), F.col("base")
    counts = arms.join(base, ["id", *keys]).groupBy("arm", *keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if((b == "harmful") & (v != "harmful")).alias("n_fixed"),
        F.count_if((b != "harmful") & (v == "harmful")).alias("n_broken"),
        F.count_if((b != "useful") & (v == "useful")).alias("n_correct_gained"),
        F.count_if((b == "useful") & (v != "useful")).alias("n_correct_lost"),
    )
    return counts.withColumn("mcnemar_p", mcnemar_p("n_fixed", "n_broken")).withColumn(
        "mcnemar_p_correct", mcnemar_p("n_correct_gained", "n_correct_lost")
    )


def compared(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Arms against several references at once. ``pairs``: arm, reference. ``arm, reference,
    n_pairs``, the counts of both verdict dimensions and their exact p."""
    arms = predictions.select("arm", "id", "verdict").join(pairs, "arm")
    base = predictions.select(F.col("arm").alias("reference"), "id", F.col("verdict").alias("base"))
    v, b = F.col("verdict"), F.col("base")
    counts = arms.join(base, ["reference", "id"]).groupBy("arm", "reference").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if((b == "harmful") & (v != "harmful")).alias("n_fixed"),
        F.count_if((b != "harmful") & (v == "harmful")).alias("n_broken"),
        F.count_if((b != "useful") & (v == "useful")).alias("n_correct_gained"),
        F.count_if((b == "useful") & (v != "useful")).alias("n_correct_lost"),
    )
    return counts.withColumn("mcnemar_p", mcnemar_p("n_fixed", "n_broken")).withColumn(
        "mcnemar_p_correct", mcnemar_p("n_correct_gained", "n_correct_lost")
    )


def changed_ids(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """``arm, reference, change, id`` in both verdict dimensions: a wrong filter fixed or
    broken, a right one gained or lost. One row each, so no arm's ids are collected."""
    arms = predictions.select("arm", "id", "verdict").join(pairs, "arm")
    base = predictions.select(F.col("arm").alias("reference"), "id", F.col("verdict").alias("base"))
    v, b = F.col("verdict"), F.col("base")
    changes = F.array_compact(F.array(
        F.when((b == "harmful") & (v != "harmful"), "fixed").when((b != "harmful") & (v == "harmful"), "broken"),
        F.when((b != "useful") & (v == "useful"), "gained").when((b == "useful") & (v != "useful"), "lost"),
    ))
    return arms.join(base, ["reference", "id"]).select("arm", "reference", "id", F.explode(changes).alias("change"))


def discordant(predictions: DataFrame, reference: str) -> DataFrame:
    """Ids whose wrong filter an arm fixed or broke, one row each."""
    arms = predictions.filter(F.col("arm") != reference).select("arm", "id", "verdict")
    base = predictions.filter(F.col("arm") == reference).select("id", F.col("verdict").alias("base"))
    both = arms.join(base, "id").filter((F.col("verdict") == "harmful") != (F.col("base") == "harmful"))
    return both.select("arm", "id", F.when(F.col("base") == "harmful", "fixed").otherwise("broken").alias("change"))
