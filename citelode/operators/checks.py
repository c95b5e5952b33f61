"""Rules that chunks, items and batches must keep, as tables of what breaks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions import text as T
from citelode.operators.keyword import top_k
from citelode.operators.scan import hash_order


def _problems(df: DataFrame, rules: list[tuple[str, Column]], keys: list[str]) -> DataFrame:
    """One row per broken rule, all rules read in one pass."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
    return df.select(*keys, F.explode(found).alias("problem"))


def chunk_violations(chunks: DataFrame, categories: list[str]) -> DataFrame:
    """``chunk_id, problem``. ``chunks``: chunk_id, file, category, page, text, kind (pdf or txt)."""
    file, page = F.col("file"), F.col("page")
    rules = [
        ("blank_text", T.strip(F.col("text")) == ""),
        ("unknown_category", ~F.coalesce(F.col("category").isin(categories), F.lit(False))),
        ("file_outside_category", ~F.coalesce(file.startswith(F.concat("category", F.lit("/"))), F.lit(False))),
        ("file_not_nfc", file != T.nfc(file)),
        ("pdf_without_page", (F.col("kind") == "pdf") & (page.isNull() | (page < 1))),
        ("txt_with_page", (F.col("kind") == "txt") & page.isNotNull()),
    ]
    return _problems(chunks, rules, ["chunk_id"])


def item_violations(items: DataFrame, categories: list[str], language: str) -> DataFrame:
    """``id, problem``. ``items``: id, domain, difficulty, question_lang, answer_lang, sources
    (array of file paths). An id starts with its domain and difficulty."""
    prefix = F.concat_ws("-", "domain", "difficulty")
    rules = [
        ("unknown_category", ~F.coalesce(F.col("domain").isin(categories), F.lit(False))),
        ("question_language", ~F.coalesce(F.col("question_lang") == language, F.lit(False))),
        ("answer_language", ~F.coalesce(F.col("answer_lang") == language, F.lit(False))),
        ("id_does_not_fit", ~F.startswith("id", F.concat(prefix, F.lit("-")))),
        ("source_outside_category", F.exists("sources", lambda s: ~F.startswith(s, F.concat("domain", F.lit("/"))))),
    ]
    return _problems(items, rules, ["id"])


def failed_ids(records: DataFrame) -> DataFrame:
    """``id, kind, failure``: records without judgment or citation judgment, one row each, so that no
    list grows with a kind; a record that names no kind is ``standard``. ``records``: id, kind, judged, citation_judged, cites."""
    kind = T.first_present(F.col("kind"), F.lit("standard"))
    rules = [("judgment", ~F.col("judged")), ("citation_judgment", F.col("cites") & ~F.col("citation_judged"))]
    return _problems(records.withColumn("kind", kind), rules, ["id", "kind"]).withColumnRenamed("problem", "failure")


def answerable(questions: DataFrame) -> DataFrame:
    """Questions that name at least one source."""
    return questions.filter(F.size("sources") > 0)


def audit_sample(items: DataFrame, per: list[str], n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` items of each group in a seeded hash order, for a second look."""
    digest = items.withColumn("__digest", hash_order(F.lit(seed), F.col(key)))
    return top_k(digest, per, [F.col("__digest"), F.col(key)], n, "draw").drop("__digest")


def parse_outcomes(files: DataFrame, parse: Callable[[Column], Column], cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed documents and ``file, status, error`` of every file.

    ``parse`` maps content to ``struct<doc,error>`` and never raises, so that one bad file
    fails alone. Files whose fingerprint is in ``cached`` are not parsed again."""
    known = cached.select("file", "fingerprint", F.lit(True).alias("__cached"))
    marked = files.join(known, ["file", "fingerprint"], "left")
    tried = marked.withColumn("__p", F.when(F.col("__cached").isNull(), parse(F.col("content"))))
    status = F.when(F.col("__cached"), "cached").when(F.col("__p.error").isNull(), "ok").otherwise("failed")
    outcomes = tried.select("file", status.alias("status"), F.col("__p.error").alias("error"))
    documents = tried.filter(F.col("__cached").isNull() & F.col("__p.error").isNull()).select("file", F.col("__p.doc").alias("doc"))
    return documents, outcomes


def provider_warnings(outputs: DataFrame) -> DataFrame:
    """``file, category, ordinal, logger, message`` from the ``warnings`` a provider returns beside its
    result, so that each is attributed to the row it came with."""
    each = outputs.select("file", "category", F.posexplode("warnings").alias("ordinal", "w"))
    return each.select("file", "category", "ordinal", "w.logger", "w.message")


def table_cells(tables: DataFrame) -> DataFrame:
    """``file, page, place, text, counted``: cells of tables and the copies of them in the grid.
    Only the cells count; an item's page is that of its first place. ``tables``: file, pages (array),
    cells (array of text), grid (array of rows)."""
    page = F.get("pages", F.lit(0)).alias("page")
    both = F.concat(
        F.transform("cells", lambda c, i: F.struct(i.alias("place"), c.alias("text"), F.lit(True).alias("counted"))),
        F.transform(F.flatten("grid"), lambda c, i: F.struct(i.alias("place"), c.alias("text"), F.lit(False).alias("counted"))),
    )
    return tables.select("file", page, F.inline(both))


def gate_inputs(pages: DataFrame, support: Column) -> DataFrame:
    """Retrieved pages in the shape of citations with the ruling a provider gives on them."""
    return pages.select("id", F.struct("file", "page", F.lit(None).cast("string").alias("quote")).alias("citation"), support.alias("support"))


def classification_or_default(parsed: Column, question: Column) -> Column:
    """Sub-questions of a reply; without any, the question itself with no category filter."""
    whole = F.array(F.struct(question.alias("question"), F.array().cast("array<string>").alias("categories")))
    return F.when(F.size(parsed) > 0, parsed).otherwise(whole)
