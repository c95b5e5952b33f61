"""Checks on extracted text."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from citelode.functions import text as T

# Fixed values -------------------------------------------------------------------
#: Characters that belong to a word when looking for a reversed token.
WORD_INNER = "א-ת׳״\"'"
HEBREW_WORD = r"[\x{0590}-\x{05FF}]{2,}"
# --------------------------------------------------------------------------------


def canary_report(docs: DataFrame, tokens: list[str], inner: str = WORD_INNER) -> DataFrame:
    """Per file: canary tokens found and reversed tokens standing as words of their own.
    Reversed text means the extraction wrote letters in visual order."""
    found = F.array_compact(
        F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in tokens])
    )
    alone = lambda t: f"(?<![{inner}])\\Q{t[::-1]}\\E(?![{inner}])"
    reversed_ = F.array_compact(
        F.array(*[F.when(F.col("text").rlike(alone(t)), F.lit(t[::-1])) for t in tokens])
    )
    return docs.select(
        *[c for c in docs.columns if c != "text"],
        found.alias("tokens_found"),
        reversed_.alias("reversals_found"),
        (F.size(reversed_) == 0).alias("ok"),
    )


def canary_verdict(report: DataFrame, tokens: list[str]) -> DataFrame:
    """One row: every file fine and every token seen somewhere."""
    seen = report.agg(
        F.bool_and("ok").alias("files_ok"),
        *[F.bool_or(F.array_contains("tokens_found", t)).alias(f"__{i}") for i, t in enumerate(tokens)],
    )
    missing = F.array_compact(
        F.array(*[F.when(~F.col(f"__{i}"), F.lit(t)) for i, t in enumerate(tokens)])
    )
    return seen.select(
        "files_ok", missing.alias("missing_tokens"), (F.col("files_ok") & (F.size(missing) == 0)).alias("ok")
    )


class CanaryError(RuntimeError):
    """The extracted text is not fit to be published."""


@dataclass(frozen=True)
class CanaryGate:
    """What the texts of a build have to show: no reversed token in any file, every token in some
    file, and in the anchor file (if there is one) every known phrase."""

    tokens: tuple[str, ...]
    anchor_file: str | None = None
    anchor_phrases: tuple[str, ...] = ()
    inner: str = WORD_INNER

    def watch(self, files: DataFrame) -> tuple[DataFrame, Observation]:
        """``files`` (file, text) whose metrics are gathered by the job that reads them."""
        alone = lambda t: f"(?<![{self.inner}])\\Q{t[::-1]}\\E(?![{self.inner}])"
        turned = F.lit(False)
        for token in self.tokens:
            turned = turned | F.col("text").rlike(alone(token))
        flat = F.regexp_replace("text", T.SPACES, " ")
        anchor = F.col("file") == F.lit(self.anchor_file)
        seen = [F.max(F.contains("text", F.lit(t)).cast("int")).alias(f"token_{i}") for i, t in enumerate(self.tokens)]
        held = [F.max((anchor & F.contains(F.when(anchor, flat), F.lit(p))).cast("int")).alias(f"phrase_{i}") for i, p in enumerate(self.anchor_phrases)]
        watched = Observation()
        return files.observe(
            watched, F.count_if(turned).alias("reversed"), F.min(F.when(turned, F.col("file"))).alias("first_reversed"), *seen, *held
        ), watched

    def require(self, watched: Observation) -> None:
        """Raise unless the job that has run met the gate."""
        try:
            metrics = watched.get
        except Py4JJavaError:  # no row was read, so that there is nothing to report
            metrics = {}
        faults = []
        if metrics.get("reversed"):
            faults.append(f"reversed text in {metrics['reversed']} files, first {metrics['first_reversed']}")
        missing = [t for i, t in enumerate(self.tokens) if not metrics.get(f"token_{i}")]
        absent = [p for i, p in enumerate(self.anchor_phrases) if not metrics.get(f"phrase_{i}")]
        if missing:
            faults.append(f"tokens nowhere: {', '.join(missing)}")
        if absent:
            faults.append(f"{self.anchor_file} lacks: {', '.join(absent)}")
        if faults:
            raise CanaryError("; ".join(faults))


def anchor_report(pages: DataFrame, phrases: list[str]) -> DataFrame:
    """Whether a page's text, white space collapsed, holds every known phrase."""
    flat = F.regexp_replace("text", T.SPACES, " ")
    missing = F.array_compact(F.array(*[F.when(~F.contains(flat, F.lit(p)), F.lit(p)) for p in phrases]))
    return pages.select(
        *[c for c in pages.columns if c != "text"],
        missing.alias("phrases_missing"), (F.size(missing) == 0).alias("ok"),
    )


def round_robin_sample(files: DataFrame, n: int, anchor: Column, category: str = "category", path: str = "file") -> DataFrame:
    """Anchor first, then the first file of every category, the second of every
    category and so on, ``n`` in all.

    Only the first ``n`` files of a category can be picked, so each task forwards at
    most that many per category.
    """
    marked = files.withColumn("is_anchor", anchor)
    turns = Window.partitionBy(category, "is_anchor").orderBy(path)
    numbered = marked.withColumn("turn", F.row_number().over(turns)).filter(F.col("turn") <= n)
    return numbered.orderBy(F.col("is_anchor").desc(), "turn", category).limit(n)


def order_agreement(text: Column, oracle: Column) -> Column:
    """Share of lines with four or more Hebrew words that the oracle text contains word
    for word; one when nothing can be checked."""
    hebrew = lambda t: F.regexp_extract_all(t, F.lit(HEBREW_WORD), F.lit(0))
    lines = F.filter(F.transform(F.split(text, "\n"), hebrew), lambda w: F.size(w) >= 4)
    # An array of one element, so that its lambda reads the oracle's words and the lines as they are worked out
    # once; written out, they would be worked out again for every line.
    once = F.array(F.struct(F.array_join(hebrew(oracle), " ").alias("truth"), F.transform(lines, lambda w: F.array_join(w, " ")).alias("lines")))
    agreed = lambda o: F.size(F.filter(o["lines"], lambda line: F.contains(o["truth"], line))) / F.size(o["lines"])
    nothing = lambda o: (F.size(o["lines"]) == 0) | (o["truth"] == "")
    return F.transform(once, lambda o: F.when(nothing(o), F.lit(1.0)).otherwise(agreed(o)))[0]


def content_loss(files: DataFrame, chunks: DataFrame, limit: float = 0.98) -> DataFrame:
    """Files whose chunks hold fewer characters than ``limit`` of the raw text.
    ``files``: file, category, raw_chars. ``chunks``: file, text."""
    kept = chunks.groupBy("file").agg(F.sum(F.length("text").cast("long")).alias("chunk_chars"))
    joined = files.filter(F.col("raw_chars") > 0).join(kept, "file", "left")
    return (
        joined.withColumn("chunk_chars", F.coalesce("chunk_chars", F.lit(0)))
        .withColumn("ratio", F.col("chunk_chars") / F.col("raw_chars"))
        .filter(F.col("ratio") < limit)
    )
