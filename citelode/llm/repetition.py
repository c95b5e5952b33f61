"""Quality rules from repetition, by suffix arrays.

The words of a batch of documents become one integer sequence in which a word of one
document is a different symbol from the same word of another, so repeats never cross
documents. Suffixes are sorted by prefix doubling; the ranks kept from each doubling give
the longest common prefix of neighbouring suffixes. A word position whose suffix shares a
prefix of n words with a neighbour starts a repeat of n words, and the maximal ones among
these cover what all repeats cover. The union of their spans and the longest of them are bounded.

Defined cases: a null or empty text, or one without words, has no words and fails the
base rule (fewer than ten words). Rows that repeat are judged each. Nothing is judged across
documents, so ties and other columns have no effect; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelode.llm.common import BLANKS, WORD, whole_text

#: Base rule.
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: Words in a repeat that counts as long, percent of words such repeats may cover, and
#: words in the longest repeat of a document that is kept.
LONG, MOST_COVERED, MOST_LONGEST = 20, 10, 50
#: Words sorted together; a longer document is sorted alone.
BATCH = 200_000
SYMBOLS = "#*$%&|<>"


def _numbered(values: np.ndarray) -> np.ndarray:
    """Dense numbers of sorted values, from 1."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.empty(len(values), dtype=np.int64)
    new[order] = np.cumsum(np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)]))
    return new


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the rank of every position by its first 1, 2, 4, ... symbols.

    Doubling stops when all ranks differ."""
    n = len(symbols)
    ranks = [_numbered(symbols)]
    step = 1
    while step < n and ranks[-1].max() < n:
        now = ranks[-1]
        later = np.zeros(n, dtype=np.int64)
        later[:-step] = now[step:]
        ranks.append(_numbered(now * (n + 1) + later))
        step *= 2
    return np.argsort(ranks[-1], kind="stable"), ranks


def neighbour_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix in ``order`` with the one before it (first: 0)."""
    n = len(order)
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(0, n - 1), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (left < n) & (right < n)
        equal = inside.copy()
        equal[inside] = ranks[level][left[inside]] == ranks[level][right[inside]]
        shared[equal] += 1 << level
        left[equal] += 1 << level
        right[equal] += 1 << level
    return np.concatenate([[0], shared])[:n]


def repeat_lengths(symbols: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest repeat that starts there."""
    out = np.zeros(len(symbols), dtype=np.int64)
    if len(symbols) > 1:
        order, ranks = suffix_order(symbols)
        shared = neighbour_prefixes(order, ranks)
        out[order] = np.maximum(shared, np.concatenate([shared[1:], [0]]))
    return out


def covered(lengths: np.ndarray, least: int, fixed: bool = False) -> np.ndarray:
    """Which positions lie in a repeat of at least ``least`` words. With ``fixed`` a repeat
    counts as windows of exactly ``least`` words, which cover the same positions."""
    n = len(lengths)
    starts = np.flatnonzero(lengths >= least)
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + (least if fixed else lengths[starts]), -1)
    return np.cumsum(marks[:n]) > 0


def measure(texts: list[str]) -> list[tuple[int, int, int, int]]:
    """``n_words, n_repeat_words, n_long_words, longest`` of each text."""
    split = [text.encode().split() for text in texts]
    sizes = np.array([len(words) for words in split], dtype=np.int64)
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(word, len(ids)) for words in split for word in words), dtype=np.int64, count=int(sizes.sum()))
    symbols = np.repeat(np.arange(len(split)), sizes) * max(1, len(ids)) + flat
    lengths = repeat_lengths(symbols)
    ends = np.cumsum(sizes)
    repeat, long = covered(lengths, WINDOW, True), covered(lengths, LONG)
    out = []
    for start, end in zip(ends - sizes, ends, strict=True):
        own = lengths[start:end]
        out.append((int(end - start), int(repeat[start:end].sum()), int(long[start:end].sum()), int(own.max()) if end > start else 0))
    return out


_FIELDS = ("n_words", "n_repeat_words", "n_long_words", "longest")


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > BATCH * 6:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in _FIELDS]))
def repetition(texts: pa.Array) -> pa.Array:
    values = texts.to_pylist()
    rows = [row for start, end in _groups([len(value) for value in values]) for row in measure(values[start:end])]
    return pa.array([dict(zip(_FIELDS, row, strict=True)) for row in rows], type=pa.struct([(name, pa.int64()) for name in _FIELDS]))


def line_repeats(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    plain = F.translate("text", BLANKS, "")
    measured = rows.select(
        "doc_id", F.length(plain).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        line_repeats(F.col("text")).alias("n_dup_lines"), repetition("text").alias("m"),
    ).select("doc_id", "m.*", "word_chars", "n_symbols", "n_dup_lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    fine = (100 * F.col("n_long_words") <= MOST_COVERED * F.col("n_words")) & (F.col("longest") <= MOST_LONGEST)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def filter_repetitive(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rejected ones, columns as they were."""
    m = repetition(whole_text(text))
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    fine = (100 * m["n_long_words"] <= MOST_COVERED * m["n_words"]) & (m["longest"] <= MOST_LONGEST)
    return docs.filter(~failed & fine)


#: The same in DuckDB: repeats of LONG words and of MOST_LONGEST + 1 words as windows.
SQL = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM words, (VALUES (5), (20), (51)) AS sizes(n), range(1, len(w) - n + 2) AS starts(s)),
twice AS (SELECT r, n, s FROM windows QUALIFY count(*) OVER (PARTITION BY r, n, k) > 1),
covered AS (SELECT r, n, count(DISTINCT p) AS c FROM twice, range(s, s + n) AS places(p) GROUP BY r, n),
lines AS (
  SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS dups
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT words.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
    coalesce((SELECT c FROM covered WHERE covered.r = words.r AND n = 5), 0) AS n_repeat_words,
    coalesce((SELECT c FROM covered WHERE covered.r = words.r AND n = 20), 0) AS n_long_words,
    coalesce((SELECT c FROM covered WHERE covered.r = words.r AND n = 51), 0) > 0 AS too_long
  FROM words LEFT JOIN lines ON lines.r = words.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_long_words <= 10 * n_words AND NOT too_long AS kept
FROM base
"""
