"""Tokenizing queries: segments of long texts, refused segments, united analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelode.operators import tokenizing
from citelode.plans import sql_parts as S
from citelode.plans import tables as D


def text_segments(spark, sf_dir):
    docs = D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = tokenizing.segment_rows(docs, ["doc_id"])
    return rows.select("doc_id", F.col("segment").cast("long").alias("segment"), F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("piece_md5"))


def no_addresses(pieces: list[str]) -> list[list[str]]:
    """Stand-in for a model that refuses a whole call if one text holds an ``@``."""
    if any("@" in piece for piece in pieces):
        raise ValueError("address in text")
    return [[word.lower() for word in piece.split(" ") if word] for piece in pieces]


def plain_words(piece: str) -> list[str]:
    return [word for word in piece.split(" ") if word]


def token_fallback(spark, sf_dir):
    docs = D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = tokenizing.tokenize(docs, ["doc_id"], no_addresses, plain_words)
    return found.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.col("segments").cast("long").alias("n_segments"),
        F.col("fallbacks").cast("long").alias("n_fallbacks"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


def lemma_union(spark, sf_dir):
    turns = D.spread(D.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    analysed = turns.withColumn("analyses", tokenizing.suffix_analyses(F.col("text")))
    united = tokenizing.with_united_tokens(analysed, "analyses")
    return united.select("conv_id", "turn", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


QUERIES = {f.__name__: f for f in (text_segments, token_fallback, lemma_union)}

# A segment ends behind the last line break in its 4000 characters, else before the last space, else there.
_SEGMENTS = r"""
walk AS (
  SELECT doc_id, text, 0 AS segment, 0 AS st, cut(text, 0) AS n FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, text, segment + 1, st + n, cut(text, st + n) FROM walk WHERE st + n < length(text)),
pieces AS (SELECT doc_id, segment, substr(text, st + 1, n) AS piece FROM walk)"""


def _cut(sql: str) -> str:
    """``cut(text, start)`` written out."""
    body = """(CASE WHEN length(text) - ({0}) <= 4000 THEN length(text) - ({0})
      WHEN contains(substr(text, ({0}) + 1, 4000), chr(10)) THEN 4001 - strpos(reverse(substr(text, ({0}) + 1, 4000)), chr(10))
      WHEN contains(substr(text, ({0}) + 2, 3999), ' ') THEN 4000 - strpos(reverse(substr(text, ({0}) + 2, 3999)), ' ')
      ELSE 4000 END)"""
    return sql.replace("cut(text, 0)", body.format("0")).replace("cut(text, st + n)", body.format("st + n"))


_ANALYSES = f"""
listed AS (
  SELECT row_number() OVER () AS id, conv_id, turn, text,
    list_filter(string_split_regex({S.strip('text')}, '[{S.WS}]+'), lambda t: t <> '') AS surfaces
  FROM conversations),
spots AS (SELECT id, unnest(surfaces) AS surface, generate_subscripts(surfaces, 1) AS i FROM listed),
words AS (SELECT id, i, surface, unnest(string_split(surface, '''')) AS word, generate_subscripts(string_split(surface, ''''), 1) AS j FROM spots),
forms AS (
  SELECT id, i, 3 * j AS place, CASE WHEN length(word) > 4 AND right(word, 1) = 's' THEN left(word, length(word) - 1) ELSE word END AS form FROM words
  UNION ALL SELECT id, i, 3 * j + 1, word FROM words
  UNION ALL SELECT id, i, 1000000000, surface FROM spots),
normal AS (SELECT id, i, place, {S.tokens('form')} AS tokens FROM forms),
each_token AS (SELECT id, i, place, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS k FROM normal),
firsts AS (SELECT id, i, token, min((place, k)) AS spot FROM each_token GROUP BY ALL),
united AS (SELECT id, list(token ORDER BY i, spot) AS tokens FROM firsts GROUP BY id)"""

ORACLES = {
    "text_segments": f"""WITH RECURSIVE {_cut(_SEGMENTS)}
SELECT doc_id, segment::BIGINT AS segment, length(piece)::BIGINT AS n_chars, md5(piece) AS piece_md5 FROM pieces""",
    "token_fallback": f"""WITH RECURSIVE {_cut(_SEGMENTS)},
parts AS (
  SELECT doc_id, segment, contains(piece, '@') AS refused,
    list_filter(string_split(CASE WHEN contains(piece, '@') THEN piece ELSE lower(piece) END, ' '), lambda w: w <> '') AS words
  FROM pieces),
joined AS (
  SELECT doc_id, flatten(list(words ORDER BY segment)) AS tokens, count(*) AS n_segments, count(*) FILTER (refused) AS n_fallbacks
  FROM parts GROUP BY doc_id)
SELECT doc_id, len(tokens)::BIGINT AS n_tokens, n_segments, n_fallbacks, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM joined""",
    "lemma_union": f"""WITH {_ANALYSES}
SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN coalesce(len(tokens), 0) END::BIGINT AS n_tokens,
  CASE WHEN text IS NOT NULL THEN md5(coalesce(array_to_string(tokens, ' '), '')) END AS tokens_md5
FROM listed LEFT JOIN united USING (id)""",
}
