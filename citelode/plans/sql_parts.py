"""Shared pieces of the comparison SQL."""

from citelode.functions.text import EDGE_PUNCTUATION, LOOKALIKES, PLAIN_FORMS, POINTS, WHITESPACE

WS = WHITESPACE


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({strip(x)}, '[{WS}]+', ' ', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def estimate(n: str) -> str:
    return f"(floor(({n}) * 1.3::DOUBLE)::INT + 1)"


def tokens(x: str) -> str:
    plain = f"translate(nfc_normalize({x}), {lit(LOOKALIKES)}, {lit(PLAIN_FORMS)})"
    lowered = f"lower(regexp_replace({plain}, '[{POINTS}]', '', 'g'))"
    return (
        f"list_filter(list_transform(string_split_regex({lowered}, '[{WS}-]+'), "
        f"lambda p: trim(p, {lit(EDGE_PUNCTUATION)})), lambda p: p <> '')"
    )


def sentences(x: str) -> str:
    marked = f"regexp_replace({strip(x)}, '([.!?])[{WS}]+', concat('\\1', chr(1)), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), "
        f"lambda p: {strip('p')}), lambda p: p <> '')"
    )


FILES = """
files AS (
  SELECT source || '/pages/' || doc_id || '.txt' AS file, source AS category, text
  FROM documents)"""

# Window starts follow the greedy walk: each start is computed from the one before.
CHUNKS = f"""
{FILES},
sents AS (
  SELECT file, category, {sentences('text')} AS s FROM files),
counted AS (
  SELECT file, category, s, len(s) AS n, list_transform(s, lambda p: {words('p')}) AS w
  FROM sents WHERE len(s) > 0),
walk AS (
  SELECT file, 0 AS n_chunk, 0 AS st,
         greatest(1, coalesce(list_max(list_filter(range(1, least(7, n)::INT + 1),
           lambda l: {estimate('list_sum(w[1:l])')} <= 512)), 1))::INT AS len
  FROM counted
  UNION ALL
  SELECT k.file, k.n_chunk + 1, k.st + greatest(1, k.len - 2),
         greatest(1, coalesce(list_max(list_filter(
           range(1, least(7, c.n - (k.st + greatest(1, k.len - 2)))::INT + 1),
           lambda l: {estimate('list_sum(w[k.st + greatest(1, k.len - 2) + 1 : k.st + greatest(1, k.len - 2) + l])')} <= 512)), 1))::INT
  FROM walk k JOIN counted c USING (file)
  WHERE k.st + k.len < c.n),
chunks AS (
  SELECT k.file || '#pnull#c' || k.n_chunk AS chunk_id, k.file, c.category, k.n_chunk, k.st, k.len,
         array_to_string(c.s[k.st + 1 : k.st + k.len], ' ') AS text
  FROM walk k JOIN counted c USING (file))"""

TOKEN_CHUNKS = f"""
{CHUNKS},
tchunks AS (
  SELECT chunk_id, file, category, text, {tokens('text')} AS tokens FROM chunks),
queries AS (
  SELECT item_id AS qid, text AS question, {tokens('text')} AS tokens FROM benchmark)"""

BM25 = f"""
{TOKEN_CHUNKS},
qterms AS (
  SELECT qid, token, count(*) AS qtf
  FROM (SELECT qid, unnest(tokens) AS token FROM queries) GROUP BY ALL),
corpus AS (
  SELECT count(*) AS n, avg(len(tokens))::DOUBLE AS avgdl FROM tchunks),
postings AS (
  SELECT chunk_id, category, dl, token, count(*) AS tf
  FROM (SELECT chunk_id, category, len(tokens) AS dl, unnest(tokens) AS token FROM tchunks)
  WHERE token IN (SELECT token FROM qterms) GROUP BY ALL),
dfreq AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
bm25 AS (
  SELECT qid, chunk_id, category,
         sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
             * (tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
  FROM postings JOIN qterms USING (token) JOIN dfreq USING (token), corpus
  GROUP BY ALL),
sparse AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
    FROM bm25 WHERE score > 0) WHERE rank <= 20)"""

DENSE = """
slots AS (
  SELECT chunk_id, category, ('0x' || substr(md5(token), 1, 4))::INT % 64 AS slot, count(*)::DOUBLE AS c
  FROM (SELECT chunk_id, category, unnest(tokens) AS token FROM tchunks) GROUP BY ALL),
qslots AS (
  SELECT qid, ('0x' || substr(md5(token), 1, 4))::INT % 64 AS slot, count(*)::DOUBLE AS c
  FROM (SELECT qid, unnest(tokens) AS token FROM queries) GROUP BY ALL),
norms AS (SELECT chunk_id, sqrt(sum(c * c)) AS norm FROM slots GROUP BY 1),
qnorms AS (SELECT qid, sqrt(sum(c * c)) AS norm FROM qslots GROUP BY 1),
dots AS (
  SELECT q.qid, s.chunk_id, any_value(s.category) AS category, sum(q.c * s.c) AS dot
  FROM slots s JOIN qslots q USING (slot) GROUP BY 1, 2),
cosine AS (
  SELECT qid, chunk_id, category, dot / n.norm / m.norm AS score
  FROM dots JOIN norms n USING (chunk_id) JOIN qnorms m USING (qid)),
dense AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
    FROM cosine) WHERE rank <= 20)"""

# Chunks without any shared slot have cosine zero and never reach a full top 20.
FUSED = f"""
{BM25},
{DENSE},
fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf_score, 9) DESC, chunk_id) AS rank
    FROM (
      SELECT qid, chunk_id, d.score AS dense_score, s.score AS sparse_score,
             coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS rrf_score
      FROM (SELECT qid, chunk_id, score, rank FROM dense) d
      FULL JOIN (SELECT qid, chunk_id, score, rank FROM sparse) s USING (qid, chunk_id)))
  WHERE rank <= 20),
reranked AS (
  SELECT f.*, t.category, t.file, t.text,
         1 / (1 + exp(-(8 * (len(list_intersect(list_distinct(q.tokens), list_distinct(t.tokens)))::DOUBLE
                             / greatest(len(list_distinct(q.tokens)), 1)) - 4))) AS rerank_score
  FROM fused f JOIN tchunks t USING (chunk_id) JOIN queries q USING (qid)),
gated AS (
  SELECT * REPLACE (new_rank AS rank) FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, chunk_id) AS new_rank
    FROM reranked WHERE rerank_score >= 0.35) WHERE new_rank <= 6)"""
