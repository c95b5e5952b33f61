"""Document-transform, chunking and text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelode.functions import text as T
from citelode.operators import chunking, markdown, quality, reading_order
from citelode.operators.order_stats import floor_rank, order_statistics
from citelode.operators.scan import blocked_last_value, integer_block
from citelode.plans import sql_parts as S
from citelode.plans import tables as D

CANARY = ["the", "que", "der", "en"]
LATIN, HEBREW = "abcdefghijklmnopqrstuv", "אבגדהוזחטיךכלםמןנסעףפץ"


def docs(spark, sf_dir):
    return D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def long(column, name):
    return column.cast("long").alias(name)


def sentence_split_counts(spark, sf_dir):
    sentences = T.sentences(F.col("text"))
    return docs(spark, sf_dir).select(
        "doc_id", long(F.size(sentences), "n_sentences"),
        F.md5(F.array_join(sentences, "\n")).alias("sentences_md5"),
    )


def token_count_heuristic(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", long(T.word_count(F.col("text")), "n_words"),
        long(T.token_estimate(F.col("text")), "n_tokens"),
        long(T.approx_tokens(F.col("text")), "approx_tokens"),
    )


def _windows(spark, sf_dir, max_tokens):
    found = chunking.sentence_windows(
        D.files(spark, sf_dir).select("file", "text"), "text", max_tokens=max_tokens
    )
    return found.select(
        chunking.chunk_id(F.col("file"), F.lit(None), F.col("n")).alias("chunk_id"),
        long(F.col("start"), "first_sentence"), long(F.col("length"), "n_sentences"),
        F.md5("text").alias("text_md5"),
    )


def sentence_window_chunks(spark, sf_dir):
    return _windows(spark, sf_dir, 512)


def capped_window_chunks(spark, sf_dir):
    """A cap low enough to shorten most windows."""
    return _windows(spark, sf_dir, 60)


def pack_paragraphs_greedy(spark, sf_dir):
    parts = T.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    packs = docs(spark, sf_dir).select(
        "doc_id", F.posexplode_outer(chunking.paragraph_packs(parts, 120)).alias("pack", "p")
    )
    return packs.select(
        "doc_id", long(F.col("pack"), "pack"), long(F.col("p.tokens"), "n_tokens"),
        F.col("p.oversized").alias("oversized"), F.md5("p.text").alias("text_md5"),
    )


def normalized_token_freq(spark, sf_dir):
    found = T.each(docs(spark, sf_dir), [], T.tokens(F.col("text")), "token")
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def word_token_stats(spark, sf_dir):
    words = T.words(F.col("text"), 3)
    return docs(spark, sf_dir).select(
        "doc_id", long(F.size(words), "n_words"), long(F.size(F.array_distinct(words)), "n_distinct"),
        T.has_quantity(F.col("text"), "0-9").alias("has_quantity"),
        T.direction(F.col("text")).alias("direction"),
        F.md5(T.snippet(F.col("text"))).alias("snippet_md5"),
    )


def _paged(spark, sf_dir):
    """Each document line becomes a marked page; page numbers repeat after 40 lines."""
    lines = F.split("text", "\n")
    body = F.array_join(
        F.transform(lines, lambda l, i: F.concat(F.lit("{"), (i % 40).cast("string"), F.lit("}------------\n\n"), l)),
        "\n\n",
    )
    return docs(spark, sf_dir).select("doc_id", body.alias("text"))


def page_split(spark, sf_dir):
    pages = markdown.split_pages(_paged(spark, sf_dir))
    return pages.select("doc_id", "page", F.md5(T.strip(F.col("body"))).alias("body_md5"))


def html_clean(spark, sf_dir):
    pages = D.spread(D.table(spark, sf_dir, "pages").select("page_id", "html"))
    cleaned = markdown.clean(F.col("html"))
    return pages.select("page_id", long(F.length(cleaned), "n_chars"), F.md5(cleaned).alias("text_md5"))


def _items(spark, sf_dir):
    """Document lines with pipes are table rows; other lines are prose."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda l: F.when(F.contains(l, F.lit(" | ")), F.concat(F.lit("| "), l, F.lit(" |"))).otherwise(l),
    )
    # A table row ends at a sentence break, so one long line gives a table of many rows.
    rows = F.transform(lines, lambda l: F.when(l.startswith("| "), F.regexp_replace(l, r"\. \| ", " |\n| ")).otherwise(l))
    pages = docs(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.array_join(rows, "\n").alias("body"))
    return markdown.page_items(pages, ["doc_id"])


def table_blocks(spark, sf_dir):
    items = _items(spark, sf_dir)
    return items.select(
        "doc_id", "seq", "kind", long(F.coalesce(F.size("grid"), F.lit(0)), "n_rows"),
        long(F.coalesce(F.size(F.get("grid", F.lit(0))), F.lit(0)), "n_cols"),
        F.md5(F.when(F.col("kind") == "text", F.col("text")).otherwise(
            F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "\n"))).alias("content_md5"),
    )


def _chunk_items(spark, sf_dir):
    return _items(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("file"), F.lit("docs").alias("category"),
        "page", "seq", "kind", "text",
    )


def per_page_chunks(spark, sf_dir):
    found = chunking.page_chunks(_chunk_items(spark, sf_dir), 400)
    return found.select("chunk_id", "file", "page", long(F.length("text"), "n_chars"), F.md5("text").alias("text_md5"))


def per_table_chunks(spark, sf_dir):
    found = chunking.table_chunks(_chunk_items(spark, sf_dir))
    return found.select("chunk_id", "file", "page", long(F.length("text"), "n_chars"), F.md5("text").alias("text_md5"))


def heading_carry(spark, sf_dir):
    """Last user turn above every turn of a conversation."""
    turns = D.table(spark, sf_dir, "conversations").withColumn("block", integer_block(F.col("turn")))
    heading = F.when((F.col("role") == "user") & (T.strip(F.col("text")) != ""), F.col("text"))
    carried = blocked_last_value(turns, ["conv_id"], "block", [F.col("turn")], heading, "heading")
    return carried.select("conv_id", "turn", "role", F.md5("heading").alias("heading_md5"))


def canary_check(spark, sf_dir):
    report = quality.canary_report(docs(spark, sf_dir).select("doc_id", "text"), CANARY, "A-Za-zÀ-ÿ'")
    return report.select(
        "doc_id", F.array_join("tokens_found", ",").alias("tokens_found"),
        F.array_join("reversals_found", ",").alias("reversals_found"), "ok",
    )


def canary_verdict(spark, sf_dir):
    report = quality.canary_report(docs(spark, sf_dir).select("doc_id", "text"), CANARY, "A-Za-zÀ-ÿ'")
    return quality.canary_verdict(report, CANARY).select(
        "files_ok", F.array_join("missing_tokens", ",").alias("missing_tokens"), "ok"
    )


def canary_sample(spark, sf_dir):
    files = D.table(spark, sf_dir, "documents").select(
        F.col("source").alias("category"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file")
    )
    picked = quality.round_robin_sample(files, 30, F.col("file") == "000000000007")
    return picked.select("category", "file", "is_anchor", F.col("turn"))


def _oracle_text():
    """Every third line loses its word order."""
    lines = F.split("text", "\n")
    return F.array_join(
        F.transform(lines, lambda l, i: F.when(i % 3 == 0, F.array_join(F.reverse(F.split(l, " ")), " ")).otherwise(l)),
        "\n",
    )


def order_agreement(spark, sf_dir):
    hebrew = lambda c: F.translate(F.lower(c), LATIN, HEBREW)
    share = quality.order_agreement(hebrew(F.col("text")), hebrew(_oracle_text()))
    return docs(spark, sf_dir).select("doc_id", F.round(share, 6).alias("agreement"), (share >= 0.7).alias("keep"))


def content_loss(spark, sf_dir):
    files = D.files(spark, sf_dir)
    raw = files.select("file", "category", F.length("text").cast("long").alias("raw_chars"))
    found = quality.content_loss(raw, D.chunks(spark, sf_dir))
    return found.select("file", "category", "raw_chars", "chunk_chars", F.round("ratio", 4).alias("ratio"))


def chunk_size_stats(spark, sf_dir):
    sizes = D.chunks(spark, sf_dir).select("category", F.length("text").cast("long").alias("chars"))
    plain = sizes.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"),
        F.round(F.avg("chars"), 6).alias("mean_chars"),
    )
    ranks = order_statistics(sizes, ["category"], "chars", {"p50": floor_rank(0.5), "p95": floor_rank(0.95)})
    return plain.join(ranks, "category")


def reading_order_repair(spark, sf_dir):
    """Document lines in Hebrew letters, every second one with its words backwards,
    repaired against the original page."""
    pages = docs(spark, sf_dir).select(
        F.col("doc_id").alias("file"), F.lit(1).alias("page"), F.translate(F.lower("text"), LATIN, HEBREW).alias("oracle")
    )
    lines = T.each(pages, ["file", "page"], F.split("oracle", "\n"), "seq", "line")
    turned = F.when(F.col("seq") % 2 == 1, F.array_join(F.reverse(F.split("line", " ")), " ")).otherwise(F.col("line"))
    items = lines.select(
        "file", "page", "seq", F.when(F.col("seq") % 3 == 0, "cell").otherwise("text").alias("kind"), turned.alias("text"), "line",
    )
    fixed = reading_order.repair(items, pages)
    return reading_order.repair_stats(fixed, ["file"], F.count_if(F.col("repaired") == F.col("line")).alias("n_as_original"))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_split_counts, token_count_heuristic, sentence_window_chunks, capped_window_chunks,
        pack_paragraphs_greedy, normalized_token_freq, word_token_stats, page_split, html_clean,
        table_blocks, per_page_chunks, per_table_chunks, heading_carry, canary_check, canary_verdict,
        canary_sample, order_agreement, content_loss, chunk_size_stats, reading_order_repair,
    )
}

_WINDOWS = """SELECT chunk_id, st::BIGINT AS first_sentence, len::BIGINT AS n_sentences, md5(text) AS text_md5
FROM chunks"""

_WORD3 = r"[\p{L}\p{M}\p{N}_]{3,}"

_PACKS = f"""
parts AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {S.strip('l')}),
                               lambda l: l <> '') AS p FROM documents)),
sized AS (SELECT *, {S.estimate(S.words('part'))} AS t FROM parts),
packed AS (
  SELECT doc_id, i, part, t, 0 AS pack, CASE WHEN t > 120 THEN NULL ELSE t END AS open_tokens,
         t > 120 AS oversized
  FROM sized WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, s.part, s.t,
         CASE WHEN p.open_tokens IS NOT NULL AND p.open_tokens + s.t <= 120 THEN p.pack ELSE p.pack + 1 END,
         CASE WHEN p.open_tokens IS NOT NULL AND p.open_tokens + s.t <= 120 THEN p.open_tokens + s.t
              WHEN s.t > 120 THEN NULL ELSE s.t END,
         NOT (p.open_tokens IS NOT NULL AND p.open_tokens + s.t <= 120) AND s.t > 120
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.i = p.i + 1)"""


def _clean(x):
    rules = (
        (r"(?is)<p>\s*Image:.*?</p>", " "), (r"(?i)<img\b[^>]*>", " "), (markdown.IMAGE, " "),
        (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?i)<input\b[^>]*>", " "), (r"(?i)<br\s*/?>", " "),
        (rf"(?i)</?(?:{markdown.STRUCTURAL_TAGS})\b[^>]*>", " "),
        (r"\\([$*_#\[\]()~`>+=|{}.!-])", r"\1"), (r"[ \t]+", " "), (r"\n{3,}", r"\n\n"),
    )
    for pattern, to in rules:
        to = to.replace(r"\n", "\n")
        x = f"regexp_replace({x}, {S.lit(pattern)}, {S.lit(to)}, 'g')"
    return S.strip(x)


_ITEMS = f"""
bodies AS (
  SELECT doc_id, string_split(array_to_string(list_transform(string_split(text, chr(10)), lambda l:
    CASE WHEN contains(l, ' | ') THEN regexp_replace('| ' || l || ' |', '\\. \\| ', ' |' || chr(10) || '| ', 'g') ELSE l END),
    chr(10)), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM bodies),
flags AS (SELECT *, regexp_matches(line, '^\\s*\\|') AS is_row FROM lines),
turns AS (
  SELECT *, CASE WHEN is_row IS DISTINCT FROM lag(is_row) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS turned
  FROM flags),
runs AS (
  SELECT *, sum(turned) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM turns),
trows AS (
  SELECT doc_id, run, pos,
         list_transform(string_split(regexp_replace(regexp_replace({S.strip('line')}, '^\\|', ''), '\\|$', ''), '|'),
                        lambda c: {_clean('c')}) AS cells
  FROM runs WHERE is_row AND NOT regexp_matches(line, '^\\s*\\|[\\s|:-]+\\|?\\s*$')),
cells AS (
  SELECT doc_id, run, pos, generate_subscripts(cells, 1) AS c, unnest(cells) AS v FROM trows),
live AS (
  SELECT *, max(v <> '') OVER (PARTITION BY doc_id, run, c) AS col_live,
         max(v <> '') OVER (PARTITION BY doc_id, run, pos) AS row_live FROM cells),
kept_cols AS (SELECT doc_id, run, c FROM live WHERE col_live GROUP BY ALL),
kept_rows AS (SELECT doc_id, run, pos FROM live WHERE row_live GROUP BY ALL),
grid AS (
  SELECT r.doc_id, r.run, r.pos, string_agg(coalesce(v, ''), '|' ORDER BY k.c) AS row_text, count(*) AS n_cols,
         string_agg(coalesce(v, ''), ' | ' ORDER BY k.c) AS row_md
  FROM kept_rows r JOIN kept_cols k USING (doc_id, run) LEFT JOIN cells USING (doc_id, run, pos, c)
  GROUP BY ALL),
tables AS (
  SELECT doc_id, run, 0 AS part, 'table' AS kind, count(*) AS n_rows, any_value(n_cols) AS n_cols,
         string_agg(row_text, chr(10) ORDER BY pos) AS content,
         list('| ' || row_md || ' |' ORDER BY pos) AS md FROM grid GROUP BY 1, 2),
prose AS (
  SELECT doc_id, run, generate_subscripts(p, 1) AS part, unnest(p) AS content FROM (
    SELECT doc_id, run, list_filter(list_transform(
             string_split_regex({_clean("string_agg(line, chr(10) ORDER BY pos)")}, '\\n[{S.WS}]*\\n'),
             lambda x: {S.strip('x')}), lambda x: x <> '') AS p
    FROM runs WHERE NOT is_row GROUP BY 1, 2)),
items AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run, part) - 1 AS seq FROM (
    SELECT doc_id, run, part, kind, n_rows, n_cols, content,
           md[1] || chr(10) || '|' || repeat('---|', n_cols) || CASE WHEN len(md) > 1 THEN chr(10) || array_to_string(md[2:], chr(10)) ELSE '' END AS text
    FROM tables
    UNION ALL SELECT doc_id, run, part, 'text', 0, 0, content, content FROM prose))"""


def _greedy(source, cap):
    """Greedy packing of ``source`` (file, i, part): pack number per part."""
    return f"""
gsized AS (SELECT *, {S.estimate(S.words('part'))} AS t FROM {source}),
gpacked AS (
  SELECT file, i, part, 0 AS pack, CASE WHEN t > {cap} THEN NULL ELSE t END AS open_tokens FROM gsized WHERE i = 1
  UNION ALL
  SELECT s.file, s.i, s.part,
         CASE WHEN p.open_tokens IS NOT NULL AND p.open_tokens + s.t <= {cap} THEN p.pack ELSE p.pack + 1 END,
         CASE WHEN p.open_tokens IS NOT NULL AND p.open_tokens + s.t <= {cap} THEN p.open_tokens + s.t
              WHEN s.t > {cap} THEN NULL ELSE s.t END
  FROM gpacked p JOIN gsized s ON s.file = p.file AND s.i = p.i + 1)"""


_PAGE_CHUNKS = f"""
whole AS (
  SELECT doc_id::VARCHAR AS file, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM items GROUP BY 1),
small AS (SELECT * FROM whole WHERE {S.estimate(S.words('text'))} <= 400),
parts AS (
  SELECT doc_id::VARCHAR AS file, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i, text AS part
  FROM items WHERE doc_id::VARCHAR NOT IN (SELECT file FROM small)),
{_greedy('parts', 400)},
pieces AS (
  SELECT file, 0 AS pack, text FROM small
  UNION ALL SELECT file, pack, string_agg(part, chr(10) || chr(10) ORDER BY i) FROM gpacked GROUP BY 1, 2)"""

_TABLE_CHUNKS = f"""
parts AS (
  SELECT doc_id::VARCHAR AS file, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i, text AS part FROM items WHERE kind = 'text'),
{_greedy('parts', 512)},
pieces AS (
  SELECT file, 0 AS after, pack AS n, string_agg(part, chr(10) || chr(10) ORDER BY i) AS text FROM gpacked GROUP BY 1, 3
  UNION ALL SELECT doc_id::VARCHAR, 1, seq, text FROM items WHERE kind = 'table')"""


def _canary_found():
    return "list_filter([" + ", ".join(
        f"CASE WHEN contains(text, {S.lit(t)}) THEN {S.lit(t)} END" for t in CANARY
    ) + "], lambda x: x IS NOT NULL)"


def _canary_reversed():
    inner = "A-Za-zÀ-ÿ''"
    return "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(text, '(^|[^{inner}]){t[::-1]}([^{inner}]|$)') THEN {S.lit(t[::-1])} END"
        for t in CANARY
    ) + "], lambda x: x IS NOT NULL)"


_HEB = lambda x: f"translate(lower({x}), {S.lit(LATIN)}, {S.lit(HEBREW)})"
_HW = lambda x: f"regexp_extract_all({x}, '[\\x{{0590}}-\\x{{05FF}}]{{2,}}')"

ORACLES = {
    "sentence_split_counts": f"""WITH s AS (SELECT doc_id, {S.sentences('text')} AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM s""",
    "token_count_heuristic": f"""SELECT doc_id, {S.words('text')}::BIGINT AS n_words,
  {S.estimate(S.words('text'))}::BIGINT AS n_tokens, greatest(1, length(text) // 4)::BIGINT AS approx_tokens
FROM documents""",
    "sentence_window_chunks": f"WITH RECURSIVE {S.CHUNKS} {_WINDOWS}",
    "capped_window_chunks": f"WITH RECURSIVE {S.CHUNKS.replace('<= 512', '<= 60')} {_WINDOWS}",
    "pack_paragraphs_greedy": f"""WITH RECURSIVE {_PACKS}
SELECT doc_id, pack::BIGINT AS pack, sum(t)::BIGINT AS n_tokens, bool_or(oversized) AS oversized,
       md5(string_agg(part, chr(10) || chr(10) ORDER BY i)) AS text_md5
FROM packed GROUP BY doc_id, pack""",
    "normalized_token_freq": f"""SELECT token, count(*) AS n
FROM (SELECT unnest({S.tokens('text')}) AS token FROM documents) GROUP BY token""",
    "word_token_stats": f"""WITH w AS (SELECT *, regexp_extract_all(text, '{_WORD3}') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct,
  regexp_matches(text, '[₪%]|ש"ח|אחוז|[0-9]{{2,}}') AS has_quantity,
  CASE WHEN regexp_matches(regexp_extract(text, '[\\x{{0590}}-\\x{{07BF}}\\x{{FB1D}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFF}}A-Za-z\\x{{00C0}}-\\x{{02AF}}]'),
       '[A-Za-z\\x{{00C0}}-\\x{{02AF}}]') THEN 'ltr' ELSE 'rtl' END AS direction,
  md5(substr({S.collapse('text')}, 1, 200)) AS snippet_md5 FROM w""",
    "page_split": f"""WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i % 40 ORDER BY i DESC) AS r FROM l)
SELECT doc_id, (i % 40 + 1)::INT AS page, md5({S.strip('line')}) AS body_md5 FROM ranked WHERE r = 1""",
    "html_clean": f"""WITH c AS (SELECT page_id, {_clean('html')} AS t FROM pages)
SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM c""",
    "table_blocks": f"""WITH {_ITEMS}
SELECT doc_id, seq::BIGINT AS seq, kind, n_rows::BIGINT AS n_rows, n_cols::BIGINT AS n_cols, md5(content) AS content_md5 FROM items""",
    "per_page_chunks": f"""WITH RECURSIVE {_ITEMS}, {_PAGE_CHUNKS}
SELECT file || '#p1#c' || (row_number() OVER (PARTITION BY file ORDER BY pack) - 1) AS chunk_id, file, 1 AS page,
  length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM pieces""",
    "per_table_chunks": f"""WITH RECURSIVE {_ITEMS}, {_TABLE_CHUNKS}
SELECT file || '#p1#c' || (row_number() OVER (PARTITION BY file ORDER BY after, n) - 1) AS chunk_id, file, 1 AS page,
  length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM pieces""",
    "heading_carry": f"""SELECT conv_id, turn, role, md5(last_value(CASE WHEN role = 'user' AND {S.strip('text')} <> '' THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS heading_md5
FROM conversations""",
    "canary_check": f"""SELECT doc_id, array_to_string({_canary_found()}, ',') AS tokens_found,
  array_to_string({_canary_reversed()}, ',') AS reversals_found, len({_canary_reversed()}) = 0 AS ok FROM documents""",
    "canary_verdict": f"""WITH r AS (SELECT {_canary_found()} AS f, {_canary_reversed()} AS rev FROM documents),
a AS (SELECT bool_and(len(rev) = 0) AS files_ok, list_distinct(flatten(list(f))) AS seen FROM r)
SELECT files_ok, array_to_string(list_filter({CANARY}, lambda t: NOT list_contains(seen, t)), ',') AS missing_tokens,
  files_ok AND len(list_filter({CANARY}, lambda t: NOT list_contains(seen, t))) = 0 AS ok FROM a""",
    "canary_sample": """WITH f AS (
  SELECT source AS category, lpad(doc_id::VARCHAR, 12, '0') AS file, doc_id = 7 AS is_anchor FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY category, is_anchor ORDER BY file) AS turn FROM f)
SELECT category, file, is_anchor, turn::INT AS turn FROM n ORDER BY is_anchor DESC, turn, category LIMIT 30""",
    "order_agreement": f"""WITH t AS (
  SELECT doc_id, string_split({_HEB('text')}, chr(10)) AS lines,
         array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
           CASE WHEN (i - 1) % 3 = 0 THEN array_to_string(list_reverse(string_split(l, ' ')), ' ') ELSE l END), chr(10)) AS o
  FROM documents),
w AS (
  SELECT doc_id, array_to_string({_HW(_HEB('o'))}, ' ') AS truth,
         list_filter(list_transform(lines, lambda l: {_HW('l')}), lambda x: len(x) >= 4) AS lw FROM t),
s AS (
  SELECT doc_id, CASE WHEN len(lw) = 0 OR truth = '' THEN 1.0::DOUBLE ELSE
    len(list_filter(lw, lambda x: contains(truth, array_to_string(x, ' '))))::DOUBLE / len(lw) END AS share FROM w)
SELECT doc_id, round(share, 6) AS agreement, share >= 0.7 AS keep FROM s""",
    "content_loss": f"""WITH RECURSIVE {S.CHUNKS},
k AS (SELECT file, sum(length(text))::BIGINT AS chunk_chars FROM chunks GROUP BY 1),
j AS (
  SELECT f.file, f.category, length(f.text)::BIGINT AS raw_chars, coalesce(chunk_chars, 0) AS chunk_chars
  FROM files f LEFT JOIN k USING (file) WHERE length(f.text) > 0)
SELECT file, category, raw_chars, chunk_chars, round(chunk_chars::DOUBLE / raw_chars, 4) AS ratio
FROM j WHERE chunk_chars::DOUBLE / raw_chars < 0.98""",
    "chunk_size_stats": f"""WITH RECURSIVE {S.CHUNKS},
z AS (SELECT category, list_sort(list(length(text)::BIGINT)) AS v FROM chunks GROUP BY 1)
SELECT category, len(v)::BIGINT AS n, list_min(v) AS min_chars, list_max(v) AS max_chars,
  round(list_avg(v), 6) AS mean_chars, v[len(v) // 2 + 1] AS p50, v[floor(len(v) * 0.95::DOUBLE)::INT + 1] AS p95 FROM z""",
}
