"""Dataset-building and dataset-checking queries.

Documents are pages of their source; orders stand in for question items, their lines
for the pages the items cite.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citelode.functions import text as T
from citelode.operators import chunking
from citelode.operators import datasets as X
from citelode.operators.near_duplicates import first_near_duplicates
from citelode.plans import sql_parts as S
from citelode.plans import tables as D

SEED = 17
EXPECTED = {
    "standard": {d: 3 for d in X.DIFFICULTIES}, "multi_source": {"hard": 900}, "unanswerable": {"medium": 150},
}


def _docs(spark, sf_dir):
    return D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


def stratified_split(spark, sf_dir):
    items = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return X.stratified_split(items, ["source", "lang"], 0.5, SEED).select("id", "source", "lang", "half")


def split_description(spark, sf_dir):
    halves = stratified_split(spark, sf_dir)
    per_source = halves.groupBy("half", "lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return per_source.groupBy("half", "lang").agg(
        F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_sources")
    )


def _site_pages(spark, sf_dir):
    pages = D.spread(D.table(spark, sf_dir, "pages"))
    return pages.select(
        F.col("page_id").alias("id"), F.regexp_extract("url", r"^https?://([^/]*)", 1).alias("category"),
        F.regexp_replace("html", "<[^>]*>", " ").alias("text"),
    )


def boilerplate_strip(spark, sf_dir):
    cleaned = X.strip_boilerplate(_site_pages(spark, sf_dir))
    return cleaned.select("id", "category", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def page_inventory(spark, sf_dir):
    """Pages long enough after boilerplate went, with their quantity flag."""
    cleaned = X.strip_boilerplate(_site_pages(spark, sf_dir)).filter(F.length("text") >= 500)
    return cleaned.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(T.has_quantity(F.col("text"))).alias("n_numeric")
    )


def near_dup_jaccard(spark, sf_dir):
    items = _docs(spark, sf_dir).select(F.col("doc_id").alias("ord"), T.words(F.lower("text")).alias("tokens"))
    return first_near_duplicates(items).select(F.col("ord").alias("doc_id"), F.col("match").alias("first_match"))


def held_out_questions(spark, sf_dir):
    """Short chunks that near-duplicate a benchmark item."""
    windows = chunking.sentence_windows(D.files(spark, sf_dir).select("file", "text"), "text", max_tokens=60)
    doc = F.regexp_extract("file", r"/(\d+)\.txt$", 1).cast("long")
    items = windows.select((doc * 100000 + F.col("n")).alias("ord"), T.words(F.lower("text")).alias("tokens"))
    existing = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), T.words(F.lower("text")).alias("tokens"))
    return first_near_duplicates(items, existing).select(F.col("ord").alias("chunk"), F.col("match").alias("item_id"))


def pair_overlap_band(spark, sf_dir):
    pages = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("lang").alias("file"),
        F.array_distinct(T.words(F.col("text"), 3)).alias("words"),
    )
    first = pages.groupBy("category").agg(F.min_by(F.struct("id", "file", "words"), F.md5(F.col("id").cast("string"))).alias("p"))
    seeds = first.select(F.col("p.id").alias("seed"), "category", "p.file", "p.words")
    found = X.partner_pages(seeds, pages)
    return found.select("seed", "id", "rank", F.col("shared").cast("long").alias("shared"))


def sampler_draw(spark, sf_dir):
    pages = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("lang").alias("file"),
        T.has_quantity(F.col("text"), "0-9").alias("has_numbers"),
    )
    return X.draw_pages(pages, 8, SEED).select("category", "draw", "id", "file", "has_numbers")


def sampler_events(spark, sf_dir):
    """Draws and releases in the order of the customers: every fifth puts back the page drawn two events before."""
    step = F.floor(F.col("c_custkey") / 20) % 5
    kind = F.when(step == 4, X.RELEASE).when(step == 2, X.DRAW_NUMBERS).otherwise(X.DRAW)
    return D.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("src"), (F.col("c_custkey") % 20).cast("string")).alias("category"), F.col("c_custkey").cast("long").alias("seq"), kind.alias("kind"),
        F.col("c_mktsegment").alias("cell"), F.when(step == 4, F.col("c_custkey") - 40).cast("long").alias("drawn_by"),
    )


def sampler_state(spark, sf_dir):
    pages = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("lang").alias("file"),
        T.has_quantity(F.col("text")).alias("has_numbers"),
    )
    held_out = D.table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return X.sampler_state(pages, sampler_events(spark, sf_dir), SEED, held_out)


def _items(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"),
        F.expr("CASE o_custkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END").alias("difficulty"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'standard' WHEN 'O' THEN 'multi_source' ELSE 'unanswerable' END").alias("kind"),
        (F.col("o_custkey") % 7 != 0).alias("answerable"),
    )


def _citations(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("page")
    )
    return _items(spark, sf_dir).join(lines, "id")


def dataset_invariants(spark, sf_dir):
    sources = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_distinct("l_suppkey").alias("n_files")
    )
    items = _items(spark, sf_dir).join(sources, "id", "left").fillna(0, ["n_groups", "n_files"])
    return X.shape_problems(items).select("id", "kind", "problem")


def duplicate_ids(spark, sf_dir):
    """Two question sets put together: benchmark and page ids collide."""
    ids = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).union(
        D.table(spark, sf_dir, "pages").select("page_id")
    )
    return X.duplicate_ids(ids)


def cell_counts(spark, sf_dir):
    items = _items(spark, sf_dir)
    return X.cell_problems(items, EXPECTED, items)


def _supplier_items(spark, sf_dir):
    """Suppliers as items of their nation."""
    nations = D.table(spark, sf_dir, "nation")
    items = D.table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return items.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("domain"), F.lit("standard").alias("kind"),
                        F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END").alias("difficulty"))


def absent_categories(spark, sf_dir):
    """Nations and market segments as categories; a segment has no items at all."""
    segments = D.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("domain"))
    categories = D.table(spark, sf_dir, "nation").select(F.col("n_name").alias("domain")).union(segments)
    return X.cell_problems(_supplier_items(spark, sf_dir), {"standard": {"easy": 1, "medium": 1, "hard": 2}}, categories)


def near_dup_hash_ids(spark, sf_dir):
    """Documents against the documents under ids of 2^62 and more."""
    words = lambda id_: _docs(spark, sf_dir).select(id_.alias("ord"), T.words(F.lower("text")).alias("tokens"))
    large = F.lit(4611686018427387904) + F.col("doc_id") * 1000003
    found = first_near_duplicates(words(F.col("doc_id")), words(large))
    return found.select(F.col("ord").alias("doc_id"), F.col("match").alias("first_match"))


def slot_plan(spark, sf_dir):
    items = _items(spark, sf_dir)
    slots = X.missing_slots(items, EXPECTED, items)
    return slots.groupBy("domain", "kind", "difficulty").agg(F.count(F.lit(1)).alias("n_slots"), F.max("slot").alias("last_slot"))


def page_reuse(spark, sf_dir):
    pairs = _citations(spark, sf_dir).select("domain", "difficulty", "page", "id").distinct()
    return X.reused_pages(pairs, ["domain", "difficulty"], ["page"]).select("domain", "difficulty", "page", "id", "used_by")


def leak_check(spark, sf_dir):
    """Items that cite a held-out page: parts of the first brand."""
    held = D.table(spark, sf_dir, "part")
    first = held.agg(F.min("p_brand")).scalar()
    pages = held.filter(F.col("p_brand") == first).select(F.col("p_partkey").alias("page"))
    _, leaking = X.excluded(_citations(spark, sf_dir), pages, ["page"])
    return leaking.groupBy("id").agg(F.count(F.lit(1)).alias("n_leaked"), F.min("page").alias("first_page"))


def coverage_by_category(spark, sf_dir):
    return X.corpus_coverage(_citations(spark, sf_dir))


def _gated(spark, sf_dir):
    items = D.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_suppkey",
        F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_returnflag"),
    )
    gates = [
        ("duplicate", F.col("l_quantity") != 1), ("derivable", F.col("l_discount") < 0.08),
        ("leave_one_out", F.col("l_tax") < 0.07), ("topical", F.col("l_returnflag") != "A"),
        ("difficulty", F.col("l_quantity") < 45),
    ]
    return X.first_failed_gate(items, gates)


def gate_failures(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("l_suppkey", F.coalesce("failed_gate", F.lit("accepted")).alias("gate")).agg(
        F.count(F.lit(1)).alias("n")
    )


QUERIES = {
    f.__name__: f
    for f in (
        stratified_split, split_description, boilerplate_strip, page_inventory, near_dup_jaccard, held_out_questions,
        pair_overlap_band, sampler_draw, sampler_state, dataset_invariants, duplicate_ids, cell_counts, slot_plan, page_reuse,
        leak_check, coverage_by_category, gate_failures, absent_categories, near_dup_hash_ids,
    )
}

_SPLIT = f"""
numbered AS (
  SELECT doc_id AS id, source, lang, row_number() OVER (PARTITION BY source, lang
    ORDER BY md5('{SEED}|' || source || '|' || lang || '|' || doc_id), doc_id) AS no FROM documents),
quota AS (
  SELECT source, lang, floor(upto * 0.5::DOUBLE) - floor((upto - n) * 0.5::DOUBLE) AS take FROM (
    SELECT source, lang, n, sum(n) OVER (ORDER BY source, lang) AS upto FROM (
      SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2))),
halves AS (
  SELECT id, source, lang, CASE WHEN no <= take THEN 'validation' ELSE 'holdout' END AS half FROM numbered JOIN quota USING (source, lang))"""

_STRIPPED = f"""
site AS (
  SELECT page_id AS id, regexp_extract(url, '^https?://([^/]*)', 1) AS category, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages),
sized AS (SELECT *, count(*) OVER (PARTITION BY category) AS np FROM site),
w AS (SELECT id, category, np, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS word FROM (
  SELECT id, category, np, string_split_regex({S.strip('text')}, '[{S.WS}]+') AS x FROM sized WHERE np >= 3)),
g AS (
  SELECT *, CASE WHEN lead(pos, 5) OVER o IS NOT NULL THEN
    concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o) END AS gram
  FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
rep AS (SELECT category, gram FROM g WHERE gram IS NOT NULL GROUP BY category, gram, np HAVING count(DISTINCT id) >= greatest(3, np * 0.3::DOUBLE)),
f AS (SELECT g.*, rep.gram IS NOT NULL AS hit FROM g LEFT JOIN rep USING (category, gram)),
m AS (SELECT id, category, pos, word, max(hit::INT) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS drop_ FROM f),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS island FROM m WHERE drop_ = 0),
runs AS (SELECT id, island, min(pos) AS start, string_agg(word, ' ' ORDER BY pos) AS run FROM isl GROUP BY 1, 2 HAVING count(*) >= 8),
txt AS (SELECT id, string_agg(run, chr(10) || chr(10) ORDER BY start) AS text FROM runs GROUP BY 1),
stripped AS (
  SELECT id, category, text FROM sized WHERE np < 3
  UNION ALL SELECT s.id, s.category, coalesce(t.text, '') FROM sized s LEFT JOIN txt t USING (id) WHERE np >= 3)"""

_WORDS = lambda x, n="+": f"regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]{n}')"

_ITEMS = """
items AS (
  SELECT o_orderkey AS id, o_orderpriority AS domain, CASE o_custkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
    CASE o_orderstatus WHEN 'F' THEN 'standard' WHEN 'O' THEN 'multi_source' ELSE 'unanswerable' END AS kind, o_custkey % 7 <> 0 AS answerable FROM orders)"""

_CITED = f"""{_ITEMS},
cited AS (SELECT items.*, l_suppkey AS file, l_partkey AS page FROM items JOIN lineitem ON l_orderkey = id)"""

_CELLS = f"""{_ITEMS},
want(kind, difficulty, expected) AS (VALUES {', '.join(f"('{k}', '{d}', {n}::BIGINT)" for k, r in EXPECTED.items() for d, n in r.items())}),
cells AS (
  SELECT d.domain, w.kind, w.difficulty, count(i.id) AS n, w.expected
  FROM (SELECT DISTINCT domain FROM items) d CROSS JOIN want w
  LEFT JOIN items i ON i.domain = d.domain AND i.kind = w.kind AND i.difficulty = w.difficulty GROUP BY ALL)"""

ORACLES = {
    "stratified_split": f"WITH {_SPLIT} SELECT id, source, lang, half FROM halves",
    "split_description": f"WITH {_SPLIT} SELECT half, lang, count(*) AS n_items, count(DISTINCT source) AS n_sources FROM halves GROUP BY 1, 2",
    "boilerplate_strip": f"WITH {_STRIPPED} SELECT id, category, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM stripped",
    "page_inventory": f"""WITH {_STRIPPED}
SELECT category, count(*) AS n_pages, count(*) FILTER (regexp_matches(text, '[₪%]|ש"ח|אחוז|\\p{{Nd}}{{2,}}')) AS n_numeric
FROM stripped WHERE length(text) >= 500 GROUP BY 1""",
    "near_dup_jaccard": f"""WITH s AS (SELECT doc_id, list_distinct({_WORDS('lower(text)')}) AS t FROM documents),
x AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM s),
p AS (SELECT a.doc_id, b.doc_id AS other, a.n AS n, b.n AS m, count(*) AS c FROM x a JOIN x b ON a.w = b.w AND b.doc_id < a.doc_id GROUP BY ALL)
SELECT doc_id, min(other) AS first_match FROM p WHERE c::DOUBLE / (n + m - c) >= 0.6 GROUP BY 1""",
    "near_dup_hash_ids": f"""WITH s AS (SELECT doc_id, list_distinct({_WORDS('lower(text)')}) AS t FROM documents),
x AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM s),
p AS (SELECT a.doc_id, b.doc_id AS other, a.n AS n, b.n AS m, count(*) AS c FROM x a JOIN x b ON a.w = b.w GROUP BY ALL)
SELECT doc_id, 4611686018427387904 + min(other) * 1000003 AS first_match FROM p WHERE c::DOUBLE / (n + m - c) >= 0.6 GROUP BY 1""",
    "absent_categories": """WITH want(difficulty, expected) AS (VALUES ('easy', 1::BIGINT), ('medium', 1::BIGINT), ('hard', 2::BIGINT)),
names AS (SELECT n_name AS domain FROM nation UNION SELECT c_mktsegment FROM customer),
have AS (
  SELECT n_name AS domain, ['easy', 'medium', 'hard'][1 + s_suppkey % 3] AS difficulty, count(*) AS n
  FROM supplier, nation WHERE s_nationkey = n_nationkey GROUP BY ALL)
SELECT domain, 'standard' AS kind, difficulty, coalesce(n, 0) AS n, expected
FROM names CROSS JOIN want LEFT JOIN have USING (domain, difficulty) WHERE coalesce(n, 0) <> expected""",
    "held_out_questions": f"""WITH RECURSIVE {S.CHUNKS.replace('<= 512', '<= 60')},
i AS (SELECT regexp_extract(file, '/([0-9]+)\\.txt$', 1)::BIGINT * 100000 + n_chunk AS ord, list_distinct({_WORDS('lower(text)')}) AS t FROM chunks),
b AS (SELECT item_id, list_distinct({_WORDS('lower(text)')}) AS t FROM benchmark),
xi AS (SELECT ord, len(t) AS n, unnest(t) AS w FROM i), xb AS (SELECT item_id, len(t) AS m, unnest(t) AS w FROM b),
p AS (SELECT ord, item_id, n, m, count(*) AS c FROM xi JOIN xb USING (w) GROUP BY ALL)
SELECT ord AS chunk, min(item_id) AS item_id FROM p WHERE c::DOUBLE / (n + m - c) >= 0.6 GROUP BY 1""",
    "pair_overlap_band": f"""WITH p AS (SELECT doc_id AS id, source, lang, list_distinct({_WORDS('text', '{3,}')}) AS w FROM documents),
s AS (SELECT source, arg_min(id, md5(id::VARCHAR)) AS seed FROM p GROUP BY 1),
r AS (
  SELECT s.seed, p.id, len(list_intersect(p.w, q.w)) AS shared,
    row_number() OVER (PARTITION BY s.seed ORDER BY len(list_intersect(p.w, q.w)) DESC, p.id) AS rank
  FROM s JOIN p q ON q.id = s.seed JOIN p ON p.source = s.source AND p.lang <> q.lang)
SELECT seed, id, rank::INT AS rank, shared::BIGINT AS shared FROM r WHERE rank > 2 AND rank <= 12""",
    "sampler_draw": f"""WITH p AS (
  SELECT doc_id AS id, source AS category, lang AS file, regexp_matches(text, '[₪%]|ש"ח|אחוז|[0-9]{{2,}}') AS has_numbers, md5('{SEED}|' || doc_id) AS d FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY category, file, has_numbers ORDER BY d, id) AS turn FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY has_numbers DESC, turn, d, id) AS draw FROM t WHERE turn <= 8)
SELECT category, draw::INT AS draw, id, file, has_numbers FROM r WHERE draw <= 8""",
    "dataset_invariants": f"""WITH {_ITEMS},
s AS (SELECT l_orderkey AS id, count(*) AS g, count(DISTINCT l_suppkey) AS f FROM lineitem GROUP BY 1),
p AS (
  SELECT id, kind, CASE
    WHEN kind = 'unanswerable' AND (answerable OR coalesce(g, 0) > 0) THEN 'unanswerable_with_sources'
    WHEN kind <> 'unanswerable' AND NOT answerable THEN 'must_be_answerable'
    WHEN kind = 'standard' AND coalesce(g, 0) <> 1 THEN 'standard_needs_one_group'
    WHEN kind = 'multi_source' AND coalesce(g, 0) <> 2 THEN 'multi_source_needs_two_groups'
    WHEN kind = 'multi_source' AND difficulty <> 'hard' THEN 'multi_source_must_be_hard'
    WHEN kind = 'multi_source' AND f < 2 THEN 'multi_source_needs_two_files' END AS problem
  FROM items LEFT JOIN s USING (id))
SELECT id, kind, problem FROM p WHERE problem IS NOT NULL""",
    "duplicate_ids": """SELECT id, count(*) AS n FROM (SELECT item_id AS id FROM benchmark UNION ALL SELECT page_id FROM pages) GROUP BY 1 HAVING count(*) > 1""",
    "cell_counts": f"WITH {_CELLS} SELECT domain, kind, difficulty, n, expected FROM cells WHERE n <> expected",
    "slot_plan": f"WITH {_CELLS} SELECT domain, kind, difficulty, expected - n AS n_slots, (expected - n)::INT AS last_slot FROM cells WHERE n < expected",
    "page_reuse": f"""WITH {_CITED},
d AS (SELECT DISTINCT domain, difficulty, page, id FROM cited),
u AS (SELECT *, lag(id) OVER (PARTITION BY domain, difficulty, page ORDER BY id) AS used_by FROM d)
SELECT domain, difficulty, page, id, used_by FROM u WHERE used_by IS NOT NULL""",
    "leak_check": f"""WITH {_CITED}
SELECT id, count(*) AS n_leaked, min(page) AS first_page FROM cited
WHERE page IN (SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) GROUP BY 1""",
    "coverage_by_category": f"""WITH {_CITED},
u AS (SELECT domain, file, count(*) AS uses FROM cited GROUP BY 1, 2)
SELECT c.domain, count(DISTINCT c.id) AS items, count(DISTINCT c.file) AS distinct_files, count(DISTINCT (c.file, c.page)) AS distinct_pages,
  (SELECT count(*) FROM u WHERE u.domain = c.domain AND uses > 2) AS overused_files FROM cited c GROUP BY 1""",
    "gate_failures": """SELECT l_suppkey, CASE WHEN l_quantity = 1 THEN 'duplicate' WHEN l_discount >= 0.08 THEN 'derivable' WHEN l_tax >= 0.07 THEN 'leave_one_out'
  WHEN l_returnflag = 'A' THEN 'topical' WHEN l_quantity >= 45 THEN 'difficulty' ELSE 'accepted' END AS gate, count(*) AS n FROM lineitem GROUP BY 1, 2""",
}
