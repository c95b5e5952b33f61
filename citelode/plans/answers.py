"""Queries around answers: fallback citations, evidence, judge jobs, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelode.functions import replies as R
from citelode.operators import answering as A
from citelode.plans import retrieval
from citelode.plans import sql_parts as S
from citelode.plans import tables as D

JUDGES = ["judge-a", "judge-b", "judge-c"]


def final_citations(spark, sf_dir):
    """Answers cite two of their sparse hits, a made-up file, or nothing valid at all."""
    hits = retrieval.texts_of(spark, sf_dir, retrieval.sparse_stage(spark, sf_dir))
    retrieved = hits.select("qid", "rank", "file", "page")
    real = retrieved.filter((F.col("qid") % 3 != 0) & F.col("rank").isin(2, 5)).select(
        "qid", F.col("rank").alias("pos"), "file", "page"
    )
    invented = D.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.lit(9).alias("pos"), F.lit("src0/pages/none.txt").alias("file"), F.lit(None).cast("int").alias("page")
    )
    return A.final_citations(real.unionByName(invented), retrieved).select("qid", "pos", "file", "fallback")


def evidence_blocks(spark, sf_dir):
    top = retrieval.sparse_stage(spark, sf_dir).filter(F.col("rank") <= 6)
    blocks = A.evidence(retrieval.texts_of(spark, sf_dir, top), 200)
    return blocks.select("qid", F.length("evidence").cast("long").alias("n_chars"), F.md5("evidence").alias("evidence_md5"))


def judge_jobs(spark, sf_dir):
    """Every order goes to every judge; jobs and word lengths per judge and priority."""
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return A.judge_jobs(orders, JUDGES).groupBy("judge_model", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_jobs"), F.max("id").alias("last_id")
    )


def form_anchors(spark, sf_dir):
    items = D.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("domain"),
        F.expr("CASE WHEN n_chars < 600 THEN 'easy' WHEN n_chars < 2500 THEN 'medium' ELSE 'hard' END").alias("difficulty"),
    )
    wanted = items.select("domain", "difficulty").distinct()
    found = A.form_anchors(items, wanted, 2, 11)
    return found.select("for_domain", "difficulty", "place", "id", "domain")


def gate_verdicts(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem")
    reply = F.concat(
        F.lit('ok {"verdict": "'), F.when(F.col("l_discount") < 0.05, " PASS ").when(F.col("l_tax") < 0.04, "fail").otherwise("unsure"),
        F.lit('", "reason": " r '), F.col("l_linenumber").cast("string"), F.lit(' "}'),
    )
    judged = lines.select("l_suppkey", A.gate_verdict(reply).alias("g"))
    return judged.groupBy("l_suppkey").agg(
        F.count_if(F.col("g.verdict") == "pass").alias("n_pass"), F.count_if(F.col("g.verdict") == "fail").alias("n_fail"),
        F.count_if(F.col("g").isNull()).alias("n_invalid"), F.max("g.reason").alias("last_reason"),
    )


def generation_replies(spark, sf_dir):
    """Generator and difficulty replies written from the orders: items, skips, and replies that are too short."""
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("k"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    key = F.col("o_orderkey").cast("string")
    generator = F.when(F.col("k") % 7 == 0, text('{"skip": "page ', key, ' is ', F.repeat(F.lit("thin "), 60), '"}')).when(
        F.col("k") % 7 == 1, text('{"question": "short?", "ground_truth_answer": "long enough answer"}')
    ).when(F.col("k") % 7 == 2, F.lit("no object")).otherwise(
        text('```json\n{"question": "  What does order ', key, ' come to? ", "ground_truth_answer": "', F.when(F.col("k") % 7 == 3, "brief").otherwise("It comes to much."), '", "rationale": " because "}\n```')
    )
    level = text('{"difficulty": " ', F.element_at(F.array(*map(F.lit, ("Easy", "MEDIUM", "hard", "odd"))), (F.col("k") % 4 + 1).cast("int")), '", "reason": " r "}')
    read = orders.select("o_orderkey", R.generated(generator).alias("g"), R.difficulty_ruling(level).alias("d"))
    return read.select(
        "o_orderkey", F.col("g.skip").alias("skip"), F.col("g.question").alias("question"), F.col("g.ground_truth_answer").alias("answer"),
        F.col("g.rationale").alias("rationale"), F.col("d.difficulty").alias("difficulty"), F.col("d.reason").alias("reason"),
    )


def judgment_values(spark, sf_dir):
    """Judgments whose hallucination is any JSON value, with and without claims."""
    values = ("true", "false", "null", "0", "0.0", "3", '""', '"false"', "[]", "[0]", "{}", '{"a":1}')
    lines = D.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % len(values) + 1).cast("int").alias("v"), F.col("o_custkey").alias("k"))
    value = F.element_at(F.array(*[F.lit(v) for v in values]), F.col("v"))
    reply = F.concat(
        F.lit('{"verdict": "'), F.when(F.col("k") % 5 == 0, "refusal").otherwise("correct"), F.lit('", "correctness": 7, "completeness": 6, "conversational_quality": 5'),
        F.when(F.col("k") % 13 == 0, "").otherwise(F.concat(F.lit(', "hallucination": '), value)),
        F.when(F.col("k") % 3 == 0, ', "claims": {"n": 1}').when(F.col("k") % 3 == 1, ', "claims": [1]').otherwise(""), F.lit("}"),
    )
    judged = lines.select("o_orderkey", R.judgment(reply).alias("j"))
    return judged.select("o_orderkey", F.col("j.verdict").alias("verdict"), F.col("j.hallucination").alias("hallucination"), F.col("j.claims").alias("claims"))


def set_labels(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages")
    path = F.concat(F.regexp_extract("url", r"^https?://([^?#]*)", 1), F.when(F.col("page_id") % 3 == 0, "_v2.json").when(F.col("page_id") % 3 == 1, "-v2").otherwise("-v2x.json"))
    return pages.select("page_id", A.set_label(path).alias("label"))


def latest_report(spark, sf_dir):
    """Newest event per user as that user's stored report."""
    events = D.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("index_name"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("#"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("created_at"),
        F.col("props").alias("report"),
    )
    return A.latest_report(events)


QUERIES = {
    f.__name__: f
    for f in (final_citations, evidence_blocks, judge_jobs, form_anchors, gate_verdicts, generation_replies, judgment_values, set_labels, latest_report)
}

ORACLES = {
    "final_citations": f"""WITH RECURSIVE {S.BM25},
r AS (SELECT qid, rank, regexp_extract(chunk_id, '^(.*)#p[^#]*#c[0-9]+$', 1) AS file FROM sparse),
v AS (SELECT qid, rank AS pos, file FROM r WHERE qid % 3 <> 0 AND rank IN (2, 5))
SELECT qid, pos::INT AS pos, file, false AS fallback FROM v
UNION ALL SELECT qid, (rank - 1)::INT, file, true FROM r WHERE rank <= 3 AND qid NOT IN (SELECT qid FROM v)""",
    "evidence_blocks": f"""WITH RECURSIVE {S.BM25},
b AS (SELECT qid, string_agg('[' || rank || '] ' || t.file || ' p.-' || chr(10) || substr(t.text, 1, 200), chr(10) || chr(10) ORDER BY rank) AS e
  FROM sparse JOIN tchunks t USING (chunk_id) WHERE rank <= 6 GROUP BY 1)
SELECT qid, length(e)::BIGINT AS n_chars, md5(e) AS evidence_md5 FROM b""",
    "judge_jobs": f"""SELECT judge_model, o_orderpriority, count(*) AS n_jobs, max(o_orderkey) AS last_id
FROM orders, (VALUES {', '.join(f"('{j}')" for j in JUDGES)}) j(judge_model) GROUP BY 1, 2""",
    "form_anchors": """WITH i AS (
  SELECT doc_id AS id, source AS domain, CASE WHEN n_chars < 600 THEN 'easy' WHEN n_chars < 2500 THEN 'medium' ELSE 'hard' END AS difficulty FROM documents),
w AS (SELECT DISTINCT domain AS for_domain, difficulty FROM i)
SELECT for_domain, difficulty, place::INT AS place, id, domain FROM (
  SELECT w.for_domain, w.difficulty, i.id, i.domain,
    row_number() OVER (PARTITION BY w.for_domain, w.difficulty ORDER BY md5('11|' || i.id), i.id) AS place
  FROM w JOIN i ON i.difficulty = w.difficulty AND i.domain <> w.for_domain) WHERE place <= 2""",
    "gate_verdicts": """SELECT l_suppkey, count(*) FILTER (l_discount < 0.05) AS n_pass, count(*) FILTER (l_discount >= 0.05 AND l_tax < 0.04) AS n_fail,
  count(*) FILTER (l_discount >= 0.05 AND l_tax >= 0.04) AS n_invalid,
  max('r ' || l_linenumber) FILTER (l_discount < 0.05 OR l_tax < 0.04) AS last_reason FROM lineitem GROUP BY 1""",
    "generation_replies": """WITH o AS (SELECT o_orderkey, o_custkey AS k FROM orders)
SELECT o_orderkey, CASE WHEN k % 7 = 0 THEN substr('page ' || o_orderkey || ' is ' || repeat('thin ', 60), 1, 200) END AS skip,
  CASE WHEN k % 7 > 3 THEN 'What does order ' || o_orderkey || ' come to?' END AS question, CASE WHEN k % 7 > 3 THEN 'It comes to much.' END AS answer,
  CASE WHEN k % 7 > 3 THEN 'because' END AS rationale, CASE k % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' END AS difficulty,
  CASE WHEN k % 4 < 3 THEN 'r' END AS reason FROM o""",
    "judgment_values": """WITH o AS (SELECT o_orderkey, o_custkey AS k, o_custkey % 12 AS v FROM orders)
SELECT o_orderkey, CASE WHEN k % 5 = 0 THEN 'refusal' ELSE 'correct' END AS verdict,
  k % 5 <> 0 AND k % 13 <> 0 AND v IN (0, 5, 7, 9, 11) AS hallucination, CASE WHEN k % 3 = 0 THEN '{"n":1}' END AS claims FROM o""",
    "set_labels": """SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'v1' ELSE 'v2' END AS label FROM pages""",
    "latest_report": """WITH e AS (SELECT user_id AS index_name, strftime(ts, '%Y-%m-%d %H:%M:%S') || '#' || lpad(event_id::VARCHAR, 12, '0') AS created_at, props FROM events)
SELECT index_name, max(created_at) AS created_at, arg_max(props, created_at) AS report FROM e GROUP BY 1""",
}
