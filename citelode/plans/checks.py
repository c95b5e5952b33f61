"""Queries over the rule, batch and comparison operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citelode.functions import replies as R
from citelode.functions import text as T
from citelode.operators import checks as K
from citelode.operators import experiments as X
from citelode.operators import keyword
from citelode.plans import experiments as P
from citelode.plans import index
from citelode.plans import sql_parts as S
from citelode.plans import tables as D
from citelode.session import application_folder

CATEGORIES = [f"src{i}" for i in range(18)]


def chunk_violations(spark, sf_dir):
    """Documents as chunks; their paths, pages and kinds follow from id, language and length."""
    docs = D.table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    chunks = docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("category"),
        F.when(n % 11 == 0, F.concat(F.lit("x/"), F.col("lang"))).when(n % 7 == 0, F.concat("source", F.lit("/cafe\u0301")))
        .otherwise(F.concat_ws("/", "source", "lang")).alias("file"),
        F.when(n % 3 > 0, n % 5).alias("page"), F.when(n % 2 == 0, "pdf").otherwise("txt").alias("kind"),
        F.when(n % 13 == 0, " ").otherwise(F.col("text")).alias("text"),
    )
    return K.chunk_violations(chunks, CATEGORIES)


def item_violations(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    n, level = F.col("n_chars"), F.when(F.col("n_chars") % 2 == 0, "easy").otherwise("hard")
    items = docs.select(
        F.concat_ws("-", F.when(n % 5 == 0, "src0").otherwise(F.col("source")), level, "doc_id").alias("id"), F.col("source").alias("domain"),
        level.alias("difficulty"), F.col("lang").alias("question_lang"), F.when(n % 3 == 0, "en").otherwise(F.col("lang")).alias("answer_lang"),
        F.array(F.concat("source", F.lit("/a.pdf")), F.concat(F.when(n % 9 == 0, "other").otherwise(F.col("source")), F.lit("/b.pdf"))).alias("sources"),
    )
    return K.item_violations(items, CATEGORIES, "en")


def failure_ids(spark, sf_dir):
    orders = D.table(spark, sf_dir, "orders")
    records = orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("kind"),
        (F.col("o_custkey") % 10 > 0).alias("judged"), (F.col("o_custkey") % 7 > 0).alias("citation_judged"), (F.col("o_totalprice") > 50000).alias("cites"),
    )
    return K.failed_ids(records)


def answerable_questions(spark, sf_dir):
    """Benchmark items that some document contains."""
    gold = P.gold_pages(spark, sf_dir).groupBy("qid").agg(F.collect_set("file").alias("sources"))
    questions = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).join(gold, "qid", "left")
    return K.answerable(questions).select("qid", F.size("sources").alias("n_sources"))


def audit_sample(spark, sf_dir):
    items = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return K.audit_sample(items, ["source", "lang"], 3, 11)


def parse_outcomes(spark, sf_dir):
    """Event properties as files; some are cut off, some are known already."""
    n = F.col("event_id")
    content = F.when(n % 6 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    files = D.table(spark, sf_dir, "events").select(n.alias("file"), content.alias("content"), F.md5(content).alias("fingerprint"))
    cached = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file")).join(files, "file").select("file", "fingerprint")
    parse = lambda c: F.struct(F.try_parse_json(c).cast("string").alias("doc"), F.when(F.try_parse_json(c).isNull(), "not JSON").alias("error"))
    _, outcomes = K.parse_outcomes(files, parse, cached)
    return outcomes.groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"), F.sum("file").alias("files"))


def provider_warnings(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations")
    given = F.when(F.col("role") == "user", F.array(
        F.struct(F.lit("parser").alias("logger"), F.concat(F.lit("turn "), "turn").alias("message")),
        F.struct(F.lit("tables").alias("logger"), F.col("role").alias("message")),
    ))
    outputs = turns.select(F.col("conv_id").alias("file"), F.col("role").alias("category"), given.alias("warnings"))
    return K.provider_warnings(outputs).groupBy("category", "logger", "ordinal").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("file", "message").alias("n_messages")
    )


def table_cells(spark, sf_dir):
    """The lines of an order as a table of two rows: cells, and their copies in the grid."""
    lines = D.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l")
    )
    cells = F.transform("l", lambda x: x["l_partkey"].cast("string"))
    tables = lines.select(
        F.col("l_orderkey").alias("file"), F.transform("l", lambda x: x["l_linenumber"]).alias("pages"), cells.alias("cells"),
        F.array(cells, F.slice(cells, 1, 1)).alias("grid"),
    )
    return K.table_cells(tables).groupBy("file", "page").agg(
        F.count_if("counted").alias("n_cells"), F.count_if(~F.col("counted")).alias("n_copies"), F.sum(F.col("text").cast("long")).alias("total")
    )


def gate_inputs(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("file"), F.col("l_linenumber").alias("page"), "l_linestatus"
    )
    shaped = K.gate_inputs(lines, F.when(F.col("l_linestatus") == "O", "fully").otherwise("partially"))
    return shaped.groupBy("citation.file", "support").agg(F.count(F.lit(1)).alias("n"), F.sum("citation.page").alias("pages"), F.count("citation.quote").alias("quotes"))


def classification_fallback(spark, sf_dir):
    """Turns of the assistant get a reply that names no sub-question."""
    turns = D.table(spark, sf_dir, "conversations")
    reply = F.when(F.col("role") == "user", F.to_json(F.struct(F.array(
        F.struct(F.concat(F.lit("q"), "turn").alias("question"), F.array(F.lit("en")).alias("categories"))).alias("sub_questions")))).otherwise("{}")
    subs = K.classification_or_default(R.sub_questions(reply, ["de", "en"]), F.col("role"))
    each = turns.select("conv_id", F.explode(subs).alias("s"))
    return each.groupBy("conv_id", "s.question", F.size("s.categories").alias("n_categories")).agg(F.count(F.lit(1)).alias("n"))


def category_keyword_search(spark, sf_dir):
    """Every benchmark item searched in one source, which follows from its id."""
    words = lambda: T.words(F.lower("text"))
    pages = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("category"), words().alias("tokens"))
    queries = D.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("category"), words().alias("tokens")
    )
    return keyword.category_search(pages, queries, 5).select("qid", "rank", "page_id", F.round("score", 6).alias("score"))


def _pairs(spark):
    return spark.createDataFrame([("narrow", "wide"), ("strict", "wide"), ("strict", "narrow")], "arm string, reference string")


def reference_comparison(spark, sf_dir):
    return X.compared(P._predictions(spark, sf_dir), _pairs(spark))


def changed_ids(spark, sf_dir):
    return X.changed_ids(P._predictions(spark, sf_dir), _pairs(spark))


def index_refresh(spark, sf_dir):
    """An index built from labelled documents, toxic ones in an older form, and benchmark items that are
    gone by now; brought up to date with all documents."""
    now = D.files(spark, sf_dir)
    labels = D.table(spark, sf_dir, "labels").withColumn("id", F.col("doc_id").cast("string"))
    known = now.withColumn("id", F.regexp_extract("file", r"(\d+)\.txt$", 1)).join(labels.select("id", "toxic"), "id")
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" Older text."))).otherwise(F.col("text"))
    gone = D.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src0/pages/b"), "item_id").alias("file"), F.lit("src0").alias("category"), "text")
    path = f"{application_folder(spark)}/index-{uuid.uuid4().hex[:12]}"
    index.build(known.select("file", "category", text.alias("text")).unionByName(gone), path)
    index.update(now, path)
    rows = index.open_index(spark, path)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_chunks"), F.md5(F.array_join(F.sort_array(F.collect_list(F.md5("text"))), "")).alias("texts_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_violations, item_violations, failure_ids, answerable_questions, audit_sample, parse_outcomes, provider_warnings, table_cells,
        gate_inputs, classification_fallback, category_keyword_search, reference_comparison, changed_ids,
        index_refresh,
    )
}

_KNOWN = "source IN (" + ", ".join(f"'src{i}'" for i in range(18)) + ")"
_PAIRED = f"""{P._PRED},
both_ AS (
  SELECT a.arm, b.arm AS reference, a.id, a.verdict AS v, b.verdict AS b FROM preds a JOIN preds b USING (id)
  WHERE (a.arm, b.arm) IN (('narrow', 'wide'), ('strict', 'wide'), ('strict', 'narrow')))"""

ORACLES = {
    "index_refresh": f"""WITH RECURSIVE {S.CHUNKS}
SELECT file, count(*) AS n_chunks, md5(string_agg(md5(text), '' ORDER BY md5(text))) AS texts_md5 FROM chunks GROUP BY 1""",
    "chunk_violations": f"""WITH c AS (
  SELECT *, CASE WHEN n_chars % 11 = 0 THEN 'x/' || lang WHEN n_chars % 7 = 0 THEN source || '/cafe' || chr(769) ELSE source || '/' || lang END AS file,
    CASE WHEN n_chars % 3 > 0 THEN n_chars % 5 END AS page FROM documents)
SELECT doc_id AS chunk_id, 'blank_text' AS problem FROM c WHERE n_chars % 13 = 0 OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = ''
UNION ALL SELECT doc_id, 'unknown_category' FROM c WHERE NOT ({_KNOWN})
UNION ALL SELECT doc_id, 'file_outside_category' FROM c WHERE NOT starts_with(file, source || '/')
UNION ALL SELECT doc_id, 'file_not_nfc' FROM c WHERE file <> nfc_normalize(file)
UNION ALL SELECT doc_id, 'pdf_without_page' FROM c WHERE n_chars % 2 = 0 AND (page IS NULL OR page < 1)
UNION ALL SELECT doc_id, 'txt_with_page' FROM c WHERE n_chars % 2 = 1 AND page IS NOT NULL""",
    "item_violations": f"""WITH i AS (
  SELECT *, CASE WHEN n_chars % 2 = 0 THEN 'easy' ELSE 'hard' END AS level, CASE WHEN n_chars % 5 = 0 THEN 'src0' ELSE source END AS given FROM documents),
k AS (SELECT *, given || '-' || level || '-' || doc_id AS id FROM i)
SELECT id, 'unknown_category' AS problem FROM k WHERE NOT ({_KNOWN})
UNION ALL SELECT id, 'question_language' FROM k WHERE lang <> 'en'
UNION ALL SELECT id, 'answer_language' FROM k WHERE n_chars % 3 <> 0 AND lang <> 'en'
UNION ALL SELECT id, 'id_does_not_fit' FROM k WHERE given <> source
UNION ALL SELECT id, 'source_outside_category' FROM k WHERE n_chars % 9 = 0""",
    "failure_ids": """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'standard' ELSE o_orderpriority END AS kind, o_custkey AS c, o_totalprice AS p FROM orders),
f AS (SELECT id, kind, 'judgment' AS failure FROM r WHERE c % 10 = 0 UNION ALL SELECT id, kind, 'citation_judgment' FROM r WHERE c % 7 = 0 AND p > 50000)
SELECT id, kind, failure FROM f""",
    "answerable_questions": """SELECT item_id AS qid, count(*)::INT AS n_sources FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1""",
    "audit_sample": """SELECT id, source, lang, draw::INT AS draw FROM (
  SELECT doc_id AS id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('11|' || doc_id), doc_id) AS draw FROM documents) WHERE draw <= 3""",
    "parse_outcomes": """WITH f AS (SELECT event_id AS file, CASE WHEN event_id % 6 = 0 THEN left(props, length(props) - 1) ELSE props END AS content FROM events),
o AS (SELECT file, CASE WHEN file IN (SELECT c_custkey FROM customer) THEN 'cached' WHEN json_valid(content) THEN 'ok' ELSE 'failed' END AS status FROM f)
SELECT status, CASE WHEN status = 'failed' THEN 'not JSON' END AS error, count(*) AS n, sum(file)::BIGINT AS files FROM o GROUP BY 1, 2""",
    "provider_warnings": """SELECT role AS category, 'parser' AS logger, 0 AS ordinal, count(*) AS n, count(DISTINCT (conv_id, turn)) AS n_messages FROM conversations WHERE role = 'user' GROUP BY 1
UNION ALL SELECT role, 'tables', 1, count(*), count(DISTINCT conv_id) FROM conversations WHERE role = 'user' GROUP BY 1""",
    "table_cells": """SELECT l_orderkey AS file, arg_min(l_linenumber, (l_linenumber, l_partkey)) AS page, count(*) AS n_cells, count(*) + 1 AS n_copies,
  (2 * sum(l_partkey) + arg_min(l_partkey, (l_linenumber, l_partkey)))::BIGINT AS total FROM lineitem GROUP BY 1""",
    "gate_inputs": """SELECT 's' || l_suppkey AS file, CASE l_linestatus WHEN 'O' THEN 'fully' ELSE 'partially' END AS support, count(*) AS n,
  sum(l_linenumber)::BIGINT AS pages, 0::BIGINT AS quotes FROM lineitem GROUP BY 1, 2""",
    "classification_fallback": """SELECT conv_id, CASE WHEN role = 'user' THEN 'q' || turn ELSE role END AS question, (role = 'user')::INT AS n_categories, count(*) AS n
FROM conversations GROUP BY ALL""",
    "category_keyword_search": r"""WITH p AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w FROM documents),
q AS (SELECT item_id, 'src' || item_id % 20 AS source, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w FROM benchmark),
t AS (SELECT item_id, source, token, count(*) AS qtf FROM (SELECT item_id, source, unnest(w) AS token FROM q) GROUP BY ALL),
c AS (SELECT source, count(*) AS n, avg(len(w))::DOUBLE AS avgdl FROM p GROUP BY 1),
o AS (SELECT doc_id, source, dl, token, count(*) AS tf FROM (SELECT doc_id, source, len(w) AS dl, unnest(w) AS token FROM p) GROUP BY ALL),
d AS (SELECT source, token, count(*) AS df FROM o GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM t JOIN o USING (source, token) JOIN d USING (source, token) JOIN c USING (source) GROUP BY 1, 2),
r AS (
  SELECT q.item_id, p.doc_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY q.item_id ORDER BY round(coalesce(score, 0), 9) DESC, p.doc_id) AS rank
  FROM q JOIN p USING (source) LEFT JOIN s ON s.item_id = q.item_id AND s.doc_id = p.doc_id)
SELECT item_id AS qid, rank::INT AS rank, doc_id AS page_id, round(score, 6) AS score FROM r WHERE rank <= 5""".replace("\\\\", "\\"),
    "reference_comparison": f"""WITH {_PAIRED},
n AS (
  SELECT arm, reference, count(*) AS n_pairs, count(*) FILTER (b = 'harmful' AND v <> 'harmful') AS n_fixed, count(*) FILTER (b <> 'harmful' AND v = 'harmful') AS n_broken,
    count(*) FILTER (b <> 'useful' AND v = 'useful') AS n_correct_gained, count(*) FILTER (b = 'useful' AND v <> 'useful') AS n_correct_lost FROM both_ GROUP BY 1, 2)
SELECT *, {P._p('n_fixed', 'n_broken')} AS mcnemar_p, {P._p('n_correct_gained', 'n_correct_lost')} AS mcnemar_p_correct FROM n""",
    "changed_ids": f"""WITH {_PAIRED}
SELECT arm, reference, id, CASE WHEN b = 'harmful' THEN 'fixed' ELSE 'broken' END AS change FROM both_ WHERE (b = 'harmful') <> (v = 'harmful')
UNION ALL SELECT arm, reference, id, CASE WHEN v = 'useful' THEN 'gained' ELSE 'lost' END FROM both_ WHERE (b = 'useful') <> (v = 'useful')""",
}
