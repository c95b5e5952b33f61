"""Run-history, report and incremental-work queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelode.functions import text as T
from citelode.operators import history as H
from citelode.plans import tables as D
from citelode.sources.records import parsed_lines


def question_index(spark, sf_dir):
    """Benchmark items, then documents, then first turns of conversations; ids collide."""
    shape = lambda df, id_, ordinal: df.select(F.col(id_).alias("id"), F.col(ordinal).alias("ordinal"), F.md5("text").alias("question_md5"))
    sources = [
        shape(D.table(spark, sf_dir, "benchmark"), "item_id", "item_id"),
        shape(D.table(spark, sf_dir, "documents"), "doc_id", "doc_id"),
        shape(D.table(spark, sf_dir, "conversations"), "conv_id", "turn"),
    ]
    return H.question_index(sources)


def history_page(spark, sf_dir):
    """The third page of fifty documents as records, with labels as judgments."""
    docs = D.table(spark, sf_dir, "documents")
    records = docs.select(
        (F.col("doc_id") + 1).alias("lineno"),
        H.pair_id(F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")), F.lit("run"), F.col("doc_id") + 1).alias("pair_id"),
        "n_chars",
    )
    questions = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("pair_id"), F.md5("text").alias("question_md5"))
    judgments = D.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("pair_id"), "quality", "toxic")
    return H.history_page(records, questions, judgments, 100, 50)


def history_page_gaps(spark, sf_dir):
    """Turns as JSON lines, user turns cut off in the middle; a page of the records left."""
    text = F.to_json(F.struct("conv_id", "turn", "role"))
    line = F.when(F.col("role") == "user", F.left(text, F.length(text) - 5)).otherwise(text)
    lines = D.table(spark, sf_dir, "conversations").select(
        F.lit("run.jsonl").alias("file"), F.floor(F.col("conv_id") / 50).alias("start"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), line.alias("line"),
    )
    records, _ = parsed_lines(lines, "conv_id bigint, turn bigint, role string")
    records = records.withColumn("pair_id", F.concat_ws("#", "conv_id", "turn")).drop("file")
    none = records.sparkSession.createDataFrame([], "pair_id string, question_md5 string")
    judged = D.table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id"), F.lit("#1")).alias("pair_id"), "quality")
    page = H.history_page(records, none, judged, 20, 30)
    return page.select("lineno", "conv_id", "turn", "role", "quality", "total")


def judged_answers(spark, sf_dir):
    """Runs name their answers file by a foreign absolute path; match on the base name."""
    pages = D.table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    name = F.concat(F.substring_index(path, "/", -1), F.when(F.length("html") % 2 == 1, ".moved").otherwise(""))
    runs = pages.select(F.col("page_id").alias("run"), F.concat(F.lit("C:\\old\\"), name).alias("recorded"))
    files = pages.select(path.alias("path"))
    return H.answers_of_runs(runs, files).select("run", "answers_path")


def citation_preview(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations")
    pages = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("page_text"))
    quote = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.lit(""))
    joined = turns.withColumn("quote", quote).join(pages, "conv_id", "left")
    return joined.select("conv_id", "turn", F.md5(H.preview(F.col("quote"), F.col("page_text"))).alias("preview_md5"))


def field_unification(spark, sf_dir):
    """Category from whichever producer's field is filled; zero is a value."""
    docs = D.table(spark, sf_dir, "documents").join(D.table(spark, sf_dir, "labels"), "doc_id", "left")
    category = F.when(F.col("doc_id") % 4 == 0, F.lit("")).when(F.col("doc_id") % 4 == 1, F.col("source"))
    return docs.select(
        "doc_id", T.first_present(category, F.col("lang")).alias("domain"),
        T.first_present(F.col("toxic"), F.lit(-1)).alias("cost"),
    )


def _warnings(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ordinal"), F.col("event_type").alias("logger"), F.col("event_type").alias("event"),
        F.concat(F.lit("value out of range in "), F.col("props"), F.lit(" while reading the very long description of a page "),
                 F.col("user_id") % 3, F.lit(" with details "), F.col("event_id")).alias("message"),
    )


def warning_topn(spark, sf_dir):
    return H.warning_counts(_warnings(spark, sf_dir)).select("logger", "head", "n", F.md5("example").alias("example_md5"))


def warning_examples(spark, sf_dir):
    return H.warning_examples(_warnings(spark, sf_dir), 20).select("event", "example_no", "ordinal")


def run_delta(spark, sf_dir):
    events = D.table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "event_type", F.col("user_id")))
    half = lambda cond: events.filter(cond).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    cut = F.lit("2024-01-16").cast("timestamp")
    return H.run_delta(
        half(F.col("ts") >= cut), half(F.col("ts") < cut), "key"
    )


def file_status_counts(spark, sf_dir):
    work, cache = _work(spark, sf_dir)
    status = H.cache_status(work, cache, ["doc_id"])
    return status.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


def _work(spark, sf_dir):
    """Documents as work; the cache holds labelled ones, toxic ones with old content."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("fingerprint"))
    labels = D.table(spark, sf_dir, "labels")
    cache = docs.join(labels, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, F.lit("old")).otherwise(F.col("fingerprint")).alias("fingerprint")
    )
    return docs, cache


def incremental_anti_join(spark, sf_dir):
    """Work left to do: content or configuration not in the cache."""
    work, cache = _work(spark, sf_dir)
    return H.not_done(work, cache, ["doc_id", "fingerprint"]).select("doc_id", "source")


def resume_anti_join(spark, sf_dir):
    todo = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    done = D.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("id"))
    return H.not_done(todo, done, ["id"])


def cache_orphans(spark, sf_dir):
    cache = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    docs = D.table(spark, sf_dir, "documents").select("doc_id")
    return H.orphans(cache, docs, ["doc_id"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def upsert_last_write(spark, sf_dir):
    stored = D.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    writes = D.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 700).alias("vec_id"), (F.col("n_chars") % 10).alias("label"), F.col("doc_id").alias("arrival")
    )
    return H.upsert(stored, writes, "vec_id")


def call_cost(spark, sf_dir):
    """Estimated model cost per source at the fixed per-million token prices."""
    docs = D.table(spark, sf_dir, "documents")
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    cost = (tokens * 0.5 + 256 * 2.0) / 1e6
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.sum(cost), 6).alias("cost_usd"))


def identity_hashes(spark, sf_dir):
    """Twelve-digit identity of each record's canonical JSON."""
    docs = D.table(spark, sf_dir, "documents")
    canonical = F.to_json(F.struct("doc_id", "lang", "source"))
    return docs.select("doc_id", F.substring(F.sha2(canonical, 256), 1, 12).alias("identity"))


QUERIES = {
    f.__name__: f
    for f in (
        question_index, history_page, history_page_gaps, judged_answers, citation_preview, field_unification, warning_topn,
        warning_examples, run_delta, file_status_counts, incremental_anti_join, resume_anti_join, cache_orphans,
        upsert_last_write, call_cost, identity_hashes,
    )
}

_WARN = """
w AS (
  SELECT event_id AS ordinal, event_type AS logger, 'value out of range in ' || props || ' while reading the very long description of a page '
    || (user_id % 3) || ' with details ' || event_id AS message FROM events)"""

_WORK = """
work AS (SELECT doc_id, source, sha256(text) AS fp FROM documents),
cache AS (SELECT w.doc_id, CASE WHEN toxic = 1 THEN 'old' ELSE fp END AS fp FROM work w JOIN labels USING (doc_id))"""

ORACLES = {
    "question_index": """WITH s AS (
  SELECT item_id AS id, item_id AS o, text, 0 AS precedence FROM benchmark UNION ALL
  SELECT doc_id, doc_id, text, 1 FROM documents UNION ALL SELECT conv_id, turn, text, 2 FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY precedence, o) AS k FROM s)
SELECT id, md5(text) AS question_md5, precedence FROM r WHERE k = 1""",
    "history_page": """WITH r AS (
  SELECT doc_id + 1 AS lineno, CASE WHEN doc_id % 5 <> 0 THEN doc_id::VARCHAR ELSE 'run#' || (doc_id + 1) END AS pair_id, n_chars FROM documents),
p AS (SELECT * FROM r ORDER BY lineno LIMIT 50 OFFSET 100)
SELECT pair_id, lineno, n_chars, md5(b.text) AS question_md5, quality, toxic, (SELECT count(*) FROM r) AS total
FROM p LEFT JOIN benchmark b ON b.item_id::VARCHAR = pair_id LEFT JOIN labels l ON l.doc_id::VARCHAR = pair_id""",
    "history_page_gaps": """WITH r AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) AS lineno, count(*) OVER () AS total, conv_id, turn, role FROM conversations WHERE role <> 'user')
SELECT lineno, conv_id, turn, role, quality, total FROM r LEFT JOIN labels l ON l.doc_id = conv_id AND turn = 1 WHERE lineno BETWEEN 21 AND 50""",
    "judged_answers": """WITH p AS (SELECT page_id, length(html) % 2 = 1 AS moved, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages),
f AS (SELECT string_split(path, '/')[-1] AS name, min(path) AS path FROM p GROUP BY 1)
SELECT page_id AS run, f.path AS answers_path FROM p LEFT JOIN f ON f.name = string_split(p.path, '/')[-1] || CASE WHEN moved THEN '.moved' ELSE '' END""",
    "citation_preview": """SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 AND c.text <> '' THEN c.text ELSE substr(d.text, 1, 600) END) AS preview_md5
FROM conversations c LEFT JOIN documents d ON d.doc_id = conv_id""",
    "field_unification": """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN source ELSE lang END AS domain, coalesce(toxic, -1) AS cost
FROM documents LEFT JOIN labels USING (doc_id)""",
    "warning_topn": f"""WITH {_WARN}
SELECT logger, substr(message, 1, 100) AS head, count(*) AS n, md5(arg_min(message, ordinal)) AS example_md5
FROM w GROUP BY 1, 2 ORDER BY n DESC, min(ordinal) LIMIT 20""",
    "warning_examples": f"""WITH {_WARN}
SELECT logger AS event, n::INT AS example_no, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY logger ORDER BY ordinal) AS n FROM w) WHERE n <= 20""",
    "run_delta": """WITH e AS (SELECT *, event_type || ':' || user_id AS key FROM events),
a AS (SELECT key, count(*) AS n FROM e WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
b AS (SELECT key, count(*) AS n FROM e WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT key, coalesce(a.n, 0) AS n_now, coalesce(b.n, 0) AS n_before, b.n IS NULL AS is_new, a.n IS NULL AS is_gone FROM a FULL JOIN b USING (key)""",
    "file_status_counts": f"""WITH {_WORK}
SELECT source, CASE WHEN c.fp IS NULL THEN 'new' WHEN c.fp = w.fp THEN 'cached' ELSE 'stale' END AS status, count(*) AS n
FROM work w LEFT JOIN cache c USING (doc_id) GROUP BY 1, 2""",
    "incremental_anti_join": f"""WITH {_WORK}
SELECT doc_id, source FROM work w WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.doc_id = w.doc_id AND c.fp = w.fp)""",
    "resume_anti_join": """SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "cache_orphans": """SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents) GROUP BY 1""",
    "upsert_last_write": """WITH l AS (SELECT doc_id % 700 AS vec_id, arg_max(n_chars % 10, doc_id) AS label FROM documents GROUP BY 1)
SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM l) UNION ALL SELECT vec_id, label FROM l""",
    "call_cost": """SELECT source, count(*) AS n_calls, round(sum((greatest(1, length(text) // 4) * 0.5::DOUBLE + 512) / 1e6), 6) AS cost_usd FROM documents GROUP BY 1""",
    "identity_hashes": """SELECT doc_id, substr(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}'), 1, 12) AS identity FROM documents""",
}
