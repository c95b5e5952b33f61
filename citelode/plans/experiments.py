"""Retrieval audit and classifier-experiment queries.

Gold pages are documents that contain a benchmark passage verbatim. The classifiers
guess a document's language from its words; three arms differ in how they tag.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citelode.functions import text as T
from citelode.operators import audit as A
from citelode.operators import experiments as X
from citelode.operators import fusion
from citelode.plans import retrieval
from citelode.plans import sql_parts as S
from citelode.plans import tables as D
from citelode.session import cut_lineage

DEEP = 60
#: Frequent words per language; the languages are the categories of the experiment.
MARKERS = {
    "de": ("der", "die", "und", "sich", "den"), "en": ("the", "of", "and", "to", "in"),
    "es": ("de", "la", "que", "el", "en"), "fr": ("le", "la", "les", "des", "et"),
}
ACCENTS = {"de": "[äöüß]", "es": "[ñíó]", "fr": "[èêç]"}
ARMS = {"wide": 0.04, "narrow": 0.1, "strict": 0.16}
BASELINE = "wide"
FAMILIES = {"romance": ("es", "fr"), "germanic": ("de", "en"), "western": ("en", "fr")}


def r6(name):
    return F.round(F.col(name), 6).alias(name)


# -- audit -------------------------------------------------------------------------

def _gold(spark, sf_dir):
    passages = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), F.col("text").alias("passage"))
    found = A.passages_in(D.files(spark, sf_dir).select("file", "text"), passages)
    doc = F.regexp_extract("file", r"/(\d+)\.txt$", 1).cast("long")
    return found.select(
        F.col("pid").alias("qid"), (doc % 2).alias("group"), "file",
        A.page_key(F.col("file"), F.lit(None)).alias("key"),
    )


def gold_pages(spark, sf_dir):
    return _gold(spark, sf_dir).select("qid", "group", "file")


def _groups(spark, sf_dir):
    dense = cut_lineage(retrieval.dense_stage(spark, sf_dir, DEEP))
    sparse = cut_lineage(retrieval.sparse_stage(spark, sf_dir, DEEP))
    pool = fusion.hybrid_candidates(dense, sparse, DEEP)
    candidates = retrieval.rerank(spark, sf_dir, pool).withColumn(
        "key", A.page_key(A.file_of(F.col("chunk_id")), A.page_of(F.col("chunk_id")))
    )
    # The index leaves out texts without a sentence, as chunking does.
    indexed = D.files(spark, sf_dir).filter(T.strip(F.col("text")) != "").select(
        A.page_key(F.col("file"), F.lit(None)).alias("key")
    )
    return A.audit_groups(_gold(spark, sf_dir), candidates, indexed)


def audit_stages(spark, sf_dir):
    return _groups(spark, sf_dir).select(
        "qid", "group", "stage", "fused_rank", "rerank_rank", r6("rerank_score"), "n_chunks"
    )


def coverage_curve(spark, sf_dir):
    return A.coverage(_groups(spark, sf_dir)).select("curve", "depth", r6("share"))


def depth_percentiles(spark, sf_dir):
    return A.depth_percentiles(cut_lineage(_groups(spark, sf_dir)))


def audit_summary(spark, sf_dir):
    questions = D.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.explode(F.array(
            F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("bucket")),
            F.struct(F.lit("difficulty").alias("slice"),
                     F.when(T.word_count(F.col("text")) < 30, "easy").otherwise("hard").alias("bucket")),
        )).alias("s"),
    ).select("qid", "s.slice", "s.bucket")
    return A.audit_summary(_groups(spark, sf_dir), questions).select(
        "slice", "bucket", "n_questions", "n_groups", *A.STAGES, "gate_blocked", r6("group_hit_rate"), r6("question_hit_rate")
    )


# -- hints and filters ---------------------------------------------------------------

def _hints(spark, sf_dir):
    fused = retrieval.fused_candidates(spark, sf_dir)
    return X.category_hint(fused.withColumn("category", F.substring_index("chunk_id", "/", 1)))


def category_hint(spark, sf_dir):
    shown = F.array_join(F.transform("histogram", lambda e: F.concat(e["category"], F.lit(":"), e["n"].cast("string"))), ",")
    return _hints(spark, sf_dir).select("qid", "n_hits", shown.alias("histogram"), "top_category", "top_share")


def hint_snippets(spark, sf_dir):
    top = retrieval.fused_candidates(spark, sf_dir).filter(F.col("rank") <= X.HINT_SNIPPETS)
    texts = retrieval.texts_of(spark, sf_dir, top)
    return texts.select("qid", "rank", "file", "category", F.md5(T.snippet(F.col("text"))).alias("snippet_md5"))


def hint_vote(spark, sf_dir):
    hints = _hints(spark, sf_dir)
    return hints.select("qid", F.array_join(X.hint_vote(hints), ",").alias("categories"))


def _tagged(spark, sf_dir):
    """Word-based and accent-based tags of every document for every arm."""
    docs = D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"))
    counted = docs.select(
        "doc_id", "lang", "n_chars", F.lower("text").alias("low"), T.tokens(F.col("text")).alias("tokens")
    )
    among = lambda marks: F.size(F.filter("tokens", lambda t: t.isin(*marks)))
    hits = {
        lang: among(marks) / F.greatest(F.size("tokens"), F.lit(1)) for lang, marks in MARKERS.items()
    }
    accents = F.array_compact(F.array(*[F.when(F.col("low").rlike(p), F.lit(lang)) for lang, p in ACCENTS.items()]))
    scored = counted.select("doc_id", "lang", "n_chars", *[h.alias(f"h_{lang}") for lang, h in hits.items()], accents.alias("accents"))
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(t).alias("cut")) for a, t in ARMS.items()])
    each = scored.withColumn("a", F.explode(arms))
    words = F.array_compact(F.array(*[F.when(F.col(f"h_{lang}") >= F.col("a.cut"), F.lit(lang)) for lang in MARKERS]))
    return each.select("doc_id", "lang", "n_chars", "a.arm", words.alias("words"), "accents")


def _predictions(spark, sf_dir):
    subs = F.array(
        F.struct(F.lit("words").alias("question"), F.col("words").alias("categories")),
        F.struct(F.lit("accents").alias("question"), F.array_intersect("words", "accents").alias("categories")),
    )
    base = _tagged(spark, sf_dir).select(
        F.col("doc_id").alias("id"), "arm", F.col("lang").alias("gold"),
        F.when(F.col("doc_id") % 3 == 0, "v2").otherwise("v1").alias("set"), "n_chars",
        F.when(F.col("n_chars") % 2 == 0, subs).otherwise(F.slice(subs, 1, 1)).alias("subs"),
    )
    categories = F.array_distinct(F.flatten(F.transform("subs", lambda s: s["categories"])))
    calls = F.when(F.col("n_chars") % 17 == 0, F.array(F.lit("stop"), F.lit("length"))).otherwise(F.array(F.lit("stop")))
    tagged = base.withColumn("categories", categories).withColumn("calls", calls)
    return tagged.select(
        "id", "arm", "gold", "set", "subs", "categories", X.verdict(F.col("categories"), F.col("gold")).alias("verdict"),
        (F.col("n_chars") % 13 == 0).alias("parse_failed"), X.finish_reason(F.col("calls")).alias("finish_reason"),
        F.size("calls").alias("n_calls"), F.col("n_chars").alias("latency_ms"), (F.col("n_chars") * 0.000001).alias("cost_usd"),
    )


def filter_verdicts(spark, sf_dir):
    return _predictions(spark, sf_dir).select(
        "id", "arm", "gold", F.array_join("categories", ",").alias("categories"), "verdict",
        F.array_join(X.applied_filters(F.col("subs")), ",").alias("applied"), "finish_reason",
    )


def filter_policies(spark, sf_dir):
    """How many filters each policy sets and how many of them hold the gold category."""
    predictions = _predictions(spark, sf_dir)
    modes = ("none", "gold", "gold-family", "predicted", "predicted-set", "predicted-family")
    each = predictions.select(
        "arm", "gold", F.explode(F.array(*[
            F.struct(F.lit(m).alias("mode"), X.filter_for(m, F.col("categories"), F.col("gold"), FAMILIES).alias("f")) for m in modes
        ])).alias("p"),
    )
    return each.groupBy("arm", "p.mode").agg(
        F.count("p.f").alias("n_filtered"), F.count_if(F.array_contains("p.f", F.col("gold"))).alias("n_with_gold"),
        F.coalesce(F.sum(F.when(F.col("p.f").isNotNull(), F.size("p.f"))), F.lit(0)).cast("long").alias("n_categories"),
    )


def self_consistency_vote(spark, sf_dir):
    samples = _tagged(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("words").alias("samples"))
    return samples.select("doc_id", F.array_join(F.sort_array(X.vote(F.col("samples"), 2)), ",").alias("kept"))


def routing(spark, sf_dir):
    shaped = _predictions(spark, sf_dir)
    strong = X.needs_strong_model(
        F.when(F.col("latency_ms") > 3000, "hard").otherwise("medium"),
        F.when(F.size("categories") > 1, "multi").otherwise("single"),
        F.col("parse_failed"), F.col("n_calls") > 1,
    )
    return shaped.groupBy("arm", "gold", strong.alias("strong")).agg(F.count(F.lit(1)).alias("n"))


def short_passage_hits(spark, sf_dir):
    """Runs of two to eight words of each benchmark item, without their first and last letter,
    against the whole documents."""
    words = F.split(F.trim("text"), r"\s+")
    run = F.array_join(F.slice(words, 3, F.col("k")), " ")
    passages = D.table(spark, sf_dir, "benchmark").select(
        "item_id", "text", F.explode(F.sequence(F.lit(2), F.lit(8))).alias("k")
    ).select((F.col("item_id") * 10 + F.col("k")).alias("pid"), F.substring(run, F.lit(2), F.length(run) - 2).alias("passage"))
    texts = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    hits = A.passages_in(texts, passages.filter(F.length("passage") > 0))
    return hits.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first_doc"), F.max("file").alias("last_doc"))


METRICS = [
    "net", "harmful_rate", "filter_correct_rate", "no_filter_rate", "recall_any", "mean_tags_per_sub",
    "mean_sub_questions", "parse_fail_rate", "calls_per_question", "truncation_rate", "p50_ms",
    "mean_cost_usd", "total_cost_usd", "sub_harmful_rate",
]


def arm_summary(spark, sf_dir):
    table = X.arm_summary(X.by_set(_predictions(spark, sf_dir)), ["arm", "bucket"])
    return table.select("arm", "bucket", "n", "sub_filter_count", *[r6(m) for m in METRICS])


def confusion(spark, sf_dir):
    return X.confusion(_predictions(spark, sf_dir), ["arm"])


def confusion_pivot(spark, sf_dir):
    """Confusion of each arm as a matrix; the columns are the closed category list."""
    table = X.confusion(_predictions(spark, sf_dir), ["arm"])
    wide = table.groupBy("arm", "gold").pivot("predicted", [*MARKERS, X.NO_FILTER]).agg(F.sum("n"))
    return wide.select("arm", "gold", *[F.coalesce(c, F.lit(0)).alias(f"as_{c}") for c in MARKERS], F.coalesce(F.col(f"`{X.NO_FILTER}`"), F.lit(0)).alias("no_filter"))


def worst_pairs(spark, sf_dir):
    return X.worst_pairs(X.confusion(_predictions(spark, sf_dir), ["arm"]), ["arm"])


def paired_mcnemar(spark, sf_dir):
    return X.paired(X.by_set(_predictions(spark, sf_dir)), BASELINE, ["bucket"])


def discordant_ids(spark, sf_dir):
    return X.discordant(_predictions(spark, sf_dir), BASELINE)


def arm_ranking(spark, sf_dir):
    """Arms by net, each called better, worse or tied against the baseline."""
    predictions = _predictions(spark, sf_dir)
    net = predictions.groupBy("arm").agg(
        (F.avg((F.col("verdict") == "useful").cast("double")) - F.avg((F.col("verdict") == "harmful").cast("double"))).alias("net")
    )
    base = net.agg(F.max(F.when(F.col("arm") == BASELINE, F.col("net")))).scalar()
    tests = X.paired(predictions, BASELINE, [])
    significant = F.least("mcnemar_p", "mcnemar_p_correct") <= 0.05
    call = F.when(~significant, "tied").when(F.col("net") > base, "better").otherwise("worse")
    return net.join(tests, "arm").select("arm", r6("net"), "n_fixed", "n_broken", "mcnemar_p", "mcnemar_p_correct", call.alias("call"))


QUERIES = {
    f.__name__: f
    for f in (
        gold_pages, short_passage_hits, audit_stages, coverage_curve, depth_percentiles, audit_summary, category_hint, hint_snippets,
        hint_vote, filter_verdicts, filter_policies, self_consistency_vote, routing, arm_summary, confusion,
        confusion_pivot, worst_pairs, paired_mcnemar, discordant_ids, arm_ranking,
    )
}

_GOLD = """
gold AS (
  SELECT item_id AS qid, doc_id % 2 AS grp, source || '/pages/' || doc_id || '.txt' AS file
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""

_GROUPS = f"""
{S.FUSED.replace('<= 20', '<= 60')},
{_GOLD},
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, chunk_id) AS rr FROM reranked),
pagestats AS (
  SELECT qid, file, min(rank) AS fr, min(rr) AS rr, max(rerank_score) AS rs, count(*) AS nc,
         bool_or(rerank_score >= 0.35 AND rr <= 6) AS g FROM ordered GROUP BY 1, 2),
groups AS (
  SELECT qid, grp, CASE WHEN bool_or(g) THEN 'gated' WHEN count(fr) > 0 THEN 'not_gated' ELSE 'not_retrieved' END AS stage,
         min(fr) AS fused_rank, min(rr) AS rerank_rank, arg_min(rs, rr) AS rerank_score, coalesce(arg_min(nc, fr), 0) AS n_chunks
  FROM gold LEFT JOIN pagestats USING (qid, file) GROUP BY 1, 2)"""

_HINT = f"""
{S.FUSED},
seen AS (
  SELECT qid, split_part(chunk_id, '/', 1) AS category, count(*) AS n, min(rank) AS first FROM fused WHERE rank <= 10 GROUP BY 1, 2),
hints AS (
  SELECT qid, sum(n)::BIGINT AS n_hits, string_agg(category || ':' || n, ',' ORDER BY n DESC, first) AS histogram,
    first(category ORDER BY n DESC, first) AS top_category, round(max(n)::DOUBLE / sum(n), 4) AS top_share FROM seen GROUP BY 1)"""

_ARM_LIST = ", ".join(f"('{a}', {t}::DOUBLE)" for a, t in ARMS.items())


def _in(marks):
    return "(" + ", ".join(f"'{m}'" for m in marks) + ")"


_PRED = f"""
tok AS (SELECT doc_id, lang, n_chars, lower(text) AS low, {S.tokens('text')} AS t FROM documents),
shares AS (
  SELECT doc_id, lang, n_chars,
    {', '.join(f"len(list_filter(t, lambda x: x IN {_in(m)}))::DOUBLE / greatest(len(t), 1) AS h_{l}" for l, m in MARKERS.items())},
    list_filter([{', '.join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{l}' END" for l, p in ACCENTS.items())}], lambda x: x IS NOT NULL) AS accents
  FROM tok),
tagged AS (
  SELECT doc_id, lang, n_chars, arm, accents,
    list_filter([{', '.join(f"CASE WHEN h_{l} >= cut THEN '{l}' END" for l in MARKERS)}], lambda x: x IS NOT NULL) AS words
  FROM shares, (VALUES {_ARM_LIST}) a(arm, cut)),
preds AS (
  SELECT doc_id AS id, arm, lang AS gold, CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS "set", n_chars, words AS categories,
    list_filter(words, lambda w: list_contains(accents, w)) AS second, n_chars % 2 = 0 AS two,
    CASE WHEN len(words) <> 1 THEN 'none' WHEN words[1] = lang THEN 'useful' ELSE 'harmful' END AS verdict FROM tagged),
pooled AS (SELECT *, "set" AS bucket FROM preds UNION ALL SELECT *, 'pooled' FROM preds)"""

_P_VALUE = """round(least(1.0, 2 * list_sum(list_transform(range(0, least({a}, {b})::INT + 1),
  lambda i: exp(lgamma(({a} + {b} + 1)::DOUBLE) - lgamma((i + 1)::DOUBLE) - lgamma(({a} + {b} - i + 1)::DOUBLE) - ({a} + {b}) * ln(2::DOUBLE))))), 6)"""


def _p(a, b):
    return _P_VALUE.format(a=a, b=b)


def _paired(source, keys):
    on = "".join(f" AND a.{k} = b.{k}" for k in keys)
    cols = "".join(f", a.{k}" for k in keys)
    return f"""
pairs AS (
  SELECT a.arm{cols}, count(*) AS n_pairs,
    count(*) FILTER (b.verdict = 'harmful' AND a.verdict <> 'harmful') AS n_fixed,
    count(*) FILTER (b.verdict <> 'harmful' AND a.verdict = 'harmful') AS n_broken,
    count(*) FILTER (b.verdict <> 'useful' AND a.verdict = 'useful') AS n_correct_gained,
    count(*) FILTER (b.verdict = 'useful' AND a.verdict <> 'useful') AS n_correct_lost
  FROM {source} a JOIN {source} b ON a.id = b.id AND b.arm = '{BASELINE}'{on} WHERE a.arm <> '{BASELINE}' GROUP BY a.arm{cols})"""


_FAMILY = "CASE WHEN list_has_any({x}, ['es', 'fr']) THEN ['es', 'fr'] ELSE [] END || CASE WHEN list_has_any({x}, ['de', 'en']) THEN ['de', 'en'] ELSE [] END || CASE WHEN list_has_any({x}, ['en', 'fr']) THEN ['en', 'fr'] ELSE [] END"

ORACLES = {
    "gold_pages": f'WITH {_GOLD} SELECT qid, grp AS "group", file FROM gold',
    "audit_stages": f"""WITH RECURSIVE {_GROUPS}
SELECT qid, grp AS "group", stage, fused_rank::INT AS fused_rank, rerank_rank::INT AS rerank_rank, round(rerank_score, 6) AS rerank_score, n_chunks FROM groups""",
    "coverage_curve": f"""WITH RECURSIVE {_GROUPS}
SELECT 'top_k' AS curve, k::INT AS depth, round(avg(coalesce(fused_rank <= k, false)::INT), 6) AS share FROM groups, (VALUES (5), (10), (20), (30), (50), (75), (100)) t(k) GROUP BY k
UNION ALL SELECT 'top_n', k::INT, round(avg(coalesce(rerank_rank <= k AND coalesce(rerank_score, 0) >= 0.35, false)::INT), 6) FROM groups, (VALUES (1), (3), (6), (10), (20)) t(k) GROUP BY k""",
    "depth_percentiles": f"""WITH RECURSIVE {_GROUPS},
v AS (SELECT list_sort(list(fused_rank) FILTER (fused_rank IS NOT NULL)) AS r, count(*) AS n FROM groups)
SELECT r[ceil(0.5::DOUBLE * n)::INT]::INT AS p50, r[ceil(0.8::DOUBLE * n)::INT]::INT AS p80, r[ceil(0.9::DOUBLE * n)::INT]::INT AS p90 FROM v""",
    "audit_summary": f"""WITH RECURSIVE {_GROUPS},
q AS (
  SELECT item_id AS qid, 'overall' AS slice, 'all' AS bucket FROM benchmark UNION ALL
  SELECT item_id, 'difficulty', CASE WHEN {S.words('text')} < 30 THEN 'easy' ELSE 'hard' END FROM benchmark),
p AS (
  SELECT qid, count(*) AS n_groups, count(*) FILTER (stage = 'gated') AS gated, count(*) FILTER (stage = 'not_gated') AS not_gated,
    count(*) FILTER (stage = 'not_retrieved') AS not_retrieved, count(*) FILTER (rerank_rank <= 6 AND coalesce(rerank_score, 0) < 0.35) AS gate_blocked
  FROM groups GROUP BY 1)
SELECT slice, bucket, count(*) AS n_questions, sum(n_groups)::BIGINT AS n_groups, sum(gated)::BIGINT AS gated, sum(not_gated)::BIGINT AS not_gated,
  sum(not_retrieved)::BIGINT AS not_retrieved, 0::BIGINT AS missing_from_index, sum(gate_blocked)::BIGINT AS gate_blocked,
  round(sum(gated)::DOUBLE / sum(n_groups), 6) AS group_hit_rate, round(avg((gated = n_groups)::INT), 6) AS question_hit_rate
FROM p JOIN q USING (qid) GROUP BY 1, 2""",
    "category_hint": f"WITH RECURSIVE {_HINT} SELECT qid, n_hits, histogram, top_category, top_share FROM hints",
    "hint_snippets": f"""WITH RECURSIVE {S.FUSED}
SELECT qid, f.rank::INT AS rank, c.file, c.category, md5(substr({S.collapse('c.text')}, 1, 200)) AS snippet_md5
FROM fused f JOIN chunks c USING (chunk_id) WHERE f.rank <= 3""",
    "hint_vote": f"WITH RECURSIVE {_HINT} SELECT qid, CASE WHEN top_share >= 0.6 THEN top_category ELSE '' END AS categories FROM hints",
    "filter_verdicts": f"""WITH {_PRED}
SELECT id, arm, gold, array_to_string(categories, ',') AS categories, verdict,
  array_to_string(CASE WHEN len(categories) = 1 THEN categories ELSE [] END || CASE WHEN two AND len(second) = 1 THEN second ELSE [] END, ',') AS applied,
  CASE WHEN n_chars % 17 = 0 THEN 'length' ELSE 'stop' END AS finish_reason FROM preds""",
    "filter_policies": f"""WITH {_PRED},
b AS (SELECT arm, gold, categories FROM preds),
m AS (
  SELECT arm, 'none' AS mode, gold, NULL::VARCHAR[] AS f FROM b UNION ALL
  SELECT arm, 'gold', gold, [gold] FROM b UNION ALL
  SELECT arm, 'gold-family', gold, list_distinct([gold] || {_FAMILY.format(x='[gold]')}) FROM b UNION ALL
  SELECT arm, 'predicted', gold, CASE WHEN len(categories) = 1 THEN categories END FROM b UNION ALL
  SELECT arm, 'predicted-set', gold, CASE WHEN len(categories) > 0 THEN categories END FROM b UNION ALL
  SELECT arm, 'predicted-family', gold, CASE WHEN len(categories) > 0 THEN list_distinct(categories || {_FAMILY.format(x='categories')}) END FROM b)
SELECT arm, mode, count(f) AS n_filtered, count(*) FILTER (list_contains(f, gold)) AS n_with_gold, coalesce(sum(len(f)), 0)::BIGINT AS n_categories FROM m GROUP BY 1, 2""",
    "self_consistency_vote": f"""WITH {_PRED},
v AS (SELECT id, unnest(categories) AS c FROM preds),
k AS (SELECT id, c FROM v GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT d.doc_id, coalesce(string_agg(c, ',' ORDER BY c), '') AS kept FROM documents d LEFT JOIN k ON k.id = d.doc_id GROUP BY 1""",
    "short_passage_hits": """WITH runs AS (
  SELECT item_id * 10 + k AS pid, array_to_string(regexp_split_to_array(trim(text), '\\s+')[3:k + 2], ' ') AS run FROM benchmark, range(2, 9) AS ks(k)),
passages AS (SELECT pid, substr(run, 2, length(run) - 2) AS passage FROM runs WHERE length(run) > 2)
SELECT pid, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM passages JOIN documents ON contains(text, passage) GROUP BY 1""",
    "routing": f"""WITH {_PRED}
SELECT arm, gold, n_chars > 3000 OR len(categories) > 1 OR n_chars % 13 = 0 OR n_chars % 17 = 0 AS strong, count(*) AS n
FROM preds GROUP BY 1, 2, 3""",
    "arm_summary": f"""WITH {_PRED},
x AS (SELECT *, CASE WHEN two THEN 2 ELSE 1 END AS subs, len(categories) + CASE WHEN two THEN len(second) ELSE 0 END AS tags,
  (len(categories) = 1)::INT + (two AND len(second) = 1)::INT AS filters,
  (len(categories) = 1 AND categories[1] <> gold)::INT + (two AND len(second) = 1 AND second[1] <> gold)::INT AS wrong FROM pooled)
SELECT arm, bucket, count(*) AS n, sum(filters)::BIGINT AS sub_filter_count,
  round(avg((verdict = 'useful')::INT) - avg((verdict = 'harmful')::INT), 6) AS net,
  round(avg((verdict = 'harmful')::INT), 6) AS harmful_rate, round(avg((verdict = 'useful')::INT), 6) AS filter_correct_rate,
  round(avg((verdict = 'none')::INT), 6) AS no_filter_rate, round(avg(list_contains(categories, gold)::INT), 6) AS recall_any,
  round(sum(tags)::DOUBLE / sum(subs), 6) AS mean_tags_per_sub, round(avg(subs), 6) AS mean_sub_questions,
  round(avg((n_chars % 13 = 0)::INT), 6) AS parse_fail_rate, round(avg(CASE WHEN n_chars % 17 = 0 THEN 2 ELSE 1 END), 6) AS calls_per_question,
  round(avg((n_chars % 17 = 0)::INT), 6) AS truncation_rate, round(median(n_chars), 6) AS p50_ms,
  round(avg(n_chars * 0.000001::DOUBLE), 6) AS mean_cost_usd, round(sum(n_chars * 0.000001::DOUBLE), 6) AS total_cost_usd,
  round(sum(wrong)::DOUBLE / nullif(sum(filters), 0), 6) AS sub_harmful_rate FROM x GROUP BY 1, 2""",
    "confusion": f"""WITH {_PRED}
SELECT arm, gold, CASE WHEN len(categories) = 1 THEN categories[1] ELSE '(none)' END AS predicted, count(*) AS n FROM preds GROUP BY ALL""",
    "confusion_pivot": f"""WITH {_PRED},
b AS (SELECT arm, gold, CASE WHEN len(categories) = 1 THEN categories[1] END AS p FROM preds)
SELECT arm, gold, {', '.join(f"count(*) FILTER (p = '{l}') AS as_{l}" for l in MARKERS)}, count(*) FILTER (p IS NULL) AS no_filter FROM b GROUP BY 1, 2""",
    "worst_pairs": f"""WITH {_PRED}
SELECT arm, gold, categories[1] AS predicted, count(*) AS n FROM preds WHERE len(categories) = 1 AND categories[1] <> gold
GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY arm ORDER BY count(*) DESC, gold DESC, categories[1] DESC) <= 8""",
    "paired_mcnemar": f"""WITH {_PRED}, {_paired('pooled', ['bucket'])}
SELECT *, {_p('n_fixed', 'n_broken')} AS mcnemar_p, {_p('n_correct_gained', 'n_correct_lost')} AS mcnemar_p_correct FROM pairs""",
    "discordant_ids": f"""WITH {_PRED}
SELECT a.arm, a.id, CASE WHEN b.verdict = 'harmful' THEN 'fixed' ELSE 'broken' END AS change
FROM preds a JOIN preds b ON a.id = b.id AND b.arm = '{BASELINE}'
WHERE a.arm <> '{BASELINE}' AND (a.verdict = 'harmful') <> (b.verdict = 'harmful')""",
    "arm_ranking": f"""WITH {_PRED}, {_paired('preds', [])},
net AS (SELECT arm, avg((verdict = 'useful')::INT) - avg((verdict = 'harmful')::INT) AS net FROM preds GROUP BY 1),
p AS (SELECT *, {_p('n_fixed', 'n_broken')} AS mcnemar_p, {_p('n_correct_gained', 'n_correct_lost')} AS mcnemar_p_correct FROM pairs)
SELECT arm, round(net, 6) AS net, n_fixed, n_broken, mcnemar_p, mcnemar_p_correct,
  CASE WHEN least(mcnemar_p, mcnemar_p_correct) > 0.05 THEN 'tied'
       WHEN net > (SELECT net FROM net WHERE arm = '{BASELINE}') THEN 'better' ELSE 'worse' END AS call
FROM p JOIN net USING (arm)""",
}
