"""Reply-parsing, citation and scoring queries.

Order lines stand in for judge ballots (one judge per line of an order), orders for
evaluated answers, page URLs for corpus paths, conversation turns for replies.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citelode.functions import replies as R
from citelode.functions import text as T
from citelode.operators import evaluation as E
from citelode.operators.keyword import top_k
from citelode.operators.sizing import small_side
from citelode.plans import retrieval
from citelode.plans import sql_parts as S
from citelode.plans import tables as D

SOURCES = [f"src{i}" for i in range(20)]


def r6(name):
    return F.round(F.col(name), 6).alias(name)


# -- replies -----------------------------------------------------------------------

def _answers(spark, sf_dir):
    """Assistant turns with a sources block: dashes and bars in look-alike forms, bidi
    marks, missing pages, quotes, and now and then no header at all."""
    turns = D.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    number = (F.col("conv_id") * 7 + F.col("turn")).cast("string")
    odd = (F.col("conv_id") + F.col("turn")) % 2 == 1
    block = F.concat(
        F.lit(f"\n{R.SOURCES_HEADER}\n- file: src"), (F.col("conv_id") % 20).cast("string"),
        F.lit("/files/"), F.col("conv_id").cast("string"), F.lit(".pdf | page: "), number, F.lit("\n"),
        F.when(odd, F.lit("‏– file： src0/pages/")).otherwise(F.lit("• file: src1/pages/")),
        F.col("turn").cast("string"), F.lit(".txt ｜ page: "),
        F.when(odd, F.lit("-")).otherwise(F.lit("null")),
        F.when(odd, F.concat(F.lit(' | quote: "'), F.regexp_replace("text", '["\n]', " "), F.lit('"'))).otherwise(F.lit("")),
        F.lit("\nnot a citation line | page: 3"),
    )
    text = F.when(F.col("conv_id") % 9 == 4, F.col("text")).otherwise(F.concat("text", block))
    return turns.select(F.concat_ws("#", "conv_id", "turn").alias("id"), "conv_id", "turn", text.alias("text"))


def citation_parse(spark, sf_dir):
    found = _answers(spark, sf_dir).select("id", F.posexplode(R.source_list(F.col("text"))).alias("pos", "c"))
    return found.select("id", F.col("pos").cast("long").alias("pos"), "c.file", "c.page", "c.quote")


def citation_long_page(spark, sf_dir):
    """Page numbers of nine to twenty-eight digits, which must not read as "no page"."""
    number = F.repeat(F.lit("9"), (F.col("turn") % 20 + 9).cast("int"))
    text = F.concat("text", F.lit(f"\n{R.SOURCES_HEADER}\n- file: a.pdf | page: "), number, F.lit("\n- file: b.txt | page: -"))
    turns = D.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(R.source_list(text)))
    return turns.select("conv_id", "turn", "file", "page")


def citation_validate(spark, sf_dir):
    """Citations that point at a retrieved file and page; null pages equal null pages."""
    cited = _answers(spark, sf_dir).select("id", "conv_id", F.inline(R.source_list(F.col("text"))))
    pages = D.table(spark, sf_dir, "conversations")
    numbered = pages.select(
        "conv_id", F.concat(F.lit("src"), F.col("conv_id") % 20, F.lit("/files/"), F.col("conv_id"), F.lit(".pdf")).alias("file"),
        (F.col("conv_id") * 7 + F.col("turn") - F.length("text") % 2).alias("page"),
    )
    unpaged = pages.select(
        "conv_id", F.concat(F.lit("src0/pages/"), F.col("turn"), F.lit(".txt")).alias("file"),
        F.lit(None).cast("bigint").alias("page"),
    )
    retrieved = numbered.unionByName(unpaged).distinct()
    same = (
        (cited["conv_id"] == retrieved["conv_id"])
        & (T.nfc(cited["file"]) == T.nfc(retrieved["file"]))
        & cited["page"].eqNullSafe(retrieved["page"])
    )
    return cited.join(retrieved, same, "left_semi").select("id", "file", "page")


def answer_flags(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" " + R.REFUSAL))).otherwise(F.col("text"))
    shown = R.without_source_list(text)
    return _answers(spark, sf_dir).select(
        "id", R.is_refusal(text).alias("is_refusal"),
        R.is_non_answer(F.concat(text, F.when(F.col("conv_id") % 5 == 0, F.lit(" no information")).otherwise(F.lit("")))).alias("is_non_answer"),
        F.md5(shown).alias("shown_md5"),
    )


def _judge_replies(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem")
    verdict = (
        F.when(F.col("l_returnflag") == "A", " Correct").when(F.col("l_returnflag") == "N", "REFUSAL ").otherwise("wrong")
    )
    body = F.to_json(
        F.struct(
            verdict.alias("verdict"), (F.col("l_discount") > 0.03).alias("hallucination"),
            (F.col("l_quantity") / 4).alias("correctness"), (F.col("l_discount") * 100 - 2).alias("completeness"),
            F.when(F.col("l_linenumber") != 5, F.col("l_tax") * 100).alias("conversational_quality"),
            F.lit(" because ").alias("reasoning"),
        )
    )
    return lines.select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```")).alias("reply"),
    )


def judgment_normalize(spark, sf_dir):
    judged = _judge_replies(spark, sf_dir).withColumn("j", R.judgment(F.col("reply")))
    return judged.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_replies"), F.count("j").alias("n_valid"),
        F.count_if("j.hallucination").alias("n_hallucinated"),
        F.sum(F.col("j.correctness").cast("long")).alias("sum_correctness"),
        F.sum(F.col("j.completeness").cast("long")).alias("sum_completeness"),
        F.count_if(F.col("j.verdict") == "refusal").alias("n_refusals"),
    )


def citation_judgment_normalize(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", "Establishes").when(F.col("l_returnflag") == "N", "partial").otherwise("other")
    reply = F.to_json(
        F.struct(
            F.when(F.col("l_linestatus") == "O", "fully").otherwise("Partially ").alias("citation_support"),
            F.array(F.struct((F.col("l_linenumber") % 4).alias("idx"), label.alias("label"))).alias("per_citation"),
        )
    )
    judged = lines.select("l_suppkey", R.citation_judgment(reply, F.lit(3)).alias("j"))
    return judged.select("l_suppkey", "j.support", F.posexplode("j.labels").alias("pos", "label")).groupBy(
        "l_suppkey", "support", "pos", "label"
    ).agg(F.count(F.lit(1)).alias("n"))


def _classifier_replies(spark, sf_dir):
    """Classifier replies about document texts, with the two defects models produce:
    stray quotes inside a string and a doubled closing bracket."""
    docs = D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    clean = F.regexp_replace("text", r'["\\\x00-\x1F]', " ")
    question = F.concat(F.lit('ask "about" '), clean)
    reply = F.concat(
        F.lit('Here: {"sub_questions": [{"question": "'), question,
        F.lit('", "categories": ["'), F.col("source"), F.lit('", "nowhere", "src1", "'), F.col("source"),
        F.when(F.col("doc_id") % 2 == 0, F.lit('"]}]], "difficulty": "hard"} thanks')).otherwise(
            F.lit('"]}, {"question": " ", "categories": []}], "difficulty": "easy"}')
        ),
    )
    return docs.select("doc_id", "source", question.alias("asked"), reply.alias("reply"))


def json_repair(spark, sf_dir):
    mended = _classifier_replies(spark, sf_dir).select("doc_id", R.repaired_object(F.col("reply")).alias("o"))
    parsed = mended.select(
        "doc_id", F.from_json("o", "sub_questions array<struct<question string>>, difficulty string").alias("p")
    )
    return parsed.select(
        "doc_id", "p.difficulty", F.size("p.sub_questions").cast("long").alias("n_subs"),
        F.md5(F.get("p.sub_questions", F.lit(0))["question"]).alias("question_md5"),
    )


def sub_question_validation(spark, sf_dir):
    subs = R.sub_questions(R.repaired_object(F.col("reply")), SOURCES)
    shaped = _classifier_replies(spark, sf_dir).select("doc_id", subs.alias("subs"))
    union = R.category_union(F.col("subs"))
    return shaped.select(
        "doc_id", F.size("subs").cast("long").alias("n_subs"), F.array_join(union, ",").alias("categories"),
        F.when(F.size(union) > 1, "multi").otherwise("single").alias("mode"),
    )


def verify_reply(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit("no json here")).otherwise(
        F.concat(F.lit('{"keep": ["'), F.col("source"), F.lit('", "src2", "made-up"]}'))
    )
    proposed = F.array_distinct(F.array(F.lit("src2"), F.lit("src5"), F.col("source")))
    kept = R.retained(proposed, reply, SOURCES)
    return docs.select("doc_id", F.array_join(kept, ",").alias("kept"))


def calc_expr(spark, sf_dir):
    lines = D.spread(D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount"))
    s = lambda c: F.col(c).cast("string")
    expression = F.concat(
        s("l_quantity"), F.lit(" * max("), s("l_discount"), F.lit(", 0.02) + abs(-"), s("l_linenumber"),
        F.lit(") ** 2 - "), s("l_partkey"), F.lit(" // ("), (F.col("l_linenumber") - 3).cast("string"), F.lit(")"),
    )
    done = lines.select("l_suppkey", R.calculate(expression).alias("c"))
    return done.groupBy("l_suppkey").agg(
        F.count("c.value").alias("n_values"), F.count("c.error").alias("n_errors"),
        F.round(F.sum(F.round("c.value", 4)), 2).alias("total"),
    )


# -- citations ---------------------------------------------------------------------

def _corpus(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/$", "")
    kind = F.when(F.col("page_id") % 4 == 0, "txt").otherwise("pdf")
    return pages.select("page_id", path.alias("file"), kind.alias("kind"))


def _corpus_files(spark, sf_dir):
    return _corpus(spark, sf_dir).groupBy("file").agg(F.max("kind").alias("kind"))


def _cited_paths(spark, sf_dir):
    """Four spellings of each path: as is, decorated, longer, and the bare name."""
    spelled = F.expr(
        "CASE page_id % 5 WHEN 0 THEN file WHEN 1 THEN concat('./', upper(file)) "
        "WHEN 2 THEN concat('/mnt/corpus/', file) WHEN 3 THEN element_at(split(file, '/'), -1) "
        "ELSE concat('nowhere/', page_id) END"
    )
    return _corpus(spark, sf_dir).withColumn("cited", spelled)


def file_match_cascade(spark, sf_dir):
    return E.match_files(_cited_paths(spark, sf_dir), _corpus_files(spark, sf_dir))


def _citations(spark, sf_dir):
    page = F.expr(
        "CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN 'x' ELSE cast(page_id % 7 AS string) END"
    )
    return _cited_paths(spark, sf_dir).select(
        F.col("page_id").alias("id"), F.col("cited").alias("file"), page.alias("page"),
        (F.col("page_id") % 11 != 3).alias("answerable"),
    )


def _page_texts(spark, sf_dir):
    """Pages 1 to 5 per pdf, the fifth blank; one unpaged text per txt file."""
    files = _corpus_files(spark, sf_dir)
    pages = F.when(F.col("kind") == "txt", F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(1), F.lit(5)))
    return files.select("file", F.explode(pages).alias("page")).withColumn(
        "text", F.when(F.col("page") == 5, F.lit("  ")).otherwise(F.concat_ws(" p", "file", "page"))
    )


def _resolved(spark, sf_dir):
    return E.resolve_citations(
        _citations(spark, sf_dir), _corpus_files(spark, sf_dir), _page_texts(spark, sf_dir)
    )


def citation_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir).select("id", "cited", "page", "file", "text", "reason")


def citation_reasons(spark, sf_dir):
    return _resolved(spark, sf_dir).filter(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def citation_score(spark, sf_dir):
    """Answers are groups of eight citations; two in nine rulings failed."""
    resolved = _resolved(spark, sf_dir).withColumn("id", F.floor(F.col("id") / 8))
    answers = resolved.select("id").distinct().withColumn("answerable", F.col("id") % 11 != 3)
    rulings = answers.select(
        "id", F.expr("CASE id % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'partially' WHEN 3 THEN 'not_at_all' ELSE 'fully' END").alias("support")
    )
    return E.score_citations(answers, resolved.select("id", "reason"), rulings).select(
        "id", "answerable", "cited_count", "valid_count", "invalid_count", "support", "credit",
        r6("accuracy"), "judge_failed",
    )


def gt_hit(spark, sf_dir):
    cited = _citations(spark, sf_dir).select(F.floor(F.col("id") / 4).alias("id"), "file", "page")
    corpus = _corpus(spark, sf_dir)
    page = lambda shift: F.expr(
        f"CASE WHEN (page_id + {shift}) % 7 = 0 THEN NULL ELSE cast((page_id + {shift}) % 7 AS string) END"
    )
    source = lambda shift: corpus.select(
        F.floor(F.col("page_id") / 4).alias("id"), (F.col("page_id") % 2).alias("group"), "file", page(shift).alias("page")
    )
    found = E.source_hits(cited, source(0).unionByName(source(3)))
    return found.select("id", "groups_total", "groups_hit", r6("hit_rate"))


# -- judging -----------------------------------------------------------------------

def _ballots(spark, sf_dir):
    verdict = F.expr(
        "CASE WHEN l_returnflag = 'A' THEN 'correct' WHEN l_returnflag = 'N' THEN 'partially_correct' "
        "WHEN l_linestatus = 'F' THEN 'incorrect' ELSE 'refusal' END"
    )
    score = lambda c: F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.bround(c)))
    return D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_tax") == 0).alias("failed"), verdict.alias("verdict"),
        ((F.col("l_discount") >= 0.05) & (verdict != "refusal")).alias("hallucination"),
        score(F.col("l_quantity") / 5).alias("correctness"), score(F.col("l_discount") * 100).alias("completeness"),
        score(F.col("l_tax") * 100).alias("conversational_quality"),
    )


def committee_vote(spark, sf_dir):
    return E.committee(_ballots(spark, sf_dir), ["id"])


def label_vote(spark, sf_dir):
    """Citation labels by position, one ballot per order line of a supplier."""
    lines = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("pos"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'establishes' WHEN 'N' THEN 'partial' ELSE 'unrelated' END").alias("label"),
    )
    return E.label_committee(lines, ["id", "pos"])


def support_vote(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'fully' WHEN 'N' THEN 'partially' ELSE 'not_at_all' END").alias("support"),
    )
    return E.support_committee(lines, ["id"])


def _records(spark, sf_dir):
    """One evaluated answer per order."""
    judged = E.committee(_ballots(spark, sf_dir), ["id"])
    lines = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count_if(F.col("l_linenumber") > 1).alias("cited_count"),
        F.count_if((F.col("l_linenumber") > 1) & (F.col("l_linenumber") % 3 == 0)).alias("invalid_count"),
        (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("hit_rate"),
    )
    orders = D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("kind"),
        F.expr("CASE o_custkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END").alias("difficulty"),
        (F.col("o_custkey") % 2 + 1).alias("n_groups"), (F.col("o_custkey") % 10 != 0).alias("answerable"),
        F.floor("o_totalprice").alias("latency_ms"),
    )
    joined = orders.join(judged, "id").join(lines, "id")
    credit = F.expr("CASE kind WHEN 'F' THEN 1.0D WHEN 'O' THEN 0.5D ELSE 0.0D END")
    accuracy = F.coalesce(F.try_divide(credit * (F.col("cited_count") - F.col("invalid_count")), F.col("cited_count")), F.lit(0.0))
    return joined.withColumn("accuracy", F.when(F.col("answerable"), accuracy))


DIMENSIONS = ("difficulty", "domain", "n_groups", "kind")
RATES = [
    *E.SCORES, "hallucination_rate", "refusal_rate", "citation_accuracy", "full_citation_credit_rate",
    "uncited_rate", "abstention_rate", "unanswerable_citation_rate", "invalid_citation_rate",
    "gt_source_hit_rate", "latency_ms_mean",
]


def metric_slices(spark, sf_dir):
    found = E.metric_slices(_records(spark, sf_dir), {d: F.col(d) for d in DIMENSIONS})
    return found.select(
        "slice", "bucket", "n", "judged", "n_correct", "n_partially_correct", "n_incorrect", "n_refusal",
        *[r6(c) for c in RATES], "latency_ms_p50", "latency_ms_p95",
    )


def _rules():
    c = F.col
    text = lambda template, *names: F.format_string(template, *[c(n) for n in names])
    return [
        (1, "grounding_absent", lambda: c("citation_accuracy") < 0.3, text("citation accuracy %.2f", "citation_accuracy")),
        (2, "citations_under_support", lambda: (c("citation_accuracy") >= 0.3) & (c("citation_accuracy") < 0.7), text("citation accuracy %.2f", "citation_accuracy")),
        (1, "invalid_citations", lambda: c("invalid_citation_rate") >= 0.05, text("%.2f of citations do not resolve", "invalid_citation_rate")),
        (3, "fact_found_elsewhere", lambda: c("citation_accuracy") - c("gt_source_hit_rate") >= 0.3, text("source hit rate %.2f", "gt_source_hit_rate")),
        (1, "hallucination", lambda: c("hallucination_rate") >= 0.25, text("hallucination rate %.2f", "hallucination_rate")),
        (2, "refusals", lambda: c("refusal_rate") >= 0.2, text("refusal rate %.2f", "refusal_rate")),
        (2, "hard_lags_easy", lambda: c("easy") - c("hard") >= 2, text("%.1f easy vs %.1f hard", "easy", "hard")),
        (2, "cross_document", lambda: c("one_group") - c("two_groups") >= 1.5, text("%.1f vs %.1f", "one_group", "two_groups")),
        (3, "weak_domains", lambda: c("weak_domains") != "", text("weak: %s", "weak_domains")),
        (3, "partial_answers", lambda: c("correctness") - c("completeness") >= 1.5, text("%.1f vs %.1f", "correctness", "completeness")),
        (3, "latency_tail", lambda: c("latency_ms_p95") > 15000, text("p95 %d ms", "latency_ms_p95")),
        (3, "judges_disagree", lambda: c("disagreement_rate") >= 0.25, text("disagreement %.2f", "disagreement_rate")),
    ]


def suggestions(spark, sf_dir):
    """Improvement suggestions from the overall and sliced metrics."""
    records = _records(spark, sf_dir)
    sliced = E.metric_slices(records, {d: F.col(d) for d in DIMENSIONS})
    pick = lambda s, b, m, name: F.max(F.when((F.col("slice") == s) & (F.col("bucket") == b), F.col(m))).alias(name)
    wide = sliced.agg(
        *[pick("overall", "all", m, m) for m in (*RATES, "latency_ms_p95")],
        pick("difficulty", "easy", "correctness", "easy"), pick("difficulty", "hard", "correctness", "hard"),
        pick("n_groups", "1", "correctness", "one_group"), pick("n_groups", "2", "correctness", "two_groups"),
        F.collect_list(F.when(F.col("slice") == "domain", F.struct("bucket", "correctness"))).alias("domains"),
    )
    disagreement = records.agg(F.avg(F.when(~F.col("failed"), F.col("disagreement").cast("double")))).scalar()
    weak = F.filter("domains", lambda d: d["correctness"] <= F.col("correctness") - 1.5)
    metrics = wide.withColumn("disagreement_rate", disagreement).withColumn(
        "weak_domains", F.array_join(F.transform(F.sort_array(weak), lambda d: d["bucket"]), ", ")
    )
    return E.apply_rules(metrics, _rules()).select("priority", "ordinal", "rule", "message")


def worst_answers(spark, sf_dir):
    """Five lowest answers by correctness, completeness, id."""
    judged = _records(spark, sf_dir).filter(~F.col("failed"))
    return judged.select("id", "correctness", "completeness", "verdict").orderBy("correctness", "completeness", "id").limit(5)


def support_counts(spark, sf_dir):
    """Answers by citation support, unscored ones under ``none``."""
    votes = E.support_committee(
        D.table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("id"),
            F.expr("CASE l_returnflag WHEN 'A' THEN 'fully' WHEN 'N' THEN 'partially' ELSE 'not_at_all' END").alias("support"),
        ), ["id"],
    )
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.join(votes, "id", "left").groupBy(F.coalesce("support", F.lit("none")).alias("support")).agg(
        F.count(F.lit(1)).alias("n")
    )


def answer_join(spark, sf_dir):
    """Questions with their last answer and questions nobody answered."""
    questions = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    answers = D.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"), F.count(F.lit(1)).alias("n_answers")
    )
    return questions.join(answers, "id", "left").select(
        "id", F.col("last.o_orderkey").alias("answer_id"), F.coalesce("n_answers", F.lit(0)).alias("n_answers"),
        F.col("last").isNull().alias("missing"),
    )


# -- budgets -----------------------------------------------------------------------

def _ranked_chunks(spark, sf_dir):
    return retrieval.texts_of(spark, sf_dir, retrieval.sparse_stage(spark, sf_dir))


def context_budget(spark, sf_dir):
    """Top chunks of every question until 600 tokens of context are used."""
    header = F.concat(F.lit("["), "file", F.lit(" | "), F.coalesce(F.col("page").cast("string"), F.lit("-")), F.lit(" | "), "category", F.lit("]\n"))
    ranked = _ranked_chunks(spark, sf_dir).withColumn("block", F.concat(header, "text"))
    kept = E.context_budget(ranked, "qid", "rank", T.approx_tokens(F.col("block")), 600)
    return kept.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.max("used_tokens").alias("used_tokens"),
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), "\n\n")).alias("context_md5"),
    )


def page_budget(spark, sf_dir):
    shown = E.page_budget(_ranked_chunks(spark, sf_dir), "qid", "rank", 300, 2000)
    return shown.select("qid", "rank", F.col("shown_chars").cast("long").alias("shown_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        citation_parse, citation_long_page, citation_validate, answer_flags, judgment_normalize, citation_judgment_normalize,
        json_repair, sub_question_validation, verify_reply, calc_expr, file_match_cascade, citation_resolve,
        citation_reasons, citation_score, gt_hit, committee_vote, label_vote, support_vote, metric_slices,
        suggestions, worst_answers, support_counts, answer_join, context_budget, page_budget,
    )
}

_H = R.SOURCES_HEADER
_ANSWERS = f"""
answers AS (
  SELECT conv_id || '#' || turn AS id, conv_id, turn,
    CASE WHEN conv_id % 9 = 4 THEN text ELSE text || chr(10) || '{_H}' || chr(10) || '- file: src' || (conv_id % 20)
      || '/files/' || conv_id || '.pdf | page: ' || (conv_id * 7 + turn) || chr(10)
      || CASE WHEN (conv_id + turn) % 2 = 1 THEN chr(8207) || '– file： src0/pages/' ELSE '• file: src1/pages/' END
      || turn || '.txt ｜ page: ' || CASE WHEN (conv_id + turn) % 2 = 1 THEN '-' ELSE 'null' END
      || CASE WHEN (conv_id + turn) % 2 = 1 THEN ' | quote: "' || regexp_replace(text, '["\\n]', ' ', 'g') || '"' ELSE '' END
      || chr(10) || 'not a citation line | page: 3' END AS text
  FROM conversations WHERE role = 'assistant'),
blocks AS (
  SELECT *, translate(regexp_replace(text, '\\p{{Cf}}', '', 'g'), '{R.CITATION_LOOKALIKES}', '{R.CITATION_PLAIN}') AS t FROM answers),
parsed AS (
  SELECT id, conv_id, generate_subscripts(f, 1) - 1 AS pos, unnest(f) AS file, unnest(p) AS p, unnest(q) AS q FROM (
    SELECT id, conv_id, regexp_extract_all(b, {S.lit(R.CITATION_LINE)}, 1) AS f,
           regexp_extract_all(b, {S.lit(R.CITATION_LINE)}, 2) AS p, regexp_extract_all(b, {S.lit(R.CITATION_LINE)}, 3) AS q
    FROM (SELECT *, CASE WHEN contains(t, '{_H}') THEN string_split(t, '{_H}')[-1] ELSE '' END AS b FROM blocks))),
cites AS (
  SELECT id, conv_id, pos, trim(file) AS file, CASE WHEN regexp_full_match(p, '[0-9]+') THEN coalesce(try_cast(p AS BIGINT), 9223372036854775807) END AS page, nullif(q, '') AS quote FROM parsed)"""

_NORM = lambda x: f"regexp_replace(replace(lower({S.strip(f'nfc_normalize({x})')}), '\\', '/'), '^[./]+', '')"

_CORPUS = f"""
corpus AS (
  SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/$', '') AS file,
         CASE WHEN page_id % 4 = 0 THEN 'txt' ELSE 'pdf' END AS kind FROM pages),
cfiles AS (SELECT file, max(kind) AS kind, {_NORM('file')} AS norm FROM corpus GROUP BY file),
spelled AS (
  SELECT *, CASE page_id % 5 WHEN 0 THEN file WHEN 1 THEN './' || upper(file) WHEN 2 THEN '/mnt/corpus/' || file
    WHEN 3 THEN string_split(file, '/')[-1] ELSE 'nowhere/' || page_id END AS cited FROM corpus),
wanted AS (SELECT DISTINCT cited, {_NORM('cited')} AS norm FROM spelled),
hits AS (
  SELECT w.cited, count(*) AS n, min(c.file) AS file FROM wanted w JOIN cfiles c
    ON w.norm <> '' AND c.norm <> '' AND (ends_with(w.norm, '/' || c.norm) OR ends_with(c.norm, '/' || w.norm)) GROUP BY 1),
normal AS (SELECT norm, max(file) AS file FROM cfiles WHERE norm <> '' GROUP BY 1),
matched AS (
  SELECT w.cited, coalesce(c.file, m.file, CASE WHEN h.n = 1 THEN h.file END) AS file,
         CASE WHEN coalesce(c.file, m.file) IS NULL AND coalesce(h.n, 0) <> 1
              THEN CASE WHEN h.n > 1 THEN 'ambiguous_file' ELSE 'unknown_file' END END AS reason
  FROM wanted w LEFT JOIN cfiles c ON c.file = w.cited LEFT JOIN normal m ON m.norm = w.norm
  LEFT JOIN hits h ON h.cited = w.cited)"""

_RESOLVED = f"""
{_CORPUS},
citations AS (
  SELECT page_id AS id, cited, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN 'x' ELSE (page_id % 7)::VARCHAR END AS page
  FROM spelled),
resolved AS (
  SELECT id, cited, page, file, reason, CASE WHEN reason IS NULL THEN CASE WHEN kind = 'txt' THEN file ELSE file || ' p' || page END END AS text
  FROM (
    SELECT c.id, c.cited, c.page, m.file, k.kind,
      CASE WHEN m.file IS NULL THEN m.reason
           WHEN k.kind = 'txt' THEN CASE WHEN c.page IS NOT NULL THEN 'page_on_txt' END
           WHEN c.page IS NULL THEN 'missing_page'
           WHEN try_cast(c.page AS INT) IS NULL OR try_cast(c.page AS INT) NOT BETWEEN 1 AND 5 THEN 'page_out_of_range'
           WHEN try_cast(c.page AS INT) = 5 THEN 'empty_page' END AS reason
    FROM citations c JOIN matched m USING (cited) LEFT JOIN cfiles k ON k.file = m.file))"""

_BALLOTS = """
ballots AS (
  SELECT *, failed_ AS failed, h AND verdict <> 'refusal' AS hallucination FROM (
    SELECT l_orderkey AS id, l_tax = 0 AS failed_, l_discount >= 0.05 AS h,
      CASE WHEN l_returnflag = 'A' THEN 'correct' WHEN l_returnflag = 'N' THEN 'partially_correct'
           WHEN l_linestatus = 'F' THEN 'incorrect' ELSE 'refusal' END AS verdict,
      least(10, greatest(0, round_even(l_quantity / 5, 0)))::DOUBLE AS correctness,
      least(10, greatest(0, round_even(l_discount * 100, 0)))::DOUBLE AS completeness,
      least(10, greatest(0, round_even(l_tax * 100, 0)))::DOUBLE AS conversational_quality
    FROM lineitem)),
votes AS (
  SELECT id, verdict, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC,
    list_position(['correct', 'partially_correct', 'incorrect', 'refusal'], verdict) DESC) AS r
  FROM ballots WHERE NOT failed GROUP BY 1, 2),
committee AS (
  SELECT b.id, count(*) FILTER (NOT failed) AS judges_valid, count(*) FILTER (failed) AS judges_failed,
    median(correctness) FILTER (NOT failed) AS correctness, median(completeness) FILTER (NOT failed) AS completeness,
    median(conversational_quality) FILTER (NOT failed) AS conversational_quality,
    any_value(v.verdict) AS verdict,
    CASE WHEN count(*) FILTER (NOT failed) > 0 THEN count(*) FILTER (NOT failed AND hallucination) * 2 >= count(*) FILTER (NOT failed) END AS hallucination,
    CASE WHEN count(*) FILTER (NOT failed) > 0 THEN
      count(DISTINCT b.verdict) FILTER (NOT failed) > 1
      OR max(correctness) FILTER (NOT failed) - min(correctness) FILTER (NOT failed) >= 3
      OR max(completeness) FILTER (NOT failed) - min(completeness) FILTER (NOT failed) >= 3
      OR max(conversational_quality) FILTER (NOT failed) - min(conversational_quality) FILTER (NOT failed) >= 3 END AS disagreement,
    count(*) FILTER (NOT failed) = 0 AS failed
  FROM ballots b LEFT JOIN (SELECT * FROM votes WHERE r = 1) v ON v.id = b.id GROUP BY b.id)"""

_RECORDS = f"""
{_BALLOTS},
linecounts AS (
  SELECT l_orderkey AS id, count(*) FILTER (l_linenumber > 1) AS cited_count,
    count(*) FILTER (l_linenumber > 1 AND l_linenumber % 3 = 0) AS invalid_count,
    count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) AS hit_rate FROM lineitem GROUP BY 1),
records AS (
  SELECT *, CASE WHEN answerable THEN coalesce(credit * (cited_count - invalid_count) / nullif(cited_count, 0), 0.0::DOUBLE) END AS accuracy
  FROM (
    SELECT o_orderkey AS id, o_orderpriority AS domain, o_orderstatus AS kind,
      CASE o_custkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
      o_custkey % 2 + 1 AS n_groups, o_custkey % 10 <> 0 AS answerable, floor(o_totalprice)::BIGINT AS latency_ms,
      CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS credit FROM orders)
  JOIN committee USING (id) JOIN linecounts USING (id)),
metrics AS (
  SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(domain) = 0 THEN 'domain'
              WHEN grouping(n_groups) = 0 THEN 'n_groups' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'overall' END AS slice,
    CASE WHEN grouping(difficulty) = 0 THEN difficulty WHEN grouping(domain) = 0 THEN domain
         WHEN grouping(n_groups) = 0 THEN n_groups::VARCHAR WHEN grouping(kind) = 0 THEN kind ELSE 'all' END AS bucket,
    count(*) AS n, count(*) FILTER (NOT failed) AS judged,
    count(*) FILTER (NOT failed AND verdict = 'correct') AS n_correct,
    count(*) FILTER (NOT failed AND verdict = 'partially_correct') AS n_partially_correct,
    count(*) FILTER (NOT failed AND verdict = 'incorrect') AS n_incorrect,
    count(*) FILTER (NOT failed AND verdict = 'refusal') AS n_refusal,
    avg(correctness) FILTER (NOT failed) AS correctness, avg(completeness) FILTER (NOT failed) AS completeness,
    avg(conversational_quality) FILTER (NOT failed) AS conversational_quality,
    avg(hallucination::INT) FILTER (NOT failed) AS hallucination_rate,
    avg((verdict = 'refusal')::INT) FILTER (NOT failed) AS refusal_rate,
    avg(accuracy) AS citation_accuracy, avg((accuracy = 1)::INT) FILTER (accuracy IS NOT NULL) AS full_citation_credit_rate,
    avg((cited_count = 0)::INT) FILTER (accuracy IS NOT NULL) AS uncited_rate,
    avg((verdict = 'correct')::INT) FILTER (NOT answerable AND NOT failed) AS abstention_rate,
    avg((cited_count > 0)::INT) FILTER (NOT answerable) AS unanswerable_citation_rate,
    (sum(invalid_count) FILTER (accuracy IS NOT NULL))::DOUBLE / nullif(sum(cited_count) FILTER (accuracy IS NOT NULL), 0) AS invalid_citation_rate,
    avg(hit_rate) AS gt_source_hit_rate, avg(latency_ms) AS latency_ms_mean,
    list_sort(list(latency_ms)) AS lat
  FROM records GROUP BY GROUPING SETS ((), (difficulty), (domain), (n_groups), (kind)))"""

_RATES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in RATES)

ORACLES = {
    "citation_parse": f"WITH {_ANSWERS} SELECT id, pos::BIGINT AS pos, file, page, quote FROM cites",
    "citation_long_page": """SELECT conv_id, turn, 'a.pdf' AS file,
  CASE WHEN turn % 20 + 9 < 19 THEN (10::HUGEINT ** (turn % 20 + 9))::BIGINT - 1 ELSE 9223372036854775807 END AS page FROM conversations
UNION ALL SELECT conv_id, turn, 'b.txt', NULL FROM conversations""",
    "citation_validate": f"""WITH {_ANSWERS},
retrieved AS (
  SELECT conv_id, 'src' || (conv_id % 20) || '/files/' || conv_id || '.pdf' AS file, conv_id * 7 + turn - length(text) % 2 AS page
  FROM conversations
  UNION SELECT conv_id, 'src0/pages/' || turn || '.txt', NULL FROM conversations)
SELECT id, file, page FROM cites c WHERE EXISTS (
  SELECT 1 FROM retrieved r WHERE r.conv_id = c.conv_id AND r.file = c.file AND r.page IS NOT DISTINCT FROM c.page)""",
    "answer_flags": f"""WITH {_ANSWERS},
t AS (SELECT id, conv_id, CASE WHEN turn % 3 = 1 THEN text || ' {R.REFUSAL}' ELSE text END AS t FROM answers)
SELECT id, contains(t, '{R.REFUSAL}') AND NOT contains(t, '{_H}') AS is_refusal,
  conv_id % 5 = 0 OR {' OR '.join(f"contains(t, '{m}')" for m in R.NON_ANSWERS)} AS is_non_answer,
  md5(CASE WHEN contains(t, '{_H}') THEN rtrim(array_to_string(string_split(t, '{_H}')[:-2], '{_H}'), ' ' || chr(10)) ELSE t END) AS shown_md5
FROM t""",
    "judgment_normalize": """WITH j AS (
  SELECT l_suppkey, l_returnflag <> 'R' AND l_linenumber <> 5 AS valid, l_returnflag = 'N' AS refusal, l_discount > 0.03 AS h,
    least(10, greatest(0, round_even(l_quantity / 4, 0)))::BIGINT AS c,
    least(10, greatest(0, round_even(l_discount * 100 - 2, 0)))::BIGINT AS p FROM lineitem)
SELECT l_suppkey, count(*) AS n_replies, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid AND h AND NOT refusal) AS n_hallucinated,
  (sum(c) FILTER (valid))::BIGINT AS sum_correctness, (sum(p) FILTER (valid))::BIGINT AS sum_completeness,
  count(*) FILTER (valid AND refusal) AS n_refusals FROM j GROUP BY 1""",
    "citation_judgment_normalize": """WITH p AS (
  SELECT l_suppkey, CASE l_linestatus WHEN 'O' THEN 'fully' ELSE 'partially' END AS support, pos::INT AS pos,
    CASE WHEN l_linenumber % 4 = pos AND l_returnflag = 'A' THEN 'establishes'
         WHEN l_linenumber % 4 = pos AND l_returnflag = 'N' THEN 'partial' ELSE 'unrelated' END AS label
  FROM lineitem, range(3) t(pos))
SELECT l_suppkey, support, pos, label, count(*) AS n FROM p GROUP BY ALL""",
    "json_repair": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'hard' ELSE 'easy' END AS difficulty,
  CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n_subs,
  md5('ask "about" ' || regexp_replace(text, '["\\\\\\x00-\\x1F]', ' ', 'g')) AS question_md5 FROM documents""",
    "sub_question_validation": """WITH c AS (SELECT doc_id, CASE WHEN source = 'src1' THEN ['src1'] ELSE [source, 'src1'] END AS u FROM documents)
SELECT doc_id, 1::BIGINT AS n_subs, array_to_string(u, ',') AS categories, CASE WHEN len(u) > 1 THEN 'multi' ELSE 'single' END AS mode FROM c""",
    "verify_reply": """SELECT doc_id, array_to_string(list_filter(
    CASE WHEN source IN ('src2', 'src5') THEN ['src2', 'src5'] ELSE ['src2', 'src5', source] END,
    lambda c: doc_id % 3 = 0 OR c = 'src2' OR c = source), ',') AS kept FROM documents""",
    "calc_expr": """WITH v AS (
  SELECT l_suppkey, CASE WHEN l_linenumber <> 3 THEN l_quantity * greatest(l_discount, 0.02) + l_linenumber * l_linenumber
    - floor(l_partkey::DOUBLE / (l_linenumber - 3)) END AS v FROM lineitem)
SELECT l_suppkey, count(v) AS n_values, count(*) - count(v) AS n_errors, round(sum(round(v, 4)), 2) AS total FROM v GROUP BY 1""",
    "file_match_cascade": f"WITH {_CORPUS} SELECT cited, file, reason FROM matched",
    "citation_resolve": f"WITH {_RESOLVED} SELECT id, cited, page, file, text, reason FROM resolved",
    "citation_reasons": f"WITH {_RESOLVED} SELECT reason, count(*) AS n FROM resolved WHERE reason IS NOT NULL GROUP BY 1",
    "citation_score": f"""WITH {_RESOLVED},
c AS (SELECT id // 8 AS id, count(*) AS cited_count, count(*) FILTER (reason IS NULL) AS valid_count FROM resolved GROUP BY 1),
r AS (
  SELECT *, id % 11 <> 3 AS answerable,
    CASE id % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'partially' WHEN 3 THEN 'not_at_all' ELSE 'fully' END AS s FROM c),
g AS (SELECT *, answerable AND s IS NOT NULL AND valid_count > 0 AS ruled FROM r),
d AS (SELECT *, CASE WHEN ruled THEN CASE s WHEN 'fully' THEN 1.0::DOUBLE WHEN 'partially' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS credit FROM g)
SELECT id, answerable, cited_count, valid_count, cited_count - valid_count AS invalid_count, CASE WHEN ruled THEN s END AS support,
  credit, CASE WHEN answerable THEN round(coalesce(credit * valid_count / cited_count, 0), 6) END AS accuracy,
  answerable AND s IS NULL AND valid_count > 0 AS judge_failed FROM d""",
    "gt_hit": f"""WITH {_RESOLVED},
c AS (SELECT id // 4 AS id, {_NORM('cited')} AS norm, page FROM citations),
src AS (
  SELECT page_id // 4 AS id, page_id % 2 AS grp, {_NORM('file')} AS norm,
    CASE WHEN (page_id + s) % 7 = 0 THEN NULL ELSE ((page_id + s) % 7)::VARCHAR END AS page
  FROM corpus, (VALUES (0), (3)) t(s)),
h AS (
  SELECT src.id, src.grp, bool_or(EXISTS (SELECT 1 FROM c WHERE c.id = src.id AND c.page IS NOT DISTINCT FROM src.page
    AND c.norm <> '' AND src.norm <> '' AND (c.norm = src.norm OR ends_with(c.norm, '/' || src.norm) OR ends_with(src.norm, '/' || c.norm)))) AS hit
  FROM src GROUP BY 1, 2)
SELECT id, count(*) AS groups_total, count(*) FILTER (hit) AS groups_hit, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS hit_rate
FROM h GROUP BY 1""",
    "committee_vote": f"""WITH {_BALLOTS}
SELECT id, judges_valid, judges_failed, correctness, completeness, conversational_quality, verdict, hallucination, disagreement, failed FROM committee""",
    "label_vote": """WITH t AS (
  SELECT l_suppkey AS id, l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 'establishes' WHEN 'N' THEN 'partial' ELSE 'unrelated' END AS label, count(*) AS n
  FROM lineitem GROUP BY ALL)
SELECT id, pos, label, n_judges FROM (
  SELECT *, sum(n) OVER (PARTITION BY id, pos)::BIGINT AS n_judges, row_number() OVER (PARTITION BY id, pos ORDER BY n DESC,
    list_position(['establishes', 'partial', 'unrelated'], label) DESC) AS r FROM t) WHERE r = 1""",
    "support_vote": """WITH t AS (
  SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'fully' WHEN 'N' THEN 'partially' ELSE 'not_at_all' END AS support, count(*) AS n
  FROM lineitem GROUP BY ALL)
SELECT id, support, n_judges, k > 1 AS disagreement FROM (
  SELECT *, sum(n) OVER (PARTITION BY id)::BIGINT AS n_judges, count(*) OVER (PARTITION BY id) AS k, row_number() OVER (PARTITION BY id ORDER BY n DESC,
    list_position(['fully', 'partially', 'not_at_all'], support) DESC) AS r FROM t) WHERE r = 1""",
    "metric_slices": f"""WITH {_RECORDS}
SELECT slice, bucket, n, judged, n_correct, n_partially_correct, n_incorrect, n_refusal, {_RATES_SQL},
  lat[round_even(0.5::DOUBLE * (n - 1), 0)::INT + 1] AS latency_ms_p50, lat[round_even(0.95::DOUBLE * (n - 1), 0)::INT + 1] AS latency_ms_p95 FROM metrics""",
    "suggestions": f"""WITH {_RECORDS},
o AS (SELECT *, lat[round_even(0.95::DOUBLE * (n - 1), 0)::INT + 1] AS p95,
  (SELECT avg(disagreement::INT) FROM records WHERE NOT failed) AS dis,
  (SELECT correctness FROM metrics WHERE slice = 'difficulty' AND bucket = 'easy') AS easy,
  (SELECT correctness FROM metrics WHERE slice = 'difficulty' AND bucket = 'hard') AS hard,
  (SELECT correctness FROM metrics WHERE slice = 'n_groups' AND bucket = '1') AS one,
  (SELECT correctness FROM metrics WHERE slice = 'n_groups' AND bucket = '2') AS two FROM metrics WHERE slice = 'overall'),
w AS (SELECT coalesce(string_agg(m.bucket, ', ' ORDER BY m.bucket), '') AS weak FROM metrics m, o WHERE m.slice = 'domain' AND m.correctness <= o.correctness - 1.5),
rules AS (
  SELECT 1 AS priority, 0 AS ordinal, 'grounding_absent' AS rule, printf('citation accuracy %.2f', citation_accuracy) AS message FROM o WHERE citation_accuracy < 0.3
  UNION ALL SELECT 2, 1, 'citations_under_support', printf('citation accuracy %.2f', citation_accuracy) FROM o WHERE citation_accuracy >= 0.3 AND citation_accuracy < 0.7
  UNION ALL SELECT 1, 2, 'invalid_citations', printf('%.2f of citations do not resolve', invalid_citation_rate) FROM o WHERE invalid_citation_rate >= 0.05
  UNION ALL SELECT 3, 3, 'fact_found_elsewhere', printf('source hit rate %.2f', gt_source_hit_rate) FROM o WHERE citation_accuracy - gt_source_hit_rate >= 0.3
  UNION ALL SELECT 1, 4, 'hallucination', printf('hallucination rate %.2f', hallucination_rate) FROM o WHERE hallucination_rate >= 0.25
  UNION ALL SELECT 2, 5, 'refusals', printf('refusal rate %.2f', refusal_rate) FROM o WHERE refusal_rate >= 0.2
  UNION ALL SELECT 2, 6, 'hard_lags_easy', printf('%.1f easy vs %.1f hard', easy, hard) FROM o WHERE easy - hard >= 2
  UNION ALL SELECT 2, 7, 'cross_document', printf('%.1f vs %.1f', one, two) FROM o WHERE one - two >= 1.5
  UNION ALL SELECT 3, 8, 'weak_domains', 'weak: ' || weak FROM w WHERE weak <> ''
  UNION ALL SELECT 3, 9, 'partial_answers', printf('%.1f vs %.1f', correctness, completeness) FROM o WHERE correctness - completeness >= 1.5
  UNION ALL SELECT 3, 10, 'latency_tail', printf('p95 %d ms', p95) FROM o WHERE p95 > 15000
  UNION ALL SELECT 3, 11, 'judges_disagree', printf('disagreement %.2f', dis) FROM o WHERE dis >= 0.25)
SELECT * FROM rules
UNION ALL SELECT 3, 999, 'none', 'no rule fired; read the lowest-scoring questions' WHERE NOT EXISTS (SELECT 1 FROM rules)""",
    "worst_answers": f"""WITH {_RECORDS}
SELECT id, correctness, completeness, verdict FROM records WHERE NOT failed ORDER BY correctness, completeness, id LIMIT 5""",
    "support_counts": """WITH t AS (
  SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'fully' WHEN 'N' THEN 'partially' ELSE 'not_at_all' END AS support, count(*) AS n
  FROM lineitem GROUP BY ALL),
v AS (SELECT id, support FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC,
    list_position(['fully', 'partially', 'not_at_all'], support) DESC) AS r FROM t) WHERE r = 1)
SELECT coalesce(support, 'none') AS support, count(*) AS n FROM orders LEFT JOIN v ON v.id = o_orderkey GROUP BY 1""",
    "answer_join": """WITH a AS (
  SELECT o_custkey AS id, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_answers,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT c_custkey AS id, o_orderkey AS answer_id, coalesce(n_answers, 0) AS n_answers, o_orderkey IS NULL AS missing
FROM customer LEFT JOIN (SELECT * FROM a WHERE r = 1) a ON a.id = c_custkey""",
    "context_budget": f"""WITH RECURSIVE {S.BM25},
b AS (
  SELECT s.qid, s.rank, '[' || t.file || ' | - | ' || t.category || ']' || chr(10) || t.text AS block
  FROM sparse s JOIN tchunks t USING (chunk_id)),
u AS (SELECT *, sum(greatest(1, length(block) // 4)) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS used FROM b)
SELECT qid, count(*) AS n_blocks, max(used) AS used_tokens, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS context_md5
FROM u WHERE used <= 600 OR rank = 1 GROUP BY 1""",
    "page_budget": f"""WITH RECURSIVE {S.BM25},
b AS (SELECT s.qid, s.rank, least(length(t.text), 300) AS m FROM sparse s JOIN tchunks t USING (chunk_id)),
u AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM b)
SELECT qid, rank::INT AS rank, least(m, greatest(2000 - spent, 0))::BIGINT AS shown_chars FROM u""",
}
