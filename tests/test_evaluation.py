from pyspark.sql import functions as F

from citelode.operators import audit as A
from citelode.operators import evaluation as E
from citelode.operators import experiments as X


def test_file_cascade(spark):
    corpus = spark.createDataFrame([(p,) for p in ("car/files/z.pdf", "life/files/z.pdf", "car/pages/y.txt", "a/b")], ["file"])
    cited = spark.createDataFrame([(p,) for p in ("car/files/z.pdf", "./CAR/files/Z.pdf", "z.pdf", "y.txt", "/mnt/car/pages/y.txt", "nope", "")], ["cited"])
    got = {r["cited"]: (r["file"], r["reason"]) for r in E.match_files(cited, corpus).collect()}
    assert got == {
        "car/files/z.pdf": ("car/files/z.pdf", None), "./CAR/files/Z.pdf": ("car/files/z.pdf", None),
        "z.pdf": (None, "ambiguous_file"), "y.txt": ("car/pages/y.txt", None),
        "/mnt/car/pages/y.txt": ("car/pages/y.txt", None), "nope": (None, "unknown_file"), "": (None, "unknown_file"),
    }


def test_citation_score(spark):
    answers = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "id int, answerable boolean")
    resolved = spark.createDataFrame([(1, None), (1, "empty_page"), (3, None), (4, None)], "id int, reason string")
    rulings = spark.createDataFrame([(1, "fully"), (3, "fully"), (4, None)], "id int, support string")
    got = {r["id"]: (r["accuracy"], r["judge_failed"]) for r in E.score_citations(answers, resolved, rulings).collect()}
    assert got == {1: (0.5, False), 2: (0.0, False), 3: (None, False), 4: (0.0, True)}


def test_source_hits_any_member_and_null_page(spark):
    cited = spark.createDataFrame([(1, "z.pdf", "3"), (1, "t.txt", None)], "id int, file string, page string")
    sources = spark.createDataFrame(
        [(1, 0, "car/files/q.pdf", "3"), (1, 0, "car/files/z.pdf", "3"), (1, 1, "car/files/z.pdf", "4"), (1, 2, "car/t.txt", None), (1, 3, "car/t.txt", "1")],
        "id int, group int, file string, page string",
    )
    r = E.source_hits(cited, sources).first()
    assert (r["groups_total"], r["groups_hit"], r["hit_rate"]) == (4, 2, 0.5)


def ballot(id_, verdict, scores, hallucination=False, failed=False):
    return (id_, failed, verdict, hallucination, *map(float, scores))


BALLOTS = "id int, failed boolean, verdict string, hallucination boolean, correctness double, completeness double, conversational_quality double"


def test_committee_ties_go_to_the_worse(spark):
    rows = [
        ballot(1, "correct", (8, 8, 8)), ballot(1, "incorrect", (5, 8, 8), True),
        ballot(2, "correct", (9, 9, 9)), ballot(2, "correct", (8, 9, 9)), ballot(2, "refusal", (1, 1, 1), failed=True),
        ballot(3, None, (0, 0, 0), failed=True),
    ]
    got = {r["id"]: r for r in E.committee(spark.createDataFrame(rows, BALLOTS), ["id"]).collect()}
    assert got[1]["verdict"] == "incorrect" and got[1]["hallucination"] and got[1]["disagreement"] and got[1]["correctness"] == 6.5
    assert got[2]["verdict"] == "correct" and not got[2]["disagreement"] and got[2]["judges_failed"] == 1
    assert got[3]["failed"] and got[3]["verdict"] is None


def test_context_keeps_the_first_block(spark):
    frame = spark.createDataFrame([(1, 1, 900), (1, 2, 10), (2, 1, 5), (2, 2, 5), (2, 3, 5), (2, 4, 1)], "q int, r int, t int")
    kept = {(x["q"], x["r"]) for x in E.context_budget(frame, "q", "r", F.col("t"), 12).collect()}
    assert kept == {(1, 1), (2, 1), (2, 2)}


def test_mcnemar():
    assert X.mcnemar_exact(0, 0) == 1.0
    assert X.mcnemar_exact(5, 0) == 0.0625
    assert X.mcnemar_exact(6, 0) == 0.03125
    assert X.mcnemar_exact(8, 2) == 0.109375
    assert X.mcnemar_exact(4, 4) == 1.0
    assert 0.04 < X.mcnemar_exact(500_000, 501_999) < 0.05


def test_verdicts_and_filters(spark):
    frame = spark.createDataFrame([(["car"],), (["life"],), ([],), (["car", "life"],)], "c array<string>")
    rows = frame.select(X.verdict(F.col("c"), F.lit("car")).alias("v"), X.filter_for("predicted-family", F.col("c"), F.lit("car")).alias("f")).collect()
    assert [r["v"] for r in rows] == ["useful", "harmful", "none", "none"]
    assert rows[1]["f"] == sorted(X.FAMILIES["personal-risk"]) and rows[2]["f"] is None and rows[0]["f"] == ["car"]


def test_vote_counts_each_sample_once(spark):
    frame = spark.createDataFrame([([["a", "a"], ["b"], ["b", "c"]],)], "s array<array<string>>")
    assert frame.select(X.vote(F.col("s"), 2).alias("v")).first()["v"] == ["b"]


def test_hint_orders_by_count_then_first_seen(spark):
    rows = [(1, i + 1, c) for i, c in enumerate(["b", "a", "a", "b", "c"])] + [(1, 11, "z")]
    hint = X.category_hint(spark.createDataFrame(rows, "qid int, rank int, category string")).first()
    assert [(h["category"], h["n"]) for h in hint["histogram"]] == [("b", 2), ("a", 2), ("c", 1)]
    assert (hint["top_category"], hint["top_share"], hint["n_hits"]) == ("b", 0.4, 5)


def test_audit_takes_the_best_member(spark):
    gold = spark.createDataFrame([(1, 0, "x"), (1, 0, "y"), (1, 1, "z"), (1, 2, "lost"), (1, 3, "low")], "qid int, group int, key string")
    candidates = spark.createDataFrame(
        [(1, "y#c0", "y", 1, 0.2), (1, "x#c0", "x", 2, 0.9), (1, "low#c0", "low", 3, 0.1)],
        "qid int, chunk_id string, key string, rank int, rerank_score double",
    )
    indexed = spark.createDataFrame([("x",), ("y",), ("z",), ("low",)], ["key"])
    got = {r["group"]: (r["stage"], r["fused_rank"], r["rerank_rank"], r["rerank_score"]) for r in A.audit_groups(gold, candidates, indexed).collect()}
    assert got == {
        0: ("gated", 1, 1, 0.9), 1: ("not_retrieved", None, None, None), 2: ("missing_from_index", None, None, None), 3: ("not_gated", 3, 3, 0.1),
    }


def test_page_key_ignores_folder_and_extension(spark):
    frame = spark.createDataFrame([("dental/files/x.pdf",), ("dental/markdown-files/X.md",)], ["f"])
    keys = frame.select(A.page_key(F.col("f"), F.lit(2)).alias("k")).distinct()
    assert keys.count() == 1


def test_rules_fall_back(spark):
    metrics = spark.createDataFrame([(0.9,)], ["a"])
    rules = [(1, "low", lambda: F.col("a") < 0.5, F.lit("x")), (2, "high", lambda: F.col("a") > 0.8, F.lit("y"))]
    assert [r["rule"] for r in E.apply_rules(metrics, rules).collect()] == ["high"]
    assert [r["rule"] for r in E.apply_rules(metrics, rules[:1]).collect()] == ["none"]


