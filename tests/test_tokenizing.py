"""Segments of long texts, refused segments, united analyses, the audit matrix, and reply readers."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citelode.functions import replies as R
from citelode.functions import text as T
from citelode.operators import audit_matrix as M
from citelode.operators import tokenizing as K


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(1, 30))
def test_segments_cover_the_text(text, most):
    spans = list(K.segment_spans(text, most))
    assert "".join(text[a:a + n] for a, n in spans) == text
    assert all(n <= most for _, n in spans) and (text == "" or all(n > 0 for _, n in spans))
    for (start, length), following in zip(spans, spans[1:]):
        window = text[start:start + most]
        if "\n" in window:  # as many whole lines as fit
            assert length == window.rindex("\n") + 1
        elif " " in window[1:]:
            assert length == window.rindex(" ")
        else:
            assert length == most


def test_segment_rows_of_nulls_and_long_texts(spark):
    rng = random.Random(1)
    texts = [None, "", "short", "x" * 25, " ".join("word" for _ in range(40)), "".join(rng.choice("ab \n") for _ in range(3_000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = K.segment_rows(frame, ["id"], most=10).orderBy("id", "segment").collect()
    joined = {}
    for row in rows:
        joined[row["id"]] = joined.get(row["id"], "") + row["piece"]
    assert joined == {i: t for i, t in enumerate(texts) if t is not None}
    spans = {r["id"]: r["s"] for r in frame.select("id", K.segments(F.col("text"), 10).alias("s")).collect()}
    assert spans[0] is None and [(s["start"], s["length"]) for s in spans[3]] == [(0, 10), (10, 10), (20, 5)]


def test_only_the_bad_piece_falls_back():
    seen = []

    def model(pieces):
        seen.append(len(pieces))
        if "bad" in pieces:
            raise ValueError("refused")
        return [[piece.upper()] for piece in pieces]

    pieces = [f"p{i}" for i in range(16)]
    pieces[5] = "bad"
    found = K.tokenized(model, lambda piece: [piece], pieces)
    assert found == [(["bad"], True) if piece == "bad" else ([piece.upper()], False) for piece in pieces]
    assert len(seen) == 1 + 2 * 4  # two calls for each halving
    assert K.tokenized(lambda pieces: [], lambda piece: ["plain"], ["a"]) == [(["plain"], True)]
    assert list(K.calls([5, 5, 20, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)]


def test_tokenize_joins_segments_and_counts_fallbacks(spark):
    def model(pieces):
        if any("@" in piece for piece in pieces):
            raise ValueError("address")
        return [piece.split() for piece in pieces]

    rows = [(1, "a b c d e f"), (2, "x @ y\n" + "z " * 20), (3, None), (4, "")]
    frame = spark.createDataFrame(rows, "id int, text string")
    found = {r["id"]: r for r in K.tokenize(frame, ["id"], model, lambda piece: ["?"], most=8, budget=16).collect()}
    assert found[1]["tokens"] == list("abcdef") and found[1]["fallbacks"] == 0
    assert found[2]["tokens"] == ["?"] + ["z"] * 20 and found[2]["fallbacks"] == 1
    assert found[3]["tokens"] is None and found[3]["segments"] == 0 and found[4]["tokens"] == []


def test_union_of_lemmas_and_surfaces(spark):
    word = lambda text, lemma: {"text": text, "lemma": lemma}
    analyses = [
        {"surface": "Houses,", "words": [word("Houses", "house")]},
        {"surface": "l'eau", "words": [word("l", "le"), word("eau", None)]},
        {"surface": "same", "words": [word("same", "same")]},
        {"surface": "same", "words": [word("same", "")]},
        {"surface": "a-b", "words": [word("a-b", "A b")]},
        {"surface": "...", "words": []},
    ]
    frame = spark.createDataFrame([(1, analyses), (2, []), (3, None)], f"id int, analyses {K.ANALYSES}")
    tokens = lambda **more: {r["id"]: r["tokens"] for r in K.with_united_tokens(frame, "analyses", **more).collect()}
    assert tokens()[1] == ["house", "houses", "le", "l", "eau", "l'eau", "same", "same", "a", "b"]
    assert tokens(surfaces=False)[1] == ["house", "le", "eau", "same", "same", "a", "b"]
    assert tokens()[2] == [] and tokens()[3] is None
    texts = ["Café été “quoted” x-y", "שָׁלוֹם", "á b", ""]
    same = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t")).alias("a"), T.composed_tokens(T.nfc(F.col("t"))).alias("b"))
    assert all(r["a"] == r["b"] for r in same.collect())


def test_variants_share_filters_and_skipped_arms_have_a_reason(spark, tmp_path):
    questions = spark.createDataFrame([(1, "a", ["a"]), (2, "b", []), (3, "b", ["c", "a"])], "qid int, gold string, predicted array<string>")
    rows = M.variants(questions, {"f": ("a", "z")})
    got = {(r["qid"], r["mode"]): r["categories"] for r in rows.collect()}
    assert got[1, "none"] is None and got[1, "gold"] == ["a"] and got[1, "gold-family"] == ["a", "z"] and got[2, "predicted-set"] is None
    assert got[3, "predicted"] is None and got[3, "predicted-set"] == ["a", "c"] and got[3, "predicted-family"] == ["a", "c", "z"]
    assert M.searches(rows).filter("qid = 1").count() == 3  # none, a, and a with its family
    gold = spark.createDataFrame([(1, 0, "k1"), (2, 0, "k2"), (3, 0, "k3")], "qid int, group int, key string")
    sets = questions.select("qid", F.lit("v1").alias("set"))
    asked = rows.filter("qid = 1 AND mode = 'gold'").first()["variant"]
    candidates = spark.createDataFrame([("one", asked, "c1", "k1", 1, 0.9)], "arm string, variant string, chunk_id string, key string, rank int, rerank_score double")
    indexed = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert M.unavailable(spark, str(tmp_path)) == "no manifest"
    table = M.matrix(rows, sets, candidates, gold, indexed, [M.Arm("one"), M.Arm("two", unavailable="no manifest")]).collect()
    cells = {(r["arm"], r["mode"]): r for r in table}
    assert len(cells) == len(table) == 12
    assert (cells["one", "gold"]["gated"], cells["one", "gold"]["not_retrieved"], cells["one", "gold"]["missing_from_index"]) == (1, 1, 1)
    assert cells["one", "predicted"]["gated"] == 1 and cells["one", "none"]["gated"] == 0
    assert cells["two", "gold"]["reason"] == "no manifest" and cells["two", "gold"]["n_groups"] is None


def test_replies(spark):
    def read(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]

    base = {"verdict": "correct", "correctness": 1, "completeness": 1, "conversational_quality": 1}
    for value, expected in ((True, True), (False, False), (None, False), (0, False), (0.0, False), (2, True), ("", False), ("false", True), ([], False), ([0], True), ({}, False), ({"a": 0}, True)):
        found = read(R.judgment, json.dumps({**base, "hallucination": value, "claims": {"n": [1]}}))
        assert found["hallucination"] is expected, value
        assert json.loads(found["claims"]) == {"n": [1]}
    assert read(R.judgment, json.dumps({**base, "claims": [1]}))["claims"] is None
    assert read(R.generated, '{"skip": "thin"}').asDict() == {"skip": "thin", "question": None, "ground_truth_answer": None, "rationale": None}
    assert read(R.generated, '{"skip": null}')["skip"] == "None" and len(read(R.generated, json.dumps({"skip": "x" * 300}))["skip"]) == 200
    good = {"question": " What is the excess of it? ", "ground_truth_answer": "It is ten euros."}
    assert read(R.generated, f"sure ```json\n{json.dumps(good)}\n```")["question"] == "What is the excess of it?"
    assert read(R.generated, json.dumps({**good, "ground_truth_answer": "ten"})) is None
    assert read(R.generated, "nothing") is None
    assert read(R.difficulty_ruling, '{"difficulty": " HARD "}').asDict() == {"difficulty": "hard", "reason": ""}
    assert read(R.difficulty_ruling, '{"difficulty": "odd"}') is None
