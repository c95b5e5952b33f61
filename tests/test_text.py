import pytest
from pyspark.sql import functions as F

from citelode.functions import replies as R
from citelode.functions import text as T


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values()) or ("x",)], list(values) or ["x"])
    return frame.select(column.alias("v")).first()["v"]


def test_tokens_follow_the_recipe(spark):
    text = "Claim-Form (2,000) חו״ל שָׁלוֹם — ... Café end."
    assert one(spark, T.tokens(F.col("t")), t=text) == [
        "claim", "form", "2,000", 'חו"ל', "שלום", "café", "end",
    ]


def test_sentences_and_paragraphs(spark):
    assert one(spark, T.sentences(F.col("t")), t=" One. Two!  Three?\nfour 3.5 ") == ["One.", "Two!", "Three?", "four 3.5"]
    assert one(spark, T.paragraphs(F.col("t")), t="a\nb\n \n\n c \n\n") == ["a\nb", "c"]


def test_token_estimates(spark):
    assert one(spark, T.token_estimate(F.col("t")), t="a b c d e f g h i j") == 14
    assert one(spark, T.token_estimate(F.col("t")), t="  ") == 1
    assert one(spark, T.approx_tokens(F.col("t")), t="abc") == 1


def test_paths(spark):
    assert one(spark, T.norm_file(F.col("t")), t="../.hidden\\X.PDF ") == "hidden/x.pdf"
    assert one(spark, T.path_suffixes(F.col("t")), t="a/b/c") == ["b/c", "c"]
    assert one(spark, T.path_suffixes(F.col("t")), t="c") == []


def test_direction_and_quantity(spark):
    assert one(spark, T.direction(F.col("t")), t="12 - abc שלום") == "ltr"
    assert one(spark, T.direction(F.col("t")), t="12 - ...") == "rtl"
    assert one(spark, T.has_quantity(F.col("t")), t="only 7 days") is False
    assert one(spark, T.has_quantity(F.col("t")), t="up to 70 days") is True


def test_first_present_keeps_zero(spark):
    assert one(spark, T.first_present(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert one(spark, T.first_present(F.col("a"), F.col("b")), a=0, b=5) == 0


def test_source_list(spark):
    text = (
        f"{R.SOURCES_HEADER}\n- file: old | page: 1\nAnswer.\n{R.SOURCES_HEADER}\n"
        "‏– file： car/pages/a.txt ｜ page: null\n• FILE: car/files/b.pdf | page: 12 | quote: \"so\"\nnoise"
    )
    rows = one(spark, R.source_list(F.col("t")), t=text)
    assert [(r["file"], r["page"], r["quote"]) for r in rows] == [
        ("car/pages/a.txt", None, None), ("car/files/b.pdf", 12, "so"),
    ]
    assert one(spark, R.source_list(F.col("t")), t="no header") == []


def test_judgment(spark):
    good = '```json\n{"verdict": " Correct ", "hallucination": true, "correctness": 11, "completeness": 2.5, "conversational_quality": -1, "reasoning": "r"}\n```'
    j = one(spark, R.judgment(F.col("t")), t=good)
    assert (j["verdict"], j["hallucination"], j["correctness"], j["completeness"], j["conversational_quality"]) == ("correct", True, 10, 2, 0)
    refused = good.replace("Correct", "refusal")
    assert one(spark, R.judgment(F.col("t")), t=refused)["hallucination"] is False
    assert one(spark, R.judgment(F.col("t")), t='{"verdict": "maybe"}') is None


def test_citation_judgment_fills_missing_labels(spark):
    reply = '{"citation_support": "Fully", "per_citation": [{"idx": 2, "label": "PARTIAL"}, {"idx": 9, "label": "partial"}, {"idx": 0, "label": "odd"}]}'
    j = one(spark, R.citation_judgment(F.col("t"), F.lit(3)), t=reply)
    assert j["support"] == "fully" and j["labels"] == ["unrelated", "unrelated", "partial"]


def test_mend_json():
    assert R.mend_json('{"q": "say "hi", ok"}') == '{"q": "say \\"hi\\", ok"}'
    assert R.mend_json('{"a": [1, 2]], "b": 3}') == '{"a": [1, 2], "b": 3}'
    assert R.mend_json('{"a": "x\\"y", "b": [[1]]}') == '{"a": "x\\"y", "b": [[1]]}'


def test_mend_json_in_odd_places():
    assert R.mend_json('{"a": "one "two" three" , "b": true}') == '{"a": "one \\"two\\" three" , "b": true}'
    assert R.mend_json('}{"a": "]"}]') == '{"a": "]"}'
    assert R.mend_json("") == ""
    long = '{"a": "' + 'x "y" ' * 20_000 + '"}'
    assert R.mend_json(long).count('\\"') == 40_000


def test_long_page_numbers_are_pages(spark):
    text = f"x\n{R.SOURCES_HEADER}\n- file: a.pdf | page: 12345678901\n- file: b.pdf | page: {'9' * 30}\n- file: c.txt | page: -"
    pages = [r["page"] for r in one(spark, R.source_list(F.col("t")), t=text)]
    assert pages == [12345678901, R.BEYOND, None]


def test_sub_questions(spark):
    reply = '{"sub_questions": [{"question": " a ", "categories": ["car", "x", "car"]}, {"question": " "}]}'
    subs = one(spark, R.sub_questions(F.col("t"), ["car", "life"]), t=reply)
    assert [(s["question"], s["categories"]) for s in subs] == [("a", ["car"])]


def test_retained_only_takes_away(spark):
    frame = spark.createDataFrame([(["car", "life"], '{"keep": ["life", "travel"]}'), (["car"], "oops")], ["p", "r"])
    kept = [r["v"] for r in frame.select(R.retained(F.col("p"), F.col("r"), ["car", "life", "travel"]).alias("v")).collect()]
    assert kept == [["life"], ["car"]]


def test_evaluate():
    assert R.evaluate("2 ** 3 + max(1, 4) // 3 - -1") == 10
    for text in ("-2 ** 2", "2 ** -1", "2 ** 3 ** 2", "2 ** -3 ** 2", "7 // 2 * 3 % 4", "-(3 - 5) * --2", "round(2.567, 1)", "abs(-1e3)",
                 "min(3, max(1, 2), 9) + .5", "1_000 / 8", "((2))", "+3 - +2", "2 - 3 - 4", "100 / 10 / 5", "5 % -3"):
        assert R.evaluate(text) == float(eval(text)), text
    for bad in ("", "()", "1 +", "2 3", "(1, 2)", "1)", "(1", "max", "max(1)", "round()", "1 if 1 else 2", "((10**100)**100)**100", "1 ** (", "a.b", "1;2", "x = 1", "(-8) ** .5"):
        with pytest.raises((ValueError, SyntaxError, TypeError, ZeroDivisionError, OverflowError)):
            R.evaluate(bad)
    for bad in ("__import__('os')", "9 ** 101", "1 if 2 else 3", "x", "max(a=1)", "1" * 600):
        try:
            R.evaluate(bad)
        except (ValueError, SyntaxError):
            continue
        raise AssertionError(bad)


def test_expressions_of_one_shape_are_parsed_once(monkeypatch):
    parsed, steps = [], R._steps
    monkeypatch.setattr(R, "_steps", lambda items: parsed.append(items) or steps(items))
    asked = [f"{i}.5 * max({i % 7}, 0.02) + abs(-{i}) ** 2 - {i} // ({i % 5 - 2})" for i in range(300)]
    found = list(R.evaluated(asked))
    assert len(parsed) < 10
    for text, (value, error) in zip(asked, found):
        if error is None:
            assert value == R.evaluate(text)
        else:
            assert error == "division by zero" and text.endswith("// (0)")


def test_parsed_shapes_keep_values_and_errors():
    asked = ["1/0 + 012", "2 ** 500", "a.5", "1.5.5", "abs2(1)", "max(1)", "(-8) ** .5", "1 +", "1__0", "٣ + 1", "1e400 - 1e400", "round(2.5, 1.5)", "1_0 + 1.", "9 ** 9 ** 9", "+".join("1" * 240)]
    shown = lambda answers: [(repr(value), error) for value, error in answers]
    for text in asked:
        assert shown(R.evaluated([text] * 3)) == shown(R.evaluated([text])) * 3, text


def test_refusals(spark):
    assert one(spark, R.is_refusal(F.col("t")), t=f"a {R.REFUSAL}") is True
    assert one(spark, R.is_refusal(F.col("t")), t=f"{R.REFUSAL}\n{R.SOURCES_HEADER}") is False
    assert one(spark, R.without_source_list(F.col("t")), t=f"a {R.SOURCES_HEADER} b \n\n{R.SOURCES_HEADER}\nx") == f"a {R.SOURCES_HEADER} b"


def test_order_agreement_reads_the_oracle_once(spark):
    import time

    from citelode.operators import quality

    lines = [" ".join("אבגדהוזח"[(i >> shift) % 8] * 2 for shift in range(0, 18, 3)) for i in range(4000)]
    text, oracle = "\n".join(lines), "\n".join(lines[:1000] + [line[::-1] + "ט" for line in lines[1000:]])
    rows = spark.createDataFrame([(text, oracle), ("a b", oracle), (text, ""), (None, oracle)], "text string, oracle string").coalesce(1)
    began = time.monotonic()
    found = [row[0] for row in rows.select(quality.order_agreement(F.col("text"), F.col("oracle"))).collect()]
    assert found[0] >= 0.25 and found[1:] == [1.0, 1.0, None]
    assert time.monotonic() - began < 8
