"""Rules and batches by hand."""

from pyspark.sql import functions as F

from citelode.operators import audit as A
from citelode.operators import checks as K
from citelode.operators import experiments as X
from citelode.operators import keyword


def test_passages_of_any_length(spark):
    texts = spark.createDataFrame([("f", "xx alpha beta gamma delta epsilon zeta yy"), ("g", "nothing here")], "file string, text string")
    passages = ["lpha", "ha be", "beta gamma delta", "pha beta gamma delta epsilon ze", "alpha beta gamma delta epsilon zeta", "gamma gamma", ""]
    asked = spark.createDataFrame(list(enumerate(passages)), "pid int, passage string")
    found = A.passages_in(texts, asked).collect()
    assert sorted((r["file"], r["pid"]) for r in found) == [("f", i) for i in range(5)]
    assert A.passages_in(texts, asked.filter("pid = 6")).count() == 0


def test_chunk_rules(spark):
    rows = [
        ("ok", "car/a.pdf", "car", 1, "x", "pdf"), ("page", "car/a.pdf", "car", 0, "x", "pdf"), ("txt", "car/a.txt", "car", 1, "x", "txt"),
        ("cat", "zoo/a.txt", "zoo", None, " ", "txt"), ("nfc", "car/é.txt", "car", None, "x", "txt"), ("null", "a.txt", None, None, "x", "txt"),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, file string, category string, page int, text string, kind string")
    assert {(r["chunk_id"], r["problem"]) for r in K.chunk_violations(chunks, ["car"]).collect()} == {
        ("page", "pdf_without_page"), ("txt", "txt_with_page"), ("cat", "unknown_category"), ("cat", "blank_text"), ("nfc", "file_not_nfc"),
        ("null", "unknown_category"), ("null", "file_outside_category"),
    }


def test_one_bad_file_fails_alone(spark):
    files = spark.createDataFrame([("a", "1", "fa"), ("b", "x", "fb"), ("c", "x", "fc")], "file string, content string, fingerprint string")
    cached = spark.createDataFrame([("c", "fc")], "file string, fingerprint string")
    parse = lambda c: F.struct(c.try_cast("int").alias("doc"), F.when(c.try_cast("int").isNull(), "bad").alias("error"))
    documents, outcomes = K.parse_outcomes(files, parse, cached)
    assert [(r["file"], r["doc"]) for r in documents.collect()] == [("a", 1)]
    assert {(r["file"], r["status"], r["error"]) for r in outcomes.collect()} == {("a", "ok", None), ("b", "failed", "bad"), ("c", "cached", None)}


def test_category_search_keeps_zero_scores(spark):
    pages = spark.createDataFrame([(1, "a", ["x"]), (2, "a", ["y"]), (3, "a", ["z"]), (4, "b", ["y"])], "page_id int, category string, tokens array<string>")
    queries = spark.createDataFrame([(7, "a", ["y"])], "qid int, category string, tokens array<string>")
    got = [(r["page_id"], r["score"] > 0) for r in keyword.category_search(pages, queries, 2).orderBy("rank").collect()]
    assert got == [(2, True), (1, False)]


def test_several_references(spark):
    rows = [("a", 1, "harmful"), ("b", 1, "useful"), ("c", 1, "none"), ("a", 2, "useful"), ("b", 2, "useful"), ("c", 2, "harmful")]
    predictions = spark.createDataFrame(rows, "arm string, id int, verdict string")
    pairs = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b")], "arm string, reference string")
    got = {(r["arm"], r["reference"], r["id"], r["change"]) for r in X.changed_ids(predictions, pairs).collect()}
    assert got == {
        ("b", "a", 1, "fixed"), ("b", "a", 1, "gained"), ("c", "a", 1, "fixed"), ("c", "a", 2, "broken"), ("c", "a", 2, "lost"),
        ("c", "b", 1, "lost"), ("c", "b", 2, "broken"), ("c", "b", 2, "lost"),
    }
    counts = {(r["arm"], r["reference"]): (r["n_fixed"], r["n_broken"]) for r in X.compared(predictions, pairs).collect()}
    assert counts == {("b", "a"): (1, 0), ("c", "a"): (1, 1), ("c", "b"): (0, 1)}


def test_passages_in_blocks_and_at_text_borders(spark, monkeypatch):
    """Every text that contains a passage, null files and repeated ids too; texts are not read as one."""
    rows = [("f", "éa béta gamma delta"), ("f", "xx éa béta gamma delta yy"), (None, "béta gamma"), ("g", None), ("h", ""), ("i", "delta"), ("j", "xx éa")]
    texts = spark.createDataFrame(rows, "file string, text string").coalesce(1)
    passages = [(1, "éa béta"), (2, "é"), (3, "béta gamma d"), (4, "delta xx"), (5, "a"), (6, "béta gamma"), (6, "béta gammb"), (7, "béta gamma")]
    asked = spark.createDataFrame(passages, "pid long, passage string")
    expected = sorted((str(f), p) for f, text in rows for p, passage in passages if text and passage in text)
    found = lambda: sorted((str(r["file"]), r["pid"]) for r in A.passages_in(texts, asked).collect())
    assert found() == expected
    monkeypatch.setattr(A, "PASSAGE_BLOCK", 3)
    monkeypatch.setattr(A, "PORTION", 10)
    assert found() == expected
