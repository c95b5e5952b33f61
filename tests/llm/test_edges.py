"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citelode.llm import exact_dedup, main_text, mixing, near_dup, pack, repetition, substrings, toxicity, url_filter, warc
from citelode.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, size string, copies int, h1 int, words int"
CLASH = ("k", 1, "s", 2, 3, 4)
LONG = " ".join(f"word{i}" for i in range(60_000))
ROWS = [
    (1, None, "en", None, None, *CLASH),
    (2, "", None, "a", 0, *CLASH),
    (3, " \t\n", "en", "a", 3, *CLASH),
    (None, "one two three four", "en", "a", 1, *CLASH),
    (4, "One two  three four", "en", "b", 1, *CLASH),
    (4, "One two  three four", "en", "b", 1, *CLASH),
    (5, "One two three\nfour", "en", "b", 1, *CLASH),
    (6, LONG, "en", "b", 1, *CLASH),
    (7, LONG + " more", "en", None, 1, *CLASH),
    (8, "solo", "en", "c", 1, *CLASH),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, nothing):
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.duplicate_groups(docs).collect())
    assert got == Counter([
        (1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (None, None, 1, True), (4, 4, 3, True), (4, 4, 3, True),
        (5, 4, 3, False), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True),
    ])
    assert exact_dedup.duplicate_groups(nothing).count() == 0


def test_exact_keeps_one_row(docs, nothing):
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "6", "7", "8", "None"]
    assert exact_dedup.drop_duplicates(nothing).count() == 0


def test_near_groups(docs, nothing):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.link(docs, width=3, percent=85).collect()}
    assert got == {
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, 4, False), (4, 2, 4, True), (5, 2, 4, False),
        (6, 59_998, 6, True), (7, 59_999, 6, False), (8, 1, 8, True),
    }
    assert near_dup.link(nothing).count() == 0


def test_near_keeps_one_row(docs):
    kept = near_dup.drop_near_duplicates(docs, width=3, percent=85)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8"]


def test_substrings(docs, nothing):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], len(r["kept_text"].split())) for r in substrings.remove_repeats(docs).collect())
    assert got[(6, 60_000, 60_000, 0)] == 1 and got[(7, 60_001, 60_000, 1)] == 1
    assert got[(1, 0, 0, 0)] == 1 and got[(4, 4, 0, 4)] == 2 and sum(got.values()) == len(ROWS)
    assert substrings.remove_repeats(nothing).count() == 0


def test_mixing(docs, nothing):
    got = mixing.sample(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["copies"] <= 2 for r in got)
    assert {r["source"]: r["source_size"] for r in got} == {"a": 4, "b": 60_012, "c": 1, None: 60_001}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want
    assert mixing.sample(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_packing(docs, nothing):
    pieces = pack.pack(docs, tokenizer_path()).collect()
    assert {r["doc_id"] for r in pieces} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert [r["length"] for r in pieces if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert pack.pack(nothing, tokenizer_path()).count() == 0


def test_repetition(docs, nothing):
    got = {(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in repetition.judge(docs).collect()}
    assert (1, 0, True, False) in got and (6, 60_000, False, True) in got and (8, 1, True, False) in got
    assert repetition.filter_repetitive(docs).columns == docs.columns
    assert repetition.judge(nothing).count() == 0


def test_toxicity_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels) is None and toxicity.train(nothing, labels) is None
    assert toxicity.drop_toxic(docs, labels).count() == len(ROWS)
    nulls = spark.createDataFrame([(None, 1, 1), (4, 1, None), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, nulls) is None


PAGES = "page_id long, url string, html string, host string, rule string, record string, path string"
PAGE_ROWS = [
    (1, None, None, "h", "r", "x", "p"),
    (2, "no scheme", "", "h", "r", "x", "p"),
    (3, "http://A.com", "<p>" + "same words in it. " * 10, "h", "r", "x", "p"),
    (4, "http://a.com/en/?q", "<p>" + "same words in it. " * 10, "h", "r", "x", "p"),
    (4, "http://a.com/en/?q", "<p>" + "same words in it. " * 10, "h", "r", "x", "p"),
    (None, "http://b.net/x y\r\n", "<p>" + "same words in it. " * 10, "h", "r", "x", "p"),
    (5, "http://b.net/é", "\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 300_000, "h", "r", "x", "p"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGE_ROWS, PAGES).repartition(2)


def test_archives(spark, pages):
    got = Counter(map(tuple, warc.capture_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    want = Counter()
    for page, _, html, *_ in PAGE_ROWS:
        data = (html or "").encode()
        again = len(data) >= 100 and page in (4, None)
        want[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)] += 1
    assert got == want
    assert warc.capture_index(spark.createDataFrame([], PAGES)).count() == 0


def test_urls(spark, pages):
    rules = url_filter.rule_table(spark, [("block", "com", "/"), ("allow", "com", "/en/"), ("block", "b.net", "/"), ("block", "b.net", "/"), ("allow", None, "/")])
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.com", "", None, "allow"), (4, "a.com", "/en/", "com/en/", "allow"),
        (None, "b.net", "/x y\r\n", "b.net/", "block"), (5, "b.net", "/é", "b.net/", "block"),
    }
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r["verdict"] for r in url_filter.judge(pages, none).collect()} == {"allow"}
    assert url_filter.judge(spark.createDataFrame([], PAGES), rules).count() == 0


def test_main_text(spark, pages):
    got = {r["page_id"]: r["text"] for r in pages.select("page_id", main_text.main_text(pages).alias("text")).collect() if r["page_id"] in (1, 2, 3)}
    assert got == {1: "", 2: "", 3: ("same words in it. " * 10).strip()}
    empty = spark.createDataFrame([], PAGES)
    assert empty.select(main_text.main_text(empty)).count() == 0


def test_word_class_is_the_contracts():
    odd = "a b\x1cc\x85d e\x0bf"
    assert [w.decode() for w in odd.encode().split()] == re.findall(r"[^\x20\x09-\x0D]+", odd)


def test_lower_case_is_ascii_only():
    assert near_dup.words_of("ÀB É") == ["Àb".encode(), "É".encode()]


def test_digest_columns(docs):
    row = exact_dedup.duplicate_groups(docs).filter("doc_id = 5").select("text_sha256").first()
    assert row[0] == hashlib.sha256(b"Onetwothreefour").hexdigest()
    assert docs.filter(F.col("doc_id").isNull()).count() == 1
