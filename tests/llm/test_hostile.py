"""Inputs made to break a reader: malformed markup, deep nesting, very long hosts."""

import os
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citelode.llm import exact_dedup, main_text, url_filter, warc
from citelode.session import application_folder

PIECES = [
    "<p>", "</p>", '<div class="comment">', "</div>", "<b>", "<a href=x>", "</a>", "<table>", "<tr>", "<td>", "<li>", "<ul>", "</ul>", "text here. ",
    "<![x[", "<![CDATA[", "<![if IE]>", "<![endif]>", "]]>", "<!--", "-->", "<!", "<!doctype", "<!ELEMENT", "<?x", "<script>", "</script>", "<head>", "<nav>",
    "&amp;", "&#x;", "&#99999999;", "<", ">", "<br/>", '"', "<p class=\"", "</", "</ ", "\x00", "é",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_no_markup_raises(pieces):
    assert isinstance(main_text.extract("".join(pieces)), str)


def test_marked_sections_are_dropped():
    assert main_text.extract("<![foo[bar]]><p>text") == "text"
    assert main_text.extract("<![CDATA[x > y]]><p>text") == "text"
    assert main_text.extract("<![if IE]><p>text<![endif]>") == "text"


def test_time_grows_with_the_page():
    n = 16_000
    for page in ("<b>" * n + "<p>word and word.</p>" * n, "<div>" * n + "text", "<!--" * n, "</p>" * n, "<ul>" + "<li>a" * n, "<table>" + "<tr><td>x" * n):
        start = time.time()
        main_text.extract(page)
        assert time.time() - start < 15  # quadratic reading took minutes


def test_hosts_of_many_labels(spark):
    long_host = "a." * 20_000 + "www.Example.com"
    urls = [(1, f"http://{long_host}/en/x"), (2, "http://" + "." * 5_000 + "net/es/"), (3, "http://x." * 1 + "com"), (4, f"http://{long_host}/fr")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = url_filter.rule_table(spark, [*url_filter.RULES, ("block", "a.b.c.d.e.f", "/"), ("block", "", "/es/")])
    start = time.time()
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).select("page_id", "rule", "verdict").collect()}
    assert found == {1: ("www.example.com/en/", "allow"), 2: ("net/es/", "block"), 3: (None, "allow"), 4: ("com/", "allow")}
    assert time.time() - start < 60


def test_keys_are_those_of_the_list(spark):
    row = spark.createDataFrame([("a.b.c", "/x/y")], "host string, path string")
    keys = url_filter.listed_keys(F.col("host"), F.col("path"), F.array(F.lit(1), F.lit(9)), F.array(F.lit(1), F.lit(3), F.lit(7)))
    assert [(k["host"], k["path"]) for k in row.select(keys.alias("k")).first()["k"]] == [("c", "/"), ("a.b.c", "/")]


def test_archives_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "RECORDS", 50)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, f"http://h.org/{i}", "x" * (9_000 + i if i % 20 == 0 else 300) + str(i)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = str(tmp_path / "warc")
    warc.write_archives(pages, folder)
    sizes = [os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder) if name.startswith("part-")]
    assert max(sizes) < 20_000 + 50 * 700 and sum(size > 18_000 for size in sizes) >= 5
    index = warc.sorted_runs(spark, folder).collect()
    assert {(r["page_id"], r["payload_bytes"]) for r in index} == {(i, len(html)) for i, _, html in rows}


def test_archives_lie_in_the_application_folder(spark):
    pages = spark.createDataFrame([(1, "http://h.org/", "x")], "page_id long, url string, html string")
    assert warc.write_archives(pages).startswith(application_folder(spark) + "/")


def test_very_long_copies_are_compared_in_one_pass(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(4_000_000))
    docs = spark.createDataFrame([(1, text), (2, text + " "), (3, text[:-1] + "!")], "doc_id long, text string")
    start = time.time()
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.duplicate_groups(docs).collect()}
    assert found == {1: (2, 2), 2: (2, 2), 3: (3, 1)}
    assert time.time() - start < 90
    pieces = docs.select(exact_dedup.compared_pieces("text").alias("p")).first()["p"]
    assert "".join(pieces) == text and {len(piece) for piece in pieces[:-1]} == {exact_dedup.COMPARED}
