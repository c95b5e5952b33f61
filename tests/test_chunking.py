import random

from pyspark.sql import functions as F

from citelode.operators import chunking as C
from citelode.operators import markdown as M
from citelode.operators import reading_order as O
from citelode.plans import documents


def estimate(words):
    return int(words * 1.3) + 1


def greedy_windows(counts, width, overlap, cap):
    """Plain walk over sentence word counts."""
    out, start = [], 0
    while start < len(counts):
        size = min(width, len(counts) - start)
        while size > 1 and estimate(sum(counts[start : start + size])) > cap:
            size -= 1
        out.append((start, size))
        if start + size >= len(counts):
            break
        start += max(1, size - overlap)
    return out


def test_windows_match_the_walk(spark):
    rng = random.Random(5)
    docs = [[rng.randint(1, 30) for _ in range(rng.randint(1, 60))] for _ in range(60)] + [[3] * 20]
    rows = [(i, " ".join(" ".join(["w"] * (n - 1) + ["e."]) for n in counts)) for i, counts in enumerate(docs)]
    frame = spark.createDataFrame(rows, ["id", "text"])
    for cap in (10**6, 60, 5):
        got = {}
        for r in C.sentence_windows(frame, "text", 7, 2, cap).orderBy("id", "n").collect():
            got.setdefault(r["id"], []).append((r["start"], r["length"]))
        assert got == {i: greedy_windows(c, 7, 2, cap) for i, c in enumerate(docs)}


def test_fixture_starts(spark):
    frame = spark.createDataFrame([("x", " ".join(["s."] * 20))], ["id", "text"])
    rows = C.sentence_windows(frame, "text").orderBy("n").collect()
    assert [(r["start"], r["length"]) for r in rows] == [(0, 7), (5, 7), (10, 7), (15, 5)]


def test_blank_documents_give_nothing(spark):
    frame = spark.createDataFrame([("x", " \n ")], ["id", "text"])
    assert C.sentence_windows(frame, "text").count() == 0


def test_paragraph_packs(spark):
    parts = ["w " * n for n in (3, 3, 50, 2, 3)]
    frame = spark.createDataFrame([([p.strip() for p in parts],)], ["p"])
    packs = frame.select(C.paragraph_packs(F.col("p"), 12).alias("v")).first()["v"]
    assert [(p["tokens"], p["oversized"]) for p in packs] == [(8, False), (66, True), (7, False)]
    assert sum(len(p["text"].split()) for p in packs) == 61


def test_pages_and_tables(spark):
    text = (
        "lost\n{0}------\n# Head\n\n| a | b |  |\n|---|:--:|---|\n| 1 | <b>2</b> | |\n| | | |\ntail [link](u)\n"
        "{1}------\nold\n{1}------\n![Logo](x.png)\nLogo\nnew \\$5"
    )
    pages = M.split_pages(spark.createDataFrame([("f", text)], ["file", "text"]))
    assert {r["page"] for r in pages.collect()} == {1, 2}
    items = [(r["page"], r["kind"], r["text"]) for r in M.page_items(pages, ["file"]).orderBy("seq").collect()]
    assert items == [
        (1, "text", "# Head"), (1, "table", "| a | b |\n|---|---|\n| 1 | 2 |"), (1, "text", "tail link"), (2, "text", "new $5"),
    ]


def test_tables_carry_their_heading(spark):
    rows = [
        ("c/f", "c", 1, 0, "heading", "Limits"), ("c/f", "c", 1, 1, "text", "prose one"), ("c/f", "c", 1, 2, "table", "|t|"),
        ("c/f", "c", 2, 5000, "table", "|u|"),
    ]
    items = spark.createDataFrame(rows, "file string, category string, page int, seq long, kind string, text string")
    chunks = [(r["chunk_id"], r["text"]) for r in C.table_chunks(items).orderBy("chunk_id").collect()]
    assert chunks == [
        ("c/f#p1#c0", "Limits\n\nprose one"), ("c/f#p1#c1", "Limits\n\n|t|"), ("c/f#p2#c2", "Limits\n\n|u|"),
    ]


def test_reordering():
    lines = O.PageLines("אבגדהו\nזחטיכל")
    assert O.reorder("דהו אבג", lines) == "אבג דהו"
    assert O.reorder("אבג דהו", lines) == "אבג דהו"
    assert O.reorder("דהו אבג ששש", lines) == "דהו אבג ששש"
    assert O.reorder("plain latin words", lines) == "plain latin words"


def brute_reorder(words, lines):
    """Largest run first, forwards before backwards, tried against every line."""
    keys = [O.word_key(w) for w in words]
    fits = lambda run: len("".join(run)) >= O.SHORTEST_KEY and any("".join(run) in line for line in lines)
    if fits(keys):
        return words
    out, at, turned = [], 0, False
    while at < len(words):
        for size in range(min(O.LONGEST_RUN, len(words) - at), 1, -1):
            if fits(keys[at : at + size]):
                out += words[at : at + size]
                break
            if fits(keys[at : at + size][::-1]):
                out, turned = out + words[at : at + size][::-1], True
                break
        else:
            return words
        at += size
    return out if turned else words


def test_reordering_equals_trying_all_lines():
    rng = random.Random(1)
    letters = "אבגדה"
    for _ in range(300):
        lines = [[("".join(rng.choice(letters) for _ in range(rng.randint(1, 3)))) for _ in range(6)] for _ in range(3)]
        words = []
        for line in rng.sample(lines, 2):
            part = line[rng.randrange(3) :][: rng.randint(2, 5)]
            words += part[::-1] if rng.random() < 0.6 else part
        page = O.PageLines("\n".join(" ".join(line) for line in lines))
        assert O.reorder(" ".join(words), page).split() == brute_reorder(words, ["".join(line) for line in lines])


def test_repair_prefers_the_box(spark):
    items = spark.createDataFrame(
        [("f", 1, 0, "cell", "דהו אבג", "אבג דהו"), ("f", 1, 1, "text", "כל זחטי", None), ("f", 2, 2, "text", "אב גד", None)],
        "file string, page int, seq int, kind string, text string, box_text string",
    )
    oracle = spark.createDataFrame([("f", 1, "אבג דהו\nזחטי כל")], "file string, page int, oracle string")
    rows = {r["seq"]: (r["strategy"], r["repaired"]) for r in O.repair(items, oracle).collect()}
    assert rows == {0: ("box", "אבג דהו"), 1: ("segment", "זחטי כל"), 2: (None, "אב גד")}


def test_reading_order_query_repairs_once(spark, sf_dir):
    plan = documents.reading_order_repair(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_page_places_by_search_and_by_table(monkeypatch):
    lines = O.PageLines("אבגדאבגד\nבגדא")
    searched = lines.places("אבגד"), lines.places("בגדא"), lines.places("זזזז")
    monkeypatch.setattr(O, "SEARCHES", 0)
    assert searched == (lines.places("אבגד"), lines.places("בגדא"), lines.places("זזזז")) == ([0, 4], [1, 9], [])
