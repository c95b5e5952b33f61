"""The stored keyword index, the layout by key, and searching an index by path."""

import math
import random

import pytest
from pyspark.sql import functions as F

from citelode.operators import fusion, keyword, layout, postings
from citelode.operators.layout import Keyed
from citelode.plans import index, retrieval
from citelode.plans import tables as D


def chunks_of(spark, n=150, words=60):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        size = rng.randrange(0, 40)
        tokens = [f"t{min(int(rng.expovariate(0.12)), words)}" for _ in range(size)]
        rows.append((f"c{i:04d}", f"k{i % 3}", tokens))
    rows += [(f"d{i:03d}", "k0", ["t1", "same"]) for i in range(60)]  # equal scores
    return rows, spark.createDataFrame(rows, "chunk_id string, category string, tokens array<string>").repartition(5)


def brute(rows, asked, k):
    n, mean = len(rows), sum(len(t) for _, _, t in rows) / len(rows)
    out = {}
    for qid, terms in asked.items():
        scores = []
        for chunk_id, _, tokens in rows:
            score = 0.0
            for term in terms:
                df, tf = sum(term in other for _, _, other in rows), tokens.count(term)
                if tf:
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / mean))
            if score > 0:
                scores.append((-round(score, 9), chunk_id))
        out[qid] = [chunk_id for _, chunk_id in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("k", [3, 200])
def test_search_against_brute_force(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(postings, "SHARD_CHUNKS", 64)
    monkeypatch.setattr(postings, "RANGE_POSTINGS", 400)
    rows, frame = chunks_of(spark)
    path = str(tmp_path / "keywords")
    postings.build(frame, path)
    stored = postings.open_keywords(spark, path)
    assert stored.ranges > 5 and stored.n == len(rows)
    asked = {1: ["t0", "t1", "t2", "t3", "t9"], 2: ["t40", "t40", "t1"], 3: ["nothing"], 4: ["same"], 5: [], 6: ["t0"] * 3 + ["t5"]}
    queries = spark.createDataFrame(list(asked.items()), "qid int, tokens array<string>")
    got = {qid: [] for qid in asked}
    for row in postings.search(stored, queries, k, ("category",)).orderBy("qid", "rank").collect():
        got[row["qid"]].append(row["chunk_id"])
    assert got == brute(rows, asked, k)
    monkeypatch.setattr(postings, "TERM_BLOCK", 3)
    again = {qid: [] for qid in asked}
    for row in postings.search(stored, queries, k).orderBy("qid", "rank").collect():
        again[row["qid"]].append(row["chunk_id"])
    assert again == got


def test_statistics_and_pruned_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_POSTINGS", 600)
    rows, frame = chunks_of(spark)
    path = str(tmp_path / "keywords")
    postings.build(frame, path)
    stored = postings.open_keywords(spark, path)
    found = {r["token"]: (r["df"], r["cf"]) for r in stored.statistics.collect()}
    tokens = {t for _, _, own in rows for t in own}
    assert found == {t: (sum(t in own for _, _, own in rows), sum(own.count(t) for _, _, own in rows)) for t in tokens}
    asked = spark.createDataFrame([("t3",)], "token string")
    read = postings.asked_only(stored.postings, asked, stored.ranges)
    assert len(read.inputFiles()) <= len(stored.postings.inputFiles())
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "range" in plan.split("PartitionFilters")[1][:120]
    touched = {row["range"] for row in read.select("range").distinct().collect()}
    assert len(touched) == 1


def test_skipping_leaves_lists_unread():
    """Chunks that only a weak term has are not taken up once the bound is out of its reach."""
    import numpy as np

    strong = (5.0, 0.9, np.array([3, 8]), np.array([0.9, 0.8]))
    weak = (0.1, 0.5, np.arange(100), np.full(100, 0.5))
    numbers, scores = postings.scored([weak, strong], 2, 0.0)
    assert numbers.tolist() == [3, 8] and np.allclose(scores, [4.55, 4.05])
    numbers, _ = postings.scored([weak], 2, 4.0)
    assert len(numbers) == 0


def test_empty_corpus_and_same_as_scan(spark, tmp_path):
    empty = spark.createDataFrame([], "chunk_id string, category string, tokens array<string>")
    postings.build(empty, str(tmp_path / "none"))
    queries = spark.createDataFrame([(1, ["t1", "t2"])], "qid int, tokens array<string>")
    assert postings.search(postings.open_keywords(spark, str(tmp_path / "none")), queries).collect() == []
    _, frame = chunks_of(spark, 120)
    postings.build(frame, str(tmp_path / "some"))
    filters = spark.createDataFrame([(1, ["k1"])], "qid int, categories array<string>")
    shape = lambda df: [(r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]
    stored = postings.open_keywords(spark, str(tmp_path / "some"))
    assert shape(postings.search(stored, queries, 9)) == shape(keyword.bm25_search(frame, queries, 9))
    assert shape(postings.filtered_search(stored, queries, filters, 5)) == shape(keyword.filtered_sparse_search(frame, queries, filters, 5))


def test_layout_reads_slots_and_moves_no_text(spark, tmp_path, monkeypatch):
    rows = spark.range(1_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.repeat(F.lit("x"), 50).alias("text"))
    keyed = Keyed.write(rows, str(tmp_path / "texts"), "chunk_id", 1_000, slot_rows=100)
    assert keyed.slots == 10 and keyed.rows.count() == 1_000
    asked = spark.createDataFrame([(1, "c5"), (1, "c77"), (2, "c5"), (2, "gone")], "qid int, chunk_id string")
    found, lost = fusion.hydrate(asked, keyed, ["text"], 4)
    assert sorted((r["qid"], r["chunk_id"]) for r in found.collect()) == [(1, "c5"), (1, "c77"), (2, "c5")]
    assert [(r["qid"], r["chunk_id"]) for r in lost.collect()] == [(2, "gone")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    in_pieces = keyed.attach(asked, ["text"], 4, limit=1)
    assert sorted((r["qid"], r["chunk_id"]) for r in in_pieces.collect()) == [(1, "c5"), (1, "c77"), (2, "c5")]
    assert "Exchange hashpartitioning" not in in_pieces._jdf.queryExecution().executedPlan().toString()


def test_search_at_agrees_with_scanning(spark, tmp_path):
    text = lambda i: " ".join(f"Word{i} common item{j}." for j in range(4))
    files = spark.createDataFrame([(f"car/pages/{i}.txt", "car" if i % 2 else "life", text(i)) for i in range(12)], "file string, category string, text string")
    path = str(tmp_path / "index")
    index.build(files, path)
    asked = spark.createDataFrame([(1, "Word3 common", ["car"]), (2, "Word4 item2", None)], "qid int, question string, categories array<string>")
    shape = lambda df: sorted((r["qid"], r["rank"], r["chunk_id"], round(r["rerank_score"], 9)) for r in df.collect())
    for questions in (asked, asked.drop("categories")):
        assert shape(index.search_at(spark, path, questions)) == shape(index.search(index.open_index(spark, path), questions))
    index.update(files.filter("file <> 'car/pages/3.txt'"), path)
    assert all("3.txt" not in row[2] for row in shape(index.search_at(spark, path, asked.drop("categories"))))


def test_chunks_are_counted_without_sorting_their_words(spark):
    """Different words of a chunk with their counts; chunks without words stay, and slices of a batch do not mix."""
    rows = [("a", ["x", "y", "x", "é"]), ("b", []), ("c", None), ("d", ["y"]), ("e", ["x"] * 3)]
    chunks = spark.createDataFrame(rows, "chunk_id string, tokens array<string>").coalesce(1)
    found = {r["chunk_id"]: sorted(map(tuple, r["runs"])) for r in postings._counted(chunks, ["chunk_id"]).collect()}
    assert found == {"a": [("x", 2), ("y", 1), ("é", 1)], "b": [], "c": [], "d": [("y", 1)], "e": [("x", 3)]}


def test_texts_of_ranked_chunks_do_not_search_again(spark, sf_dir):
    found = retrieval.texts_of(spark, sf_dir, retrieval.sparse_stage(spark, sf_dir))
    assert found.count() and "MapInArrow" not in found._jdf.queryExecution().toString()


def test_long_words_many_repeats_and_nulls_in_blocks(spark, tmp_path):
    """Words and counts that need wide numbers, chunks without words, an empty and a null word, equal and null ids."""
    rows = [("a", ["x"] * 300 + ["y"]), ("b", ["w" * 300, "x", ""]), ("c", []), ("d", None), ("e", ["y", None, "é"]), ("e", ["y"]), (None, ["x"])]
    frame = spark.createDataFrame([(c, "k", t) for c, t in rows], "chunk_id string, category string, tokens array<string>")
    path = str(tmp_path / "keywords")
    postings.build(frame, path)
    stored = postings.open_keywords(spark, path)
    ids = {(r["shard"], r["number"]): r["chunk_id"] for r in stored.chunks.collect()}
    mean = sum(len(t or []) for _, t in rows) / len(rows)
    wanted = sorted(
        (word, str(c), round(t.count(word) / (t.count(word) + 1.5 * (0.25 + 0.75 * len(t) / mean)), 12)) for c, t in rows for word in {w for w in t or [] if w is not None}
    )
    found = stored.postings.collect()
    assert sorted((r["token"], str(ids[r["shard"], at]), round(x, 12)) for r in found for at, x in zip(r["numbers"], r["impacts"])) == wanted
    assert all(r["n"] == len(r["numbers"]) and r["top"] == max(r["impacts"]) and r["numbers"] == sorted(r["numbers"]) for r in found)
    assert sum(r["cf"] for r in found) == sum(1 for _, t in rows for w in t or [] if w is not None)


def test_postings_travel_packed(spark, tmp_path):
    """No task receives words with their counts or postings as lists of rows; both are a few bytes each on their way."""
    rng = random.Random(3)
    rows = [(f"c{i:05d}", "k", [f"word{rng.randrange(400)}" for _ in range(60)]) for i in range(4_000)]
    frame = spark.createDataFrame(rows, "chunk_id string, category string, tokens array<string>")
    counted = postings._counted(frame, ["chunk_id"], packed=True)
    size = counted.agg(F.sum(F.length("words") + F.length("sizes"))).first()[0]
    assert size < 12 * sum(len(set(t)) for _, _, t in rows)
    numbered = counted.withColumn("shard", F.lit(0)).withColumn("number", F.substring("chunk_id", 2, 5).cast("int")).coalesce(1).sortWithinPartitions("number")
    blocks = numbered.select("shard", "number", "dl", "width", "words", "sizes").mapInArrow(postings._blocks, "token string, shard int, kind int, postings binary")
    assert blocks.agg(F.sum(F.length("postings"))).first()[0] == 5 * sum(len(set(t)) for _, _, t in rows)


def test_scores_do_not_depend_on_skipping():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        lists = []
        for _ in range(rng.integers(1, 9)):
            chunk = np.sort(rng.choice(300, rng.integers(1, 200), replace=False))
            impact = rng.random(len(chunk))
            lists.append((float(rng.random() * 5), float(impact.max()), chunk, impact))
        total = np.zeros(300)
        for weight, _, chunk, impact in lists:
            total[chunk] += weight * impact
        numbers, scores = postings.scored(lists, 5, 0.0)
        best = sorted(total, reverse=True)[:5]
        assert np.allclose(sorted(scores, reverse=True)[:5], [x for x in best if x > 0]) and np.allclose(total[numbers], scores)


def test_chunks_are_stored_once(spark, sf_dir):
    assert sorted(D.index(spark, sf_dir).inputFiles()) == sorted(D.texts(spark, sf_dir).rows.inputFiles())


def test_changed_files_are_dealt_before_they_are_chunked(spark, tmp_path):
    files = spark.createDataFrame([(f"car/pages/{i}.txt", "car", f"Word{i} common.") for i in range(40)], "file string, category string, text string")
    path = str(tmp_path / "index")
    index.build(files.filter("file < 'car/pages/2'"), path)
    plan = index.refresh(files, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("ArrowEvalPython") < plan.rindex("REPARTITION_BY_NUM")
