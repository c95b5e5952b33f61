import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelode.operators import fusion, keyword, vectors


def ranking(spark, ids, qid=1):
    return spark.createDataFrame([(qid, c, i + 1, 1.0 / (i + 1)) for i, c in enumerate(ids)], "qid int, chunk_id string, rank int, score double")


def test_rrf_by_hand(spark):
    out = fusion.reciprocal_rank_fusion([ranking(spark, "abc"), ranking(spark, "ca")]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["a", "c", "b"]
    assert out[0]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62)
    tie = fusion.reciprocal_rank_fusion([ranking(spark, "b"), ranking(spark, "a")]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in tie] == ["a", "b"]
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion([], 0)


def test_gate(spark):
    rows = [(1, "a", 0.9), (1, "b", 0.35), (1, "c", 0.34), (1, "d", None)]
    frame = spark.createDataFrame(rows, "qid int, chunk_id string, rerank_score double")
    assert [r["chunk_id"] for r in fusion.gate(frame).orderBy("rank").collect()] == ["a", "b"]


def test_pool_merge_keeps_first_on_tie(spark):
    rows = [(1, "a", 0.5, 1), (1, "a", 0.5, 2), (1, "b", 0.1, 1), (1, "b", 0.3, 2)]
    frame = spark.createDataFrame(rows, "qid int, chunk_id string, rerank_score double, arrival int")
    assert {(r["chunk_id"], r["arrival"]) for r in fusion.merge_pools(frame).collect()} == {("a", 1), ("b", 2)}


def corpus(spark, n=200):
    rng = np.random.default_rng(1)
    rows = [(f"src{i % 3}/pages/{i}.txt#pnull#c0", f"src{i % 3}", [f"t{j}" for j in rng.zipf(1.6, 30) % 40]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "chunk_id string, category string, tokens array<string>").repartition(3)


def test_bm25_against_brute_force(spark):
    rows, frame = corpus(spark)
    asked = {1: ["t1", "t7", "t7", "unknown"], 2: ["t39"], 3: ["nothing"]}
    queries = spark.createDataFrame(list(asked.items()), "qid int, tokens array<string>")
    n, avg = len(rows), sum(len(t) for _, _, t in rows) / len(rows)
    expected = {}
    for q, terms in asked.items():
        scores = []
        for cid, _, toks in rows:
            s = 0.0
            for t in terms:
                df = sum(t in other for _, _, other in rows)
                tf = toks.count(t)
                if df and tf:
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avg))
            if s > 0:
                scores.append((-round(s, 9), cid))
        expected[q] = [c for _, c in sorted(scores)[:10]]
    got = {1: [], 2: [], 3: []}
    for r in keyword.bm25_search(frame, queries, 10).orderBy("qid", "rank").collect():
        got[r["qid"]].append(r["chunk_id"])
    assert got == expected


def test_bm25_blocks_agree_with_one_pass(spark, monkeypatch):
    _, frame = corpus(spark)
    queries = spark.createDataFrame([(i, [f"t{i}", f"t{i + 1}"]) for i in range(12)], "qid int, tokens array<string>")
    whole = keyword.bm25_search(frame, queries, 5).collect()
    monkeypatch.setattr(keyword, "TERM_BLOCK", 8)
    parts = keyword.bm25_search(frame, queries, 5).collect()
    shape = lambda rows: sorted((r["qid"], r["rank"], r["chunk_id"]) for r in rows)
    assert shape(whole) == shape(parts)


def test_sparse_filter_comes_after_overfetch(spark):
    _, frame = corpus(spark)
    queries = spark.createDataFrame([(1, ["t1"])], "qid int, tokens array<string>")
    filters = spark.createDataFrame([(1, ["src0"])], "qid int, categories array<string>")
    first = [r["chunk_id"] for r in keyword.bm25_search(frame, queries, 12).orderBy("rank").collect()]
    kept = [r["chunk_id"] for r in keyword.filtered_sparse_search(frame, queries, filters, 4).orderBy("rank").collect()]
    assert kept == [c for c in first if c.startswith("src0/")][:4]


def test_cosine_with_and_without_filter(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(150, 8))
    rows = [(f"c{i:03d}", f"k{i % 4}", data[i].tolist()) for i in range(150)]
    stored = spark.createDataFrame(rows, "chunk_id string, category string, vector array<double>").repartition(3)
    asked = rng.normal(size=(6, 8))
    cats = [["k1"], ["k0", "k3"], None, ["k2"], [], ["k1"]]
    queries = spark.createDataFrame([(i, asked[i].tolist(), cats[i]) for i in range(6)], "qid int, vector array<double>, categories array<string>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(asked) @ unit(data).T
    for block in (4096, 2):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        got = {}
        for r in vectors.cosine_search(stored, queries, 7).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["chunk_id"])
        for q in range(6):
            allowed = [i for i in range(150) if not cats[q] or f"k{i % 4}" in cats[q]]
            best = sorted(allowed, key=lambda i: (-round(scores[q][i], 9), i))[:7]
            assert got[q] == [f"c{i:03d}" for i in best]


def test_retry_and_confidence(spark):
    narrow, wide = ranking(spark, "ab", 1), ranking(spark, "cd", 2).unionByName(ranking(spark, "x", 1))
    out = fusion.retry_unfiltered(narrow, wide).collect()
    assert {(r["qid"], r["chunk_id"]) for r in out} == {(1, "a"), (1, "b"), (2, "c"), (2, "d")}
    pool = spark.createDataFrame([(1, 0.4), (1, 0.7)], "qid int, rerank_score double")
    queries = spark.createDataFrame([(1,), (2,)], "qid int")
    assert {r["qid"]: r["confidence"] for r in fusion.pooled_confidence(queries, pool).collect()} == {1: 0.7, 2: 0.0}


def test_index_round_trip(spark, tmp_path):
    from citelode.plans import index

    text = lambda i: " ".join(f"Word{i} common item{j}." for j in range(4))
    files = spark.createDataFrame([(f"car/pages/{i}.txt", "car" if i % 2 else "life", text(i)) for i in range(8)], "file string, category string, text string")
    path = str(tmp_path / "index")
    index.build(files, path)
    stored = index.open_index(spark, path)
    asked = spark.createDataFrame([(1, "Word3 common")], "qid int, question string")
    assert index.search(stored, asked).orderBy("rank").first()["file"] == "car/pages/3.txt"
    with pytest.raises(ValueError):
        index.open_index(spark, path, index.IndexConfig(max_tokens=100))
    with pytest.raises(ValueError):
        index.IndexConfig.of(typo=1)
    changed = files.withColumn("text", F.when(F.col("file") == "car/pages/1.txt", F.lit("Fresh words here.")).otherwise(F.col("text"))).filter("file != 'car/pages/2.txt'")
    renewed = {r["file"]: r["text"] for r in index.refresh(changed, path).collect()}
    assert "car/pages/2.txt" not in renewed and renewed["car/pages/1.txt"] == "Fresh words here." and len(renewed) == 7
    index.update(changed.unionByName(spark.createDataFrame([("life/pages/new.txt", "life", "A new file.")], files.schema)), path)
    after = {(r["file"], r["text"]) for r in index.open_index(spark, path).collect()}
    assert after == {(r["file"], r["text"]) for r in index.refresh(changed, path).collect()} | {("life/pages/new.txt", "A new file.")}
    assert not [name for name in os.listdir(tmp_path) if ".build" in name or ".old" in name]


def test_running_top_equals_sorting_everything():
    from citelode.operators.topk import RunningTop

    rng = np.random.default_rng(3)
    for k in (1, 3, 7):
        scores, keys = np.round(rng.random((4, 90)), 1), np.array([f"c{i:02d}" for i in rng.permutation(90)], dtype=object)
        best = RunningTop(k, 9)
        for at in range(0, 90, 13):
            best.add(scores[:, at : at + 13], keys[at : at + 13], 0.2)
        for q in range(4):
            want = [name for value, name in sorted((-s, name) for s, name in zip(scores[q], keys) if s > 0.2)][:k]
            assert best.keys[best.rows == q].tolist() == want


def test_tasks_forward_at_most_k_rows_per_query(spark):
    _, frame = corpus(spark, 600)
    queries = spark.createDataFrame([(i, [f"t{i}", "t1"]) for i in range(8)], "qid int, tokens array<string>")
    shared = spark.sparkContext.broadcast(keyword._scoring_tables(
        [{"token": "t1", "qid": i, "qtf": 1, "df": 5} for i in range(8)], 600, 30.0, 1.5, 0.75
    ))
    import pyarrow as pa

    counts = frame.select("chunk_id", "tokens").mapInArrow(
        keyword._bm25_batches(shared, 5, [], pa.int32()), "qid int, chunk_id string, score double"
    ).groupBy(F.spark_partition_id().alias("task"), "qid").count()
    assert counts.agg(F.max("count")).first()[0] <= 5 and queries.count() == 8


def test_dense_search_over_splits_without_rows(spark):
    rows = [(f"c{i}", [1.0, float(i)]) for i in range(3)]
    stored = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "chunk_id string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, vector array<double>")
    found = vectors.cosine_search(stored, queries, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in found] == ["c0", "c1"]
    assert vectors.cosine_search(stored.filter("false"), queries, 2).count() == 0
