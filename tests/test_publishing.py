"""Canary gate, cache back-fill, and finding runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from citelode.operators.quality import CanaryError, CanaryGate
from citelode.plans import backfill, index
from citelode.sources import runs


def files(spark, *texts):
    rows = [(f"car/pages/{i}.txt", "car", text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "file string, category string, text string")


def test_gate_keeps_the_old_index(spark, tmp_path):
    path = str(tmp_path / "index")
    gate = CanaryGate(("policy", "claim"), "car/pages/0.txt", ("annual report",), inner="a-z")
    index.build(files(spark, "The policy of the annual\nreport.", "A claim."), path, gate=gate)
    before = {row["file"] for row in index.open_index(spark, path).collect()}
    for bad, says in (
        (("The policy of the annual report.", "A claim. The ycilop of it."), "reversed text in 1 files, first car/pages/1.txt"),
        (("The policy of the annual report.", "Nothing."), "tokens nowhere: claim"),
        (("The policy.", "A claim."), "car/pages/0.txt lacks: annual report"),
        ((), "tokens nowhere: policy, claim"),
    ):
        with pytest.raises(CanaryError, match=says):
            index.build(files(spark, *bad), path, gate=gate)
        assert {row["file"] for row in index.open_index(spark, path).collect()} == before
    assert os.listdir(tmp_path) == ["index"]  # no build is left behind


def test_gate_needs_no_second_scan(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)
    rows = files(spark, "A policy.", "A claim.").repartition(1)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    index.build(rows.mapInArrow(counted, rows.schema), str(tmp_path / "index"), gate=CanaryGate(("policy",), inner="a-z"))
    assert read.value == 2


def stamps(folder):
    return {name: sorted((f, os.stat(folder / name / f).st_mtime_ns) for f in os.listdir(folder / name)) for name in os.listdir(folder) if "=" in name}


def test_backfill_rewrites_stale_buckets_only(spark, tmp_path):
    parsed = spark.range(60).select(F.concat(F.lit("s"), "id").alias("sha256"), F.when(F.col("id").isin(5, 17), "olleh").otherwise("fine").alias("text"))
    cache, tokens = str(tmp_path / "parsed"), str(tmp_path / "tokens")
    backfill.write_cache(parsed, cache, "sha256", 8)
    backfill.write_cache(parsed.filter("sha256 <> 's17'").crossJoin(spark.range(2)).select("sha256", "id"), tokens, "sha256", 8)
    present = parsed.filter("sha256 <> 's59'").select("sha256")
    repair = lambda rows: rows.withColumn("fixed", F.col("text") == "olleh").withColumn("text", F.when(F.col("fixed"), F.reverse("text")).otherwise(F.col("text")))
    before, tokens_before = stamps(tmp_path / "parsed"), stamps(tmp_path / "tokens")
    expected = {"scanned": 59, "changed": 2, "orphaned": 1, "invalidated": 2}
    run = lambda **more: backfill.backfill(spark, cache, [tokens], present, repair, F.col("fixed"), **more)
    dry = run(dry_run=True)
    assert {k: dry[k] for k in expected} == expected and stamps(tmp_path / "parsed") == before
    done = run()
    assert done == dry and 1 <= done["buckets"] <= 2
    after, tokens_after = stamps(tmp_path / "parsed"), stamps(tmp_path / "tokens")
    assert sum(after[name] != before[name] for name in before) == done["buckets"]
    assert sum(tokens_after[name] != tokens_before[name] for name in tokens_before) == 1
    rows = {r["sha256"]: r["text"] for r in spark.read.parquet(cache).collect()}
    assert len(rows) == 60 and rows["s5"] == rows["s17"] == "hello" and rows["s1"] == "fine"
    assert spark.read.parquet(tokens).filter("sha256 = 's5'").count() == 0 and spark.read.parquet(tokens).count() == 116
    assert run() == {"scanned": 59, "changed": 0, "orphaned": 1, "invalidated": 0, "buckets": 0}


def test_backfill_removes_a_bucket_left_empty(spark, tmp_path):
    parsed = spark.createDataFrame([("a", "olleh")], "sha256 string, text string")
    cache, tokens = str(tmp_path / "parsed"), str(tmp_path / "tokens")
    backfill.write_cache(parsed, cache, "sha256", 64)
    both = parsed.unionByName(spark.createDataFrame([("b", "x"), ("c", "x")], parsed.schema))
    backfill.write_cache(both, tokens, "sha256", 64)
    backfill.backfill(spark, cache, [tokens], parsed, lambda rows: rows.withColumn("text", F.reverse("text")), F.col("text") == "hello")
    assert sorted(r["sha256"] for r in spark.read.parquet(tokens).collect()) == ["b", "c"]


def test_runs_newest_first_with_a_broken_one(spark, tmp_path):
    def put(rel, text, age):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))

    lines = lambda *rows: "\n".join(json.dumps(row) for row in rows) + "\n\n"
    put("rag_answers.jsonl", lines({"id": "a", "trace": [1]}, {"id": "b"}), 50)
    put("rag_answers_old one.jsonl", lines({"id": "a", "trace": []}), 500)
    put("eval_results/r1/answers/x.jsonl", lines({"id": "a", "trace": {"k": 1}}), 20)
    put("eval_results/r1/judgments.jsonl", lines({"id": "a"}, {"id": "b"}, {"id": "c"}), 10)
    put("eval_results/r1/metrics.json", json.dumps({"meta": {"answers_file": "/elsewhere/x.jsonl", "questions_file": "q.json"}}), 5)
    put("eval_results/r2/judgments.jsonl", lines({"id": "a"}), 30)
    put("eval_results/r2/metrics.json", "{broken", 1)
    put("eval_results/r3/judgments.jsonl", "\n", 40)
    put("other/answers.jsonl", lines({"id": "a"}), 0)
    found = [(r["id"], r["label"], r["kind"], r["n_pairs"], r["has_trace"], r["questions_file"]) for r in runs.discover_runs(spark, str(tmp_path)).collect()]
    assert found == [
        ("eval_results/r1/judgments.jsonl", "eval_results/r1", "judged", 3, True, "q.json"),
        ("eval_results/r1/answers/x.jsonl", "x", "answers", 1, True, None),
        ("eval_results/r2/judgments.jsonl", "eval_results/r2", "judged", 1, False, None),
        ("eval_results/r3/judgments.jsonl", "eval_results/r3", "judged", 0, False, None),
        ("rag_answers.jsonl", "rag_answers", "answers", 2, True, None),
        ("rag_answers_old one.jsonl", "rag_answers_old one", "answers", 1, False, None),
    ]
    (tmp_path / "nothing").mkdir()
    assert runs.discover_runs(spark, str(tmp_path / "nothing")).collect() == []
