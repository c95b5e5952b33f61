import json

import pytest
from pyspark.sql import functions as F

from citelode.providers import identity, provider
from citelode.sources import corpus, records, sinks
from citelode.streaming import steps


def write(root, rel, text):
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


@pytest.fixture
def root(tmp_path):
    write(tmp_path, "car/files/a.pdf", "%PDF")
    write(tmp_path, "car/markdown-files/a.md", "{0}-----\nhello\n\n|x|y|\n|-|-|\n|1|2|")
    write(tmp_path, "car/markdown-files/orphan.md", "{0}-----\nx")
    write(tmp_path, "car/pages/p q.txt", "One. Two.")
    write(tmp_path, "nowhere/pages/x.txt", "no")
    write(tmp_path, "car/pages/x.bin", "no")
    return tmp_path


def test_discover(spark, root):
    pdf = {(r["file"], r["kind"]) for r in corpus.discover(spark, str(root)).collect()}
    assert pdf == {("car/files/a.pdf", "pdf"), ("car/pages/p q.txt", "txt")}
    md = corpus.discover(spark, str(root), prefer="markdown")
    assert {(r["file"], r["kind"]) for r in md.collect()} == {("car/files/a.pdf", "md"), ("car/pages/p q.txt", "txt")}
    with pytest.raises(ValueError):
        corpus.subset(md, ["life"])
    texts = corpus.read_corpus_texts(spark, str(root), md)
    assert {r["file"]: r["text"] for r in texts.collect()}["car/pages/p q.txt"] == "One. Two."
    items = corpus.markdown_items(texts).orderBy("seq").collect()
    assert [(r["kind"], r["text"]) for r in items] == [("text", "hello"), ("table", "| x | y |\n|---|---|\n| 1 | 2 |")]
    assert corpus.unpaged(texts).count() == 0


def test_urls_and_hashes(spark, root):
    write(root, "manifest.json", json.dumps({"car/pages/p q.txt": "https://e/p"}))
    files = corpus.discover(spark, str(root))
    urls = {r["file"]: r["source_url"] for r in corpus.with_urls(files, str(root / "manifest.json")).collect()}
    assert urls == {"car/files/a.pdf": None, "car/pages/p q.txt": "https://e/p"}
    assert corpus.content_hashes(spark, str(root / "car/pages")).count() == 2


def test_records_in_three_shapes(spark, tmp_path):
    rows = [{"id": "a", "question": "x"}, {"question": "no id"}, {"id": "b", "question": "y"}]
    write(tmp_path, "list.json", json.dumps(rows))
    write(tmp_path, "wrapped.json", json.dumps({"questions": rows}))
    write(tmp_path, "lines.jsonl", "\n".join(map(json.dumps, rows)) + '\n\n[1]\n{"id": "c", "ques')
    for name in ("list.json", "wrapped.json", "lines.jsonl"):
        got = records.read_records(spark, str(tmp_path / name), "id string, question string")
        assert sorted(r["id"] for r in got.collect()) == ["a", "b"], name
    good, skipped = records.read_lines(spark, str(tmp_path / "lines.jsonl"), "id string, question string")
    assert [(r["lineno"], r["id"]) for r in good.orderBy("lineno").collect()] == [(1, "a"), (2, None), (3, "b")]
    assert skipped.first()["skipped"] == 2
    assert records.line_counts(spark, str(tmp_path / "lines.jsonl")).first()["n"] == 5


def test_lines_are_numbered_across_splits(spark, tmp_path):
    write(tmp_path, "big.jsonl", "\n".join(json.dumps({"id": str(i)}) for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        good, _ = records.read_lines(spark, str(tmp_path / "big.jsonl"), "id string")
        wrong = good.filter(F.col("lineno") != F.col("id").cast("long") + 1)
        assert good.count() == 5000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_candidate_specs(spark):
    spec = '["a#p1#c0", {"chunk_id": "b"}, {"chunk": {"chunk_id": "c"}}]'
    rows = records.candidate_specs(spark.createDataFrame([(1, spec)], ["qid", "spec"])).orderBy("ordinal").collect()
    assert [r["chunk_id"] for r in rows] == ["a#p1#c0", "b", "c"]


def test_ordered_lines_and_publish(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_json_lines(spark.range(100).repartition(5), out, [F.col("id").desc()])
    lines = [json.loads(l)["id"] for f in sorted((tmp_path / "out").glob("part-*")) for l in f.read_text().splitlines()]
    assert lines == list(range(99, -1, -1))
    for generation in ("one", "two"):
        sinks.write_text(spark, generation, str(tmp_path / "build" / "v.txt"))
        sinks.publish(spark, str(tmp_path / "build"), str(tmp_path / "live"))
        assert sinks.read_text(spark, str(tmp_path / "live" / "v.txt")) == generation
    assert not list(tmp_path.glob("live.old-*"))


def test_providers():
    assert identity("hashing", dims=64) == identity("hashing", dims=64) != identity("hashing", dims=32)
    with pytest.raises(ValueError):
        provider("embedder", "absent")


def test_step_relay(spark, tmp_path):
    write(tmp_path, "in/1.json", json.dumps({"id": "q1", "trace": [{"step": "retrieve", "ms": 5.0}, {"step": "answer", "ms": 9.0}]}))
    seen = []
    query = steps.relay(
        steps.step_stream(spark, str(tmp_path / "in")),
        lambda batch, _: seen.extend((r["id"], r["ordinal"], r["step"]) for r in batch.collect()), str(tmp_path / "cp"),
    )
    query.awaitTermination(60)
    assert sorted(seen) == [("q1", 0, "retrieve"), ("q1", 1, "answer")]


def test_shared_tables_lie_in_one_folder(spark):
    import os

    from citelode.session import application_folder, shared_folder, shared_table

    written = shared_table(spark.range(3), "numbers")
    assert written.count() == 3
    assert application_folder(spark).startswith(shared_folder(spark)) and os.path.isdir(application_folder(spark))


def test_record_numbers_have_no_gaps(spark, tmp_path):
    from citelode.sources import records

    path = tmp_path / "run.jsonl"
    path.write_text('{"id": "a"}\n{"id": "b"\n\n[1]\n{"id": "c"}\n')
    found, skipped = records.read_lines(spark, str(path), "id string")
    assert [(r["lineno"], r["id"]) for r in found.orderBy("lineno").collect()] == [(1, "a"), (2, "c")]
    assert skipped.first()["skipped"] == 2
