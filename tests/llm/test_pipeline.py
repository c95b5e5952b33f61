"""The pipeline stage by stage, and the queries against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from citelode.llm import common, exact_dedup, near_dup, pack, toxicity
from citelode.llm.queries import ORACLES, tokenizer_path
from citelode.session import shared_table
from tests.llm.test_methods import brute_components
from tools.check import TABLES, compare


@pytest.fixture(scope="module")
def connection(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    line, good = compare(spark, connection, sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good, line


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = shared_table(stage(spark, docs, sf_dir), name)
        seen[name] = (docs.collect(), out.collect())
        assert name == "pack" or out.columns == docs.columns
        docs = out
    before, after = seen["toxicity"]
    assert 0.8 * len(before) < len(after) <= len(before) and set(after) <= set(before)
    before, after = seen["exact_dedup"]
    plain = lambda r: "".join((r["text"] or "").encode().translate(None, b" \t\n\x0b\x0c\r").decode())
    best = {}
    for r in before:
        key = (-len(r["text"] or ""), r["doc_id"])
        best[plain(r)] = min(best.get(plain(r), key), key)
    assert sorted(r["doc_id"] for r in after) == sorted(doc for _, doc in best.values())
    before, after = seen["near_dedup"]
    want = brute_components({r["doc_id"]: r["text"] or "" for r in before}, 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(doc for doc, (_, name) in want.items() if doc == name)
    before, after = seen["mix"]
    words = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    assert set(after) <= set(before) and words(after) == pytest.approx(1.5 * words(before), rel=0.05)
    _, pieces = seen["pack"]
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in after}
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)


def test_pipeline_is_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert near_dup.Plan(5, 80).bands > 0
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in entry.queries()}


def test_texts_reach_python_in_small_batches(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(name) for name in names]

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    long_texts = spark.range(6000, numPartitions=1).select(F.repeat(F.lit("word "), 800).alias("text"))
    try:
        corpus_pipeline.STAGES[4][1](spark, long_texts.limit(5).select(F.lit(1).alias("doc_id"), "text"), "")
        assert max(row[0] for row in long_texts.mapInArrow(sizes, "bytes long").collect()) < 9_000_000
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_a_worker_forgets_what_other_operators_kept():
    scored = toxicity.Model(["idiot"], np.ones(1, dtype=np.float32), 0.0)
    scored.worst(["some words here"])
    assert toxicity._MEMORY
    pack.WordTokens._known.clear()
    pack.WordTokens.of(tokenizer_path(), 10)
    assert not toxicity._MEMORY
    scored.worst(["some words here"])
    assert not pack.WordTokens._known


def test_stages_after_the_classifier_empty_its_memory():
    scored = toxicity.Model(["idiot"], np.ones(1, dtype=np.float32), 0.0)
    scored.worst(["some words here"])
    exact_dedup.hash_pieces.func(pa.array(["a text"]))
    assert not toxicity._MEMORY


def test_duplicate_stages_give_memory_back_after_every_batch(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    toxicity._MEMORY.clear()
    pack.WordTokens._known.clear()
    for work, column in ((exact_dedup.hash_pieces, ["a text"]), (exact_dedup.compared_pieces, ["", "a text"])):
        given.clear()
        assert len(work.func(pa.array(column))) == len(column)
        assert given
    given.clear()
    with pytest.raises(AttributeError):
        exact_dedup.hash_pieces.func(pa.array([None], pa.string()))
    assert given
