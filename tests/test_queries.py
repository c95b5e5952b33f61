"""Registered queries against their SQL, and the shape of their plans."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools.check import TABLES, compare

QUICK = [
    "sentence_split_counts", "capped_window_chunks", "pack_paragraphs_greedy", "page_split", "hybrid_search",
    "sparse_postfilter_3x", "citation_parse", "file_match_cascade", "gt_hit", "committee_vote", "metric_slices",
    "audit_stages", "paired_mcnemar", "stratified_split", "near_dup_jaccard", "page_reuse", "history_page", "run_delta",
]


@pytest.fixture(scope="module")
def connection(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, connection, name):
    line, good = compare(spark, connection, sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good, line


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_query_crosses_or_nests(spark, sf_dir):
    for name, query in entry.queries().items():
        plan = plan_of(query(spark, sf_dir))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_topk_is_cut_before_the_shuffle(spark, sf_dir):
    plan = plan_of(entry.queries()["bm25_topk"](spark, sf_dir))
    assert plan.count("WindowGroupLimit") == 2


def test_scans_read_needed_columns(spark, sf_dir):
    plan = plan_of(entry.queries()["committee_vote"](spark, sf_dir))
    assert "l_shipdate" not in plan and "l_extendedprice" not in plan


def test_category_filter_reaches_the_scan(spark, sf_dir):
    from citelode.operators import vectors

    stored = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("category"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector")
    )
    queries = spark.createDataFrame([(1, [1.0, 0.0], ["src1"])], "qid int, vector array<double>, categories array<string>")
    assert "EqualTo(source,src1)]" in plan_of(vectors.cosine_search(stored, queries, 3))
