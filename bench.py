"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import pyspark

from citelode.plans import catalog
from citelode.plans import tables
from citelode.session import build_session, drop_shared

HEADLINE = [
    "hybrid_search", "bm25_topk", "dense_topk", "sentence_window_chunks", "normalized_token_freq", "boilerplate_strip",
    "near_dup_jaccard", "committee_vote", "metric_slices", "arm_summary", "paired_mcnemar", "stratified_split",
    "page_reuse", "file_match_cascade", "json_repair", "calc_expr", "table_blocks", "chunk_size_stats",
    "coverage_by_category", "run_delta",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    # The same warm-up for all: a scan, a shuffle and a Python worker; then the index, on its own line.
    warm = spark.read.parquet(f"{sf_dir}/nation.parquet").repartition(int(cpus))
    warm.mapInArrow(lambda batches: batches, warm.schema).groupBy("n_regionkey").count().collect()
    seconds, rows = {}, {}
    start = time.perf_counter()
    rows["index_build"] = tables.index(spark, sf_dir).count()
    seconds["index_build"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        rows[name] = len(catalog.QUERIES[name](spark, sf_dir).collect())
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows": rows, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "spark": pyspark.__version__,
    }))
    drop_shared(spark)
    spark.stop()


if __name__ == "__main__":
    main()
