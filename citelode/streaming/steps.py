"""Pipeline steps as they happen: trace records landing in a folder, sent on per step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TRACE = "id string, trace array<struct<step:string, ms:double, detail:string>>"


def step_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """``id, ordinal, step, ms, detail`` for every trace step of the answers that land in
    ``folder`` as JSON lines."""
    answers = spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return answers.select("id", F.posexplode("trace").alias("ordinal", "s")).select("id", "ordinal", "s.*")


def relay(
    steps: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Hand each micro-batch to ``send``; the checkpoint resumes a stopped relay."""
    return (
        steps.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
