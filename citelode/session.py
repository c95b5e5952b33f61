"""Session set-up and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "citelode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC timestamps.

    Cluster sizing (executors, shuffle partitions, memory) stays with the submitter;
    only settings the results or the plans rely on are fixed here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows and bytes of a batch of texts on its way to Python.
BATCH_ROWS, BATCH_BYTES = 2_000, "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session. Spark lets one grow to 10,000 rows or 64 MB, which the executor
    and its Python worker each hold more than once; long texts need no such batches."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only where that is unset and the master is
    local, a folder of the application in the warehouse."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"


def application_folder(spark: SparkSession) -> str:
    """Where everything that this application shares lies."""
    return f"{shared_folder(spark).rstrip('/')}/citelode-{spark.sparkContext.applicationId}"


def drop_shared(spark: SparkSession) -> None:
    """Remove what this application wrote with ``shared_table``; results that still read it have
    to be written before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished writes. It does so when the driver's JVM collects garbage, which may
    else come only after the next ones are written."""
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, so that later reads
    can prune columns and row groups."""
    path = f"{application_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    release_shuffles(df.sparkSession)
    return df.sparkSession.read.parquet(path)
