"""Writers: ordered JSON lines, index tables, atomic publication."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def write_json_lines(df: DataFrame, path: str, order: list[Column | str]) -> None:
    """JSON lines in order: part files follow the sort, each task writes its own."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Add finished records to a checkpoint folder."""
    df.write.mode("append").json(path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def publish(spark: SparkSession, build: str, live: str) -> None:
    """Swap a finished build into place: old aside, new in, old removed. Readers see the
    old folder or the new one."""
    fs, path = _filesystem(spark, live)
    aside = f"{live}.old-{uuid.uuid4().hex[:8]}"
    had_old = fs.exists(path(live))
    if had_old and not fs.rename(path(live), path(aside)):
        raise OSError(f"could not move {live} aside")
    if not fs.rename(path(build), path(live)):
        if had_old:
            fs.rename(path(aside), path(live))
        raise OSError(f"could not publish {build}")
    if had_old:
        fs.delete(path(aside), True)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder that this library wrote."""
    fs, target = _filesystem(spark, path)
    return fs.delete(target(path), True)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Put the partitions that ``df`` has rows for in place of theirs; all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_text(spark: SparkSession, text: str, target: str) -> None:
    """Small report or manifest: written beside its place, then renamed into it."""
    fs, path = _filesystem(spark, target)
    temporary = f"{target}.tmp-{uuid.uuid4().hex[:8]}"
    stream = fs.create(path(temporary), True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    fs.delete(path(target), False)
    if not fs.rename(path(temporary), path(target)):
        raise OSError(f"could not write {target}")


def read_text(spark: SparkSession, target: str) -> str | None:
    fs, path = _filesystem(spark, target)
    if not fs.exists(path(target)):
        return None
    return spark.read.text(target, wholetext=True).first()[0]
