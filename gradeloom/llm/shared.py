"""The folder that the driver and all executors share, for tables that cut lineage and for archives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder in local mode and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not (known := context.getCheckpointDir()):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gradeloom-"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/gradeloom/{name}-{uuid.uuid4().hex}"


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, so that its lineage ends there; and its path."""
    spark = df.sparkSession
    path = fresh(spark, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")  # shuffles that only this table needed go once it is saved, not when the driver collects garbage
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    return saved_at(df, name)[0]


def dealt(df: DataFrame) -> DataFrame:
    """``df``, an aggregate that is small beside what it is joined with, dealt out evenly.

    A join that reads an aggregate in place can't have its skewed partitions split; one that shuffles both sides can.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
