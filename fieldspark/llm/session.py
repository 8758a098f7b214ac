"""Checkpoint folder and clean-up helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; set one only in local tests."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder")
        if context.master.startswith("local-cluster"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder")
        folder = tempfile.mkdtemp(prefix="corpus-checkpoint-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write a result several later steps read to the shared checkpoint folder.

    Survives the loss of the executors that made it.  The shuffle files of
    the steps before serve nothing else, so Spark is told to remove them as
    soon as the result is written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def written(df: DataFrame) -> DataFrame:
    """Write a small table to the shared folder and read it back.

    Its size is then known when a join is planned: Spark broadcasts it below
    its own threshold and shuffles it beyond.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
