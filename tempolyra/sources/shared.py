"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_side(table: DataFrame, most: int = 500_000) -> DataFrame:
    """The table with a hint to broadcast it if it has been counted to hold at most `most` rows; else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bounds the rows and bytes of an Arrow batch, so that a batch of large values fits a worker; smaller settings of
    the session stay."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the folder of spark.checkpoint.dir (or, where that is unset on a local master, a new one)
    and reads it back: it is computed once, its lineage ends, and it outlives any executor."""
    context = df.sparkSession.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = context.getCheckpointDir()
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
