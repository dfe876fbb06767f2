"""Cutting the lineage of a table that several results read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session on one machine gets one of its own if the setting is missing."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local["):
        return os.path.join(tempfile.gettempdir(), "mnemospark-checkpoints")
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def settled(df: DataFrame) -> DataFrame:
    """The same rows from a written table, so that many readers and retried tasks do not compute them again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
