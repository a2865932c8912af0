"""Reliable checkpoints in the folder that the cluster names, for plans that read one intermediate twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def temporary_folder(spark: SparkSession, prefix: str) -> str:
    """A folder of this machine's, for a session that runs on it alone; on a cluster a shared one must be named."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; one of our own only where a local session names none (as in tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        named = named or temporary_folder(spark, "tidelog-checkpoint-")
        context.setCheckpointDir(named)
    return named or current


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, beside the session's checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidelog-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """`df`, computed now and kept in the shared checkpoint folder; its lineage is cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
