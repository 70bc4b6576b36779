"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir. Only a local session may go without that setting: it gets a temporary
    folder, which other machines could not read."""
    context = spark.sparkContext
    home = context.getConf().get("spark.checkpoint.dir")
    if not home and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(home or 'file://' + tempfile.mkdtemp(prefix='marlstone-')).rstrip('/')}/marlstone-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in that folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
