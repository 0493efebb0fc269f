"""Cutting the lineage of a frame in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of this machine, which only a
    local session can use: on a cluster it would lose rows, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spectraloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df read back from a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """df read back from Parquet in the shared folder: computed once, however often it is used."""
    path = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
