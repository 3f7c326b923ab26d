"""Checkpoints in the folder that the cluster names; one of our own only in local sessions without one."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "file:/tmp/checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. ValueError on a cluster that names none: executors share no folder of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return named or LOCAL


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint(): files in a shared folder, which outlive any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, inside one of this application that goes when it ends."""
    own = f"{checkpoint_dir(spark).rstrip('/')}/dendra-{spark.sparkContext.applicationId}"
    p = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{own}/{name}-{uuid.uuid4().hex}"
