"""Spark session defaults, and what is kept between stages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: For sessions that run in one process on one machine and configure no folder.
LOCAL_CHECKPOINTS = "/tmp/strandframe-checkpoints"


def session(name: str = "strandframe", **settings: str) -> SparkSession:
    """A session with adaptive execution; what the cluster configures stays."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. A session of one process may do without; on a cluster a folder
    of our own would lie on one machine's disk, so there it is an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(root or LOCAL_CHECKPOINTS)
    return (root or LOCAL_CHECKPOINTS).rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder: a reliable checkpoint."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
