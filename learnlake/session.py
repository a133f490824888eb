"""The session factory: adaptive execution, UTC and ANSI mode, everything else as the cluster sets it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "learnlake", **conf: str) -> SparkSession:
    """A session; ``conf`` keys use double underscores for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share: the context's, else the one that spark.checkpoint.dir names.

    One of our own serves only where neither is set and all run in one process.
    """
    own = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="learnlake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(own)
    return own


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
