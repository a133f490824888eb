"""The scanner's files as a stream, and what its state machine makes of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlake.streaming import machine


def stream_of(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The landed scanner files as a stream, in the roles' names."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a stream reads folders, so a single file is named by its folder and a filter
    folder, _, name = path.rstrip("/").rpartition("/")
    single = name.endswith(".parquet") and not _is_folder(spark, path)
    raw = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return raw.select(F.col("event_id").alias("punch_id"), F.col("user_id").alias("student_id"), F.col("ts").cast("timestamp").alias("punch_time"), F.col("event_type").alias("status"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def drained_attendance(spark: SparkSession, path: str, captured_at: Column, window: int = 1) -> DataFrame:
    """The complete rows of a full read of the scanner's files at ``captured_at``: all days before it are past days."""
    changed = machine.drained(spark, machine.changes(machine.captured(stream_of(spark, path), captured_at), window=window, outcomes=False))
    return machine.rows_of(changed).filter("m_out is not null")


def notify(stream: DataFrame, send: Callable[[DataFrame, int], None], folder: str):
    """Each batch of changed sessions goes to ``send`` (batch, number), at least once, in order."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", folder).outputMode("append")
