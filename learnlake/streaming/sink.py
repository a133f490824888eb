"""Sinks of a stream's micro-batches that a replay leaves as they were.

A batch is known by its number. Spark may run the last one again after a
failure, at any point of what it had done; each sink here writes the same files
or the same rows then, so the table ends as if it had run once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlake.session import stored


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _overwrite(df: DataFrame, folder: str, *partitions: str) -> None:
    """Replaces the partitions that df has rows of, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(folder)


class ChangedTable:
    """A table that batches of changes are merged into, a version a key, by partitions.

    Changes have the keys, ``version`` (rising a key), ``change`` (put or gone) and the
    partition column, which a key never changes. The newest version of a key
    stays, removed ones too, as a mark: so a batch that comes again changes
    nothing, and a removal reaches a partition that keeps no other row. Only
    the partitions of a batch's changes are read and written.
    """

    def __init__(self, folder: str, keys: tuple[str, ...], partition: str):
        self.folder, self.keys, self.partition = folder, keys, partition

    def apply(self, changes: DataFrame, number: int) -> None:
        """Merges a batch; fit for ``foreachBatch``."""
        spark, columns = changes.sparkSession, changes.columns
        every = changes
        if _exists(spark, self.folder):
            touched = changes.select(self.partition).distinct()
            every = changes.unionByName(spark.read.schema(changes.schema).parquet(self.folder).join(touched, self.partition, "left_semi"))
        rest = [c for c in columns if c not in self.keys]
        newest = every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "version").alias("_new"))
        _overwrite(stored(newest.select(*self.keys, "_new.*").select(*columns)), self.folder, self.partition)

    def rows(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows that stand; ``schema`` is that of the changes."""
        if not _exists(spark, self.folder):
            return spark.createDataFrame([], schema).drop("version", "change")
        return spark.read.schema(schema).parquet(self.folder).filter("change = 'put'").drop("version", "change")


def archive_batch(folder: str, name: str = "fingerprint", day: str = "archive_day") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that adds punches by day, each fingerprint once over all batches.

    A batch has files of its own, which a replay writes again; what other
    batches hold is left out.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([name])
        if _exists(spark, folder):
            held = spark.read.parquet(folder).filter(F.col("batch") != number)
            new = new.join(held.select(name), name, "left_anti")
        stored(new).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return add


def told_once(folder: str, send: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that hands a batch to ``send`` and marks its number after that: one that was sent isn't sent again."""

    def tell(batch: DataFrame, number: int) -> None:
        mark = f"{folder}/{number}"
        spark = batch.sparkSession
        if not _exists(spark, mark):
            send(batch, number)
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place).close()

    return tell
