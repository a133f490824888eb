"""Comparison of two copies of a table by trees of digests, and summaries that follow from it.

A copy is written once in buckets of its key, with the digests of the buckets
and of groups of 16 of them up to the root. Digests are sums of row hashes, so
a parent's is the sum of its children's. Two copies are compared from the root
down, and only under nodes that differ; rows are read of differing buckets alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlake.session import stored

#: Children of a node, and levels below the root: 16 ** 2 buckets.
FAN, LEVELS = 16, 2
#: Name of the bucket's column in stored copies.
BUCKET = "_bucket"


def bucket_of(*key: str, levels: int = LEVELS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(FAN**levels)).cast("int")


def levels_for(rows: int, most: int = 1_000_000) -> int:
    """Levels below the root, one at least, at which a bucket has ``most`` rows on average or fewer."""
    levels = 1
    while FAN**levels * most < rows:
        levels += 1
    return levels


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Rows dealt by bucket over as many tasks as the session shuffles to: small ones aren't put together, as each bucket is a file."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), BUCKET)


def write_copy(df: DataFrame, folder: str, *key: str, levels: int = LEVELS) -> None:
    """df in buckets of its key under folder/rows, its digests under folder/tree."""
    columns = sorted(df.columns)
    rows = df.withColumn(BUCKET, bucket_of(*key, levels=levels))
    _by_bucket(rows).write.partitionBy(BUCKET).parquet(f"{folder}/rows")
    spark = df.sparkSession
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    kept = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    leaves = stored(kept.groupBy(F.col(BUCKET).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("one"), F.sum(two.cast("decimal(38,0)")).alias("two")))
    tree = leaves.withColumn("level", F.lit(levels))
    for k in range(levels):
        up = leaves.groupBy(F.floor(F.col("node") / FAN ** (levels - k)).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
        tree = tree.unionByName(up.withColumn("level", F.lit(k)))
    tree.coalesce(1).write.parquet(f"{folder}/tree")  # some 16 ** levels rows


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("node int, n long, one decimal(38,0), two decimal(38,0), level int").parquet(f"{folder}/tree")


def differing(spark: SparkSession, a: str, b: str, levels: int = LEVELS) -> list[int]:
    """The buckets, 16 ** levels at most, in which two copies differ; found from the root down."""
    nodes = [0]
    for k in range(levels + 1):
        at = lambda folder: _tree(spark, folder).filter((F.col("level") == k) & F.col("node").isin(nodes))  # noqa: E731, B023
        old, new = at(a).alias("a"), at(b).alias("b")
        same = F.struct("a.n", "a.one", "a.two").eqNullSafe(F.struct("b.n", "b.one", "b.two"))
        met = old.join(new, F.col("a.node") == F.col("b.node"), "full").filter(~same | F.col("a.node").isNull() | F.col("b.node").isNull())
        found = sorted(r[0] for r in met.select(F.coalesce("a.node", "b.node")).collect())
        if not found or k == levels:
            return found
        nodes = [n * FAN + c for n in found for c in range(FAN)]
    return []


def rows_in(spark: SparkSession, folder: str, buckets: list[int], schema) -> DataFrame:
    """The rows of a copy's buckets; no file of any other is opened."""
    full = spark.read.schema(schema).parquet(f"{folder}/rows") if buckets else spark.createDataFrame([], schema)
    return full.filter(F.col(BUCKET).isin(buckets)) if buckets else full


def differences(spark: SparkSession, a: str, b: str, schema: str, *key: str, levels: int = LEVELS) -> DataFrame:
    """key and kind (added, removed, changed) of the keys, unique in each copy, that differ between copies a and b; ``schema`` is the table's."""
    buckets = differing(spark, a, b, levels)
    held = f"{schema}, {BUCKET} int"
    rest = [c for c in spark.createDataFrame([], schema).columns if c not in key]
    side = lambda folder, name: rows_in(spark, folder, buckets, held).select(*key, F.struct(F.lit(1).alias("here"), *rest).alias(name))
    met = side(a, "old").join(side(b, "new"), list(key), "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return met.select(*key, kind.alias("kind")).filter("kind is not null")


def refresh(spark: SparkSession, state: str, old: str, new: str, schema: str, summary: Callable[[DataFrame], DataFrame], *key: str, levels: int = LEVELS) -> list[int]:
    """Brings a stored summary (a row a key, in the buckets of the copies) from copy old to copy new; returns the buckets that were worked out again.

    ``summary`` makes it from facts, with ``n``, the number of a key's facts.
    Keys that have no facts left stay with n = 0, so that every bucket that
    changed is written; ``read_summary`` leaves them out. Of an unchanged table no fact is read. A second run after a failure
    writes the same buckets again.
    """
    buckets = differing(spark, old, new, levels)
    if buckets:
        held = f"{schema}, {BUCKET} int"
        made = summary(rows_in(spark, new, buckets, held))
        gone = rows_in(spark, old, buckets, held).select(*key).distinct().join(made, list(key), "left_anti").withColumn("n", F.lit(0).cast("long"))
        rows = stored(made.unionByName(gone, allowMissingColumns=True).withColumn(BUCKET, bucket_of(*key, levels=levels)))
        _by_bucket(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(state)
    return buckets


def write_summary(copy: DataFrame, state: str, summary: Callable[[DataFrame], DataFrame], *key: str, levels: int = LEVELS) -> None:
    """The summary of a whole copy, to be refreshed later."""
    made = summary(copy).withColumn(BUCKET, bucket_of(*key, levels=levels))
    _by_bucket(made).write.mode("overwrite").partitionBy(BUCKET).parquet(state)


def read_summary(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(state).filter("n > 0").drop(BUCKET)
