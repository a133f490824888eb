"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnlake.session import shared_folder

#: Maps A-Z to a-z and leaves every other byte as it is.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: As ASCII_LOWER, and every ASCII byte that is neither letter nor digit becomes a space.
ALNUM_LOWER = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 8 << 20
#: Characters of text whose n-grams make one range of the hash, and ranges that a task takes at most on average.
RANGE_CHARS, RANGES_A_TASK = 8_000_000, 8


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches: rows of whole texts are held as bytes, as Arrow and as Python objects at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = int("".join(filter(str.isdigit, spark.conf.get(name))) or 0)
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def hash_ranges(docs: DataFrame) -> tuple[int, int]:
    """Partitions, and ranges of the n-grams' hash, for documents of this length; a task holds one range at a time."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ranges // RANGES_A_TASK)), ranges


def by_range(rows: DataFrame, parts: int, ranges: int) -> DataFrame:
    """Rows dealt by their range p, neighbours together, in the order of p within a partition."""
    return rows.repartitionById(parts, (F.col("p") * parts / ranges).cast("int")).sortWithinPartitions("p")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return shared_folder(spark)


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table that is broadcast at most.
BROADCAST_ROWS = 50_000


def checked_broadcast(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is counted to have few rows; else stored, so that it is joined as two plain
    exchanges, which adaptive execution can split for a hot key."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else materialize(df)


def release(spark: SparkSession) -> None:
    """Has shuffle files removed that lie behind a cut lineage.

    Spark's cleaner does so once the driver has collected the objects that
    stand for them, which on an idle driver may be never; on the executors'
    disks those files would stand beside the next phase's.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of df's, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"{stem}_{uuid.uuid4().hex[:6]}"
    return name


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def lower_words(text: str | None, table: bytes = ASCII_LOWER) -> list[bytes]:
    """The words of a text as UTF-8 after translating it by a byte table.

    bytes.split() cuts at space and \\t \\n \\v \\f \\r alone, so no byte of a
    non-ASCII letter is ever taken for a separator.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(table).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser on unsigned 64-bit arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(df: DataFrame, buckets: int = 4096) -> DataFrame:
    """All rows of df with ``row_no`` (0 to N-1) and ``n_rows`` (N).

    The number depends on the row's values alone, never on files, partitions
    or their order. Equal rows are counted before anything is shuffled, so a
    row that repeats for a third of the table is one group and not one task;
    it is spread out again at the end, 65,536 rows a chunk. The table of bucket
    starts has at most ``buckets`` rows, which bounds what is broadcast.
    """
    cols = df.columns
    count, bucket, size, start, inside, first, chunk_at, at = (unused_name(df, f"_{x}") for x in ("n", "bucket", "size", "from", "in", "first", "lo", "k"))
    hashed = F.pmod(F.xxhash64(*map(quoted, cols)), F.lit(buckets))
    groups = df.groupBy(*map(quoted, cols)).agg(F.count(F.lit(1)).alias(count)).withColumn(bucket, hashed)
    order = Window.partitionBy(bucket).orderBy(*[quoted(c).asc_nulls_first() for c in cols])
    starts = groups.groupBy(bucket).agg(F.sum(count).alias(size))
    running = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        bucket,
        F.coalesce(F.sum(size).over(running), F.lit(0)).alias(start),
        F.sum(size).over(Window.partitionBy()).alias("n_rows"),
    )
    before = F.coalesce(F.sum(count).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunk = 65_536
    placed = (
        groups.withColumn(inside, before)
        .join(F.broadcast(starts), bucket)
        .withColumn(first, F.col(start) + F.col(inside))
        .withColumn(chunk_at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(chunk).cast("long"))))
        .repartition(bucket, chunk_at)
        .withColumn(at, F.explode(F.sequence(F.col(chunk_at), F.least(F.col(chunk_at) + (chunk - 1), F.col(count) - 1))))
    )
    return placed.select(*map(quoted, cols), (F.col(first) + F.col(at)).alias("row_no"), "n_rows")


def in_order(df: DataFrame, by: list[str], size: str | None = None) -> tuple[DataFrame, int]:
    """df with ``row_no``, a row's place (from 0) in the order of the columns ``by``, nulls first, and the number of places.

    A row takes as many places as its column ``size`` says, one without it. The
    ranges are dealt by sampled bounds and stored once, so that all that follows
    sees the same ranges; each range numbers its own rows and only its total,
    one row a partition, is summed up in one task. Equal rows have equal bounds:
    they should have been counted into one row with a size.
    """
    part, base, before = (unused_name(df, f"_{x}") for x in ("part", "base", "before"))
    order = [quoted(c).asc_nulls_first() for c in by]
    places = F.lit(1).cast("long") if size is None else quoted(size).cast("long")
    ranged = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = ranged.groupBy(part).agg(F.sum(places).alias(before))
    running = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(part, F.coalesce(F.sum(before).over(running), F.lit(0)).alias(base), before)
    inside = F.coalesce(F.sum(places).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn(before, inside).join(F.broadcast(starts.select(part, base)), part)
    found = placed.select(*map(quoted, df.columns), (F.col(base) + F.col(before)).alias("row_no"))
    return found, totals.agg(F.sum(before)).first()[0] or 0
