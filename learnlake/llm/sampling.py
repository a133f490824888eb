"""Bounded samples for fitting the small models of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents whose labels are never learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def pick(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct doc_ids, always the same ones: those with the smallest hashes."""
    named = ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
