"""Prefix scans over all rows of a table in one order, without a window over all rows.

The rows are dealt out in ranges of the order. Each range gives one row of
summaries; those, as many as there are ranges, are scanned in one small window,
and what a range gets from the ones before it is the start of its own scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlake.session import stored

#: Names of the columns that a scan adds for itself.
PART, BASE = "_part", "_base_"


def ranges(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges of ``order``, nulls first, with the number of each; written once, so that all that follows sees the same ranges."""
    columns = [F.col(c).asc_nulls_first() for c in order]
    return stored(df.repartitionByRange(*columns).withColumn(PART, F.spark_partition_id()))


def _with_base(ranged: DataFrame, part: str, summaries: dict[str, Column], carry) -> DataFrame:
    """Rows with what ``carry`` makes, for each summary, of the ranges before theirs."""
    totals = ranged.groupBy(part).agg(*[v.alias(c) for c, v in summaries.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(part, *[carry(c).over(before).alias(BASE + c) for c in summaries])
    return ranged.join(F.broadcast(starts), part)  # one row a range


def carried_down(ranged: DataFrame, values: dict[str, Column], *order: str, part: str = PART) -> DataFrame:
    """The rows with columns that hold the last value given at or above them, null above the first.

    ``ranged`` has its ranges numbered in ``part``, which rise with ``order``.
    """
    given = ranged.withColumns({f"_own_{c}": v for c, v in values.items()})
    place = F.struct(*order)
    last = {c: F.max_by(f"_own_{c}", F.when(F.col(f"_own_{c}").isNotNull(), place)) for c in values}
    met = _with_base(given, part, last, lambda c: F.last(c, ignorenulls=True))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(f"_own_{c}", ignorenulls=True).over(within), F.col(BASE + c)) for c in values}
    return met.withColumns(filled).drop(*[f"_own_{c}" for c in values], *[BASE + c for c in values])


def totals_before(ranged: DataFrame, values: dict[str, Column], *order: str, part: str = PART) -> DataFrame:
    """The rows with columns that hold the sums of values over all rows before them."""
    given = ranged.withColumns({f"_own_{c}": v for c, v in values.items()})
    met = _with_base(given, part, {c: F.sum(f"_own_{c}") for c in values}, lambda c: F.sum(c))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = {c: F.coalesce(F.sum(f"_own_{c}").over(within), zero) + F.coalesce(F.col(BASE + c), zero) for c in values}
    return met.withColumns(sums).drop(*[f"_own_{c}" for c in values], *[BASE + c for c in values])
