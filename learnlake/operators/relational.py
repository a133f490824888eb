"""Filters, joins, summaries, windows and table maintenance as functions on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast once it has been counted.
BROADCAST_ROWS = 100_000


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Conjunction of the conditions that are given; None is skipped."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(and_, given)) if given else df


def optional(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def date_range(column: str, since=None, until=None) -> Column | None:
    """Inclusive on both ends; either may be open."""
    ends = [c for c in (F.col(column) >= F.lit(since) if since else None, F.col(column) <= F.lit(until) if until else None) if c is not None]
    return reduce(and_, ends) if ends else None


def contains_any(text: str | None, *columns: str) -> Column | None:
    """Substring search over several columns; % and _ in the text stay wildcards, as staff use them."""
    return None if not text else reduce(or_, [F.col(c).cast("string").ilike(f"%{text}%") for c in columns])


def page(df: DataFrame, *order: Column | str, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """One page of a totally ordered list; give a key as the last sort column."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(limit, most))


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """Each row with the number of rows; the count is an aggregate of one row beside the list."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))


def whitelist(df: DataFrame, *allowed: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c in allowed])


def required(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows with all required fields, rows for review with the reason)."""
    missing = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"missing {c}")) for c in columns]
    tagged = df.withColumn("problem", F.concat_ws("; ", *missing))
    return tagged.filter("problem = ''").drop("problem"), tagged.filter("problem <> ''")


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a count shows that it is small; else joined as the planner likes."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def days_of(*frames: DataFrame) -> DataFrame:
    """Distinct (student_id, date) over several activities."""
    return reduce(DataFrame.unionByName, [f.select("student_id", "date") for f in frames]).distinct()


def near_in_time(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: int) -> DataFrame:
    """Pairs with equal keys whose minutes differ by ``tolerance`` at most in every column; a missing side passes."""
    fits = [F.coalesce(F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= tolerance, F.lit(True)) for c in columns]
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    return left.alias("l").join(right.alias("r"), reduce(and_, [*same, *fits]))


def date_band(events: DataFrame, activities: DataFrame, days: int = 2) -> DataFrame:
    """Events with activities of the same student within ``days`` days, by an equi join on exploded days."""
    wide = events.withColumn("_day", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))))
    return wide.join(activities.withColumnRenamed("date", "_day"), ["student_id", "_day"]).withColumnRenamed("_day", "activity_date")


def exact_sum(c: Column | str, scale: int = 2) -> Column:
    """A sum of money or marks that doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast(f"decimal(18,{scale})") if isinstance(c, str) else c.cast(f"decimal(18,{scale})")).cast("double")


def most_common(df: DataFrame, keys: list[str], value: str, first_seen: str) -> DataFrame:
    """The commonest value of each group; of ties the one seen first."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(first_seen).alias("_seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "_seen")
    return counted.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_seen")


def trend(value: str, order: list[str], threshold: float) -> Column:
    """Struct of delta (last less first, two decimals) and label; with fewer than two values, no delta."""
    at = F.when(F.col(value).isNotNull(), F.struct(*[F.coalesce(F.col(c), F.lit("0001-01-01").cast("date")) if c == "date" else F.col(c) for c in order]))
    delta = F.when(F.count(value) > 1, F.round(F.max_by(value, at) - F.min_by(value, at), 2))
    label = F.when(delta.isNull(), F.lit("Insufficient data")).when(delta > threshold, F.lit("Improving")).when(delta < -threshold, F.lit("Declining")).otherwise(F.lit("Consistent"))
    return F.struct(delta.alias("delta"), label.alias("label"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each group: the first in the order given."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def at_most(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, which the planner limits before it shuffles."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)
    return ranked.withColumn("place", F.col("place").cast("long"))


def carried_down(value: Column, order: Window) -> Column:
    """The last value above that isn't null."""
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def islands(days: DataFrame) -> DataFrame:
    """Runs of consecutive days of each student: student_id, first, last and length."""
    w = Window.partitionBy("student_id").orderBy("date")
    runs = days.withColumn("_i", F.date_sub("date", F.row_number().over(w)))
    return runs.groupBy("student_id", "_i").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("length")).drop("_i")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows replace old ones of the same key; an anti join and a union."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def insert_new(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows whose key the old table lacks are added; of new rows with one key any one."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*new.columns), allowMissingColumns=True)


def overlay(old: DataFrame, changes: DataFrame, keys: list[str], allowed: Iterable[str]) -> DataFrame:
    """Partial updates: non-null fields of the allowed columns take effect."""
    fields = [c for c in changes.columns if c in set(allowed) - set(keys)]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    return old.join(renamed, keys, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def delete_restricted(table: DataFrame, doomed: DataFrame, key: str, *children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table without the doomed rows that nothing refers to, doomed rows that are referred to)."""
    used = reduce(DataFrame.unionByName, [c.select(key) for c in children]).distinct()
    refused = doomed.select(key).join(used, key, "left_semi")
    return table.join(doomed.select(key).join(refused, key, "left_anti"), key, "left_anti"), refused


def delete_cascade(table: DataFrame, doomed: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """The table and its children without the doomed rows."""
    return [t.join(doomed.select(key), key, "left_anti") for t in (table, *children)]


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: the number of rows and an order-free 128-bit sum of their hashes."""
    rows = df.select(F.xxhash64(*df.columns).alias("h"))
    low, high = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(low), F.lit(0)).alias("low"), F.coalesce(F.sum(high), F.lit(0)).alias("high"))


def touched(old: DataFrame, new: DataFrame, keys: list[str], now: Column, stamp: str = "updated_at") -> DataFrame:
    """new with ``stamp`` set to now where a row differs from the old one of its key, and kept where it doesn't."""
    rest = [c for c in new.columns if c not in (*keys, stamp)]
    before = old.select(*keys, F.struct(*rest).alias("_before"), F.col(stamp).alias("_stamp"))
    joined = new.drop(stamp).join(before, keys, "left")
    same = F.struct(*rest).eqNullSafe(F.col("_before"))
    return joined.withColumn(stamp, F.when(same, F.col("_stamp")).otherwise(now)).drop("_before", "_stamp")
