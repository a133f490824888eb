"""Attendance over years of calendar as bitmaps: a bit a day, counted back from today.

The days that count are numbered once, the latest with 0. A student's days then
are one bitmap, built in a single aggregation that needs no distinct days and
no order; bitmaps of parts of the history unite to that of the whole. Streaks
and rates are bit operations on it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlake.functions import dates

#: Days that a streak is followed back at most (a fixed value), and days that a bitmap of Spark holds.
SPAN, MOST_DAYS = 3650, 32_768


def counted_days(spark: SparkSession, today: dt.date, span: int = SPAN, closures: bool = True, holidays: tuple[dt.date, ...] = ()) -> DataFrame:
    """date and back of the days that count up to today, ``span`` days in all: without weekly closures and holidays, if they are to be left out.

    One row a day, so it may be broadcast whatever the facts' size.
    """
    if not 0 < span <= MOST_DAYS:
        raise ValueError(f"a bitmap holds 1 to {MOST_DAYS} days, not {span}")
    days = spark.range(span).select(F.date_sub(F.lit(today), F.col("id").cast("int")).alias("date"), F.col("id").alias("ago"))
    if closures:
        days = days.filter(~dates.is_weekly_closure(F.col("date")))
    if holidays:
        days = days.filter(~F.col("date").isin(*holidays))
    days = days.groupBy().agg(F.sort_array(F.collect_list(F.struct("ago", "date"))).alias("days"))
    return days.select(F.posexplode("days").alias("back", "day")).select("day.date", "back", "day.ago")


def bitmaps(days: DataFrame, counted: DataFrame, *keys: str) -> DataFrame:
    """keys and ``bits`` of every key of days (keys, date): whether each counted day is among its days."""
    met = days.join(F.broadcast(counted.select("date", "back")), "date", "left")
    return met.groupBy(*keys).agg(F.bitmap_construct_agg("back").alias("bits"))


def united(maps: DataFrame, *keys: str) -> DataFrame:
    """The bitmaps of parts of a history, as one a key."""
    return maps.groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits"))


def _byte(bits: Column, k: Column) -> Column:
    """Byte k, from 0, as a number; 0 beyond the end."""
    return F.coalesce(F.conv(F.hex(F.substring(bits, k.cast("int") + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))


def first_bits(bits: Column, n: int) -> Column:
    """How many of the first n bits are set."""
    whole = F.bitmap_count(F.substring(bits, F.lit(1), F.lit(n // 8)))
    return whole + F.bit_count(_byte(bits, F.lit(n // 8)).bitwiseAND(2 ** (n % 8) - 1))


def leading_run(bits: Column) -> Column:
    """How many bits are set before the first that is not."""
    whole = F.floor(F.length(F.regexp_extract(F.hex(bits), "^(?:FF)*+", 0)) / 2)
    byte = _byte(bits, whole)
    return whole * 8 + F.bit_count(byte.bitwiseXOR(byte + 1)) - 1


def run_with(bits: Column, open_today: bool) -> Column:
    """The run up to today; where today counts it may still be missing, as the day isn't over."""
    if not open_today:
        return leading_run(bits)
    here = _byte(bits, F.lit(0)).bitwiseAND(1)
    first = F.unhex(F.lpad(F.hex(_byte(bits, F.lit(0)).bitwiseOR(1)), 2, "0"))
    return leading_run(F.concat(first, F.substring(bits, F.lit(2), F.length(bits)))) - F.when(here == 1, 0).otherwise(1)


def statistics(days: DataFrame, today: dt.date, *keys: str, window: int = 30, span: int = SPAN, closures: bool = True, holidays: tuple[dt.date, ...] = ()) -> DataFrame:
    """keys, open_days and attended of the last ``window`` days, rate in percent (null without open days) and streak up to today."""
    spark = days.sparkSession
    counted = counted_days(spark, today, span, closures, holidays)
    near, open_today = counted.agg(F.count_if(F.col("ago") < window), F.count_if(F.col("ago") == 0)).first()
    attended = first_bits(F.col("bits"), near)
    found = bitmaps(days, counted, *keys).select(*keys, F.lit(near).cast("long").alias("open_days"), attended.cast("long").alias("attended"), run_with(F.col("bits"), bool(open_today)).cast("long").alias("streak"))
    return found.withColumn("rate", F.when(F.col("open_days") > 0, F.round(F.col("attended") * 100.0 / F.col("open_days"), 2)))
