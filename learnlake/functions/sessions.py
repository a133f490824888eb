"""The three session rules, kept apart on purpose, and the punch fingerprint.

Minutes since midnight throughout. Lunch is from 13:00 to 14:00.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LUNCH, AFTER = 780, 840


def live_session(start: Column, end: Column) -> Column:
    """Sessions of live punches: an afternoon keeps lunch, and a visit that ends by 14:00 is a morning."""
    return F.when(start >= LUNCH, F.lit("Afternoon")).when(end.isNull() | (end <= AFTER), F.lit("Morning")).otherwise(F.lit("Full Day"))


def live_duration(start: Column, end: Column) -> Column:
    return (
        F.when(end.isNull(), F.lit(None).cast("int"))
        .when(start >= LUNCH, end - start)
        .when(end <= LUNCH, end - start)
        .when(end <= AFTER, LUNCH - start)
        .otherwise((LUNCH - start) + (end - AFTER))
    )


def batch_session(start: Column, end: Column) -> Column:
    """Sessions of loaded sheets: whoever stays beyond 13:00 from the morning has a full day."""
    return F.when(start >= LUNCH, F.lit("Afternoon")).when(end.isNull() | (end <= LUNCH), F.lit("Morning")).otherwise(F.lit("Full Day"))


def batch_duration(start: Column, end: Column) -> Column:
    """Elapsed minutes less the overlap with lunch."""
    return (end - start) - F.greatest(F.lit(0), F.least(end, F.lit(AFTER)) - F.greatest(start, F.lit(LUNCH)))


def cleaner_session(start: Column, end: Column) -> Column:
    """Sessions of the cleaning step; null without an arrival."""
    return (
        F.when(start.isNull(), F.lit(None).cast("string"))
        .when(end.isNull(), F.lit("open"))
        .when(start >= LUNCH, F.lit("afternoon"))
        .when(end <= LUNCH, F.lit("morning"))
        .otherwise(F.lit("full_day"))
    )


def fingerprint(serial: Column, user: Column, ts: Column, status: Column) -> Column:
    """serial|user|time to the second|status, which names a punch whatever way it came."""
    return F.concat_ws("|", serial, user.cast("string"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.coalesce(status, F.lit("")))
