"""Times of day as minutes since midnight, and the small sums made with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_hhmm(c: Column) -> Column:
    return c.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")


def minute_of(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def hhmm_minutes(c: Column) -> Column:
    """Minutes of an HH:MM text; null for any other."""
    return F.when(is_hhmm(c), F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 4, 2).cast("int"))


def to_hhmm(minutes: Column) -> Column:
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def parse_time(raw: Column) -> Column:
    """HH:MM from hours and minutes parted by : ; . or ", or from three or four digits; null out of range."""
    t = F.trim(raw)
    parted = r'^(\d{1,2})\s*[:;."]\s*(\d{1,2})(?:\D.*)?$'
    bare = r"^(\d{1,2})(\d{2})$"
    pick = lambda k: F.when(t.rlike(parted), F.regexp_extract(t, parted, k)).when(t.rlike(r"^\d{3,4}$"), F.regexp_extract(t, bare, k)).try_cast("int")
    h, m = pick(1), pick(2)
    return F.when(h.between(0, 23) & m.between(0, 59), to_hhmm(h * 60 + m))


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from one HH:MM to another; null unless both are valid."""
    return hhmm_minutes(end) - hhmm_minutes(start)


def percentage(marks: Column, most: Column) -> Column:
    """marks of most in percent, two decimals; null where either is missing or most is 0."""
    return F.round(F.try_divide(marks.cast("double"), most.cast("double")) * 100, 2)


OPEN, NOON = 9 * 60, 12 * 60


def repair_morning_slip(minutes: Column) -> Column:
    """An arrival before 08:00 was written without its afternoon: twelve hours later."""
    return F.when(minutes < 8 * 60, minutes + NOON).otherwise(minutes)


def repair_leaving_slip(start: Column, end: Column) -> Column:
    """A departure at or before the arrival and before 12:00 moves twelve hours on if the visit then lasts ten hours at most."""
    later = end + NOON
    return F.when((end <= start) & (end < NOON) & (later > start) & (later - start <= 600), later).otherwise(end)


def unswap(start: Column, end: Column) -> Column:
    """(start, end), exchanged where the end comes first and the start is 18:00 or later."""
    swap = (end < start) & (start >= 18 * 60)
    return F.struct(F.when(swap, end).otherwise(start).alias("start"), F.when(swap, start).otherwise(end).alias("end"))


def duration_label(minutes: Column) -> Column:
    """A dash, ``45m`` or ``2h 05m`` without the padding."""
    m = F.round(minutes).cast("int")
    hours = F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m"))
    return F.when(m.isNull(), F.lit("—")).when(m < 60, F.concat(m.cast("string"), F.lit("m"))).otherwise(hours)


def recover_decimal(raw: Column, most: Column) -> Column:
    """The first number of a text, where ``18:50`` means 18.50, if it lies between 0 and ``most``."""
    n = F.regexp_extract(F.regexp_replace(raw, r"(\d)\s*:\s*(\d)", "$1.$2"), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(n.between(0, most), n)
