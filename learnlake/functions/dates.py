"""Date expressions. ``today`` is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-digit years up to this belong to this century.
PIVOT = 26


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_date(raw: Column, today: Column | None = None, clamp_day: bool = False, min_year: int = 1900, max_year: int = 2100) -> Column:
    """Day, month and year from the first three runs of digits; null where they make no date.

    Two-digit years up to PIVOT are 20xx, others 19xx. With ``clamp_day`` a day
    beyond its month's end becomes the last one; with ``today`` a later date is
    refused.
    """
    runs = F.regexp_extract_all(raw, F.lit(r"(\d+)"), 1)
    at = lambda k: F.try_element_at(runs, F.lit(k)).try_cast("int")
    day, month, year = at(1), at(2), at(3)
    year = F.when((year < 100) & (year <= PIVOT), year + 2000).when(year < 100, year + 1900).otherwise(year)
    if clamp_day:
        last = F.day(F.last_day(_date(year, month, F.lit(1))))
        day = F.when((day >= 1) & (day <= 31), F.least(day, last))
    found = F.when(year.between(min_year, max_year) & month.between(1, 12) & day.between(1, 31), _date(year, month, day))
    return found if today is None else F.when(found <= today, found)


def parse_section_date(raw: Column) -> Column:
    """Exactly three parts once : / and - are dots; day, month, year."""
    parts = F.split(F.translate(F.trim(raw), ":/-", "..."), r"\.")
    return F.when(F.size(parts) == 3, parse_date(raw))


def add_years(d: Column, years: Column) -> Column:
    """Feb 29 becomes Feb 28 in a common year."""
    return F.add_months(d, (years * 12).cast("int"))


def years_gap(later: Column, earlier: Column) -> Column:
    """Started years between two dates, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.datediff(later, earlier) / 365.25)).cast("int")


def renewals_needed(join_date: Column, until: Column) -> Column:
    """The smallest n for which join_date plus n + 1 years is not before ``until``."""
    years = F.year(until) - F.year(join_date)
    return F.greatest(F.when((years > 0) & (add_years(join_date, years) >= until), years - 1).otherwise(years), F.lit(0)).cast("int")


def is_weekly_closure(d: Column) -> Column:
    """Sundays, and the second, fourth and fifth Saturday of a month."""
    return (F.dayofweek(d) == 1) | ((F.dayofweek(d) == 7) & F.ceil(F.dayofmonth(d) / 7).isin(2, 4, 5))


def monday(d: Column) -> Column:
    return F.to_date(F.date_trunc("week", d))


def sunday(d: Column) -> Column:
    return F.date_sub(d, F.dayofweek(d) - 1)


def local_date(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """The calendar day of a UTC time in the centre's zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def days_until(d: Column, today: Column) -> Column:
    return F.datediff(d, today)


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")
