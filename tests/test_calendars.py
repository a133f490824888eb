"""Calendar bitmaps against a walk back from today."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from learnlake.operators import calendars

TODAY = dt.date(2024, 3, 15)


def closed(day, holidays):
    return day in holidays or day.weekday() == 6 or (day.weekday() == 5 and -(-day.day // 7) in (2, 4, 5))


def walked(mine, today, window, span, closures, holidays):
    back = [today - dt.timedelta(days=k) for k in range(span)]
    shut = lambda d: (closures and closed(d, holidays)) or d in holidays
    near = [d for d in back[:window] if not shut(d)]
    streak = 0
    for d in back:
        if shut(d):
            continue
        if d in mine:
            streak += 1
        elif d != today:
            break
    return len(near), sum(d in mine for d in near), streak


@pytest.mark.parametrize("today, closures, holidays", [
    (TODAY, True, ()), (dt.date(2024, 3, 17), True, ()), (TODAY, False, ()), (TODAY, True, (TODAY, dt.date(2024, 3, 11))), (TODAY, False, (dt.date(2024, 3, 14),)),
])
def test_statistics_equal_a_walk_back(spark, today, closures, holidays):
    rng, rows, want = random.Random(3), [], {}
    for student in range(40):
        back = [today - dt.timedelta(days=k) for k in range(900)]
        mine = {d for d in back if rng.random() < (0.3, 0.97, 1.0, 0.999)[student % 4]} - ({today} if student % 3 else set())
        mine |= {today + dt.timedelta(days=2), today - dt.timedelta(days=5000)}
        rows += [(student, d) for d in mine for _ in range(1 + rng.randrange(2))]
        want[student] = walked(mine, today, 45, 800, closures, holidays)
    got = calendars.statistics(spark.createDataFrame(rows, "student_id long, date date"), today, "student_id", window=45, span=800, closures=closures, holidays=holidays)
    assert {r["student_id"]: (r["open_days"], r["attended"], r["streak"]) for r in got.collect()} == want
    assert max(s for _, _, s in want.values()) > 300


def test_bitmaps_of_parts_unite_and_their_bits_are_counted(spark):
    days = [(k % 3, TODAY - dt.timedelta(days=k)) for k in range(200)] + [(0, None), (7, TODAY - dt.timedelta(days=9999))]
    df, counted = spark.createDataFrame(days, "k long, date date"), calendars.counted_days(spark, TODAY, 300, closures=False)
    whole = calendars.bitmaps(df, counted, "k")
    parts = [calendars.bitmaps(df.filter(F.coalesce(F.month("date") % 3, F.lit(0)) == m), counted, "k") for m in range(3)]
    united = calendars.united(parts[0].unionByName(parts[1]).unionByName(parts[2]), "k")
    assert whole.join(united, ["k", "bits"]).count() == 4 == united.count()
    assert {r["k"]: r["n"] for r in whole.select("k", calendars.first_bits(F.col("bits"), 10).alias("n")).collect()} == {0: 4, 1: 3, 2: 3, 7: 0}
    with pytest.raises(ValueError):
        calendars.counted_days(spark, TODAY, 40_000)


def test_no_days_and_no_open_days(spark):
    df = spark.createDataFrame([], "student_id long, date date")
    assert calendars.statistics(df, TODAY, "student_id").count() == 0
    one = spark.createDataFrame([(1, TODAY)], "student_id long, date date")
    r = calendars.statistics(one, TODAY, "student_id", window=1, span=1, closures=False, holidays=(TODAY,)).first()
    assert (r["open_days"], r["attended"], r["streak"], r["rate"]) == (0, 0, 0, None)
