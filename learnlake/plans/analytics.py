"""Per-student analytics, for all students at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnlake.functions import dates
from learnlake.operators import calendars
from learnlake.operators import punches as machine
from learnlake.operators import relational as rel
from learnlake.plans.registry import query
from learnlake.sources import roles
from learnlake.sources.roles import TODAY_EVENTS, with_roles

_DAYS = "days AS (SELECT DISTINCT student_id, CAST(punch_time AS DATE) AS date FROM punches)"
_OPEN = """open_days AS (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) t(d)
    WHERE NOT (dayofweek(d) = 0 OR (dayofweek(d) = 6 AND ceil(day(d) / 7.0) IN (2, 4, 5))))"""


def _days(spark, sf_dir) -> DataFrame:
    return roles.punches(spark, sf_dir).select("student_id", F.to_date("punch_time").alias("date")).distinct()


def open_days(spark, since, until) -> DataFrame:
    """The days of a range on which the centre is open."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("date"))
    return d.filter(~dates.is_weekly_closure(F.col("date")))


_TREND = """CASE WHEN delta IS NULL THEN 'Insufficient data' WHEN delta > 5 THEN 'Improving' WHEN delta < -5 THEN 'Declining' ELSE 'Consistent' END"""


@query(with_roles(f"SELECT student_id, n, delta, {_TREND} AS trend FROM (SELECT student_id, count(*) AS n, CASE WHEN count(marks) > 1 THEN round(arg_max(marks * 2, (date, o_orderkey, line, exam_id, marks)) - arg_min(marks * 2, (date, o_orderkey, line, exam_id, marks)), 2) END AS delta FROM marks GROUP BY 1)", "marks"))
def trend_per_student(spark, sf_dir):
    """Last score less the first, without a window."""
    m = roles.marks(spark, sf_dir).withColumn("percent", F.col("marks") * 2)
    t = m.groupBy("student_id").agg(F.count(F.lit(1)).alias("n"), rel.trend("percent", ["date", "o_orderkey", "line", "exam_id", "marks"], 5).alias("t"))
    return t.select("student_id", "n", F.col("t.delta").alias("delta"), F.col("t.label").alias("trend"))


@query(with_roles(f"SELECT student_id, subject, n, mean, delta, {_TREND} AS trend FROM (SELECT student_id, subject, count(*) AS n, round(avg(marks * 2), 2) AS mean, CASE WHEN count(marks) > 1 THEN round(arg_max(marks * 2, (date, o_orderkey, line, exam_id, marks)) - arg_min(marks * 2, (date, o_orderkey, line, exam_id, marks)), 2) END AS delta FROM marks JOIN exams USING (exam_id) GROUP BY ALL)", "marks", "exams"))
def trend_per_subject(spark, sf_dir):
    """Count, mean and trend by student and subject."""
    m = roles.marks(spark, sf_dir).withColumn("percent", F.col("marks") * 2).join(roles.exams(spark, sf_dir).select("exam_id", "subject"), "exam_id")
    t = m.groupBy("student_id", "subject").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("percent"), 2).alias("mean"), rel.trend("percent", ["date", "o_orderkey", "line", "exam_id", "marks"], 5).alias("t"))
    return t.select("student_id", "subject", "n", "mean", F.col("t.delta").alias("delta"), F.col("t.label").alias("trend"))


@query(with_roles(f"SELECT student_id, round(count(*) FILTER (WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') * 100.0 / 30, 2) AS rate FROM days GROUP BY 1", "punches").replace("WITH ", f"WITH ", 1).replace(" SELECT student_id, round", f", {_DAYS} SELECT student_id, round", 1))
def attendance_rate_30d(spark, sf_dir):
    """Attended days of the last thirty, in percent."""
    inside = F.col("date").between(F.date_sub(F.lit(TODAY_EVENTS), 29), F.lit(TODAY_EVENTS))
    return _days(spark, sf_dir).groupBy("student_id").agg(F.round(F.count_if(inside) * 100.0 / 30, 2).alias("rate"))


@query(with_roles(f"SELECT student_id, CAST(CASE WHEN DATE '2024-01-30' - max(last) <= 1 THEN arg_max(length, last) ELSE 0 END AS BIGINT) AS streak FROM (SELECT student_id, max(date) AS last, count(*) AS length FROM (SELECT student_id, date, date - CAST(row_number() OVER (PARTITION BY student_id ORDER BY date) AS INTEGER) AS i FROM days) GROUP BY student_id, i) GROUP BY 1", "punches").replace(" SELECT student_id, CAST(CASE", f", {_DAYS} SELECT student_id, CAST(CASE", 1))
def current_streak(spark, sf_dir):
    """Days in a row that end at the last visit, if that was yesterday or later."""
    runs = rel.islands(_days(spark, sf_dir))
    alive = F.datediff(F.lit(TODAY_EVENTS), F.max("last")) <= 1
    return runs.groupBy("student_id").agg(F.when(alive, F.max_by("length", "last")).otherwise(F.lit(0)).alias("streak"))


@query(with_roles("SELECT student_id, count(o.date) AS attended, round(count(o.date) * 100.0 / (SELECT count(*) FROM open_days), 2) AS rate FROM days LEFT JOIN open_days o USING (date) GROUP BY 1", "punches").replace(" SELECT student_id, count(o.date)", f", {_DAYS}, {_OPEN} SELECT student_id, count(o.date)", 1))
def holiday_rate(spark, sf_dir):
    """Attended open days among the open days; the calendar has one row a day and is broadcast."""
    cal = open_days(spark, "2024-01-01", "2024-01-30").withColumn("open", F.lit(1))
    total = cal.agg(F.count(F.lit(1)).alias("all"))
    d = _days(spark, sf_dir).join(F.broadcast(cal), "date", "left").groupBy("student_id").agg(F.count("open").alias("attended"))
    return d.crossJoin(F.broadcast(total)).select("student_id", "attended", F.round(F.col("attended") * 100.0 / F.col("all"), 2).alias("rate"))


@query(with_roles("""SELECT s.student_id, count(*) FILTER (WHERE o.date > coalesce(s.missed, DATE '1900-01-01') AND d.date IS NOT NULL) AS streak FROM (SELECT k.student_id, max(o.date) FILTER (WHERE d.date IS NULL AND o.date <> DATE '2024-01-30') AS missed
    FROM (SELECT DISTINCT student_id FROM days) k CROSS JOIN open_days o LEFT JOIN days d ON d.student_id = k.student_id AND d.date = o.date GROUP BY 1) s CROSS JOIN open_days o LEFT JOIN days d ON d.student_id = s.student_id AND d.date = o.date GROUP BY 1""", "punches").replace(" SELECT s.student_id, count(*)", f", {_DAYS}, {_OPEN} SELECT s.student_id, count(*)", 1))
def holiday_streak(spark, sf_dir):
    """Open days in a row up to today; closed days are skipped and today may still be missing.

    Open days are numbered back from today. A student's own days are ranked
    likewise, so the run lasts as long as number and rank keep step; no student
    is crossed with the calendar.
    """
    cal = open_days(spark, "2024-01-01", "2024-01-30").withColumn("back", F.row_number().over(Window.orderBy(F.desc("date"))))
    today_open = cal.filter(F.col("date") == F.lit(TODAY_EVENTS)).agg(F.count(F.lit(1)).alias("today_open"))
    mine = _days(spark, sf_dir).join(F.broadcast(cal), "date", "left")
    w = Window.partitionBy("student_id").orderBy(F.desc("date"))
    ranked = mine.filter("back is not null").withColumn("rank", F.row_number().over(w)).withColumn("first", F.max("date").over(Window.partitionBy("student_id")))
    ranked = ranked.crossJoin(F.broadcast(today_open))
    skip = F.when((F.col("today_open") == 1) & (F.col("first") < F.lit(TODAY_EVENTS)), 1).otherwise(0)
    runs = ranked.groupBy("student_id").agg(F.count_if(F.col("back") - skip == F.col("rank")).alias("streak"))
    return _days(spark, sf_dir).select("student_id").distinct().join(runs, "student_id", "left").select("student_id", F.coalesce("streak", F.lit(0)).alias("streak"))


@query(with_roles("SELECT student_id, date, CASE WHEN d.student_id IS NOT NULL AND c.present THEN 'present' WHEN NOT c.open THEN 'closed' ELSE 'absent' END AS status FROM (SELECT k.student_id, CAST(g.d AS DATE) AS date, NOT (dayofweek(g.d) = 0 OR (dayofweek(g.d) = 6 AND ceil(day(g.d) / 7.0) IN (2, 4, 5))) AS open, EXISTS (SELECT 1 FROM days x WHERE x.student_id = k.student_id AND x.date = CAST(g.d AS DATE)) AS present FROM (SELECT DISTINCT student_id FROM days WHERE student_id < 50) k CROSS JOIN generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) g(d)) c LEFT JOIN (SELECT DISTINCT student_id FROM days) d USING (student_id)", "punches").replace(" SELECT student_id, date, CASE", f", {_DAYS} SELECT student_id, date, CASE", 1).replace(" WHERE student_id < 50", ""))
def calendar_status(spark, sf_dir):
    """A month of days for every student: present, closed or absent."""
    mine = _days(spark, sf_dir)
    month = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    grid = mine.select("student_id").distinct().withColumn("date", F.explode(month))
    joined = grid.join(mine.withColumn("present", F.lit(True)), ["student_id", "date"], "left")
    return joined.select("student_id", "date", F.when(F.col("present"), "present").when(dates.is_weekly_closure(F.col("date")), "closed").otherwise("absent").alias("status"))


@query(with_roles("SELECT student_id, date_trunc('week', date)::DATE AS week, count(*) AS n, round(avg(minutes), 2) AS mean FROM usage GROUP BY ALL", "usage"))
def weekly_means(spark, sf_dir):
    """Means by weeks that start on Monday."""
    u = roles.usage(spark, sf_dir)
    return u.groupBy("student_id", dates.monday(F.col("date")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("minutes"), 2).alias("mean"))


@query(with_roles("SELECT s.student_id, s.date, s.minutes AS attended, greatest(s.minutes - coalesce(c.minutes, 0) - coalesce(v.minutes, 0), 0) AS estimated FROM (SELECT student_id, date, CAST(sum(minutes) AS BIGINT) AS minutes FROM sessions GROUP BY ALL) s LEFT JOIN (SELECT student_id, CAST(punch_time AS DATE) AS date, count(*) * 20 AS minutes FROM punches WHERE status = 'click' GROUP BY ALL) c USING (student_id, date) LEFT JOIN (SELECT student_id, CAST(punch_time AS DATE) AS date, count(*) * 5 AS minutes FROM punches WHERE status = 'view' GROUP BY ALL) v USING (student_id, date)", "sessions"))
def estimated_minutes(spark, sf_dir):
    """Study time by elimination; each source is summed to a row a day before it is joined."""
    p = roles.punches(spark, sf_dir)
    att = machine.attendance(p).groupBy("student_id", "date").agg(F.sum("minutes").alias("attended"))
    other = p.groupBy("student_id", F.to_date("punch_time").alias("date")).agg((F.count_if(F.col("status") == "click") * 20 + F.count_if(F.col("status") == "view") * 5).alias("used"))
    joined = att.join(other, ["student_id", "date"], "left")
    return joined.select("student_id", "date", "attended", F.greatest(F.col("attended") - F.coalesce("used", F.lit(0)), F.lit(0)).alias("estimated"))


@query(with_roles(f"""SELECT s.student_id, s.name, coalesce(m.exams, 0) AS exams, m.mean, coalesce(u.sessions, 0) AS sessions, coalesce(u.minutes, 0) AS minutes, u.last, m.delta, CASE WHEN m.exams IS NULL THEN 'Insufficient data' ELSE {_TREND} END AS trend
    FROM students s LEFT JOIN (SELECT student_id, count(*) AS exams, round(avg(marks * 2), 2) AS mean, CASE WHEN count(marks) > 1 THEN round(arg_max(marks * 2, (date, o_orderkey, line, exam_id, marks)) - arg_min(marks * 2, (date, o_orderkey, line, exam_id, marks)), 2) END AS delta FROM marks GROUP BY 1) m USING (student_id)
    LEFT JOIN (SELECT student_id, count(*) AS sessions, CAST(sum(minutes) AS BIGINT) AS minutes, max(date) AS last FROM usage GROUP BY 1) u USING (student_id)""", "students", "marks", "usage"))  # fmt: skip
def dashboard_flat(spark, sf_dir):
    """Every student's dashboard row: facts are reduced to one row a student, then joined on that key."""
    m = roles.marks(spark, sf_dir).withColumn("percent", F.col("marks") * 2)
    m = m.groupBy("student_id").agg(F.count(F.lit(1)).alias("exams"), F.round(F.avg("percent"), 2).alias("mean"), rel.trend("percent", ["date", "o_orderkey", "line", "exam_id", "marks"], 5).alias("t"))
    u = roles.usage(spark, sf_dir).groupBy("student_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("minutes").alias("minutes"), F.max("date").alias("last"))
    joined = roles.students(spark, sf_dir).select("student_id", "name").join(m, "student_id", "left").join(u, "student_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("student_id", "name", zero("exams"), "mean", zero("sessions"), zero("minutes"), "last", F.col("t.delta").alias("delta"), F.coalesce("t.label", F.lit("Insufficient data")).alias("trend"))


_YEARS = """SELECT k.instructor_id, (SELECT count(*) FROM near) AS open_days, count(DISTINCT n.date) AS attended, round(count(DISTINCT n.date) * 100.0 / (SELECT count(*) FROM near), 2) AS rate, any_value(s.streak) AS streak
    FROM (SELECT DISTINCT instructor_id FROM marks) k JOIN (SELECT r.instructor_id, count(*) FILTER (WHERE c.date > coalesce(r.missed, DATE '1900-01-01') AND d.date IS NOT NULL) AS streak FROM
        (SELECT k.instructor_id, max(c.date) FILTER (WHERE d.date IS NULL AND c.date <> DATE '1997-06-30') AS missed FROM (SELECT DISTINCT instructor_id FROM marks) k CROSS JOIN cal c LEFT JOIN own d ON d.instructor_id = k.instructor_id AND d.date = c.date GROUP BY 1) r
        CROSS JOIN cal c LEFT JOIN own d ON d.instructor_id = r.instructor_id AND d.date = c.date GROUP BY 1) s ON s.instructor_id = k.instructor_id
    LEFT JOIN own o ON o.instructor_id = k.instructor_id LEFT JOIN near n ON n.date = o.date GROUP BY 1"""
_CALENDAR = """cal AS (SELECT date FROM (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1997-06-30' - 3649, DATE '1997-06-30', INTERVAL 1 DAY) g(d)) WHERE NOT (dayofweek(date) = 0 OR (dayofweek(date) = 6 AND ceil(day(date) / 7.0) IN (2, 4, 5))) AND date <> DATE '1997-05-01'),
    near AS (SELECT date FROM cal WHERE date > DATE '1997-06-30' - 365), own AS (SELECT DISTINCT instructor_id, date FROM marks)"""


@query(with_roles(_YEARS, "marks").replace(" SELECT k.instructor_id, (SELECT", f", {_CALENDAR} SELECT k.instructor_id, (SELECT", 1))
def attendance_years(spark, sf_dir):
    """Rate of a year and streak over ten years of open days, by bitmaps."""
    m = roles.marks(spark, sf_dir).select("instructor_id", "date")
    return calendars.statistics(m, dt.date(1997, 6, 30), "instructor_id", window=365, holidays=(dt.date(1997, 5, 1),))
