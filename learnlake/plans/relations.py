"""Joins, set operations and aggregates over several tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from learnlake.operators import punches as machine
from learnlake.operators import relational as rel
from learnlake.plans.registry import query
from learnlake.sources import roles
from learnlake.sources.roles import with_roles


@query(with_roles("SELECT s.student_id, name, date, session, m_in, m_out, minutes FROM sessions JOIN students s USING (student_id)", "sessions", "students"))
def extract_attendance(spark, sf_dir):
    """Attendance with names."""
    a = machine.attendance(roles.punches(spark, sf_dir))
    return a.join(roles.students(spark, sf_dir).select("student_id", "name"), "student_id").select("student_id", "name", "date", "session", "m_in", "m_out", "minutes")


@query(with_roles("SELECT usage_id, u.student_id, s.name, platform, coalesce(CAST(minutes AS VARCHAR), '') AS minutes, coalesce(e.name, 'Self-study') AS book FROM usage u JOIN students s USING (student_id) LEFT JOIN exams e ON e.exam_id = u.usage_id", "usage", "students", "exams"))
def extract_usage(spark, sf_dir):
    """Usage with an optional book; no book is self-study."""
    u, s = roles.usage(spark, sf_dir), roles.students(spark, sf_dir).select("student_id", "name")
    books = roles.exams(spark, sf_dir).select(F.col("exam_id").alias("usage_id"), F.col("name").alias("title"))
    joined = u.join(s, "student_id").join(books, "usage_id", "left")
    return joined.select("usage_id", "student_id", "name", "platform", F.coalesce(F.col("minutes").cast("string"), F.lit("")).alias("minutes"), F.coalesce("title", F.lit("Self-study")).alias("book"))


@query(with_roles("SELECT m.student_id, s.name, e.name AS exam, subject, marks, round(marks * 100.0 / 50, 2) AS percent, date FROM marks m JOIN students s USING (student_id) JOIN exams e USING (exam_id)", "marks", "students", "exams"))
def extract_exams(spark, sf_dir):
    """Three tables; names come last, after the wide fact."""
    m = roles.marks(spark, sf_dir)
    joined = m.join(roles.students(spark, sf_dir).select("student_id", "name"), "student_id").join(roles.exams(spark, sf_dir).select("exam_id", F.col("name").alias("exam"), "subject"), "exam_id")
    return joined.select("student_id", "name", "exam", "subject", "marks", F.round(F.col("marks") * 100.0 / 50, 2).alias("percent"), "date")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN c_name ELSE s_name END AS participant, CASE WHEN l_linenumber % 2 = 0 THEN 'library' ELSE 'external' END AS kind FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def roster_coalesce(spark, sf_dir):
    """A roster of students or outside participants; the one that is there names the row."""
    t = lambda n: roles.table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    own = F.col("l_linenumber") % 2 == 0
    rows = rows.withColumn("student_id", F.when(own, F.col("o_custkey"))).withColumn("external_id", F.when(~own, F.col("l_suppkey")))
    rows = rows.join(t("customer").select(F.col("c_custkey").alias("student_id"), "c_name"), "student_id", "left").join(t("supplier").select(F.col("s_suppkey").alias("external_id"), "s_name"), "external_id", "left")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("c_name", "s_name").alias("participant"), F.when(own, F.lit("library")).otherwise(F.lit("external")).alias("kind"))


@query(with_roles("SELECT student_id, name FROM students WHERE student_id IN (SELECT student_id FROM punches WHERE CAST(punch_time AS DATE) = DATE '2024-01-30')", "students", "punches"))
def present_semi(spark, sf_dir):
    """Students who punched today; the day is a range that reaches the scan."""
    day = F.lit(roles.TODAY_EVENTS).cast("timestamp")
    today = roles.punches(spark, sf_dir).filter((F.col("punch_time") >= day) & (F.col("punch_time") < day + F.expr("interval 1 day")))
    return roles.students(spark, sf_dir).join(today, "student_id", "left_semi").select("student_id", "name")


@query(with_roles("SELECT DISTINCT student_id, date FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM (SELECT student_id, CAST(punch_time AS DATE) AS date FROM punches WHERE status = 'click' UNION ALL SELECT student_id, CAST(punch_time AS DATE) FROM punches WHERE status = 'purchase') a WHERE a.student_id = s.student_id AND a.date = s.date)", "sessions"))
def no_activity_anti(spark, sf_dir):
    """Attended days without another activity, which count as self-study."""
    p = roles.punches(spark, sf_dir).withColumn("date", F.to_date("punch_time"))
    active = rel.days_of(p.filter("status = 'click'"), p.filter("status = 'purchase'"))
    return machine.attendance(p).select("student_id", "date").distinct().join(active, ["student_id", "date"], "left_anti")


@query(with_roles("SELECT exam_id, count(o_orderkey) AS uses FROM exams LEFT JOIN marks USING (exam_id) GROUP BY 1", "exams", "marks"))
def books_left_count(spark, sf_dir):
    """Uses of each book, 0 for the unused; counted before the join, so titles don't travel."""
    counts = roles.marks(spark, sf_dir).groupBy("exam_id").agg(F.count("o_orderkey").alias("uses"))
    return roles.exams(spark, sf_dir).select("exam_id").join(counts, "exam_id", "left").select("exam_id", F.coalesce("uses", F.lit(0)).alias("uses"))


@query(with_roles("SELECT a.student_id, a.date, a.session, b.session AS other, b.m_in, b.m_out FROM sessions a JOIN (SELECT student_id, date, session, m_in + 1 AS m_in, CASE WHEN m_out % 3 = 0 THEN NULL ELSE m_out + (m_out % 4) END AS m_out FROM sessions) b ON a.student_id = b.student_id AND a.date = b.date AND abs(a.m_in - b.m_in) <= 2 AND coalesce(abs(a.m_out - b.m_out) <= 2, true)", "sessions"))
def tolerance_join(spark, sf_dir):
    """The same visit told by two sources, two minutes apart at most."""
    a = machine.attendance(roles.punches(spark, sf_dir))
    other = a.select("student_id", "date", "session", (F.col("m_in") + 1).alias("m_in"), F.when(F.col("m_out") % 3 != 0, F.col("m_out") + F.col("m_out") % 4).alias("m_out"))
    return rel.near_in_time(a, other, ["student_id", "date"], ["m_in", "m_out"], 2).select("l.student_id", "l.date", "l.session", F.col("r.session").alias("other"), "r.m_in", "r.m_out")


@query(with_roles("SELECT punch_id, s.session FROM punches p JOIN sessions s ON p.student_id = s.student_id AND CAST(punch_time AS DATE) = s.date AND hour(punch_time) * 60 + minute(punch_time) BETWEEN m_in AND m_out", "sessions"))
def span_join(spark, sf_dir):
    """Punches that lie within a session of their day."""
    p = machine.with_gaps(roles.punches(spark, sf_dir)).withColumnRenamed("day", "date").select("punch_id", "student_id", "date", "m")
    s = machine.attendance(roles.punches(spark, sf_dir)).select("student_id", "date", "session", "m_in", "m_out")
    return p.join(s, ["student_id", "date"]).filter(F.col("m").between(F.col("m_in"), F.col("m_out"))).select("punch_id", "session")


@query(with_roles("SELECT a.usage_id, b.date AS activity_date FROM (SELECT * FROM usage WHERE account = 'P') a JOIN (SELECT DISTINCT student_id, date FROM marks) b ON a.student_id = b.student_id AND b.date BETWEEN a.date - 2 AND a.date + 2 JOIN students s ON s.student_id = a.student_id AND s.join_date <= a.date", "usage", "marks", "students"))
def date_band_join(spark, sf_dir):
    """Activities within two days of an event, of students who had joined by then."""
    events = roles.usage(spark, sf_dir).filter("account = 'P'").select("usage_id", "student_id", "date")
    acts = rel.days_of(roles.marks(spark, sf_dir))
    joined = rel.date_band(events, acts, 2).join(roles.students(spark, sf_dir).select("student_id", "join_date"), "student_id")
    return joined.filter("join_date <= date").select("usage_id", "activity_date")


@query(with_roles("SELECT student_id, date, session FROM sessions s WHERE EXISTS (SELECT 1 FROM punches p WHERE p.student_id = s.student_id AND CAST(punch_time AS DATE) = s.date AND p.status IN ('view', 'click') AND (hour(punch_time) * 60 + minute(punch_time)) IN (s.m_in, s.m_out))", "sessions"))
def punch_exists_or(spark, sf_dir):
    """Sessions that begin or end with a punch of certain states; one equi join, the OR inside it."""
    p = machine.with_gaps(roles.punches(spark, sf_dir)).filter(F.col("status").isin("view", "click")).select("student_id", F.col("day").alias("date"), "m")
    s = machine.attendance(roles.punches(spark, sf_dir)).alias("s")
    p = p.alias("p")
    same = (F.col("s.student_id") == F.col("p.student_id")) & (F.col("s.date") == F.col("p.date")) & ((F.col("p.m") == F.col("s.m_in")) | (F.col("p.m") == F.col("s.m_out")))
    return s.join(p, same, "left_semi").select("student_id", "date", "session")


@query(with_roles("SELECT student_id, date, 'exam' AS activity FROM marks UNION ALL SELECT student_id, date, 'digital' FROM usage", "marks", "usage"))
def activity_union(spark, sf_dir):
    """Two streams under one schema with a tag."""
    a = roles.marks(spark, sf_dir).select("student_id", "date", F.lit("exam").alias("activity"))
    return a.unionByName(roles.usage(spark, sf_dir).select("student_id", "date", F.lit("digital").alias("activity")))


@query(with_roles("SELECT date, count(DISTINCT student_id) AS students FROM (SELECT student_id, date FROM marks UNION SELECT student_id, date FROM usage) GROUP BY 1", "marks", "usage"))
def activity_days(spark, sf_dir):
    """Students by day over all sources."""
    return rel.days_of(roles.marks(spark, sf_dir), roles.usage(spark, sf_dir)).groupBy("date").agg(F.count(F.lit(1)).alias("students"))


@query(with_roles("SELECT u.usage_id FROM usage u WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.student_id = u.student_id AND m.date = u.date)", "usage", "marks"))
def sittings_without_score(spark, sf_dir):
    """Sittings for which no score came."""
    return roles.usage(spark, sf_dir).select("usage_id", "student_id", "date").join(roles.marks(spark, sf_dir), ["student_id", "date"], "left_anti").select("usage_id")


@query(with_roles("SELECT exam_id, round(avg(marks * 100.0 / 50.0), 2) AS average FROM marks GROUP BY 1", "marks"))
def batch_average(spark, sf_dir):
    """Mean percentage of each exam; partial sums before the shuffle."""
    m = roles.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("exam_id"), F.col("l_quantity").alias("marks"))
    return m.groupBy("exam_id").agg(F.round(F.avg(F.col("marks") * 100.0 / 50.0), 2).alias("average"))


@query(with_roles("SELECT exam_id, max(marks) AS highest, max(marks) > any_value(small_max) AS refused FROM marks JOIN exams USING (exam_id) GROUP BY 1", "marks", "exams"))
def guard_max(spark, sf_dir):
    """A new maximum below the highest mark is refused."""
    top = roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("exam_id")).agg(F.max("l_quantity").alias("highest"))
    return top.join(roles.exams(spark, sf_dir).select("exam_id", "small_max"), "exam_id").select("exam_id", "highest", (F.col("highest") > F.col("small_max")).alias("refused"))


@query(with_roles("SELECT student_id, max(date) AS last FROM usage GROUP BY 1", "usage"))
def last_activity(spark, sf_dir):
    """The last day of each student."""
    return roles.usage(spark, sf_dir).groupBy("student_id").agg(F.max("date").alias("last"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_having(spark, sf_dir):
    """Keys that occur more than once."""
    return rel.duplicates(roles.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(with_roles("SELECT date, string_agg(DISTINCT platform, ' | ' ORDER BY platform) AS platforms FROM usage GROUP BY 1 HAVING sum(CASE WHEN account = 'O' THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN account = 'F' THEN 1 ELSE 0 END) > 0", "usage"))
def mixed_having_listagg(spark, sf_dir):
    """Days with both kinds of rows, their platforms in order."""
    g = roles.usage(spark, sf_dir).groupBy("date").agg(F.count_if(F.col("account") == "O").alias("o"), F.count_if(F.col("account") == "F").alias("f"), F.array_join(F.array_sort(F.collect_set("platform")), " | ").alias("platforms"))
    return g.filter("o > 0 and f > 0").select("date", "platforms")


@query(with_roles("SELECT subject, count(*) AS n, min(exam_id) AS first FROM exams WHERE subject IS NOT NULL GROUP BY 1", "exams"))
def category_counts(spark, sf_dir):
    """Counts by category with what settles ties."""
    return roles.exams(spark, sf_dir).filter("subject is not null").groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("exam_id").alias("first"))


@query(with_roles("SELECT student_id, date, CAST(sum(minutes) AS BIGINT) AS minutes FROM usage GROUP BY ALL", "usage"))
def daily_minutes(spark, sf_dir):
    """Minutes by student and day."""
    return roles.usage(spark, sf_dir).groupBy("student_id", "date").agg(F.sum("minutes").alias("minutes"))


@query(with_roles("SELECT instructor_id, exam_id AS usual, n FROM (SELECT *, row_number() OVER (PARTITION BY instructor_id ORDER BY n DESC, seen) AS r FROM (SELECT instructor_id, exam_id, count(*) AS n, min(o_orderkey * 10000000 + exam_id) AS seen FROM marks GROUP BY ALL)) WHERE r = 1", "marks"))
def majority_title(spark, sf_dir):
    """The commonest value of each group, of ties the first seen."""
    m = roles.marks(spark, sf_dir).withColumn("seen", F.col("o_orderkey") * 10000000 + F.col("exam_id"))
    return rel.most_common(m, ["instructor_id"], "exam_id", "seen").withColumnRenamed("exam_id", "usual")


@query(with_roles("SELECT student_id, day AS date, CASE WHEN m_in >= 780 THEN 'Afternoon' WHEN m_out <= 840 OR m_out IS NULL THEN 'Morning' ELSE 'Full Day' END AS session, min(m_in) AS m_in, max(m_out) AS m_out, count(*) AS n FROM pairs GROUP BY ALL", "pairs"))
def session_minmax(spark, sf_dir):
    """Rows of one session become one."""
    from learnlake.functions.sessions import live_session

    p = machine.pairs(roles.punches(spark, sf_dir)).withColumn("session", live_session(F.col("m_in"), F.col("m_out")))
    return p.groupBy("student_id", F.col("day").alias("date"), "session").agg(F.min("m_in").alias("m_in"), F.max("m_out").alias("m_out"), F.count(F.lit(1)).alias("n"))


@query(with_roles("SELECT exam_id, n, percent, CASE WHEN percent > 100 THEN 'FATAL' WHEN n >= 5 AND (percent > 95 OR percent < 5) THEN 'WARN' ELSE 'OK' END AS band FROM (SELECT exam_id, count(*) AS n, round(CAST(sum(CAST(marks AS DECIMAL(18,2))) AS DOUBLE) / count(*) / any_value(small_max) * 100, 2) AS percent FROM marks JOIN exams USING (exam_id) GROUP BY 1)", "marks", "exams"))
def exam_pct_bands(spark, sf_dir):
    """Averages that can't be, and those that are odd."""
    sums = roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("exam_id")).agg(F.count(F.lit(1)).alias("n"), rel.exact_sum("l_quantity").alias("s"))
    p = sums.join(roles.exams(spark, sf_dir).select("exam_id", "small_max"), "exam_id").withColumn("percent", F.round(F.col("s") / F.col("n") / F.col("small_max") * 100, 2))
    band = F.when(F.col("percent") > 100, "FATAL").when((F.col("n") >= 5) & ((F.col("percent") > 95) | (F.col("percent") < 5)), "WARN").otherwise("OK")
    return p.select("exam_id", "n", "percent", band.alias("band"))


@query(with_roles("SELECT student_id, m.date, exam_id, round(marks - avg(marks) OVER (PARTITION BY exam_id), 4) AS above FROM marks m", "marks"))
def marks_against_batch(spark, sf_dir):
    """Each mark beside its exam's mean; the means are aggregated first and joined, so a hot exam isn't one window."""
    m = roles.marks(spark, sf_dir)
    mean = m.groupBy("exam_id").agg(F.avg("marks").alias("mean"))
    return m.join(mean, "exam_id").select("student_id", "date", "exam_id", F.round(F.col("marks") - F.col("mean"), 4).alias("above"))


@query("SELECT p_brand AS title, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY 1")
def rank_ids(spark, sf_dir):
    """Ranks and shares of a small distinct table."""
    n = roles.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("title")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    return n.crossJoin(F.broadcast(total)).select("title", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"), F.row_number().over(Window.orderBy(F.desc("n"), "title")).cast("long").alias("place"))
