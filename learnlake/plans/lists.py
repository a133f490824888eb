"""Lists and summaries: filters, search, paging, conditional counts, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnlake.functions import dates
from learnlake.operators import relational as rel
from learnlake.plans.registry import query
from learnlake.sources import roles
from learnlake.sources.roles import TODAY_EVENTS, TODAY_ORDERS, with_roles


@query(with_roles("SELECT usage_id, student_id, date, platform, minutes FROM usage WHERE platform = '1-URGENT' AND date >= DATE '1996-01-01' AND date <= DATE '1997-12-31' ORDER BY date DESC, platform, usage_id LIMIT 50 OFFSET 100", "usage"))
def list_filter_page(spark, sf_dir):
    """Optional filters, then one page of a total order."""
    found = rel.where_all(roles.usage(spark, sf_dir), rel.optional("student_id", None), rel.optional("platform", "1-URGENT"), rel.date_range("date", "1996-01-01", "1997-12-31"))
    return rel.page(found, F.desc("date"), "platform", "usage_id", limit=50, offset=100).select("usage_id", "student_id", "date", "platform", "minutes")


@query(with_roles("SELECT exam_id, name, subject FROM exams WHERE name ILIKE '%Re%' OR subject ILIKE '%Re%'", "exams"))
def list_contains_search(spark, sf_dir):
    """Substring search over two columns, whatever the case."""
    return rel.where_all(roles.exams(spark, sf_dir), rel.contains_any("Re", "name", "subject")).select("exam_id", "name", "subject")


@query(with_roles("SELECT student_id, name FROM students WHERE CAST(student_id AS VARCHAR) LIKE '%12%' OR name ILIKE '%12%'", "students"))
def list_id_text_search(spark, sf_dir):
    """P5: a number searched as text."""
    return rel.where_all(roles.students(spark, sf_dir), rel.contains_any("12", "student_id", "name")).select("student_id", "name")


@query(with_roles("SELECT student_id, date, session, m_in, m_out, minutes FROM sessions WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'", "sessions"))
def list_date_range(spark, sf_dir):
    """An inclusive range of days; a day's sessions need that day's punches alone, so the range reaches the scan."""
    from learnlake.operators import punches

    within = (F.col("punch_time") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("punch_time") < F.lit("2024-01-21").cast("timestamp"))
    return rel.where_all(punches.attendance(roles.punches(spark, sf_dir).filter(within)), rel.date_range("date", "2024-01-10", "2024-01-20"))


@query(with_roles("SELECT student_id, day, m_in FROM pairs WHERE m_out IS NULL", "pairs"))
def list_null_open(spark, sf_dir):
    """Visits without a departure."""
    from learnlake.operators import punches

    return punches.pairs(roles.punches(spark, sf_dir)).filter(F.col("m_out").isNull()).select("student_id", "day", "m_in")


@query(with_roles("SELECT exam_id, student_id, o_orderkey, marks, place FROM (SELECT *, row_number() OVER (PARTITION BY exam_id ORDER BY marks DESC, student_id, o_orderkey, line, date, instructor_id) AS place FROM marks) WHERE place <= 3", "marks"))
def top_marks_per_exam(spark, sf_dir):
    """The best marks of each exam."""
    order = [F.desc("marks"), *map(F.col, ("student_id", "o_orderkey", "line", "date", "instructor_id"))]
    return rel.at_most(roles.marks(spark, sf_dir), ["exam_id"], 3, *order).select("exam_id", "student_id", "o_orderkey", "marks", "place")


@query(with_roles("SELECT *, count(*) OVER () AS total FROM (SELECT usage_id, account FROM usage WHERE account = 'P')", "usage"))
def list_with_total(spark, sf_dir):
    """A1: the number of rows that the filter finds, beside the rows."""
    return rel.with_total(roles.usage(spark, sf_dir).filter("account = 'P'").select("usage_id", "account"))


@query(with_roles("""SELECT count(*) AS total, count(*) FILTER (WHERE valid_until >= DATE '2001-08-01') AS active, count(*) FILTER (WHERE valid_until < DATE '2001-08-01') AS inactive,
    count(*) FILTER (WHERE join_date >= DATE '1995-03-01' AND join_date < DATE '1995-04-01') AS new_in_month, count(*) FILTER (WHERE valid_until BETWEEN DATE '2001-08-01' AND DATE '2001-08-31') AS expiring,
    CAST(sum(CAST(coalesce(balance, 0) AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM (SELECT *, CAST(join_date + INTERVAL 72 MONTH AS DATE) AS valid_until FROM students)""", "students"))  # fmt: skip
def student_summary(spark, sf_dir):
    """Counts under conditions in one pass; no row is read twice."""
    today, month = F.lit(TODAY_ORDERS), F.lit("1995-03-01").cast("date")
    s = roles.students(spark, sf_dir).withColumn("valid_until", dates.add_years(F.col("join_date"), F.lit(6)))
    return s.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("valid_until") >= today).alias("active"),
        F.count_if(F.col("valid_until") < today).alias("inactive"),
        F.count_if(F.trunc("join_date", "month") == month).alias("new_in_month"),
        F.count_if(F.col("valid_until").between(today, F.date_add(today, 30))).alias("expiring"),
        rel.exact_sum(F.coalesce("balance", F.lit(0.0))).alias("balance"),
    )


@query(with_roles("SELECT coalesce(label, 'Not specified') AS label, count(*) AS n FROM students GROUP BY 1", "students"))
def label_distribution(spark, sf_dir):
    """A4, P10: counts by a label with a name for those without."""
    return roles.students(spark, sf_dir).groupBy(F.coalesce("label", F.lit("Not specified")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(with_roles("SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM usage WHERE date >= DATE '2001-03-01' GROUP BY 1", "usage"))
def monthly_registrations(spark, sf_dir):
    """A5: the last six calendar months; months without rows are left out."""
    since = F.trunc(F.add_months(F.lit(TODAY_ORDERS), -5), "month")
    return roles.usage(spark, sf_dir).filter(F.col("date") >= since).groupBy(dates.month_label(F.col("date")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(with_roles("SELECT student_id, count(*) AS n FROM usage GROUP BY 1 ORDER BY n DESC, student_id LIMIT 8", "usage"))
def usage_top8(spark, sf_dir):
    """The eight heaviest users."""
    return roles.usage(spark, sf_dir).groupBy("student_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "student_id").limit(8)


@query(with_roles("SELECT count(DISTINCT student_id) AS present, count(*) AS punches FROM punches WHERE CAST(punch_time AS DATE) = DATE '2024-01-30'", "punches"))
def used_on_day_distinct(spark, sf_dir):
    """Exact distinct count on one day; the range reaches the scan."""
    day = F.lit(TODAY_EVENTS).cast("timestamp")
    p = roles.punches(spark, sf_dir).filter((F.col("punch_time") >= day) & (F.col("punch_time") < day + F.expr("interval 1 day")))
    return p.agg(F.countDistinct("student_id").alias("present"), F.count(F.lit(1)).alias("punches"))


@query(with_roles("""SELECT usage_id, CASE WHEN valid_until IS NULL THEN account WHEN valid_until < DATE '2001-08-01' THEN 'Expired' ELSE 'Active' END AS status, valid_until FROM (
    SELECT usage_id, account, CASE WHEN account <> 'P' THEN date + minutes END AS valid_until FROM usage)""", "usage"))  # fmt: skip
def subscription_status(spark, sf_dir):
    """A status worked out at reading; without an end the stored one stays."""
    u = roles.usage(spark, sf_dir).withColumn("valid_until", F.when(F.col("account") != "P", F.date_add("date", F.col("minutes"))))
    status = F.when(F.col("valid_until").isNull(), F.col("account")).when(F.col("valid_until") < F.lit(TODAY_ORDERS), F.lit("Expired")).otherwise(F.lit("Active"))
    return u.select("usage_id", status.alias("status"), "valid_until")


@query(with_roles("SELECT usage_id, student_id, date + 30 AS valid_until FROM usage WHERE date + 30 BETWEEN DATE '2001-08-01' AND DATE '2001-08-31'", "usage"))
def expiring_30d(spark, sf_dir):
    """What ends within thirty days; the bounds move to the stored column, so the scan can use them."""
    today = F.lit(TODAY_ORDERS)
    u = roles.usage(spark, sf_dir).filter(F.col("date").between(F.date_sub(today, 30), today))
    return u.select("usage_id", "student_id", F.date_add("date", 30).alias("valid_until"))


@query("SELECT s_suppkey AS instructor_id, s_name AS name FROM supplier WHERE s_suppkey = 7")
def instructor_lookup(spark, sf_dir):
    """One row by its key, allowed columns only."""
    t = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instructor_id"), F.col("s_name").alias("name"), "s_acctbal")
    return rel.whitelist(t.filter("instructor_id = 7"), "instructor_id", "name")


@query("SELECT 'bad' AS kind, count(*) AS n FROM events WHERE coalesce(trim(event_type), '') = '' OR user_id IS NULL UNION ALL SELECT 'good', count(*) FROM events WHERE coalesce(trim(event_type), '') <> '' AND user_id IS NOT NULL")
def required_fields(spark, sf_dir):
    """Complete rows and those for review."""
    good, bad = rel.required(roles.punches(spark, sf_dir), "status", "student_id")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(good, "good").unionByName(count(bad, "bad"))


@query(with_roles("SELECT state, n FROM (SELECT count(*) FILTER (WHERE account='F') AS f, count(*) FILTER (WHERE account='O') AS o, count(*) FILTER (WHERE account='P') AS p FROM usage) UNPIVOT (n FOR state IN (f, o, p))", "usage"))
def state_pivot(spark, sf_dir):
    """A histogram over known states, absent ones at 0."""
    counts = roles.usage(spark, sf_dir).agg(*[F.count_if(F.col("account") == x.upper()).alias(x) for x in "fop"])
    return counts.unpivot([], list("fop"), "state", "n")
