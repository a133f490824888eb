"""The study centre's own read operations, over its 21 tables.

``Centre`` takes the tables as DataFrames (see ``learnlake.schemas``) and gives
each list, summary, roster, extract, dashboard and check as a DataFrame. Today
is an argument throughout.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlake import schemas
from learnlake.functions import dates, times
from learnlake.operators import quality
from learnlake.operators import relational as rel

Day = dt.date


class Centre:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        empty = {n: spark.createDataFrame([], schemas.of(n)) for n in schemas.DDL if n not in tables}
        self.t = tables | empty
        self.spark = spark

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Centre:
        return cls(spark, {n: spark.read.schema(schemas.of(n)).parquet(f"{folder}/{n}") for n in schemas.DDL})

    def students(self, today: Day, search: str | None = None, label: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """A page of students by name and id, with valid_until. Labels: present, new, expiring, active, inactive."""
        t = F.lit(today)
        s = self.t["students"].withColumn("valid_until", dates.add_years(F.col("join_date"), F.col("renewal_count") + 1))
        s = rel.where_all(s, rel.contains_any(search, "name", "student_id", "phone"))
        if label == "present":
            s = s.join(self.t["attendance"].filter(F.col("date") == t), "student_id", "left_semi")
        picks: dict[str | None, Column] = {
            "new": F.trunc("join_date", "month") == F.trunc(t, "month"), "expiring": F.col("valid_until").between(t, F.date_add(t, 30)),
            "active": F.col("status") == "Active", "inactive": F.col("status") == "Inactive",
        }
        return rel.page(rel.where_all(s, picks.get(label)), "name", "student_id", limit=limit, offset=offset)

    def student_summary(self, today: Day) -> DataFrame:
        t = F.lit(today)
        s = self.t["students"].withColumn("valid_until", dates.add_years(F.col("join_date"), F.col("renewal_count") + 1))
        counts = s.agg(
            F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "Active").alias("active"), F.count_if(F.col("status") == "Inactive").alias("inactive"),
            F.count_if(F.trunc("join_date", "month") == F.trunc(t, "month")).alias("new_this_month"), F.count_if(F.col("valid_until").between(t, F.date_add(t, 30))).alias("expiring"),
        )
        present = self.t["attendance"].filter(F.col("date") == t).agg(F.countDistinct("student_id").alias("present_today"))
        return counts.crossJoin(F.broadcast(present))

    def gender_distribution(self) -> DataFrame:
        return self.t["students"].groupBy(F.coalesce("gender", F.lit("Not specified")).alias("gender")).agg(F.count(F.lit(1)).alias("n"))

    def subscriptions(self, today: Day, search: str | None = None) -> DataFrame:
        """Subscriptions with their end and the status that follows from it; without an end the stored one stays."""
        end = F.date_add("start_date", F.col("validity_days"))
        s = rel.where_all(self.t["subscriptions"], rel.contains_any(search, "name", "subscription_id", "type")).withColumn("valid_until", end)
        status = F.when(F.col("valid_until").isNull(), F.col("status")).when(F.col("valid_until") < F.lit(today), "Expired").otherwise("Active")
        return s.withColumn("status", status).orderBy("name", "subscription_id")

    def subscription_summary(self, today: Day, search: str | None = None) -> DataFrame:
        s = self.subscriptions(today, search)
        used = self.t["digital_library_usage"].filter(F.col("date") == F.lit(today)).join(s.select("subscription_id"), "subscription_id", "left_semi")
        counts = s.agg(
            F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "Active").alias("active"), F.count_if(F.col("status") == "Expired").alias("expired"),
            F.coalesce(rel.exact_sum("cost"), F.lit(0.0)).alias("cost"), F.avg("validity_days").alias("average_validity"),
        )
        return counts.crossJoin(F.broadcast(used.agg(F.countDistinct("subscription_id").alias("used_today"))))

    def top_subscriptions(self, k: int = 8) -> DataFrame:
        n = self.t["digital_library_usage"].filter("subscription_id is not null").groupBy("subscription_id").agg(F.count(F.lit(1)).alias("uses"))
        return n.join(self.t["subscriptions"].select("subscription_id", "name"), "subscription_id").orderBy(F.desc("uses"), "name").limit(k)

    def attendance(self, student_id: int | None = None, since: Day | None = None, until: Day | None = None, session: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        a = rel.where_all(self.t["attendance"], rel.optional("student_id", student_id), rel.optional("session", session), rel.date_range("date", since, until))
        return rel.page(a, F.desc("date"), "session", "check_in", "attendance_id", limit=limit, offset=offset, most=500)

    def present_now(self, today: Day) -> DataFrame:
        a = self.t["attendance"].filter((F.col("date") == F.lit(today)) & F.col("check_out").isNull()).select("student_id", F.lit("attendance").alias("activity"), F.col("check_in").alias("since"))
        d = self.t["digital_library_usage"].filter((F.col("date") == F.lit(today)) & F.col("out_time").isNull()).select("student_id", F.lit("digital").alias("activity"), F.col("in_time").alias("since"))
        return a.unionByName(d).join(self.t["students"].select("student_id", "name"), "student_id").orderBy("activity", "since", "student_id")

    def digital(self, student_id: int | None = None, since: Day | None = None, until: Day | None = None, account_type: str | None = None) -> DataFrame:
        u = self.t["digital_library_usage"].withColumn("duration_minutes", times.minutes_between(F.col("in_time"), F.col("out_time")))
        return rel.where_all(u, rel.optional("student_id", student_id), rel.optional("account_type", account_type), rel.date_range("date", since, until)).orderBy(F.desc("date"), "usage_id")

    def offline(self, student_id: int | None = None, since: Day | None = None, until: Day | None = None, book_id: str | None = None) -> DataFrame:
        return rel.where_all(self.t["offline_library_usage"], rel.optional("student_id", student_id), rel.optional("book_id", book_id), rel.date_range("date", since, until)).orderBy(F.desc("date"), "usage_id")

    def books(self, search: str | None = None, category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return rel.page(rel.where_all(self.t["books"], rel.contains_any(search, "title", "book_id"), rel.optional("category", category)), "title", "book_id", limit=limit, offset=offset)

    def assessments(self, kind: str, search: str | None = None, subject: str | None = None, since: Day | None = None, until: Day | None = None) -> DataFrame:
        """Exams or quizzes (``kind`` exam or quiz), newest first."""
        t = self.t["exams" if kind == "exam" else "quizzes"]
        return rel.where_all(t, rel.contains_any(search, f"{kind}_name", "subject"), rel.optional("subject", subject), rel.date_range(f"{kind}_date", since, until)).orderBy(F.desc(f"{kind}_date"), f"{kind}_id")

    def scores(self, kind: str, student_id: int | None = None, assessment_id: int | None = None) -> DataFrame:
        """Marks or scores, best first."""
        t, value = (self.t["exam_marks"], "marks_obtained") if kind == "exam" else (self.t["quiz_scores"], "score")
        return rel.where_all(t, rel.optional("student_id", student_id), rel.optional(f"{kind}_id", assessment_id)).orderBy(F.desc(value), "student_id")

    def holidays(self, since: Day | None = None, until: Day | None = None) -> DataFrame:
        return rel.where_all(self.t["holidays"], rel.date_range("date", since, until)).orderBy("date")

    def _roster(self, rows: DataFrame) -> DataFrame:
        own = self.t["students"].select("student_id", F.col("name").alias("_own"))
        other = self.t["external_participants"].select("external_participant_id", F.col("name").alias("_other"))
        joined = rows.join(own, "student_id", "left").join(other, "external_participant_id", "left")
        return joined.withColumn("participant", F.coalesce("_own", "_other")).drop("_own", "_other")

    def coaching_roster(self, class_id: int | None = None) -> DataFrame:
        teachers = self.t["instructors"].select("instructor_id", F.col("name").alias("instructor"))
        rows = rel.where_all(self.t["coaching_enrollments"], rel.optional("class_id", class_id)).join(self.t["coaching_classes"].drop("notes"), "class_id").join(teachers, "instructor_id", "left")
        return self._roster(rows)

    def activity_roster(self, activity_id: int | None = None) -> DataFrame:
        rows = rel.where_all(self.t["other_activities_attendance"], rel.optional("activity_id", activity_id)).join(self.t["other_activities"].drop("notes"), "activity_id")
        return self._roster(rows)

    def extracts(self) -> dict[str, DataFrame]:
        """The eight sheets, as text with '' for null."""
        names = self.t["students"].select("student_id", "name")
        percent = lambda v: times.percentage(F.col(v), F.col("max_marks"))
        digital = self.t["digital_library_usage"].withColumn("duration", times.minutes_between(F.col("in_time"), F.col("out_time")))
        offline = self.t["offline_library_usage"].join(self.t["books"].select("book_id", "title"), "book_id", "left").withColumn("title", F.coalesce("title", F.lit("Self-study")))
        exams = self.t["exam_marks"].join(self.t["exams"], "exam_id").withColumn("percentage", percent("marks_obtained"))
        quizzes = self.t["quiz_scores"].join(self.t["quizzes"], "quiz_id").withColumn("percentage", percent("score"))
        sheets = {
            "Attendance": (self.t["attendance"].join(names, "student_id"), "date student_id name session check_in check_out duration_minutes"),
            "Digital Library": (digital.join(names, "student_id"), "date student_id name in_time out_time duration account_type subscription_id platform_name purpose notes"),
            "Offline Library": (offline.join(names, "student_id"), "date student_id name book_id title"),
            "Exams": (exams.join(names, "student_id"), "exam_date student_id name exam_name subject marks_obtained max_marks percentage remarks"),
            "Quizzes": (quizzes.join(names, "student_id"), "quiz_date student_id name quiz_name subject score max_marks percentage remarks"),
            "Students": (self.t["students"], "student_id name gender date_of_birth phone email father_name qualification status join_date renewal_count"),
            "Coaching": (self.coaching_roster(), "class_date title subject instructor participant_type participant"),
            "Other Activities": (self.activity_roster(), "session_date session_name speaker_name session_type participant_type participant"),
        }
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        return {n: df.select(*map(text, columns.split())) for n, (df, columns) in sheets.items()}

    @staticmethod
    def sync_outcome(done: int, total: int) -> str:
        return "Success" if done == total else "Partial" if done else "Failed"

    def assessment_rows(self) -> DataFrame:
        """Exams and quizzes as one stream of percentages beside their batch averages."""
        parts = []
        for kind, value in (("exam", "marks_obtained"), ("quiz", "score")):
            scores, about = self.t["exam_marks" if kind == "exam" else "quiz_scores"], self.t["exams" if kind == "exam" else "quizzes"]
            rows = scores.join(about, f"{kind}_id").withColumn("percent", F.try_divide(F.col(value) * 100.0, F.col("max_marks")))
            mean = rows.groupBy(f"{kind}_id").agg(F.round(F.avg("percent"), 2).alias("batch_average"))
            rows = rows.join(mean, f"{kind}_id")
            parts.append(rows.select("student_id", F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), F.col(f"{kind}_name").alias("name"), F.col(f"{kind}_date").alias("date"), "subject", F.round("percent", 2).alias("percent"), "batch_average"))
        return reduce(DataFrame.unionByName, parts)

    def estimated_minutes(self) -> DataFrame:
        """Study time by elimination: attendance less digital and coaching, by student and day, never below 0."""
        key = ["student_id", "date"]
        a = self.t["attendance"].groupBy(*key).agg(F.sum("duration_minutes").alias("attended"))
        d = self.digital().groupBy(*key).agg(F.sum("duration_minutes").alias("digital"))
        c = self.t["coaching_enrollments"].join(self.t["coaching_classes"], "class_id").filter("student_id is not null")
        c = c.groupBy("student_id", F.col("class_date").alias("date")).agg(F.sum(times.minutes_between(F.col("start_time"), F.col("end_time"))).alias("coaching"))
        left = F.col("attended") - F.coalesce("digital", F.lit(0)) - F.coalesce("coaching", F.lit(0))
        return a.join(d, key, "left").join(c, key, "left").withColumn("estimated", F.greatest(left, F.lit(0)))

    def dashboards(self, today: Day) -> DataFrame:
        """One row a student: attendance rate, streak, average duration, score trend, estimated study time."""
        t = F.lit(today)
        days = self.t["attendance"].select("student_id", "date").distinct()
        rate = days.groupBy("student_id").agg(F.round(F.count_if(F.col("date").between(F.date_sub(t, 29), t)) * 100.0 / 30, 2).alias("rate_30d"))
        streak = rel.islands(days).groupBy("student_id").agg(F.when(F.datediff(t, F.max("last")) <= 1, F.max_by("length", "last")).otherwise(F.lit(0)).alias("streak"))
        spent = self.t["attendance"].groupBy("student_id").agg(F.round(F.avg("duration_minutes"), 2).alias("average_minutes"), rel.trend("duration_minutes", ["date", "attendance_id"], 15).alias("attendance_trend"))
        scores = self.assessment_rows().groupBy("student_id").agg(F.round(F.avg("percent"), 2).alias("average_percent"), rel.trend("percent", ["date", "kind", "id"], 5).alias("score_trend"))
        study = self.estimated_minutes().groupBy("student_id").agg(F.sum("estimated").alias("estimated_minutes"))
        return reduce(lambda a, b: a.join(b, "student_id", "left"), [self.t["students"].select("student_id", "name"), rate, streak, spent, scores, study])

    def validate(self, today: Day) -> DataFrame:
        """V1 to V7 as severity, problem and n."""
        t, checks = self.t, []
        for child, key, parent in (("attendance", "student_id", "students"), ("digital_library_usage", "student_id", "students"), ("digital_library_usage", "subscription_id", "subscriptions"), ("offline_library_usage", "student_id", "students"), ("offline_library_usage", "book_id", "books"), ("exam_marks", "student_id", "students"), ("exam_marks", "exam_id", "exams"), ("quiz_scores", "student_id", "students"), ("quiz_scores", "quiz_id", "quizzes"), ("coaching_enrollments", "class_id", "coaching_classes"), ("coaching_enrollments", "student_id", "students"), ("other_activities_attendance", "activity_id", "other_activities")):
            checks.append(quality.Check("FATAL", f"{child}.{key} without {parent}", rel.orphans(t[child], t[parent], key, key)))
        for kind, rows, value in (("exam", "exam_marks", "marks_obtained"), ("quiz", "quiz_scores", "score")):
            about = t["exams" if kind == "exam" else "quizzes"]
            checks.append(quality.Check("FATAL", f"{rows} beyond its range", t[rows].join(about, f"{kind}_id").filter(f"{value} > max_marks or {value} < 0")))
            checks.append(quality.Check("FATAL", f"{rows} twice", rel.duplicates(t[rows], "student_id", f"{kind}_id")))
            checks.append(quality.Check("WARN", f"{kind} without maximum", about.filter("max_marks is null")))
        checks.append(quality.Check("FATAL", "attendance twice", rel.duplicates(t["attendance"], "student_id", "date", "session")))
        checks.append(quality.Check("FATAL", "several open sessions", rel.duplicates(t["attendance"].filter("check_out is null"), "student_id")))
        checks.append(quality.Check("FATAL", "attendance times", t["attendance"].filter(~times.is_hhmm(F.col("check_in")) | (F.col("check_out") <= F.col("check_in")))))
        checks.append(quality.Check("FATAL", "account and subscription disagree", t["digital_library_usage"].filter((F.col("account_type") == "Library Subscription") != F.col("subscription_id").isNotNull())))
        checks.append(quality.Check("FATAL", "participant not one of two", t["coaching_enrollments"].filter(F.col("student_id").isNull() == F.col("external_participant_id").isNull())))
        checks.append(quality.Check("WARN", "date in the future", t["attendance"].filter(F.col("date") > F.lit(today))))
        return quality.report(*checks)
