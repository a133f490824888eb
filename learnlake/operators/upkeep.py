"""Jobs that run from time to time: renewals, inferred entries, completeness, and clearing the scanner's buffer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlake.functions import dates
from learnlake.sources import files

#: Days within which a member counts as current, and renewals at most (fixed values).
RECENT_DAYS, MOST_RENEWALS = 90, 365


def backfill_renewals(students: DataFrame, attendance: DataFrame, today) -> DataFrame:
    """student_id, renewals and status of students (student_id, join_date, renewal_count) after their attendance is counted.

    A membership must cover the last visit, and today where that was no more
    than RECENT_DAYS ago. Visits before the join date, and none, renew nothing.
    """
    last = attendance.groupBy("student_id").agg(F.max("date").alias("last"))
    s = students.join(last, "student_id", "left")
    until = F.when(F.col("last") >= F.date_sub(F.lit(today), RECENT_DAYS), F.lit(today)).otherwise(F.col("last"))
    needed = F.when(F.col("last") >= F.col("join_date"), dates.renewals_needed(F.col("join_date"), until)).otherwise(F.lit(0))
    renewals = F.when(needed > F.col("renewal_count"), F.least(needed, F.lit(MOST_RENEWALS))).otherwise(F.col("renewal_count")).cast("int")
    s = s.withColumn("renewals", renewals)
    status = F.when(dates.add_years(F.col("join_date"), F.col("renewals") + 1) < F.lit(today), "Inactive").otherwise("Active")
    return s.select("student_id", "renewals", status.alias("status"))


def inferred_entries(attended: DataFrame, standing: DataFrame, *activities: DataFrame) -> DataFrame:
    """The inferred self-study entries (student_id, date) that should stand: those of days with attendance and no other activity.

    ``standing`` are those that stand now; ``action`` says which to add and
    which to take back, since an activity was entered later.
    """
    key = ["student_id", "date"]
    wanted = attended.select(*key).distinct()
    for other in activities:
        wanted = wanted.join(other.select(*key).distinct(), key, "left_anti")
    now = standing.select(*key).distinct().withColumn("stands", F.lit(True))
    both = wanted.withColumn("wanted", F.lit(True)).join(now, key, "full")
    action = F.when(F.col("wanted").isNull(), "retract").when(F.col("stands").isNull(), "add").otherwise("keep")
    return both.select(*key, action.alias("action"))


def missing_punches(buffer: DataFrame, ledger: DataFrame, *name: str) -> DataFrame:
    """Buffer records that the ledger lacks: what a completeness pass captures again."""
    return buffer.dropDuplicates(list(name)).join(ledger.select(*name), list(name), "left_anti")


def archive_then_clear(logs: DataFrame, path: str, issues: int, clear: Callable[[], int], auto_clear: bool = True, force: bool = False) -> str:
    """Archives a buffer's records, then has it cleared; says how that ended.

    Nothing is cleared that isn't archived, and nothing at all while a record
    has no durable row (``issues``). ``clear`` gives the number of records that
    remain and raises OSError where the device fails. The answer is ok,
    full_auto_clear_disabled, full_verify_failed, archive_failed, clear_failed
    or clear_partial.
    """
    if not force and not auto_clear:
        return "full_auto_clear_disabled"
    if issues:
        return "full_verify_failed"
    if not logs.limit(1).count():
        return "ok"
    files.archive(logs, path)
    held = logs.sparkSession.read.parquet(path).select("fingerprint")
    if logs.join(held, "fingerprint", "left_anti").limit(1).count():
        return "archive_failed"
    try:
        remaining = clear()
    except OSError:
        return "clear_failed"
    return "clear_partial" if remaining else "ok"


def load_quizzes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quizzes, scores) of rows (line, student_id, topic, date): one quiz for a topic and date, one open score for each student in it."""
    named = rows.filter("topic <> '' and date is not null")
    quizzes = named.groupBy("topic", "date").agg(F.min("line").alias("quiz_id"))
    scores = named.filter("student_id is not null").select("topic", "date", "student_id").distinct().join(quizzes, ["topic", "date"])
    return quizzes, scores.select("quiz_id", "topic", "date", "student_id", F.lit(None).cast("double").alias("score"))
