"""Loaders: exports to tables, with the rows that a person must look at beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlake.functions import dates, text
from learnlake.operators import topics


def load_members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, review) of rows (line, number, name, birth_date, join_date, male, female), all text but the line.

    Rows without a name are fillers. Of rows with one number the first counts,
    whatever becomes of it; a join date that can't be read refuses the row, a
    birth date or a gender that can't is left open and reported.
    """
    named = rows.filter(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("student_id", text.member_digits(F.col("number")))
    own = Window.partitionBy("student_id").orderBy("line")
    named = named.withColumn("again", F.col("student_id").isNotNull() & (F.row_number().over(own) > 1))
    read = lambda c: dates.parse_date(F.col(c))
    read_rows = named.withColumn("born", read("birth_date")).withColumn("joined", read("join_date")).withColumn("gender", text.gender_from_markers(F.col("male"), F.col("female")))
    members = read_rows.filter(~F.col("again") & F.col("joined").isNotNull())
    problem = F.array_compact(F.array(
        F.when(F.col("again"), "duplicate number"), F.when(~F.col("again") & F.col("joined").isNull(), "join date"),
        F.when(~F.col("again") & (F.trim(F.coalesce("birth_date", F.lit(""))) != "") & F.col("born").isNull(), "birth date"),
        F.when(~F.col("again") & F.col("joined").isNotNull() & F.col("gender").isNull(), "gender"),
    ))
    review = read_rows.select("line", F.explode(problem).alias("problem"))
    return members.select("line", "student_id", text.collapse_ws(F.col("name")).alias("name"), "gender", F.col("born").alias("date_of_birth"), F.col("joined").alias("join_date")), review


def load_coaching(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, enrolments) of rows (line, student_id, date, topic): a class for a topic and date, a student in it once.

    A class is numbered by the first line that names it.
    """
    named = rows.withColumn("title", text.collapse_ws(F.col("topic"))).filter("title <> ''")
    classes = named.groupBy("title", F.col("date").alias("class_date")).agg(F.min("line").alias("class_id"))
    members = named.select("title", F.col("date").alias("class_date"), "student_id").distinct()
    return classes, members.join(classes, ["title", "class_date"]).select("class_id", "title", "class_date", "student_id")


def offline_section(rows: DataFrame, ids: Column, names: Column) -> DataFrame:
    """rows with one row for each book of a visit, ``book_id`` and ``book_name``; ids and names are arrays.

    Where there are more ids than names the last name serves for the rest; where
    there are more names the rest have no id. ``problem`` says what is missing.
    """
    n = F.greatest(F.size(ids), F.size(names))
    blank = lambda a: F.concat(a, F.array_repeat(F.lit(""), F.greatest(n - F.size(a), F.lit(0))))
    padded = F.when(F.size(names) > 0, text.pad_with_last(names, n)).otherwise(blank(names))
    pairs = F.arrays_zip(blank(ids).alias("book_id"), padded.alias("book_name"))
    problem = F.when(F.size(names) == 0, "no name").when(F.size(ids) == 0, "no id").when(F.size(ids) > F.size(names), "fewer names").when(F.size(ids) < F.size(names), "fewer ids")
    marked = rows.withColumn("_pairs", pairs).withColumn("problem", problem)
    return marked.filter(F.size("_pairs") > 0).withColumn("_p", F.explode("_pairs")).select(*rows.columns, "problem", "_p.book_id", "_p.book_name")


def attendance_section(rows: DataFrame, in_time: Column, out_time: Column) -> tuple[DataFrame, DataFrame]:
    """(attendance, review) of cleaned rows whose times are minutes of the day.

    A row needs an arrival; a departure must come after it. Rows without a
    departure stay, open, and are reported.
    """
    checked = rows.withColumn("m_in", in_time).withColumn("m_out", out_time)
    problem = F.when(F.col("m_in").isNull(), "no arrival").when(F.col("m_out") <= F.col("m_in"), "departure before arrival").when(F.col("m_out").isNull(), "open")
    checked = checked.withColumn("problem", problem)
    return checked.filter(F.coalesce(F.col("problem") == "open", F.lit(True))).drop("problem"), checked.filter("problem is not null")


def apply_marks(exams: DataFrame, marks: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exams, marks, review) after rows (line, student_id, exam_id, marks_obtained, max_marks) are applied in the order of their lines.

    A mark above its own row's maximum is refused. An exam keeps the maximum
    that it has; without one the first row that states one sets it. A student's
    mark that stands stays; without one the first row's counts. Rows that say
    otherwise go to review as conflicts. All is decided by the first line of an exam,
    and of a student in it, which needs no order among the rest.
    """
    above = F.coalesce(F.col("marks_obtained") > F.col("max_marks"), F.lit(False))
    read = rows.filter("marks_obtained is not null")
    good = read.filter(~above)
    first = good.filter("max_marks is not null").groupBy("exam_id").agg(F.min_by("max_marks", "line").alias("stated"))
    exams_after = exams.join(first, "exam_id", "full").withColumn("max_marks", F.coalesce("max_marks", "stated")).drop("stated")
    keys = ["student_id", "exam_id"]
    given = good.groupBy(*keys).agg(F.min_by("marks_obtained", "line").alias("given"))
    held = marks.withColumn("stands", F.lit(True)).join(given, keys, "full")
    how = F.when(F.col("stands").isNull(), "inserted").when(F.col("marks_obtained").isNull() & F.col("given").isNotNull(), "filled").otherwise("kept")
    marks_after = held.withColumn("how", how).withColumn("marks_obtained", F.coalesce("marks_obtained", "given")).select(*keys, "marks_obtained", "how")
    known = good.join(exams_after.select("exam_id", F.col("max_marks").alias("_most")), "exam_id", "left").join(marks_after.select(*keys, F.col("marks_obtained").alias("_mark")), keys)
    problems = F.array_compact(F.array(F.when(F.col("max_marks") != F.col("_most"), "max_marks_conflict"), F.when(F.col("marks_obtained") != F.col("_mark"), "marks_conflict")))
    review = known.select("line", F.explode(problems).alias("problem")).unionByName(read.filter(above).select("line", F.lit("marks_above_max").alias("problem")))
    return exams_after, marks_after, review


def load_digital(rows: DataFrame, aliases: DataFrame, opens: int = 9 * 60, closes: int = 19 * 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subscriptions, usage, review) of rows (line, student_id, date, m_in, m_out, platform, purpose, account).

    Rows without a platform or an arrival are left out; an arrival outside the
    opening hours and a missing departure go to review. Only what says Library
    Subscription, and is no free platform, belongs to a subscription: it is
    known by its slug, bears its commonest name (of equals the one seen first) and
    starts on the date of the first row that names it.
    """
    named = topics.resolve_platforms(rows.withColumn("platform", text.collapse_ws(F.col("platform"))).withColumnRenamed("platform", "_cell"), "_cell", aliases)
    usable = named.filter((F.coalesce("_cell", F.lit("")) != "") & F.col("m_in").isNotNull())
    problem = F.when(~F.col("m_in").between(opens, closes), "outside_operating_hours").when(F.col("m_out").isNull(), "missing_out_time")
    usable = usable.withColumn("problem", problem)
    own = (F.trim("account") == "Library Subscription") & F.col("subscription")
    slug = F.when(F.coalesce(own, F.lit(False)), text.slugify(F.col("platform")))
    purpose = F.nullif(text.collapse_ws(F.coalesce("purpose", F.lit(""))), F.lit(""))
    usage = usable.filter("problem is null").select("line", "student_id", "date", "m_in", "m_out", F.when(slug.isNotNull(), "Library Subscription").otherwise("Own Account").alias("account_type"), slug.alias("subscription_id"), "platform", purpose.alias("purpose"))
    spelt = usage.filter("subscription_id is not null").groupBy("subscription_id", "platform").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line", "date")).alias("first"))
    best = F.max_by("platform", F.struct("n", -F.col("first.line")))
    subscriptions = spelt.groupBy("subscription_id").agg(best.alias("name"), F.lit("Active").alias("status"), F.min("first")["date"].alias("start_date"))
    return subscriptions, usage, usable.filter("problem is not null").select("line", "problem")
