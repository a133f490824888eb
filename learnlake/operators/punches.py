"""The punch machine as set operations: debounce, pairing and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlake.functions import sessions, times
from learnlake.session import stored


def _by_day() -> Window:
    return Window.partitionBy("student_id", "day").orderBy("punch_time", "punch_id")


def with_gaps(punches: DataFrame) -> DataFrame:
    """Adds day, m (minute of the day) and gap (minutes since the student's punch before, debounced ones included)."""
    p = punches.withColumn("day", F.to_date("punch_time")).withColumn("m", times.minute_of(F.col("punch_time")))
    return p.withColumn("gap", F.col("m") - F.lag("m").over(_by_day()))


def debounced(window: int = 1) -> Column:
    """True for a punch that follows another within ``window`` minutes; 0 still swallows the same minute."""
    return F.coalesce(F.col("gap").between(0, window), F.lit(False))


def pairs(punches: DataFrame, window: int = 1) -> DataFrame:
    """student_id, day, pair, m_in and m_out (null for a punch that waits for its second).

    One shuffle by student and day serves the gap, the number and the pair.
    """
    kept = with_gaps(punches).filter(~debounced(window)).withColumn("rn", F.row_number().over(_by_day()))
    kept = kept.withColumn("pair", F.floor((F.col("rn") + 1) / 2).cast("int"))
    return kept.groupBy("student_id", "day", "pair").agg(F.min("m").alias("m_in"), F.when(F.count(F.lit(1)) == 2, F.max("m")).alias("m_out"))


def attendance(punches: DataFrame, window: int = 1) -> DataFrame:
    """student_id, date, session, m_in, m_out and minutes: the last complete pair of each session."""
    m_in, m_out = F.col("m_in"), F.col("m_out")
    done = pairs(punches, window).filter(m_out.isNotNull()).withColumn("session", sessions.live_session(m_in, m_out))
    last = Window.partitionBy("student_id", "day", "session").orderBy(F.desc("pair"))
    rows = done.withColumn("r", F.row_number().over(last)).filter("r = 1")
    return rows.select("student_id", F.col("day").alias("date"), "session", "m_in", "m_out", sessions.live_duration(m_in, m_out).alias("minutes"))


def open_rows(punches: DataFrame, today, window: int = 1) -> DataFrame:
    """Punches that wait for their second: closed at 23:59 on a past day, open today, dropped beside a closed row of the session."""
    waiting = pairs(punches, window).filter(F.col("m_out").isNull())
    waiting = waiting.select("student_id", F.col("day").alias("date"), sessions.live_session(F.col("m_in"), F.col("m_out")).alias("session"), "m_in")
    closed = attendance(punches, window).select("student_id", "date", "session")
    left = waiting.join(closed, ["student_id", "date", "session"], "left_anti")
    return left.withColumn("m_out", F.when(F.col("date") < F.lit(today), F.lit(1439)))


def first_copies(punches: DataFrame, *name: str) -> DataFrame:
    """Exactly-once ledger: of punches with one fingerprint the one that came first stays."""
    w = Window.partitionBy(*name).orderBy("punch_id")
    return punches.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def prune(ledger: DataFrame, today, oldest, days: int = 30) -> DataFrame:
    """The ledger without settled rows older than the buffer's oldest punch, or than ``days`` days without a buffer."""
    limit = F.lit(oldest) if oldest is not None else F.date_sub(F.lit(today), days)
    gone = (F.col("state") != "pending") & (F.to_date("punch_time") < F.lit(today)) & (F.col("punch_time") < limit)
    return ledger.filter(~gone)


#: What a student's day is folded into: the latest minute, the past day's check-in that waits, rows and outcomes.
ROW = "session string, m_in int, m_out int, minutes int, punch_id long"
DAY = f"struct<latest: int, waiting: int, waiting_id: long, rows: array<struct<{ROW}>>, outcomes: array<struct<punch_id: long, outcome: string>>>"


def _row(session: Column, m_in: Column, m_out: Column, minutes: Column, punch_id: Column) -> Column:
    return F.struct(session.alias("session"), m_in.cast("int").alias("m_in"), m_out.cast("int").alias("m_out"), minutes.cast("int").alias("minutes"), punch_id.cast("long").alias("punch_id"))


def _judged(day: Column, punch: Column, window: int) -> Column:
    """A day after one more punch (m, punch_id), by the rules of ``with_standing_rows``."""
    m, rows, today = punch["m"], day["rows"], F.col("today")
    none, long_none = F.lit(None).cast("int"), F.lit(None).cast("long")
    again = F.coalesce((m - day["latest"]).between(0, window), F.lit(False))
    open_ = F.get(F.filter(rows, lambda r: r["m_out"].isNull()), F.lit(0))
    start = F.when(today, open_["m_in"]).otherwise(day["waiting"])
    start_id = F.when(today, open_["punch_id"]).otherwise(day["waiting_id"])
    early = F.when(m >= sessions.LUNCH, "Afternoon").otherwise("Morning")
    spanned = F.exists(rows, lambda r: F.coalesce((r["m_in"] <= m) & (m <= r["m_out"]), F.lit(False)))
    taken = today & F.exists(rows, lambda r: (r["m_in"] == m) | F.coalesce(r["m_out"] == m, F.lit(False)) | (r["session"] == early))
    final, minutes = sessions.live_session(start, m), sessions.live_duration(start, m)

    def after(outcome: str, waiting: Column = day["waiting"], waiting_id: Column = day["waiting_id"], kept: Column = rows, told: Column = day["outcomes"]) -> Column:
        own = F.struct(punch["punch_id"].alias("punch_id"), F.lit(outcome).alias("outcome"))
        return F.struct(
            F.greatest(day["latest"], m).alias("latest"), waiting.alias("waiting"), waiting_id.alias("waiting_id"), kept.alias("rows"), F.array_append(told, own).alias("outcomes")
        ).cast(DAY)

    opened = F.when(today, F.array_append(rows, _row(early, m, none, none, punch["punch_id"]))).otherwise(rows)
    closed = F.filter(rows, lambda r: ~(today & r["m_out"].isNull() & (r["m_in"] == start)) & (r["session"] != final))
    closed = F.array_append(closed, _row(final, start, m, minutes, long_none))
    told = F.transform(day["outcomes"], lambda o: F.when(o["punch_id"] == start_id, F.struct(o["punch_id"].alias("punch_id"), F.lit("applied").alias("outcome"))).otherwise(o))
    return (
        F.when(again, after("debounced"))
        .when(start.isNull() & (spanned | taken), after("duplicate"))
        .when(start.isNull(), after("pending", F.when(~today, m), F.when(~today, punch["punch_id"]), opened))
        .when(m <= start, after("duplicate"))
        .otherwise(after("applied", none, long_none, closed, told))
    )


def with_standing_rows(punches: DataFrame, standing: DataFrame, today, window: int = 1) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rows): what becomes of punches where attendance rows stand already.

    ``standing`` has student_id, date, session, m_in, m_out and minutes. A punch
    within a standing row's span, or one that only repeats it, is a duplicate; a
    completed pair replaces the standing row of its session. A past day's first
    punch waits in the ledger; today's opens a row. Rows open on an earlier day
    close at 23:59 when a later day brings a check-in, or go beside a closed
    row of that session.

    What a punch means depends on what those before it left, so each student's
    day is one ordered fold, as an expression over an array. Of one minute the
    first punch decides and all others repeat it: they are counted before
    anything is shuffled, and no day has more than 1,440 minutes.
    """
    keys = ["student_id", "day"]
    p = punches.select("student_id", F.to_date("punch_time").alias("day"), "punch_id", "punch_time", times.minute_of(F.col("punch_time")).alias("m"))
    first = p.groupBy(*keys, "m").agg(F.min(F.struct("punch_time", "punch_id")).alias("x")).select(*keys, "m", F.col("x.punch_id").alias("punch_id"))
    clock = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("m", "punch_id"))).alias("punches"))
    held = F.sort_array(F.collect_list(F.struct("m_in", "session", "m_out", "minutes")))
    rows = standing.withColumnRenamed("date", "day").groupBy(*keys).agg(held.alias("held"))
    rows = rows.withColumn("held", F.transform("held", lambda r: _row(r["session"], r["m_in"], r["m_out"], r["minutes"], F.lit(None)))).withColumn("held", F.col("held").cast(f"array<struct<{ROW}>>"))
    met = clock.join(rows, keys, "full").withColumn("today", F.col("day") == F.lit(today))
    start = F.struct(F.lit(None), F.lit(None), F.lit(None), F.coalesce("held", F.array().cast(f"array<struct<{ROW}>>")), F.array()).cast(DAY)
    days = met.withColumn("after", F.aggregate(F.coalesce("punches", F.array().cast("array<struct<m: int, punch_id: long>>")), start, lambda day, punch: _judged(day, punch, window)))
    folded = stored(days.select(*keys, "after.rows", "after.outcomes"))
    told = folded.select(*keys, F.inline("outcomes"))
    again = p.select(*keys, "punch_id").join(first, [*keys, "punch_id"], "left_anti").withColumn("outcome", F.lit("debounced"))
    outcomes = told.unionByName(again)
    rows = folded.select(*keys, F.inline("rows")).drop("punch_id")
    checks_in = told.filter("outcome in ('pending', 'applied')").select(*keys).distinct()
    last = checks_in.groupBy("student_id").agg(F.max("day").alias("last"))
    own = Window.partitionBy(*keys)
    met = rows.join(last, "student_id", "left")
    stale = F.coalesce(F.col("m_out").isNull() & (F.col("last") > F.col("day")), F.lit(False))
    end = F.lit(23 * 60 + 59)
    closing = F.when(stale, sessions.live_session(F.col("m_in"), end)).otherwise(F.col("session"))
    met = met.withColumn("stale", stale).withColumn("session", closing)
    met = met.withColumn("taken", F.array_contains(F.collect_set(F.when(~F.col("stale"), F.col("session"))).over(own), F.col("session")))
    kept = met.filter(~(F.col("stale") & F.col("taken")))
    kept = kept.withColumn("minutes", F.when(F.col("stale"), sessions.live_duration(F.col("m_in"), end)).otherwise(F.col("minutes"))).withColumn("m_out", F.when(F.col("stale"), end).otherwise(F.col("m_out")))
    return outcomes, kept.select("student_id", F.col("day").alias("date"), "session", "m_in", "m_out", "minutes")
