"""The scanner's live path as one stateful operator a student, on Spark's ``transformWithState``.

Punches are judged in the order in which they were captured. What a student's
past punches left is kept in one state variable, which a batch reads and writes
once: the days within the retention (latest punch, waiting check-in,
fingerprints, rows), the one open row, the number of changes told, and the time
at which the next day is due to go. The day on which a punch is captured is today: its punches open and close
rows at once; those of other days wait in the ledger until their second punch.
A punch that is captured late is judged by what stands then, so it is a
duplicate if it doesn't come after the waiting one.

Event time is the time of capture, so that no punch is ever late for the
watermark, however old it is. Timers on it close an open row at 23:59 of its
day once that has passed, and drop a day's state after the retention. Each
batch emits, in update mode, the outcome of its punches (where they are asked
for) and, as it leaves them, the rows that it wrote or removed, numbered a student; ``rows_of`` and ``outcomes_of`` read the
newest. Punches of users who aren't on the roster are kept as ``unknown``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from learnlake.functions import sessions
from learnlake.session import shared_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Days for which fingerprints and rows are kept; the longest that a timer waits for punches still to be captured.
RETENTION_DAYS, PATIENCE = 30, "1 day"
DAY_END, SESSIONS = 23 * 60 + 59, ("Morning", "Afternoon", "Full Day")
CHANGES = "student_id long, version long, change string, date date, punch_id long, outcome string, session string, m_in int, m_out int, minutes int"
_DAY_MS = 86_400_000


def span(start: int, end: int) -> tuple[str, int]:
    """Session and minutes of a pair, as ``sessions.live_session`` and ``live_duration`` have them."""
    if start >= sessions.LUNCH:
        return "Afternoon", end - start
    if end <= sessions.AFTER:
        return "Morning", min(end, sessions.LUNCH) - start
    return "Full Day", (sessions.LUNCH - start) + (end - sessions.AFTER)


def _ms(day: dt.date) -> int:
    return (day - dt.date(1970, 1, 1)).days * _DAY_MS


@dataclass
class Day:
    """A student's day: minute of the latest punch, the check-in that waits and its punch, fingerprints, closed rows by session."""

    latest: int | None = None
    waiting: int | None = None
    waiting_id: int | None = None
    seen: set[str] = field(default_factory=set)
    rows: dict[str, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, value: tuple) -> Day:
        latest, waiting, waiting_id, seen, *ends = value
        rows = {s: (ends[2 * k], ends[2 * k + 1]) for k, s in enumerate(SESSIONS) if ends[2 * k] is not None}
        return cls(latest, waiting, waiting_id, set(seen), rows)

    def value(self) -> tuple:
        ends = [m for s in SESSIONS for m in self.rows.get(s, (None, None))]
        return self.latest, self.waiting, self.waiting_id, sorted(self.seen), *ends


_DAY = "date: date, latest: int, waiting: int, waiting_id: bigint, seen: array<string>, " + ", ".join(f"in_{k}: int, out_{k}: int" for k in range(len(SESSIONS)))
STATE = f"version long, due long, open_date date, open_session string, open_in int, open_id long, days array<struct<{_DAY}>>"
_Change = Row(*[c.split()[0] for c in CHANGES.split(", ")])


class Machine(StatefulProcessor):
    """Debounce, pairing, spans, conflicts, stale close and retention of one student's punches.

    State is read once and written once for each student that a batch touches;
    one timer at a time waits for the first day that is due to go.
    """

    def __init__(self, window: int = 1, retention: int = RETENTION_DAYS, outcomes: bool = True):
        self.window, self.retention, self.outcomes = window, retention, outcomes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("student", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._begin(key[0])
        for row in sorted(rows, key=lambda r: (r.captured_at, r.punch_time, r.punch_id)):
            date = row.punch_time.date()
            day = self._day(date, row.captured_at.date())
            if row.fingerprint in day.seen:
                outcome = "transport"
            else:
                day.seen.add(row.fingerprint)
                outcome = self._judge(date, day, row.punch_time.hour * 60 + row.punch_time.minute, row.punch_id, row.captured_at.date() == date)
            self._tell("punch", date, punch_id=row.punch_id, outcome=outcome)
        yield from self._end()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._begin(key[0])
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.opened and _ms(self.opened[0]) + _DAY_MS <= now:
            self._close_stale()
        self.known = {date: day for date, day in self.known.items() if _ms(date) + self.retention * _DAY_MS > now}
        if self.due is not None and self.due <= now:
            self.due = None
            if self.known:
                self._wait_until(_ms(min(self.known)) + self.retention * _DAY_MS)
        yield from self._end()

    def close(self) -> None:
        pass

    def _begin(self, student: int) -> None:
        held = self.state.get() if self.state.exists() else None
        self.version, self.due, *opened, days = held or (0, None, None, None, None, None, [])
        self.opened = self.before = tuple(opened) if opened[0] else None
        self.known = {date: Day.of(value) for date, *value in days}
        self.student, self.out, self.rows = student, [], {}

    def _end(self) -> list[Row]:
        if self.opened and self.opened != self.before:
            self.handle.registerTimer(_ms(self.opened[0]) + _DAY_MS)
        days = [(date, *self.known[date].value()) for date in sorted(self.known)]
        self.state.update((self.version, self.due, *(self.opened or (None, None, None, None)), days))
        return [*self.out, *self.rows.values()]

    def _day(self, date: dt.date, today: dt.date) -> Day:
        """A day's state; the end of a new one's retention may be the first to wait for."""
        if date not in self.known:
            self.known[date] = Day()
            self._wait_until(max(_ms(date) + self.retention * _DAY_MS, _ms(today) + _DAY_MS))
        return self.known[date]

    def _wait_until(self, due: int) -> None:
        if self.due is None or due < self.due:
            self.handle.registerTimer(due)
            self.due = due

    def _tell(self, change: str, date: dt.date, punch_id=None, outcome=None, session=None, m_in=None, m_out=None, minutes=None) -> None:
        self.version += 1
        if change != "punch":
            self.rows[date, session] = _Change(self.student, self.version, change, date, punch_id, outcome, session, m_in, m_out, minutes)
        elif self.outcomes:
            self.out.append(_Change(self.student, self.version, change, date, punch_id, outcome, session, m_in, m_out, minutes))

    def _write(self, date: dt.date, day: Day, start: int, end: int) -> None:
        """A pair replaces the row that its session already has."""
        session, minutes = span(start, end)
        day.rows[session] = (start, end)
        self._tell("put", date, session=session, m_in=start, m_out=end, minutes=minutes)

    def _close_stale(self) -> None:
        """An open row ends at 23:59, or goes where a row with a real check-out has its session."""
        date, session, start, _ = self.opened
        self.opened, day = None, self._day(date, date)
        self._tell("gone", date, session=session)
        final = span(start, DAY_END)[0]
        if final not in day.rows:
            self._write(date, day, start, DAY_END)
        elif final == session:
            self._tell("put", date, session=session, m_in=day.rows[final][0], m_out=day.rows[final][1], minutes=span(*day.rows[final])[1])

    def _judge(self, date: dt.date, day: Day, m: int, punch_id: int, today: bool) -> str:
        close = day.latest is not None and 0 <= m - day.latest <= self.window
        day.latest = m if day.latest is None else max(day.latest, m)
        if close:
            return "debounced"
        own = self.opened if today and self.opened and self.opened[0] == date else None
        waiting, waiting_id = (own[2], own[3]) if own else (None, None) if today else (day.waiting, day.waiting_id)
        if waiting is None:
            session = "Afternoon" if m >= sessions.LUNCH else "Morning"
            if any(a <= m <= b for a, b in day.rows.values()) or (today and session in day.rows):
                return "duplicate"
            if self.opened and self.opened[0] != date:
                self._close_stale()
            day.waiting, day.waiting_id = m, punch_id
            if today:
                self.opened = (date, session, m, punch_id)
                self._tell("put", date, session=session, m_in=m)
            return "pending"
        if m <= waiting:
            return "duplicate"
        if own:
            self.opened = None
            self._tell("gone", date, session=own[1])
        day.waiting = day.waiting_id = None
        self._write(date, day, waiting, m)
        self._tell("punch", date, punch_id=waiting_id, outcome="applied")
        return "applied"


def changes(punches: DataFrame, roster: DataFrame | None = None, window: int = 1, patience: str = PATIENCE, retention: int = RETENTION_DAYS, outcomes: bool = True) -> DataFrame:
    """The stream of CHANGES of a stream of punches (punch_id, student_id, punch_time, fingerprint, captured_at).

    ``roster`` has student_id, once each; the punches of others come out as
    ``unknown`` and reach no state. Without ``outcomes`` only rows are told.
    """
    spark = punches.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    p = punches.select("punch_id", F.col("student_id").cast("long").alias("student_id"), "punch_time", "fingerprint", "captured_at")
    own = p.filter("student_id is not null")
    if roster is not None:
        own = own.join(roster.select("student_id"), "student_id", "left_semi")
    timed = own.withWatermark("captured_at", patience)
    return timed.groupBy("student_id").transformWithState(Machine(window, retention, outcomes), CHANGES, "Update", "EventTime")


def unknown(punches: DataFrame, roster: DataFrame) -> DataFrame:
    """Punches of nobody on the roster: they are kept for the ledger and never become a row."""
    return punches.join(roster.select("student_id"), "student_id", "left_anti").select("student_id", F.to_date("punch_time").alias("date"), "punch_id", F.lit("unknown").alias("outcome"))


def newest(changed: DataFrame, *keys: str) -> DataFrame:
    """The last change of each key; what a replayed batch emitted again has the same version."""
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in changed.columns if c not in keys]), "version").alias("_last"))
    return last.select(*keys, "_last.*")


def rows_of(changed: DataFrame) -> DataFrame:
    """The attendance rows after all changes: student_id, date, session, m_in, m_out (null while open) and minutes."""
    rows = newest(changed.filter("change <> 'punch'"), "student_id", "date", "session")
    return rows.filter("change = 'put'").select("student_id", "date", "session", "m_in", "m_out", "minutes")


def outcomes_of(changed: DataFrame) -> DataFrame:
    """punch_id and its last outcome: applied, pending, debounced, duplicate or transport."""
    told = newest(changed.filter("change = 'punch'"), "student_id", "date", "punch_id")
    return told.select("student_id", "date", "punch_id", "outcome")


def captured(raw: DataFrame, at: Column) -> DataFrame:
    """Punches (punch_id, student_id, punch_time, status) with their fingerprint and the time of their capture."""
    name = sessions.fingerprint(F.lit("D1"), F.col("student_id"), F.col("punch_time"), F.concat_ws(":", "status", "punch_id"))
    return raw.withColumn("fingerprint", name).withColumn("captured_at", at)


def drained(spark: SparkSession, stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All changes of what is there now, written and read again; a second call with the same folder goes on from the first."""
    folder = folder or f"{shared_folder(spark)}/machine-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes")
