"""The scanner's stream on transformWithState: the scenarios of the punch fixtures, order of arrival, timers, restarts."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from learnlake.streaming import machine

DAY = dt.date(2026, 6, 10)
SCHEMA = "punch_id long, student_id long, punch_time timestamp, fingerprint string, captured_at timestamp"


def at(clock, day=DAY):
    h, m, *s = map(int, clock.split(":"))
    return dt.datetime.combine(day, dt.time(h, m, *s))


def landed(spark, folder, batches):
    """Each batch of (student, punch time, capture time[, fingerprint]) becomes a file that one trigger takes."""
    number = 0
    for rows in batches:
        made = []
        for student, punch, capture, *name in rows:
            number += 1
            made.append((number, student, punch, name[0] if name else f"f{number}", capture))
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, tmp_path, batches, **more):
    changed = machine.drained(spark, machine.changes(landed(spark, str(tmp_path / "in"), batches), **more), str(tmp_path / "out"))
    rows = sorted((r["student_id"], r["date"], r["m_in"], r["m_out"], r["session"], r["minutes"]) for r in machine.rows_of(changed).collect())
    return rows, {r["punch_id"]: r["outcome"] for r in machine.outcomes_of(changed).collect()}


LATER = at("12:00", DAY + dt.timedelta(days=20))

#: Punches of a past day, the rows (m_in, m_out, session, minutes) and outcomes that come of them.
PAST = {
    1: ("09:00 17:00", [(540, 1020, "Full Day", 420)], "applied applied"),
    2: ("09:00 11:00 15:00 17:00", [(540, 660, "Morning", 120), (900, 1020, "Afternoon", 120)], "applied applied applied applied"),
    3: ("09:00 12:00", [(540, 720, "Morning", 180)], "applied applied"),
    4: ("14:30 17:00", [(870, 1020, "Afternoon", 150)], "applied applied"),
    5: ("09:00 11:00 15:00", [(540, 660, "Morning", 120)], "applied applied pending"),
    6: ("09:00 09:10 15:00 17:00", [(540, 550, "Morning", 10), (900, 1020, "Afternoon", 120)], "applied applied applied applied"),
    7: ("09:45 12:40 14:04 14:05", [(585, 760, "Morning", 175)], "applied applied pending debounced"),
    8: ("09:00", [], "pending"),
}


def test_past_days_complete_or_wait(spark, tmp_path):
    """Every scenario is a student; their punches come one a batch."""
    each = {s: p.split() for s, (p, _, _) in PAST.items()}
    batches = [[(s, at(p[k]), LATER) for s, p in each.items() if k < len(p)] for k in range(4)]
    rows, outcomes = run(spark, tmp_path, batches)
    assert rows == sorted((s, DAY, a, b, name, n) for s, (_, want, _) in PAST.items() for a, b, name, n in want)
    numbers = iter(range(1, 100))
    told = {s: [] for s in PAST}
    for batch in batches:
        for s, *_ in batch:
            told[s].append(outcomes[next(numbers)])
    assert {s: " ".join(x) for s, x in told.items()} == {s: x for s, (_, _, x) in PAST.items()}


def test_late_and_repeated_punches_are_duplicates(spark, tmp_path):
    """After 10:00 one of 09:50 that comes later pairs with nothing; a re-tap at 10:00 is debounced; 10:30 closes."""
    rows, outcomes = run(spark, tmp_path, [[(1, at("10:00"), LATER)], [(1, at("09:50"), LATER)], [(1, at("10:00"), LATER)], [(1, at("10:30"), LATER)], [(1, at("10:15"), LATER)]])
    assert rows == [(1, DAY, 600, 630, "Morning", 30)]
    assert [outcomes[k] for k in range(1, 6)] == ["applied", "duplicate", "debounced", "applied", "duplicate"]


def test_one_fingerprint_counts_once_over_batches(spark, tmp_path):
    rows, outcomes = run(spark, tmp_path, [[(1, at("09:00"), LATER, "a")], [(1, at("09:00"), LATER, "a")], [(1, at("11:00"), LATER, "b"), (1, at("11:00"), LATER, "b")]])
    assert rows == [(1, DAY, 540, 660, "Morning", 120)] and sorted(outcomes.values()) == ["applied", "applied", "transport", "transport"]


def test_today_opens_at_once_and_the_next_check_in_closes_what_is_stale(spark, tmp_path):
    today, following = at("09:00"), at("09:00", DAY + dt.timedelta(days=1))
    first = [(1, today, today), (2, today, today), (2, at("09:00:30"), at("09:00:30")), (3, today, today), (3, at("11:00"), at("11:00")), (3, at("11:30"), at("11:30"))]
    changed = machine.drained(spark, machine.changes(landed(spark, str(tmp_path / "in"), [first])), str(tmp_path / "out"))
    assert {(r["student_id"], r["m_in"], r["m_out"]) for r in machine.rows_of(changed).collect()} == {(1, 540, None), (2, 540, None), (3, 540, 660)}
    assert Counter(r["outcome"] for r in machine.outcomes_of(changed).collect()) == {"pending": 2, "debounced": 1, "applied": 2, "duplicate": 1}
    # the stream goes on from its state; a timer would wait a day more
    landed(spark, str(tmp_path / "in"), [[(1, following, following), (3, following, following)]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changed = machine.drained(spark, machine.changes(stream), str(tmp_path / "out"))
    got = {(r["student_id"], r["date"], r["m_in"], r["m_out"], r["session"]) for r in machine.rows_of(changed).collect()}
    after = DAY + dt.timedelta(days=1)
    assert got == {(1, DAY, 540, 1439, "Full Day"), (1, after, 540, None, "Morning"), (2, DAY, 540, None, "Morning"), (3, DAY, 540, 660, "Morning"), (3, after, 540, None, "Morning")}


def test_a_timer_closes_what_nobody_touched_and_drops_old_days(spark, tmp_path):
    """Timers run in the batch after the one that moves the watermark on; a real check-out found later replaces 23:59, until the day is dropped."""
    now = [(1, at("09:00"), at("09:00")), (1, at("10:00"), at("10:00")), (1, at("14:30"), at("14:30")), (2, at("15:00"), at("15:00")), (3, at("15:00"), at("15:00"))]
    soon, late = at("08:00", DAY + dt.timedelta(days=3)), at("08:00", DAY + dt.timedelta(days=40))
    batches = [now, [(9, soon, soon)], [(9, soon, soon)], [(1, at("16:00"), soon)], [(9, late, late)], [(9, late, late)], [(3, at("16:00"), late)]]
    rows, outcomes = run(spark, tmp_path, batches)
    want = {(1, DAY, 540, 600, "Morning", 60), (1, DAY, 870, 960, "Afternoon", 90), (2, DAY, 900, 1439, "Afternoon", 539), (3, DAY, 900, 1439, "Afternoon", 539)}
    assert {r for r in rows if r[0] < 9} == want and outcomes[8] == "applied" and outcomes[11] == "pending"


def test_any_cut_into_batches_gives_what_one_batch_gives(spark, tmp_path):
    """Same order of capture, other batches: the same rows and outcomes."""
    rng, punches = random.Random(6), []
    for _ in range(250):
        punch = at("00:00") + dt.timedelta(days=rng.randrange(3), minutes=rng.randrange(1440))
        punches.append((rng.randrange(5), punch, punch + dt.timedelta(minutes=rng.choice((0, 0, 0, 30, 3000)))))
    punches.sort(key=lambda p: (p[2], p[1]))
    whole = run(spark, tmp_path / "one", [punches])
    cuts = sorted(rng.sample(range(1, len(punches)), 4))
    parts = [punches[a:b] for a, b in zip([0, *cuts], [*cuts, len(punches)], strict=True)]
    assert run(spark, tmp_path / "many", parts) == whole and whole[0]


def test_unknown_users_reach_no_state(spark, tmp_path):
    roster = spark.createDataFrame([(1,)], "student_id long")
    batch = [(1, at("09:00"), LATER), (99_999, at("09:00"), LATER), (99_999, at("17:00"), LATER), (None, at("10:00"), LATER)]
    rows, outcomes = run(spark, tmp_path, [batch], roster=roster)
    assert rows == [] and outcomes == {1: "pending"}
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert Counter(r["outcome"] for r in machine.unknown(batch, roster).collect()) == {"unknown": 3}


@pytest.mark.parametrize("start, end, want", [(540, 1020, ("Full Day", 420)), (540, 800, ("Morning", 240)), (780, 900, ("Afternoon", 120))])
def test_span_is_the_columns_rule(spark, start, end, want):
    from learnlake.functions import sessions

    row = spark.range(1).select(sessions.live_session(F.lit(start), F.lit(end)).alias("s"), sessions.live_duration(F.lit(start), F.lit(end)).alias("n")).first()
    assert (row["s"], row["n"]) == want == machine.span(start, end)


def test_a_batch_reads_and_writes_a_students_state_once():
    """Thirty days of punches cost one read, one write and one timer, and each row is told as the batch leaves it."""
    calls = Counter()

    class State:
        value = None

        def exists(self):
            calls["exists"] += 1
            return self.value is not None

        def get(self):
            calls["get"] += 1
            return self.value

        def update(self, value):
            calls["update"] += 1
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, due):
            calls["timer"] += 1

    from pyspark.sql import Row

    punches = [at(clock, DAY + dt.timedelta(days=k)) for k in range(30) for clock in ("09:00", "11:00")]
    rows = [Row(punch_id=k, punch_time=p, fingerprint=str(k), captured_at=p) for k, p in enumerate(punches)]
    student = machine.Machine(outcomes=False)
    student.init(Handle())
    told = list(student.handleInputRows((1,), iter(rows), None))
    assert [(r["change"], r["date"], r["m_in"], r["m_out"]) for r in told] == [("put", p.date(), 540, 660) for p in punches[::2]]
    assert calls == {"exists": 1, "update": 1, "timer": 1}
    assert list(student.handleInputRows((1,), iter(rows), None)) == [] and calls == {"exists": 2, "get": 1, "update": 2, "timer": 1}
