"""Marks applied line after line, and the digital section's subscriptions."""

import datetime as dt
import random

from learnlake.operators import loaders


def plain_marks(exams, marks, rows):
    exams, marks, review, how = dict(exams), dict(marks), [], {k: "kept" for k in marks}
    for line, student, exam, mark, most in sorted(rows, key=lambda r: r[0]):
        if mark is None:
            continue
        if most is not None and mark > most:
            review.append((line, "marks_above_max"))
            continue
        if most is not None:
            if exams.get(exam) is None:
                exams[exam] = most
            elif exams[exam] != most:
                review.append((line, "max_marks_conflict"))
        exams.setdefault(exam, None)
        key = (student, exam)
        if key not in marks:
            marks[key], how[key] = mark, "inserted"
        elif marks[key] is None:
            marks[key], how[key] = mark, "filled"
        elif marks[key] != mark:
            review.append((line, "marks_conflict"))
    return exams, {k: (v, how[k]) for k, v in marks.items()}, sorted(review)


def test_marks_equal_those_applied_line_by_line(spark):
    rng = random.Random(4)
    exams = {e: rng.choice([None, 50]) for e in range(6)}
    marks = {(s, e): rng.choice([None, 10]) for s in range(5) for e in range(6) if rng.random() < 0.3}
    rows = [(k, rng.randrange(5), rng.randrange(8), rng.choice([10, 20, 45, None]), rng.choice([None, 30, 50])) for k in range(150)]
    rng.shuffle(rows)
    got = loaders.apply_marks(
        spark.createDataFrame(list(exams.items()), "exam_id long, max_marks int"),
        spark.createDataFrame([(*k, v) for k, v in marks.items()], "student_id long, exam_id long, marks_obtained int"),
        spark.createDataFrame(rows, "line long, student_id long, exam_id long, marks_obtained int, max_marks int"),
    )
    want = plain_marks(exams, marks, rows)
    # an exam whose only rows state no maximum needs no row of its own
    assert {r["exam_id"]: r["max_marks"] for r in got[0].collect()} == {e: m for e, m in want[0].items() if e in exams or m is not None}
    assert {(r["student_id"], r["exam_id"]): (r["marks_obtained"], r["how"]) for r in got[1].collect()} == want[1]
    held = {r["exam_id"] for r in got[0].collect()}
    assert held >= {e for _, e in want[1]} - {6, 7} and sorted(map(tuple, got[2].collect())) == want[2]


def test_digital_rows_and_the_subscriptions_that_they_name(spark):
    day = lambda k: dt.date(2024, 1, k)
    rows = [
        (1, 1, day(3), 600, 700, "Unacademy", " maths ", "Library Subscription"), (2, 2, day(2), 600, 700, "unacademy ", "", "Library Subscription"), (3, 3, day(1), 600, 700, "unacademy", None, "Library Subscription "),
        (4, 4, day(1), 600, 700, "YouTube", "x", "Library Subscription"), (5, 5, day(1), 600, 700, "Unacademy", "x", "Own"), (6, 6, day(1), 600, 700, "", "x", "Own"), (7, 7, day(1), None, 700, "A", "x", "Own"),
        (8, 8, day(1), 500, 700, "A", "x", "Own"), (9, 9, day(1), 600, None, "A", "x", "Own"), (10, 10, day(9), 600, 700, "Test book", "x", "Library Subscription"),
    ]
    df = spark.createDataFrame(rows, "line long, student_id long, date date, m_in int, m_out int, platform string, purpose string, account string")
    subscriptions, usage, review = loaders.load_digital(df, spark.createDataFrame([("testbook", "Testbook")], "alias string, canonical string"))
    assert sorted(map(tuple, subscriptions.collect())) == [("testbook", "Testbook", "Active", day(9)), ("unacademy", "unacademy", "Active", day(3))]
    assert {r["line"]: (r["account_type"], r["subscription_id"], r["purpose"]) for r in usage.collect()} == {
        1: ("Library Subscription", "unacademy", "maths"), 2: ("Library Subscription", "unacademy", None), 3: ("Library Subscription", "unacademy", None),
        4: ("Own Account", None, "x"), 5: ("Own Account", None, "x"), 10: ("Library Subscription", "testbook", "x"),
    }
    assert sorted(map(tuple, review.collect())) == [(8, "outside_operating_hours"), (9, "missing_out_time")]


def test_a_digital_section_in_one_call(spark):
    from learnlake.operators import sections

    day, names = dt.date(2024, 1, 1), [(n, n) for n in ("Unacademy", "Testbook")]
    cells = [
        (1, 600, 700, "Unacademy", "maths"), (2, 600, 900, "Unacademy", "maths"), (3, 600, 900, "Testbook", ""), (4, 600, 800, "Testbook", "a"), (5, 600, 900, "Unacademy", "x"),
        (6, 600, 1000, "Unacademy, Testbook, Other", "a, b"), (7, 600, 800, "Unacademy,Testbook", "a,b"), (8, 900, 950, "UnacademyTestbook", "a"), (9, 600, 700, "X , X", "h , h"), (10, 600, 700, " , ", None), (11, 600, 700, "", "only"),
        (12, 600, None, "X", "open"),
    ]
    df = spark.createDataFrame([(n, n, day, a, b, p, q) for n, a, b, p, q in cells], "line long, student_id long, date date, m_in int, m_out int, platform string, purpose string")
    section, review = sections.digital_section(df.repartition(3), spark.createDataFrame(names, "alias string, canonical string"))
    got = sorted((r["line"], r["item"], r["platform"], r["purpose"], r["m_in"], r["m_out"]) for r in section.collect())
    assert got == sorted([
        (1, 0, "Unacademy", "maths", 600, 700), (2, 0, "Unacademy", "maths", 600, 780), (3, 0, "Testbook", "", 840, 900), (4, 0, "Testbook", "a", 600, 780), (5, 0, "Unacademy", "x", 840, 900),
        (6, 0, "Unacademy", "a", 600, 780), (6, 1, "Testbook", "b", 600, 780), (6, 2, "Other", "b", 840, 1000), (7, 0, "Unacademy", "a", 600, 780), (7, 1, "Testbook", "b", 600, 780),
        (8, 0, "Unacademy", "a", 900, 950), (8, 1, "Testbook", "a", 900, 950), (9, 0, "X", "h", 600, 700), (11, 0, "", "only", 600, 700), (12, 0, "X", "open", 600, None),
    ], key=lambda r: r[:2])
    problems = {}
    for r in review.collect():
        problems.setdefault(r["line"], set()).add(r["problem"])
    assert problems == {2: {"one_half"}, 3: {"one_half"}, 4: {"one_half"}, 5: {"one_half"}, 6: {"lists_differ", "split", "halves_by_order"}, 7: {"split", "morning_alone"}, 8: {"lists_differ", "split"}, 9: {"split", "repeated_pair"}, 10: {"no_platform"}}
