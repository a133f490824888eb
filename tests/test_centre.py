"""The study centre's own read operations on a few rows."""

import datetime as dt

import pytest

from learnlake import schemas
from learnlake.plans.centre import Centre

D = dt.date


@pytest.fixture(scope="module")
def centre(spark):
    def table(name, *rows):
        schema = schemas.of(name)
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    return Centre(spark, {
        "students": table("students", dict(student_id=1, name="Asha", gender="Female", status="Active", join_date=D(2023, 2, 10), renewal_count=0), dict(student_id=2, name="Ravi", status="Inactive", join_date=D(2024, 1, 5), renewal_count=0)),
        "attendance": table("attendance", dict(attendance_id=1, student_id=1, date=D(2024, 1, 29), session="Morning", check_in="09:00", check_out="12:00", duration_minutes=180), dict(attendance_id=2, student_id=1, date=D(2024, 1, 30), session="Morning", check_in="09:00")),
        "digital_library_usage": table("digital_library_usage", dict(usage_id=1, student_id=1, date=D(2024, 1, 29), in_time="10:00", out_time="11:30", account_type="Library Subscription", subscription_id="s1", platform_name="P")),
        "subscriptions": table("subscriptions", dict(subscription_id="s1", name="S", cost=10.5, start_date=D(2023, 1, 1), validity_days=30, status="Active"), dict(subscription_id="s2", name="T", status="Active")),
        "offline_library_usage": table("offline_library_usage", dict(usage_id=1, student_id=2, date=D(2024, 1, 2))),
        "exams": table("exams", dict(exam_id=1, exam_name="Polity", exam_date=D(2024, 1, 3), subject="GS", max_marks=50.0), dict(exam_id=2, exam_name="History", exam_date=D(2024, 1, 9))),
        "exam_marks": table("exam_marks", dict(mark_id=1, student_id=1, exam_id=1, marks_obtained=40.0), dict(mark_id=2, student_id=2, exam_id=1, marks_obtained=60.0)),
        "coaching_classes": table("coaching_classes", dict(class_id=1, title="C", class_date=D(2024, 1, 29), start_time="11:30", end_time="12:00", instructor_id=9)),
        "coaching_enrollments": table("coaching_enrollments", dict(enrollment_id=1, class_id=1, participant_type="Library Student", student_id=1), dict(enrollment_id=2, class_id=1, participant_type="External Student", external_participant_id=5)),
        "external_participants": table("external_participants", dict(external_participant_id=5, name="Guest")),
    })


TODAY = D(2024, 1, 30)


def test_lists_and_summaries(centre):
    assert [r["student_id"] for r in centre.students(TODAY, search="RA").collect()] == [2]
    assert [r["student_id"] for r in centre.students(TODAY, label="expiring").collect()] == [1]
    assert [r["student_id"] for r in centre.students(TODAY, label="present").collect()] == [1]
    assert tuple(centre.student_summary(TODAY).first()) == (2, 1, 1, 1, 1, 1)
    assert {tuple(r) for r in centre.gender_distribution().collect()} == {("Female", 1), ("Not specified", 1)}
    assert [(r["subscription_id"], r["status"]) for r in centre.subscriptions(TODAY).collect()] == [("s1", "Expired"), ("s2", "Active")]
    assert tuple(centre.subscription_summary(D(2024, 1, 29), "s").first()) == (2, 1, 1, 10.5, 30.0, 1)
    assert [(r["subscription_id"], r["uses"]) for r in centre.top_subscriptions().collect()] == [("s1", 1)]
    assert [r["attendance_id"] for r in centre.attendance(student_id=1, since=D(2024, 1, 1)).collect()] == [2, 1]
    assert [(r["name"], r["activity"]) for r in centre.present_now(TODAY).collect()] == [("Asha", "attendance")]
    assert centre.digital(account_type="Own Account").count() == 0 and centre.offline(book_id="x").count() == 0 and centre.books("a").count() == 0
    assert [r["exam_id"] for r in centre.assessments("exam", search="pol").collect()] == [1] and centre.assessments("quiz").count() == 0
    assert [r["student_id"] for r in centre.scores("exam").collect()] == [2, 1] and centre.holidays().count() == 0
    assert {r["participant"] for r in centre.coaching_roster(1).collect()} == {"Asha", "Guest"} and centre.activity_roster().count() == 0


def test_extracts_and_dashboards(centre):
    sheets = centre.extracts()
    assert len(sheets) == 8
    assert {tuple(r) for r in sheets["Attendance"].collect()} == {("2024-01-29", "1", "Asha", "Morning", "09:00", "12:00", "180"), ("2024-01-30", "1", "Asha", "Morning", "09:00", "", "")}
    assert sheets["Digital Library"].first()["duration"] == "90" and sheets["Offline Library"].first()["title"] == "Self-study"
    assert {(r["name"], r["percentage"]) for r in sheets["Exams"].collect()} == {("Asha", "80.0"), ("Ravi", "120.0")}
    row = {r["student_id"]: r for r in centre.dashboards(TODAY).collect()}[1]
    assert (row["rate_30d"], row["streak"], row["average_minutes"], row["average_percent"], row["score_trend"]["label"], row["estimated_minutes"]) == (6.67, 2, 180.0, 80.0, "Insufficient data", 60)
    assert {(r["percent"], r["batch_average"]) for r in centre.assessment_rows().collect()} == {(80.0, 100.0), (120.0, 100.0)}
    assert [Centre.sync_outcome(k, 8) for k in (8, 3, 0)] == ["Success", "Partial", "Failed"]


def test_checks(centre):
    bad = {r["problem"]: r["n"] for r in centre.validate(TODAY).collect() if r["n"]}
    assert bad == {"exam_marks beyond its range": 1, "exam without maximum": 1}
