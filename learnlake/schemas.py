"""Schemas of the study-centre tables."""

from __future__ import annotations

from pyspark.sql.types import StructType


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


# Tables and columns as the study centre names them.
DDL = {
    "students": "student_id long, name string, gender string, date_of_birth date, phone string, email string, father_name string, qualification string, status string, join_date date, renewal_count int",
    "attendance": "attendance_id long, student_id long, date date, session string, check_in string, check_out string, duration_minutes int",
    "subscriptions": "subscription_id string, name string, type string, cost double, start_date date, validity_days int, status string",
    "digital_library_usage": "usage_id long, student_id long, date date, in_time string, out_time string, account_type string, subscription_id string, platform_name string, purpose string, notes string",
    "books": "book_id string, title string, category string",
    "offline_library_usage": "usage_id long, student_id long, book_id string, date date",
    "exams": "exam_id long, exam_name string, exam_date date, subject string, max_marks double",
    "exam_marks": "mark_id long, student_id long, exam_id long, marks_obtained double, remarks string",
    "quizzes": "quiz_id long, quiz_name string, quiz_date date, subject string, max_marks double",
    "quiz_scores": "score_id long, student_id long, quiz_id long, score double, remarks string",
    "instructors": "instructor_id long, name string, phone string, specialization string, notes string, status string",
    "external_participants": "external_participant_id long, name string, village string, phone string, gender string, guardian_name string, notes string",
    "coaching_classes": "class_id long, title string, class_date date, start_time string, end_time string, subject string, instructor_id long, notes string",
    "coaching_enrollments": "enrollment_id long, class_id long, participant_type string, student_id long, external_participant_id long",
    "other_activities": "activity_id long, session_name string, speaker_name string, session_date date, session_type string, notes string",
    "other_activities_attendance": "attendance_id long, activity_id long, participant_type string, student_id long, external_participant_id long",
    "device_punches": "fingerprint string, device_serial string, user_id string, student_id long, punch_time timestamp, status_code string, verify_method string, source string, state string, raw_record string, captured_at timestamp, applied_at timestamp",
    "device_state": "device_serial string, last_sync timestamp, records int, capacity int",
    "holidays": "date date, name string",
    "sync_log": "sync_id long, synced_at timestamp, status string, details string",
    "runtime_config": "key string, value string",
}


def of(table: str) -> StructType:
    return _schema(DDL[table])
