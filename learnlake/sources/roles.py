"""The study-centre tables, played by the fixture tables.

Each role is a projection, so filters and column lists reach the Parquet scan.
``SQL`` holds the same projections for the DuckDB side of a comparison.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The days that stand for today: for tables made of events, and for those made of orders.
TODAY_EVENTS, TODAY_ORDERS = dt.date(2024, 1, 30), dt.date(2001, 8, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student_id, name, label, balance and join_date (first order; null without any)."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("student_id")).agg(F.min(F.to_date("o_orderdate")).alias("join_date"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("balance"))
    return people.join(first, "student_id", "left")


def punches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """punch_id, student_id, punch_time, status of the scanner."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("punch_id"), F.col("user_id").alias("student_id"), F.col("ts").alias("punch_time"), F.col("event_type").alias("status"), "value", "props")


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("exam_id"), F.col("p_name").alias("name"), F.col("p_type").alias("subject"), F.col("p_size").alias("small_max"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student_id, exam_id, marks (of 50), date, order and line."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("student_id"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("exam_id"), F.col("l_quantity").alias("marks"),
        F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("instructor_id"),
    )
    return lines.join(orders, "o_orderkey")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital-library sessions: usage_id, student_id, date, platform, account, cost, minutes."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("usage_id"), F.col("o_custkey").alias("student_id"), F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("platform"), F.col("o_orderstatus").alias("account"), F.col("o_totalprice").alias("cost"),
        (F.floor("o_totalprice") % 240).cast("int").alias("minutes"),
    )


SQL = {
    "students": """students AS (SELECT c_custkey AS student_id, c_name AS name, c_mktsegment AS label, c_acctbal AS balance, j.join_date
        FROM customer LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS join_date FROM orders GROUP BY 1) j ON o_custkey = c_custkey)""",
    "punches": "punches AS (SELECT event_id AS punch_id, user_id AS student_id, ts AS punch_time, event_type AS status, value, props FROM events)",
    "exams": "exams AS (SELECT p_partkey AS exam_id, p_name AS name, p_type AS subject, p_size AS small_max FROM part)",
    "marks": """marks AS (SELECT o_custkey AS student_id, l_partkey AS exam_id, l_quantity AS marks, CAST(l_shipdate AS DATE) AS date,
        l_orderkey AS o_orderkey, l_linenumber AS line, l_suppkey AS instructor_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
    "usage": """usage AS (SELECT o_orderkey AS usage_id, o_custkey AS student_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS platform,
        o_orderstatus AS account, o_totalprice AS cost, CAST(CAST(floor(o_totalprice) AS BIGINT) % 240 AS INTEGER) AS minutes FROM orders)""",
    # Debounced punches of a student and day, numbered; pairs; the last pair of each session.
    "kept": """kept AS (SELECT *, row_number() OVER (PARTITION BY student_id, day ORDER BY punch_time, punch_id) AS rn FROM (
        SELECT *, m - lag(m) OVER (PARTITION BY student_id, day ORDER BY punch_time, punch_id) AS gap FROM (
        SELECT *, CAST(punch_time AS DATE) AS day, CAST(hour(punch_time) * 60 + minute(punch_time) AS INTEGER) AS m FROM punches)) WHERE gap IS NULL OR gap > 1 OR gap < 0)""",
    "pairs": "pairs AS (SELECT student_id, day, CAST((rn + 1) // 2 AS INTEGER) AS pair, min(m) AS m_in, CASE WHEN count(*) = 2 THEN max(m) END AS m_out FROM kept GROUP BY ALL)",
    "sessions": """sessions AS (SELECT student_id, day AS date, session, m_in, m_out, CAST(CASE WHEN m_in >= 780 THEN m_out - m_in WHEN m_out <= 780 THEN m_out - m_in
        WHEN m_out <= 840 THEN 780 - m_in ELSE (780 - m_in) + (m_out - 840) END AS INTEGER) AS minutes FROM (
        SELECT *, row_number() OVER (PARTITION BY student_id, day, session ORDER BY pair DESC) AS r FROM (
        SELECT *, CASE WHEN m_in >= 780 THEN 'Afternoon' WHEN m_out <= 840 THEN 'Morning' ELSE 'Full Day' END AS session FROM pairs WHERE m_out IS NOT NULL)) WHERE r = 1)""",
}

_NEEDS = {"sessions": ["punches", "kept", "pairs"], "pairs": ["punches", "kept"], "kept": ["punches"]}


def with_roles(select: str, *roles: str) -> str:
    """DuckDB SQL that may name the given roles."""
    wanted = list(dict.fromkeys(n for r in roles for n in [*_NEEDS.get(r, []), r]))
    return f"WITH {', '.join(SQL[n] for n in wanted)} {select}"
