"""Queries on scanner punches, and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnlake.functions import sessions
from learnlake.operators import punches as machine
from learnlake.operators import relational as rel
from learnlake.plans.registry import query
from learnlake.sources import roles
from learnlake.sources.roles import TODAY_EVENTS, with_roles


@query(with_roles("SELECT fingerprint, min(punch_id) AS punch_id, count(*) AS copies FROM (SELECT punch_id, concat_ws('|', 'D1', CAST(student_id AS VARCHAR), strftime(punch_time, '%Y-%m-%d %H:%M:%S'), coalesce(status, '')) AS fingerprint FROM punches UNION ALL SELECT punch_id + 1000000, concat_ws('|', 'D1', CAST(student_id AS VARCHAR), strftime(punch_time, '%Y-%m-%d %H:%M:%S'), coalesce(status, '')) FROM punches WHERE punch_id % 3 = 0) GROUP BY 1", "punches"))
def punch_fingerprint_dedup(spark, sf_dir):
    """One ledger row a punch whatever way it came; the first source stays."""
    p = roles.punches(spark, sf_dir)
    both = p.unionByName(p.filter("punch_id % 3 = 0").withColumn("punch_id", F.col("punch_id") + 1000000))
    both = both.withColumn("fingerprint", sessions.fingerprint(F.lit("D1"), F.col("student_id"), F.col("punch_time"), F.col("status")))
    return both.groupBy("fingerprint").agg(F.min("punch_id").alias("punch_id"), F.count(F.lit(1)).alias("copies"))


@query(with_roles("SELECT punch_id, coalesce(gap BETWEEN 0 AND 1, false) AS debounced FROM (SELECT *, m - lag(m) OVER (PARTITION BY student_id, day ORDER BY punch_time, punch_id) AS gap FROM (SELECT *, CAST(punch_time AS DATE) AS day, CAST(hour(punch_time) * 60 + minute(punch_time) AS INTEGER) AS m FROM punches))", "punches"))
def punch_debounce(spark, sf_dir):
    """Punches that follow another within a minute."""
    return machine.with_gaps(roles.punches(spark, sf_dir)).select("punch_id", machine.debounced().alias("debounced"))


@query(with_roles("SELECT * FROM pairs", "pairs"))
def punch_pairs(spark, sf_dir):
    """Debounced punches alternate between arrival and departure."""
    return machine.pairs(roles.punches(spark, sf_dir))


@query(with_roles("SELECT * FROM sessions", "sessions"))
def attendance_sessions(spark, sf_dir):
    """The last pair of each session of a student's day."""
    return machine.attendance(roles.punches(spark, sf_dir))


@query(with_roles("SELECT state, count(*) AS n FROM (SELECT CASE WHEN s.student_id IS NULL THEN 'unknown_student' WHEN k.punch_id IS NULL THEN 'debounced' ELSE 'applied' END AS state FROM punches p LEFT JOIN (SELECT student_id FROM students WHERE student_id % 7 <> 0) s USING (student_id) LEFT JOIN (SELECT punch_id FROM kept) k USING (punch_id)) GROUP BY 1", "students", "kept"))
def punch_state_counts(spark, sf_dir):
    """Outcomes of a run; punches of people that nobody knows are kept and counted."""
    known = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id")).filter("student_id % 7 <> 0").withColumn("known", F.lit(True))
    p = machine.with_gaps(roles.punches(spark, sf_dir)).join(known, "student_id", "left")
    state = F.when(F.col("known").isNull(), "unknown_student").when(machine.debounced(), "debounced").otherwise("applied")
    return p.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(with_roles("SELECT student_id, date, session, m_in, CASE WHEN date < DATE '2024-01-30' THEN 1439 END AS m_out FROM (SELECT student_id, day AS date, CASE WHEN m_in >= 780 THEN 'Afternoon' ELSE 'Morning' END AS session, m_in FROM pairs WHERE m_out IS NULL) w WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.student_id = w.student_id AND s.date = w.date AND s.session = w.session)", "sessions"))
def open_sessions_stale_close(spark, sf_dir):
    """Open rows of past days close at 23:59, or go beside a closed row of the session."""
    return machine.open_rows(roles.punches(spark, sf_dir), TODAY_EVENTS)


@query(with_roles("SELECT punch_id FROM punches WHERE NOT (punch_id % 5 <> 0 AND CAST(punch_time AS DATE) < DATE '2024-01-30' AND punch_time < TIMESTAMP '2024-01-15')", "punches"))
def ledger_prune(spark, sf_dir):
    """Settled rows older than the buffer go; what waits stays."""
    p = roles.punches(spark, sf_dir).withColumn("state", F.when(F.col("punch_id") % 5 == 0, "pending").otherwise("applied"))
    return machine.prune(p, TODAY_EVENTS, "2024-01-15 00:00:00").select("punch_id")


@query(with_roles("SELECT punch_id, student_id FROM punches WHERE punch_id % 11 = 0", "punches"))
def verify_buffer(spark, sf_dir):
    """Pulled records without a ledger row."""
    p = roles.punches(spark, sf_dir)
    mark = lambda df: df.withColumn("fp", sessions.fingerprint(F.lit("D1"), F.col("student_id"), F.col("punch_time"), F.concat_ws(":", "status", "punch_id")))
    return mark(p).join(mark(p.filter("punch_id % 11 <> 0")).select("fp"), "fp", "left_anti").select("punch_id", "student_id")


@query(with_roles("SELECT CAST(punch_time AS DATE) AS day, count(*) AS n, min(punch_time) AS first, max(punch_time) AS last, round(count(*) * 100.0 / 400, 2) AS fill, CASE WHEN count(*) * 100.0 / 400 >= 95 THEN 'clear' WHEN count(*) * 100.0 / 400 >= 80 THEN 'alert' ELSE 'ok' END AS band FROM punches GROUP BY 1", "punches"))
def archive_days(spark, sf_dir):
    """What a day's archive holds, and how full a buffer of 400 records it makes."""
    fill = F.count(F.lit(1)) * 100.0 / 400
    p = roles.punches(spark, sf_dir).groupBy(F.to_date("punch_time").alias("day"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.min("punch_time").alias("first"), F.max("punch_time").alias("last"), F.round(fill, 2).alias("fill"), F.when(fill >= 95, "clear").when(fill >= 80, "alert").otherwise("ok").alias("band"))


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO' AND p_partkey % 50 <> 0)")
def fk_orphans(spark, sf_dir):
    """V1: rows whose parent is gone."""
    parent = roles.table(spark, sf_dir, "part").filter("p_type <> 'PROMO' and p_partkey % 50 <> 0")
    return rel.orphans(roles.table(spark, sf_dir, "lineitem"), parent, "l_partkey", "p_partkey").select("l_orderkey", "l_partkey")


@query(with_roles("SELECT exam_id, o_orderkey, marks, small_max FROM marks JOIN exams USING (exam_id) WHERE marks > small_max OR marks < 0", "marks", "exams"))
def mark_over_max(spark, sf_dir):
    """V2: marks above their exam's maximum or below zero."""
    m = roles.marks(spark, sf_dir).join(roles.exams(spark, sf_dir).select("exam_id", "small_max"), "exam_id")
    return m.filter("marks > small_max or marks < 0").select("exam_id", "o_orderkey", "marks", "small_max")


@query(with_roles("SELECT student_id, date, count(*) AS n FROM usage GROUP BY ALL HAVING count(*) > 1", "usage"))
def unique_violations(spark, sf_dir):
    """V3, V4: keys that should be unique and are not."""
    return rel.duplicates(roles.usage(spark, sf_dir), "student_id", "date")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, sf_dir):
    """Rows of each table; Parquet footers answer it."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [roles.table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in _TABLES])


@query()
def table_fingerprint(spark, sf_dir):
    """An order-free fingerprint of each table."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [rel.fingerprint(roles.table(spark, sf_dir, t)).withColumn("name", F.lit(t)) for t in _TABLES])


@query("SELECT severity, problem, n FROM (SELECT 'FATAL' AS severity, 'orphan line' AS problem, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'FATAL', 'negative quantity', count(*) FROM lineitem WHERE l_quantity < 0 UNION ALL SELECT 'WARN', 'duplicate line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'WARN', 'order outside 1995-2000', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1995-01-01' AND DATE '2000-12-31')")
def validation_report(spark, sf_dir):
    """V1-V8: all checks as one table of severity, problem and count."""
    from learnlake.operators import quality

    t = lambda n: roles.table(spark, sf_dir, n)
    return quality.report(
        quality.Check("FATAL", "orphan line", rel.orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey")),
        quality.Check("FATAL", "negative quantity", t("lineitem").filter("l_quantity < 0")),
        quality.Check("WARN", "duplicate line", rel.duplicates(t("lineitem"), "l_orderkey", "l_linenumber")),
        quality.Check("WARN", "order outside 1995-2000", t("orders").filter(~F.to_date("o_orderdate").between("1995-01-01", "2000-12-31"))),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 100000000, 'N' FROM orders WHERE o_orderkey % 100 = 0")
def upsert_orders(spark, sf_dir):
    """Changed rows replace, new ones join."""
    o = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.filter("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("X"))
    new = new.unionByName(o.filter("o_orderkey % 100 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return rel.upsert(o, new, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority, o_orderstatus FROM orders")
def partial_update(spark, sf_dir):
    """Only allowed, given fields change."""
    o = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    changes = o.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("changed").alias("o_orderpriority"), F.lit("Z").alias("o_orderstatus"))
    return rel.overlay(o, changes, ["o_orderkey"], ["o_orderpriority"])


@query("SELECT s_suppkey, 'kept' AS outcome FROM supplier WHERE NOT (s_suppkey % 2 = 0 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)) UNION ALL SELECT s_suppkey, 'refused' FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def delete_restrict(spark, sf_dir):
    """Rows that something refers to are not deleted."""
    s = roles.table(spark, sf_dir, "supplier").select("s_suppkey")
    child = roles.table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    left, refused = rel.delete_restricted(s, s.filter("s_suppkey % 2 = 0"), "s_suppkey", child)
    return left.withColumn("outcome", F.lit("kept")).unionByName(refused.withColumn("outcome", F.lit("refused")))


@query("SELECT problem, n, sample FROM (SELECT problem, count(*) OVER (PARTITION BY problem) AS n, o_orderkey AS sample, row_number() OVER (PARTITION BY problem ORDER BY o_orderkey) AS r FROM (SELECT o_orderkey, 'priority ''...'' unknown' AS problem FROM orders WHERE o_orderpriority LIKE '5%' UNION ALL SELECT o_orderkey, 'status ''...''' FROM orders WHERE o_orderstatus = 'P')) WHERE r <= 8")
def review_histogram(spark, sf_dir):
    """Problems by template, eight samples each; counts come from an aggregate, not a window."""
    from learnlake.functions.text import template_key

    o = roles.table(spark, sf_dir, "orders")
    rows = o.filter("o_orderpriority like '5%'").select("o_orderkey", F.format_string("priority '%s' unknown", "o_orderpriority").alias("message"))
    rows = rows.unionByName(o.filter("o_orderstatus = 'P'").select("o_orderkey", F.format_string("status '%s'", "o_orderstatus").alias("message")))
    rows = rows.withColumn("problem", template_key(F.col("message")))
    counts = rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    return rel.at_most(rows, ["problem"], 8, F.col("o_orderkey")).join(counts, "problem").select("problem", "n", F.col("o_orderkey").alias("sample"))


@query(with_roles("SELECT student_id, date, session, m_in, m_out, minutes FROM sessions", "sessions"))
def punch_stream(spark, sf_dir):
    """A full read of the scanner through the state machine, drained once."""
    from learnlake.streaming import punches

    return punches.drained_attendance(spark, f"{sf_dir}/events.parquet", F.lit("2024-02-15 12:00:00").cast("timestamp"))


#: A student's day, punch by punch: what is open, what is closed, and whether it was a check-in.
_LIVE = """WITH RECURSIVE p AS MATERIALIZED (SELECT user_id AS student_id, CAST(ts AS DATE) AS date, hour(ts) * 60 + minute(ts) AS m, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT student_id, date, 0 AS k, CAST(NULL AS BIGINT) AS latest, CAST(NULL AS BIGINT) AS start, CAST([] AS STRUCT(s VARCHAR, a BIGINT, b BIGINT)[]) AS rows FROM (SELECT DISTINCT student_id, date FROM p)
        UNION ALL SELECT student_id, date, k, m AS latest,
            CASE WHEN again OR (start IS NOT NULL AND m <= start) THEN start WHEN start IS NOT NULL THEN NULL WHEN len(list_filter(rows, lambda x: x.a <= m AND m <= x.b OR x.s = CASE WHEN m >= 780 THEN 'Afternoon' ELSE 'Morning' END)) > 0 THEN NULL ELSE m END,
            CASE WHEN again OR start IS NULL OR m <= start THEN rows ELSE list_append(list_filter(rows, lambda x: x.s <> made), struct_pack(s := made, a := start, b := m)) END
        FROM (SELECT r.student_id, r.date, p.k, p.m, r.start, r.rows, coalesce(p.m - r.latest BETWEEN 0 AND 1, FALSE) AS again, CASE WHEN r.start >= 780 THEN 'Afternoon' WHEN p.m <= 840 THEN 'Morning' ELSE 'Full Day' END AS made
            FROM r JOIN p ON p.student_id = r.student_id AND p.date = r.date AND p.k = r.k + 1)),
    e AS MATERIALIZED (SELECT *, max(date) OVER (PARTITION BY student_id) AS last FROM r QUALIFY row_number() OVER (PARTITION BY student_id, date ORDER BY k DESC) = 1),
    c AS (SELECT student_id, date, unnest(rows, recursive := true) FROM e),
    o AS (SELECT student_id, date, start, date < last OR date + INTERVAL 1 DAY < (SELECT max(ts) - INTERVAL 1 DAY FROM events) AS stale, CASE WHEN start >= 780 THEN 'Afternoon' ELSE 'Full Day' END AS final FROM e WHERE start IS NOT NULL),
    n AS (SELECT student_id, date, s AS session, a AS m_in, b AS m_out FROM c UNION ALL SELECT student_id, date, CASE WHEN stale THEN final WHEN start >= 780 THEN 'Afternoon' ELSE 'Morning' END, start, CASE WHEN stale THEN 1439 END FROM o WHERE NOT stale OR NOT EXISTS (SELECT 1 FROM c WHERE c.student_id = o.student_id AND c.date = o.date AND c.s = o.final))
    SELECT student_id, date, session, CAST(m_in AS INTEGER) AS m_in, CAST(m_out AS INTEGER) AS m_out, CAST(CASE WHEN m_in >= 780 THEN m_out - m_in WHEN m_out <= 840 THEN least(m_out, 780) - m_in ELSE 780 - m_in + m_out - 840 END AS INTEGER) AS minutes FROM n"""


@query(_LIVE)
def live_attendance(spark, sf_dir):
    """Every punch captured as it is made: rows open and close at once, stale ones end at 23:59."""
    from learnlake.streaming import machine, punches

    raw = punches.stream_of(spark, f"{sf_dir}/events.parquet")
    changed = machine.drained(spark, machine.changes(machine.captured(raw, F.col("punch_time")), outcomes=False))
    return machine.rows_of(changed)


@query(_LIVE)
def live_table(spark, sf_dir):
    """The live capture's changes merged into a table by day, batch by batch."""
    import uuid

    from learnlake.session import shared_folder
    from learnlake.streaming import machine, punches, sink

    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    table = sink.ChangedTable(f"{folder}/table", ("student_id", "date", "session"), "date")
    raw = punches.stream_of(spark, f"{sf_dir}/events.parquet")
    changed = machine.changes(machine.captured(raw, F.col("punch_time")), outcomes=False)
    run = changed.writeStream.foreachBatch(table.apply).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    return table.rows(spark, machine.CHANGES).drop("punch_id", "outcome")


_COPY = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date"


def _copies(spark, sf_dir, *key):
    """Two stored copies of orders, in the second of which some are changed, removed and added: their folder, and the levels of their trees."""
    import uuid

    from learnlake.operators import hashtree
    from learnlake.session import shared_folder

    folder = f"{shared_folder(spark)}/copies-{uuid.uuid4().hex}"
    o = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))
    o = o.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in _COPY.split(", ")])
    k = F.col("o_orderkey")
    status = F.when(k % 997 == 0, "Z").otherwise(F.col("o_orderstatus"))
    added = o.filter(k % 1999 == 0).withColumn("o_orderkey", k + 1_000_000_000)
    levels = hashtree.levels_for(o.count())
    hashtree.write_copy(o, f"{folder}/old", *key, levels=levels)
    hashtree.write_copy(o.filter(k % 1009 != 0).withColumn("o_orderstatus", status).unionByName(added), f"{folder}/new", *key, levels=levels)
    return folder, levels


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 0 THEN 'removed' ELSE 'changed' END AS kind FROM orders WHERE o_orderkey % 1009 = 0 OR (o_orderkey % 997 = 0 AND o_orderstatus <> 'Z') UNION ALL SELECT o_orderkey + 1000000000, 'added' FROM orders WHERE o_orderkey % 1999 = 0")
def copies_compared(spark, sf_dir):
    """Differing keys of two copies, found by digests from the root down."""
    from learnlake.operators import hashtree

    folder, levels = _copies(spark, sf_dir, "o_orderkey")
    return hashtree.differences(spark, f"{folder}/old", f"{folder}/new", _COPY, "o_orderkey", levels=levels)


@query("SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'Z' THEN 1 ELSE 0 END)::BIGINT AS marked, max(o_orderdate) AS last FROM (SELECT o_custkey, CASE WHEN o_orderkey % 997 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderkey % 1009 <> 0 UNION ALL SELECT o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 1999 = 0) GROUP BY 1")
def summary_refreshed(spark, sf_dir):
    """A summary a student brought up to date from what changed between two versions alone."""
    from learnlake.operators import hashtree

    folder, levels = _copies(spark, sf_dir, "o_custkey")
    summary = lambda facts: facts.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "Z").alias("marked"), F.max("o_orderdate").alias("last"))
    old = spark.read.schema(_COPY).parquet(f"{folder}/old/rows")
    hashtree.write_summary(old, f"{folder}/state", summary, "o_custkey", levels=levels)
    hashtree.refresh(spark, f"{folder}/state", f"{folder}/old", f"{folder}/new", _COPY, summary, "o_custkey", levels=levels)
    return hashtree.read_summary(spark, f"{folder}/state")


@query("""SELECT CASE WHEN GROUPING(status) = 0 THEN 'status' WHEN GROUPING(priority) = 0 THEN 'priority' WHEN GROUPING(month) = 0 THEN 'month' ELSE 'all' END AS facet, coalesce(status, priority, month, '') AS value, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS large, count(DISTINCT o_custkey) AS students, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2)::DOUBLE AS total
    FROM (SELECT o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice, o_custkey FROM orders) GROUP BY GROUPING SETS ((), (status), (priority), (month))""")
def dashboard_counters(spark, sf_dir):
    """All counters and distributions of a dashboard in one scan, by grouping sets."""
    o = roles.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice", "o_custkey"
    )
    facets = ["status", "priority", "month"]
    of = lambda c: F.grouping(c) == 0
    facet = F.when(of("status"), "status").when(of("priority"), "priority").when(of("month"), "month").otherwise("all")
    counted = o.groupingSets([[], *[[c] for c in facets]], *facets).agg(
        facet.alias("facet"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200_000).alias("large"),
        F.countDistinct("o_custkey").alias("students"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )
    return counted.select("facet", F.coalesce(*facets, F.lit("")).alias("value"), "n", "large", "students", "total")
