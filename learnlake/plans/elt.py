"""Queries of the loading and cleaning steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from learnlake.functions import text, times
from learnlake.operators import elt, punches
from learnlake.operators import relational as rel
from learnlake.plans.registry import query
from learnlake.sources import roles
from learnlake.sources.roles import with_roles


@query("SELECT s_suppkey, UNNEST(list_distinct([{'a': 'B1', 'b': s_name}, {'a': 'B' || CAST(s_suppkey % 3 AS VARCHAR), 'b': s_name}])).a AS item_id, s_name AS item_name FROM supplier")
def explode_zip_pairs(spark, sf_dir):
    """Two comma-joined cells to rows; the shorter repeats its last item."""
    s = roles.table(spark, sf_dir, "supplier")
    cells = s.select("s_suppkey", F.concat(F.lit("B1, B"), (F.col("s_suppkey") % 3).cast("string"), F.lit(",")).alias("ids"), F.col("s_name").alias("names"))
    return elt.explode_pairs(cells, "ids", "names").select("s_suppkey", "item_id", "item_name")


@query("SELECT title, id, n, top AS suggested, CASE WHEN NOT (n <= 5 AND n <= 0.05 * top_n) THEN 'not_rare' WHEN id = top OR contains(id, top) OR contains(top, id) OR damerau_levenshtein(id, top) <= 1 THEN 'merge' ELSE 'wrong_id_by_title' END AS action FROM (SELECT *, row_number() OVER w AS r, first(id) OVER w AS top, first(n) OVER w AS top_n FROM (SELECT p_type AS title, CAST(p_size AS VARCHAR) AS id, CASE WHEN p_size = 1 THEN 400 ELSE count(*) % 9 + 1 END AS n FROM part GROUP BY p_type, p_size) WINDOW w AS (PARTITION BY title ORDER BY n DESC, length(id), id)) WHERE r > 1")
def id_merge_plan(spark, sf_dir):
    """Ids of a title that are slips of its commonest id."""
    u = roles.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("title"), "p_size").agg(F.count(F.lit(1)).alias("c"))
    return elt.id_merge_plan(u.select("title", F.col("p_size").cast("string").alias("id"), F.when(F.col("p_size") == 1, F.lit(400)).otherwise(F.col("c") % 9 + 1).alias("n")))


@query()
def title_near_dups(spark, sf_dir):
    """Rare titles that resemble a commoner one."""
    t = roles.table(spark, sf_dir, "part").select(F.col("p_name").alias("title"))
    odd = t.filter(F.xxhash64("title") % 7 == 0).select(F.regexp_replace("title", "i", "ii").alias("title")).distinct()
    return elt.near_titles(t.unionByName(odd).groupBy("title").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT CASE WHEN k % 3 = 0 THEN f || '. ' || g WHEN k % 3 = 1 THEN upper(f) || '.' || g ELSE 'x' || substring(f, 2) || ' ' || g END AS name, k AS student_id, CASE k % 3 WHEN 0 THEN 'words' WHEN 1 THEN 'exact' ELSE 'similar' END AS tier FROM (SELECT s_suppkey AS k, substring(md5('g' || CAST(s_suppkey AS VARCHAR)), 1, 12) AS g, substring(md5('f' || CAST(s_suppkey AS VARCHAR)), 1, 12) AS f FROM supplier)".replace("f || '. ' || g WHEN", "g || '. ' || f WHEN"))
def name_match_tiers(spark, sf_dir):
    """Names to the roster, by exact name, by the same words, by likeness."""
    k = F.col("s_suppkey")
    part = lambda c: F.substring(F.md5(F.concat(F.lit(c), k.cast("string"))), 1, 12)
    s = roles.table(spark, sf_dir, "supplier").select(k, part("f").alias("f"), part("g").alias("g"))
    roster = s.select(k.alias("student_id"), F.concat("f", F.lit(" "), "g").alias("roster_name"))
    slip = F.concat(F.lit("x"), F.substr("f", F.lit(2)), F.lit(" "), "g")
    name = F.when(k % 3 == 0, F.concat("g", F.lit(". "), "f")).when(k % 3 == 1, F.concat(F.upper("f"), F.lit("."), "g")).otherwise(slip)
    return elt.match_names(s.select(name.alias("name")), roster)


@query(with_roles("SELECT student_id, exam_id, count(DISTINCT marks) AS versions, min(marks) AS lowest, max(marks) AS highest FROM marks GROUP BY ALL HAVING count(DISTINCT marks) > 1", "marks"))
def marks_conflicts(spark, sf_dir):
    """One student's different marks in one exam go to review."""
    g = roles.marks(spark, sf_dir).groupBy("student_id", "exam_id").agg(F.countDistinct("marks").alias("versions"), F.min("marks").alias("lowest"), F.max("marks").alias("highest"))
    return g.filter("versions > 1")


@query(with_roles("""SELECT block, most AS old, usual AS new FROM (SELECT instructor_id * 1000 + small_max AS block, subject AS topic, small_max AS most, count(*) FILTER (WHERE marks > small_max) AS over, max(marks) AS high FROM marks JOIN exams USING (exam_id) GROUP BY ALL) b
    JOIN (SELECT topic, most AS usual FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY k DESC, most DESC) AS r FROM (SELECT topic, most, count(*) AS k FROM (SELECT DISTINCT instructor_id * 1000 + small_max AS block, subject AS topic, small_max AS most FROM marks JOIN exams USING (exam_id)) GROUP BY ALL)) WHERE r = 1 AND k >= 2) USING (topic) WHERE over >= 2 AND usual >= high""", "marks", "exams"))  # fmt: skip
def block_max_repair(spark, sf_dir):
    """A block's maximum that its marks exceed gives way to the topic's usual one."""
    m = roles.marks(spark, sf_dir).join(roles.exams(spark, sf_dir).select("exam_id", "subject", "small_max"), "exam_id")
    m = m.select((F.col("instructor_id") * 1000 + F.col("small_max")).alias("block"), F.col("subject").alias("topic"), F.col("small_max").alias("most"), "marks")
    return elt.repair_block_max(m)


@query(with_roles("""SELECT row_id, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.student_id = b.student_id AND n.date = b.date AND n.session = b.session) THEN 'fill'
    WHEN EXISTS (SELECT 1 FROM n WHERE n.student_id = b.student_id AND n.date = b.date AND coalesce(abs(n.m_in - b.m_in) <= 2, true) AND coalesce(abs(n.m_out - b.m_out) <= 2, true)) THEN 'near'
    WHEN EXISTS (SELECT 1 FROM (SELECT student_id, date, min(m_in) AS lo, max(m_out) AS hi FROM n GROUP BY ALL) s WHERE s.student_id = b.student_id AND s.date = b.date AND b.m_in >= lo - 2 AND coalesce(b.m_out, b.m_in) <= hi + 2) THEN 'covered' ELSE 'insert' END AS action
    FROM (SELECT student_id * 100000 + (date - DATE '2024-01-01') * 1440 + m_in AS row_id, student_id, date, CASE WHEN m_in % 2 = 0 THEN 'Other' ELSE session END AS session, m_in + 1 AS m_in, CASE WHEN m_in % 3 = 0 THEN NULL ELSE m_out + 1 END AS m_out FROM sessions) b""", "sessions").replace(" SELECT row_id, CASE", ", n AS (SELECT * FROM sessions WHERE student_id % 4 <> 0 AND m_in % 5 <> 0) SELECT row_id, CASE", 1))  # fmt: skip
def snapshot_merge(spark, sf_dir):
    """What becomes of each row of an older copy."""
    s = punches.attendance(roles.punches(spark, sf_dir))
    now = s.filter("student_id % 4 <> 0 and m_in % 5 <> 0")
    row_id = F.col("student_id") * 100000 + F.datediff("date", F.lit("2024-01-01").cast("date")) * 1440 + F.col("m_in")
    old = s.select(row_id.alias("row_id"), "student_id", "date", F.when(F.col("m_in") % 2 == 0, "Other").otherwise(F.col("session")).alias("session"), (F.col("m_in") + 1).alias("m_in"), F.when(F.col("m_in") % 3 != 0, F.col("m_out") + 1).alias("m_out"))
    return elt.merge_snapshot(now, old)


@query(with_roles("SELECT exam_id, count(*) AS rejected FROM marks JOIN exams USING (exam_id) WHERE marks > small_max GROUP BY 1", "marks", "exams"))
def over_max_rejects(spark, sf_dir):
    """Marks above the maximum are refused and counted."""
    m = roles.marks(spark, sf_dir).join(roles.exams(spark, sf_dir).select("exam_id", "small_max"), "exam_id")
    return m.filter("marks > small_max").groupBy("exam_id").agg(F.count(F.lit(1)).alias("rejected"))


@query(with_roles("SELECT punch_id, last_value(CASE WHEN status = 'purchase' THEN punch_id END IGNORE NULLS) OVER (PARTITION BY student_id ORDER BY punch_time, punch_id ROWS UNBOUNDED PRECEDING) AS header FROM punches", "punches"))
def forward_fill(spark, sf_dir):
    """A header row's value carried down to the rows below it."""
    w = Window.partitionBy("student_id").orderBy("punch_time", "punch_id")
    header = F.when(F.col("status") == "purchase", F.col("punch_id"))
    return roles.punches(spark, sf_dir).select("punch_id", rel.carried_down(header, w).alias("header"))


@query(with_roles("SELECT usage_id, CASE WHEN (row_number() OVER (PARTITION BY student_id ORDER BY usage_id) - 1) % 2 = 0 THEN 'Morning' ELSE 'Afternoon' END AS half FROM usage WHERE platform = '5-LOW'", "usage"))
def alternate_half(spark, sf_dir):
    """Full-day rows go to the halves by turns."""
    return elt.alternate_halves(roles.usage(spark, sf_dir).filter("platform = '5-LOW'"), ["student_id"], "usage_id").select("usage_id", "half")


@query("SELECT l_orderkey, min(l_linenumber * 1000000 + l_partkey) AS kept, count(*) - 1 AS skipped FROM lineitem GROUP BY 1")
def first_wins(spark, sf_dir):
    """Of rows with one number the first stays, the rest are counted."""
    seen = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    return roles.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(seen).alias("kept"), (F.count(F.lit(1)) - 1).alias("skipped"))


@query("SELECT p_type, p_brand AS runner_up, n, round(n / total, 4) AS share FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r, sum(n) OVER (PARTITION BY p_type) AS total FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 2 AND n >= 2")
def runner_up_share(spark, sf_dir):
    """The second title of each id and its share."""
    n = roles.table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("p_type")
    r = n.withColumn("r", F.row_number().over(own.orderBy(F.desc("n"), "p_brand"))).withColumn("total", F.sum("n").over(own))
    return r.filter("r = 2 and n >= 2").select("p_type", F.col("p_brand").alias("runner_up"), "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


@query("SELECT problem, l_orderkey, place FROM (SELECT CASE WHEN l_quantity > 45 THEN 'high' ELSE 'low' END AS problem, l_orderkey, row_number() OVER (PARTITION BY CASE WHEN l_quantity > 45 THEN 'high' ELSE 'low' END ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem WHERE l_quantity > 45 OR l_quantity < 3) WHERE place <= 8")
def sample_per_group(spark, sf_dir):
    """Eight details a problem; the limit runs before the shuffle."""
    rows = roles.table(spark, sf_dir, "lineitem").filter("l_quantity > 45 or l_quantity < 3").withColumn("problem", F.when(F.col("l_quantity") > 45, "high").otherwise("low"))
    return rel.at_most(rows, ["problem"], 8, *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).select("problem", "l_orderkey", "place")


@query(with_roles("SELECT usage_id, platform AS subscription, account, CAST(540 + minutes * 3 AS INTEGER) AS m_in FROM usage WHERE account = 'F' AND 540 + minutes * 3 BETWEEN 540 AND 1140", "usage"))
def digital_load(spark, sf_dir):
    """Sessions within opening hours whose account cell says subscription, however it is typed."""
    m = (F.lit(540) + F.col("minutes") * 3).alias("m_in")
    cell = F.when(F.col("account") == "F", "Sub s,cription").when(F.col("account") == "O", "Own account").otherwise(" ")
    u = roles.usage(spark, sf_dir).filter(text.subscription_like(cell)).select("usage_id", F.col("platform").alias("subscription"), "account", m)
    return u.filter(elt.operating_hours(F.col("m_in")))


@query()
def canonicalizer_fold(spark, sf_dir):
    """Spellings of a name fold into one, in the order in which they appeared."""
    p = roles.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    slipped = F.when(F.col("p_partkey") % 50 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))
    return elt.canonicalise(p.select("p_partkey", slipped.alias("name")), "name", "p_partkey")


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS sheet, event_id AS line, CASE WHEN event_id % 97 = 0 THEN CAST(CAST(ts AS DATE) - INTERVAL 24 MONTH AS DATE) ELSE CAST(ts AS DATE) END AS date, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    w(sheet, rn, line, date, fixed, good) AS (SELECT sheet, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DATE), CAST(NULL AS DATE), CAST(NULL AS DATE) FROM (SELECT DISTINCT sheet FROM e) UNION ALL
    SELECT sheet, rn, line, date, f, coalesce(f, good) FROM (SELECT w.sheet, e.rn, e.line, e.date, w.good, list_extract(list_filter([e.date, TRY_CAST(strftime(w.good, '%Y') || strftime(e.date, '-%m-%d') AS DATE)], lambda x: x BETWEEN DATE '2020-01-01' AND DATE '2024-01-31' AND (w.good IS NULL OR abs(x - w.good) <= 60)), 1) AS f FROM w JOIN e ON e.sheet = w.sheet AND e.rn = w.rn + 1))
    SELECT sheet, line, date, fixed FROM w WHERE rn > 0""")  # fmt: skip
def date_carry_forward(spark, sf_dir):
    """Dates of a sheet that can't be, repaired from the row above; a sheet a student."""
    e = roles.punches(spark, sf_dir)
    slip = F.when(F.col("punch_id") % 97 == 0, F.add_months(F.to_date("punch_time"), -24)).otherwise(F.to_date("punch_time"))
    rows = e.select(F.col("student_id").cast("string").alias("sheet"), F.col("punch_id").alias("line"), slip.alias("date"))
    return elt.carry_dates(rows, roles.TODAY_EVENTS)


@query("WITH RECURSIVE m AS (SELECT s_suppkey AS source, CASE WHEN s_suppkey % 10 = 6 THEN s_suppkey + 3 ELSE s_suppkey - 1 END AS target FROM supplier WHERE s_suppkey % 5 <> 0), w(source, here, path) AS (SELECT source, target, [source] FROM m UNION ALL SELECT w.source, m.target, list_append(w.path, w.here) FROM w JOIN m ON m.source = w.here WHERE NOT list_contains(w.path, w.here)) SELECT source, here AS target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY len(path) DESC) AS r FROM w) WHERE r = 1")
def merge_chains(spark, sf_dir):
    """A to B and B to C give A to C; walks into a cycle end where they enter it."""
    r = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source")).filter("source % 5 <> 0")
    target = F.when(F.col("source") % 10 == 6, F.col("source") + 3).otherwise(F.col("source") - 1)
    return elt.resolve_chains(r.withColumn("target", target))
