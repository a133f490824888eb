"""Queries over text files that Spark writes from the tables first: registers, exports, chunks of sheets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlake.plans.registry import query
from learnlake.session import shared_folder
from learnlake.sources import files, roles


def written(lines: DataFrame, *order: str) -> str:
    """The column ``value`` as text files in the shared folder; the names of the files follow the order."""
    folder = f"{shared_folder(lines.sparkSession)}/text-{uuid.uuid4().hex}"
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(folder)
    return folder


def _quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))


_REGISTER = """SELECT CAST(l_linenumber AS VARCHAR) AS serial, CASE WHEN l_orderkey % 5 = 0 THEN 'Clerk' || chr(10) || '"No" ' || l_suppkey ELSE 'Clerk, ' || l_suppkey END AS name, CAST(l_orderkey AS VARCHAR) AS student_id, p_name AS exam,
    strftime(DATE '2024-01-01' + CAST(p_partkey % 300 AS INTEGER), '%d.%m.%Y') AS date, max(CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) END) OVER (PARTITION BY g) AS most, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS marks
    FROM lineitem JOIN (SELECT *, count(CASE WHEN p_partkey % 4 <> 0 THEN 1 END) OVER (ORDER BY p_partkey) AS g FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) ON p_partkey = l_partkey"""


@query(_REGISTER)
def register_read(spark, sf_dir):
    """A register of one block an exam, with swapped heads, maxima in the wrong column or left out, and names over two lines."""
    lines = roles.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_suppkey", F.col("l_quantity").cast("long").alias("marks"))
    part = roles.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").join(lines.select("p_partkey").distinct(), "p_partkey")
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")), "dd.MM.yyyy")
    k = F.col("p_partkey") % 4
    topic, day = F.when(k == 1, date).otherwise(_quoted("p_name")), F.when(k == 1, _quoted("p_name")).otherwise(date)
    most = F.when(k == 0, F.lit(",")).when(k == 2, F.concat(F.lit(","), "p_size", F.lit(" Marks"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",")))
    heads = part.select("p_partkey", F.lit(0).cast("long").alias("at"), F.lit(0).cast("int").alias("n"), F.concat(F.lit(",,"), topic, F.lit(","), day, F.lit(","), most).alias("value"))
    name = F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit('Clerk\n"No" '), "l_suppkey")).otherwise(F.concat(F.lit("Clerk, "), "l_suppkey"))
    rows = lines.select("p_partkey", F.col("l_orderkey").alias("at"), F.col("l_linenumber").cast("int").alias("n"), F.concat("l_linenumber", F.lit(","), _quoted(name), F.lit(","), "l_orderkey", F.lit(",,,"), "marks").alias("value"))
    return files.read_register(spark, written(heads.unionByName(rows), "p_partkey", "at", "n")).drop("line")


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"ID NO\", 'Dr ' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'x, y' ELSE '' END AS \"Name of the Student\", CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS \"Gender\", 'd' || c_nationkey AS \"Date\", '9:' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') AS \"IN\", '' AS \"OUT\" FROM customer")
def export_read(spark, sf_dir):
    """A daily export with its header below other rows, blank rows, an unnamed column and line breaks within quotes."""
    c = roles.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = _quoted(F.concat(F.lit("Dr "), k.cast("string"), F.when(k % 3 == 0, F.lit("\nx, y")).otherwise(F.lit(""))))
    clock = F.concat(F.lit("9:"), F.lpad((k % 60).cast("string"), 2, "0"))
    row = F.concat(k.cast("string"), F.lit(","), name, F.lit(", "), F.when(k % 7 != 0, F.col("c_mktsegment")).otherwise(F.lit("")), F.lit(",d"), F.col("c_nationkey").cast("string"), F.lit(","), clock, F.lit(",,zz"))
    rows = c.select(k.cast("long").alias("at"), row.alias("value"))
    blank = c.filter(k % 10 == 0).select(k.cast("long").alias("at"), F.lit(",,,,,,").alias("value"))
    head = spark.createDataFrame([(-3, "Report of the day,,"), (-2, ""), (-1, "ID NO,Name of the Student,Gender,Date,IN,OUT,Unnamed: 6")], "at long, value string")
    return files.read_daily_export(spark, written(rows.unionByName(blank).unionByName(head), "at")).drop("source_row")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 500 AS INTEGER) AS chunk FROM orders")
def sheet_chunk_rows(spark, sf_dir):
    """The request in which each row reaches a spreadsheet, by a scan over ranges."""
    o = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return files.sheet_chunks(o, "o_orderdate", "o_orderkey", most_cells=1000).select("o_orderkey", "chunk")


@query("SELECT problem, count(*) AS n, min(row) AS first_row FROM (SELECT o_orderkey AS row, 'status ' || o_orderstatus AS problem FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice > 300000) GROUP BY 1")
def review_ledger(spark, sf_dir):
    """What a load reset, two steps appended and a report reads of the review ledger."""
    folder = f"{shared_folder(spark)}/review-{uuid.uuid4().hex}"
    o = roles.table(spark, sf_dir, "orders")
    step = lambda where, problem: o.filter(where).select(F.col("o_orderkey").alias("row"), problem.alias("problem"))
    files.append_review(step("o_orderstatus = 'F'", F.lit("of a load before")), folder)
    files.reset_review(spark, folder)
    files.append_review(step("o_orderstatus = 'P'", F.concat(F.lit("status "), "o_orderstatus")), folder)
    files.append_review(step("o_totalprice > 300000", F.lit("large")), folder)
    return files.read_review(spark, folder, "row long, problem string").groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))


@query("SELECT CAST(ts AS DATE) AS archive_day, count(*) AS punches, count(DISTINCT user_id) AS students FROM events GROUP BY 1")
def archive_once(spark, sf_dir):
    """Punches archived by day in batches that overlap, one of them again; each fingerprint is there once."""
    from learnlake.streaming import sink

    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    p = roles.punches(spark, sf_dir).select(F.col("punch_id").cast("string").alias("fingerprint"), "student_id", F.to_date("punch_time").alias("archive_day"))
    add, number = sink.archive_batch(folder), F.col("fingerprint").cast("long") % 4
    for k, part in enumerate((number < 2, number.isin(1, 2), number.isin(1, 2), number >= 2)):
        add(p.filter(part), min(k, 1) if k < 3 else 2)
    return spark.read.parquet(folder).groupBy("archive_day").agg(F.count(F.lit(1)).alias("punches"), F.countDistinct("student_id").alias("students"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def newest_version(spark, sf_dir):
    """Snapshots under names that sort by age: one too small is refused, the oldest are pruned, readers see the newest whole one."""
    folder = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    o = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    files.write_version(o.filter("o_orderkey % 2 = 0"), folder, "2024-01-01")
    files.write_version(o, folder, "2024-01-02")
    files.write_version(o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "changed").otherwise(F.col("o_orderstatus"))), folder, "2024-01-03")
    try:
        files.write_version(o.limit(0), folder, "2024-01-04", least_rows=1)
    except ValueError:
        files.prune_versions(spark, folder, keep=2)
    return files.read_version(spark, folder)
