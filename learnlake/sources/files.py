"""Text sources and sinks of the batch side: exports with odd heads, positional files, ledgers, archives, snapshots."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from learnlake.functions import text
from learnlake.operators import scan
from learnlake.session import stored

#: The columns by which the header row of a daily export is known (fixed values).
DAILY_HEADER = ("ID NO", "Name of the Student", "Gender", "Date", "IN", "OUT")

#: Positions of a members export (fixed values).
MEMBER_COLUMNS = {0: "number", 1: "name", 2: "father", 3: "address", 4: "birth_date", 5: "qualification", 6: "goal", 7: "preparing_for", 9: "join_date", 13: "male", 14: "female", 15: "phone"}

MOST_CELLS = 100_000

#: Lines of a block at most; a block is a row of the scan over all of them.
BLOCK_LINES = 100_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, line, value) of the text files under a path: a row a physical line, which count from 1 over all files by name.

    Files are read in the splits that Spark makes of them; each split is cut
    into blocks of BLOCK_LINES at most, so that what a task sorts doesn't grow
    with the splits, and lines are numbered by a scan over the blocks.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    raw = stored(raw.withColumn("at", F.monotonically_increasing_id()))  # rises with the lines of a split
    raw = raw.withColumn("cut", F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / BLOCK_LINES))  # the lower 33 bits count the lines of a task
    blocks = raw.select("file", "start", "cut").distinct()
    number = F.row_number().over(Window.orderBy("file", "start", "cut"))  # one row a block
    blocks = blocks.select("file", "start", "cut", number.alias("block"))
    numbered = scan.totals_before(raw.join(F.broadcast(blocks), ["file", "start", "cut"]), {"line": F.lit(1)}, "at", part="block")
    bare = F.when(F.col("line") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return numbered.select("block", (F.col("line") + 1).alias("line"), bare.alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, line, value) of the records of delimited text files; a record is known by its first line.

    A line break within quotes belongs to the record. Whether a line begins
    within quotes follows from how many there are before it, which is a scan; only
    the lines of records of several lines are gathered. A quote that is never closed is an
    error.
    """
    lines = read_lines(spark, path).withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    lines = scan.totals_before(lines, {"before": F.col("quotes")}, "line", part="block")
    lines = stored(lines.withColumns({"inside": F.col("before") % 2 == 1, "open": (F.col("before") + F.col("quotes")) % 2 == 1}))
    if (lines.agg(F.sum("quotes")).first()[0] or 0) % 2:
        raise ValueError(f"a quote is left open in {path}")
    several = lines.filter("inside or open")
    if several.isEmpty():
        return lines.select("block", "line", "value")
    begun = scan.carried_down(several, {"record": F.when(~F.col("inside"), F.col("line")), "first": F.when(~F.col("inside"), F.col("block"))}, "line", part="block")
    parts = F.sort_array(F.collect_list(F.struct("line", "value")))
    whole = begun.groupBy("first", "record").agg(F.array_join(parts["value"], "\n").alias("value"))
    return lines.filter("not inside and not open").select("block", "line", "value").unionByName(whole.select(F.col("first").alias("block"), F.col("record").alias("line"), "value"))


def _parsed(records: DataFrame, width: int) -> DataFrame:
    """block, line and cells c0, c1 ... of records."""
    ddl = ", ".join(f"c{k} string" for k in range(width))
    options = {"escape": '"', "multiLine": "true"}
    return records.select("block", "line", F.from_csv("value", F.lit(ddl), options).alias("r")).select("block", "line", "r.*")


def read_daily_export(spark: SparkSession, path: str, header: tuple[str, ...] = DAILY_HEADER) -> DataFrame:
    """An export whose header stands somewhere below the top: trimmed strings, source_row, no blank rows or unnamed columns."""
    lines = stored(numbered_lines(spark, path))
    has_all = reduce(lambda a, b: a & b, [F.contains("value", F.lit(h)) for h in header])
    top = lines.filter(has_all).agg(F.min_by("value", "line"), F.min("line")).first()
    if top[1] is None:
        raise ValueError(f"no header row with {', '.join(header)} in {path}")
    names = [n.strip().strip('"') for n in _cells(top[0])]
    kept = [(k, n) for k, n in enumerate(names) if n and not n.startswith("Unnamed")]
    rows = _parsed(lines.filter(F.col("line") > top[1]), len(names))
    rows = rows.select(F.col("line").alias("source_row"), *[F.coalesce(F.trim(F.col(f"c{k}")), F.lit("")).alias(n) for k, n in kept])
    return rows.filter(reduce(or_, [F.col(f"`{n}`") != "" for _, n in kept]))


def _cells(line: str) -> list[str]:
    import csv

    return next(csv.reader([line]), [])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: a file with a header in its first line; all strings, a byte order mark is dropped."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """A file without names, read by position; short rows give nulls."""
    width = max(MEMBER_COLUMNS) + 1
    schema = StructType([StructField(f"c{k}", StringType()) for k in range(width)])
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    return df.select(*[F.trim(f"c{k}").alias(n) for k, n in MEMBER_COLUMNS.items()])


#: What the first cell of a register's label row says, without dots (fixed values).
SERIAL_LABELS = ("sl no", "slno", "s no")


def read_register(spark: SparkSession, path: str, corrections: dict[tuple[str, str, str], str] | None = None) -> DataFrame:
    """A ragged register of six cells: header rows (no serial or name, a topic or date) give exam, date and maximum to the rows below.

    A date in c2 beside a topic in c3 is a swap; a maximum is the first number of
    c4, or else of c5. A part that a header lacks stays as it was. A student's row
    may name a topic instead of the number of the student; it holds from there on. Label
    rows and rows without any cell are left out. ``corrections`` gives marks for
    (date, exam, marks) that were mistyped.
    """
    lines = _parsed(numbered_lines(spark, path), 6)
    cells = lines.select("block", "line", *[F.coalesce(F.trim(f"c{k}"), F.lit("")).alias(f"c{k}") for k in range(6)])
    cells = cells.filter(~F.lower(F.trim(F.replace("c0", F.lit("."), F.lit("")))).isin(*SERIAL_LABELS))
    letters = lambda c: F.col(c).rlike("[A-Za-z]")
    swapped = text.is_bare_date(F.col("c2")) & letters("c3")
    cells = cells.withColumns({"c2": F.when(swapped, F.col("c3")).otherwise(F.col("c2")), "c3": F.when(swapped, F.col("c2")).otherwise(F.col("c3"))})
    person = (F.col("c0") != "") | (F.col("c1") != "")
    head = ~person & ((F.col("c2") != "") | (F.col("c3") != ""))
    number = lambda c: F.nullif(F.regexp_extract(c, r"\d+(?:\.\d+)?", 0), F.lit(""))
    topic = letters("c2")
    given = {
        "exam": F.when((head | person) & topic, F.col("c2")),
        "date": F.when(head | (person & topic), F.nullif("c3", F.lit(""))),
        "most": F.when(head, F.coalesce(number("c4"), number("c5"))).when(person & topic, number("c4")),
    }
    filled = scan.carried_down(cells.withColumn("person", person), given, "line", part="block").filter("person")
    marks = F.col("c5")
    for (date, exam, wrong), right in (corrections or {}).items():
        marks = F.when((F.col("date") == date) & (F.col("exam") == exam) & (F.col("c5") == wrong), F.lit(right)).otherwise(marks)
    student = F.when(F.col("c2").rlike(r"^\d+$"), F.col("c2")).otherwise(F.lit(""))
    return filled.select("line", F.col("c0").alias("serial"), F.col("c1").alias("name"), student.alias("student_id"), "exam", "date", "most", marks.alias("marks"))


def write_csv(df: DataFrame, path: str) -> bool:
    """Quoted text with a header; nothing is written for an empty result."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return True


def sheet_chunks(df: DataFrame, *order: str, most_cells: int = MOST_CELLS) -> DataFrame:
    """Rows with the chunk in which a spreadsheet of limited cells a request takes them."""
    rows = max(1, most_cells // max(1, len(df.columns)))
    placed = scan.totals_before(scan.ranges(df, *order), {"_place": F.lit(1)}, *order)
    return placed.select(*df.columns, F.floor(F.col("_place") / rows).cast("int").alias("chunk"))


def append_review(rows: DataFrame, path: str) -> None:
    """One JSON object a problem row."""
    rows.write.mode("append").json(path)


def archive(punches: DataFrame, path: str) -> int:
    """Punches by day, each fingerprint once, however often it is called; returns how many were new."""
    spark = punches.sparkSession
    new = punches.dropDuplicates(["fingerprint"]).withColumn("archive_day", F.to_date("punch_time"))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        new = new.join(spark.read.parquet(path).select("fingerprint"), "fingerprint", "left_anti")
    if not new.limit(1).count():
        return 0
    counted = Observation()
    new.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("archive_day").parquet(path)
    return counted.get["n"]


def write_snapshot(df: DataFrame, path: str, least_rows: int = 1) -> None:
    """A new version beside the old ones; refused when it looks half built."""
    n = df.count()
    if n < least_rows:
        raise ValueError(f"{n} rows; a snapshot of fewer than {least_rows} would replace a good one")
    df.write.mode("errorifexists").parquet(path)


def read_review(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The review ledger's rows; none where nothing was ever written."""
    return spark.read.schema(schema).json(path) if _place(spark, path)[1] else spark.createDataFrame([], schema)


def reset_review(spark: SparkSession, path: str) -> None:
    """An empty ledger, as a load begins."""
    fs, there = _place(spark, path)
    if there:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.exists(place)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions of a snapshot folder, oldest first; a version without its _SUCCESS mark isn't one."""
    fs, there = _place(spark, path)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath().toString() for s in fs.listStatus(path_of(path))] if there else []
    return sorted(p for p in found if fs.exists(path_of(f"{p}/_SUCCESS")))


def write_version(df: DataFrame, path: str, name: str, least_rows: int = 1) -> None:
    """A version under a name that sorts by age (a time, say); readers see it once it is complete."""
    write_snapshot(df, f"{path}/{name}", least_rows)


def read_version(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The newest complete version, or the one of a name."""
    found = [v for v in versions(spark, path) if name is None or v.rpartition("/")[2] == name]
    if not found:
        raise ValueError(f"no complete version{f' {name}' if name else ''} in {path}")
    return spark.read.parquet(found[-1])


def prune_versions(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Deletes all complete versions but the newest ``keep`` (1 or more); returns what went."""
    if keep < 1:
        raise ValueError("one version at least is kept")
    fs, _ = _place(spark, path)
    gone = versions(spark, path)[:-keep]
    for p in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p), True)
    return gone
