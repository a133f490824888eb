"""Whole sections of a cleaned export in one call, with what a person should look at beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlake.functions import sessions, text
from learnlake.operators import scan, topics


def _filled(items: Column, n: Column) -> Column:
    """An array of n items: the last one serves for what is missing, or an empty text where there is none."""
    return F.when(F.size(items) > 0, text.pad_with_last(items, n)).otherwise(F.array_repeat(F.lit(""), n))


def platform_lists(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows with ``platforms``: the items of their cell in order, two names that run into one another apart."""
    items = rows.select("line", F.posexplode(text.split_list(F.col("platform"))).alias("k", "item")).withColumn("cell", text.collapse_ws(F.col("item")))
    parts = items.join(topics.split_jammed(items.select("cell"), aliases), "cell")
    ordered = F.sort_array(F.collect_list(F.struct("k", "parts")))
    lists = parts.groupBy("line").agg(F.flatten(ordered["parts"]).alias("platforms"))
    return rows.join(lists, "line", "left").withColumn("platforms", F.coalesce("platforms", F.array().cast("array<string>")))


def digital_section(rows: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(section, review) of the digital-library rows (line, student_id, date, m_in, m_out, platform, purpose) of a cleaned export.

    Cells of platforms and purposes are lists; the shorter one repeats its last
    item, and a pair that a cell repeats is one use. Each use gets a part of the
    visit. A visit on one side of lunch serves all uses as it is. One that spans
    lunch is shared out: of several uses the first half, rounded up, has the
    morning and the rest the afternoon; one use alone has one half, and such rows
    take the morning and the afternoon by turns, over the whole export. Who
    leaves during lunch has no afternoon. The turns are a scan over ranges of
    lines, which are unique.
    """
    listed = platform_lists(rows, aliases)
    purposes = F.transform(text.split_list(F.col("purpose")), text.collapse_ws)
    listed = listed.withColumn("purposes", purposes).withColumn("n", F.greatest(F.size("platforms"), F.size("purposes")))
    zipped = F.arrays_zip(_filled(F.col("platforms"), F.col("n")).alias("platform"), _filled(F.col("purposes"), F.col("n")).alias("purpose"))
    paired = listed.withColumn("pairs", F.array_distinct(zipped)).withColumn("uses", F.size("pairs"))
    full = F.coalesce(sessions.cleaner_session(F.col("m_in"), F.col("m_out")) == "full_day", F.lit(False))
    paired = paired.withColumn("full", full).withColumn("single", full & (F.col("uses") == 1))
    turned = scan.totals_before(scan.ranges(paired, "line"), {"turn": F.col("single").cast("int")}, "line")
    late = F.col("m_out") > sessions.AFTER
    morning_uses = F.floor((F.col("uses") + 1) / 2)
    turned = turned.withColumn("afternoon", F.when(~F.col("full") | ~late, F.lit(None).cast("int")).when(F.col("single"), F.when(F.col("turn") % 2 == 1, 0).otherwise(1)).otherwise(morning_uses.cast("int")))
    used = turned.select("line", "student_id", "date", "m_in", "m_out", "full", "afternoon", F.posexplode("pairs").alias("item", "pair"))
    later = F.coalesce(F.col("item") >= F.col("afternoon"), F.lit(False))
    start = F.when(later, F.lit(sessions.AFTER)).otherwise(F.col("m_in"))
    end = F.when(F.col("full") & ~later, F.lit(sessions.LUNCH)).otherwise(F.col("m_out"))
    section = used.select("line", "item", "student_id", "date", "pair.platform", "pair.purpose", start.cast("int").alias("m_in"), end.cast("int").alias("m_out"))
    several = F.col("full") & (F.col("uses") >= 2)
    problems = F.array_compact(F.array(
        F.when(F.col("n") == 0, "no_platform"),
        F.when((F.size("platforms") != F.size("purposes")) & (F.size("platforms") > 0) & (F.size("purposes") > 0), "lists_differ"),
        F.when(F.col("n") > 1, "split"), F.when(F.col("uses") < F.col("n"), "repeated_pair"),
        F.when(several & late, "halves_by_order").when(several, "morning_alone").when(F.col("single"), "one_half"),
    ))
    return section, turned.select("line", F.explode(problems).alias("problem"))
