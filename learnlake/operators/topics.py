"""Names of exams and platforms: aliases, one exam a topic and day, cells that hold two names.

Aliases are a table (alias, canonical) that the caller brings; they are looked
up by their normalised key, so a table may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlake.functions import text

#: Keys that never stand for a subscription (fixed values).
NEVER_SUBSCRIPTIONS = ("youtube", "telegram", "rrb", "6308", "y")
#: Letters that each part of a jammed cell has at least.
LEAST_PART = 3


def alias_keys(aliases: DataFrame, suffixes: bool = True) -> DataFrame:
    """key and canonical; of aliases with one key the last by canonical name counts."""
    alias = text.strip_exam_suffix(text.collapse_ws(F.col("alias"))) if suffixes else F.col("alias")
    return aliases.groupBy(text.normalize_key(alias).alias("key")).agg(F.max("canonical").alias("canonical")).filter("key <> ''")


def cleaned(c: Column) -> Column:
    """White space collapsed, double quotes and spaces at the ends gone; null counts as empty."""
    return F.trim(F.btrim(text.collapse_ws(F.coalesce(c, F.lit(""))), F.lit('"')))


def topic_key(topic: Column) -> Column:
    """The key of a cleaned topic without exam words; its own if nothing is left."""
    core = text.normalize_key(text.strip_exam_suffix(topic))
    return F.when(core != "", core).otherwise(text.normalize_key(topic))


def resolve_topics(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """df with ``topic`` and ``identity``: the alias's canonical name, else the name without exam words.

    A bare date or an empty cell has an empty topic and identity. Where no
    alias is known, spellings may still be folded (elt.canonicalise).
    """
    raw = cleaned(F.col(column))
    bare = (raw == "") | text.is_bare_date(raw)
    keyed = df.withColumn("_raw", raw).withColumn("key", F.when(~bare, topic_key(raw)))
    met = keyed.join(alias_keys(aliases), "key", "left")
    topic = F.when(F.col("key").isNull(), F.lit("")).otherwise(F.coalesce("canonical", text.strip_exam_suffix(F.col("_raw"))))
    identity = F.when(F.col("key").isNull(), F.lit("")).otherwise(F.coalesce(text.normalize_key(F.col("canonical")), "key"))
    return met.select(*df.columns, topic.alias("topic"), identity.alias("identity"))


def resolve_platforms(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """df with ``platform`` (canonical name, else the cleaned one) and ``subscription``, false for what never is one."""
    keyed = df.withColumn("_raw", cleaned(F.col(column))).withColumn("key", text.normalize_key(F.col("_raw")))
    met = keyed.join(alias_keys(aliases, suffixes=False), "key", "left")
    platform = F.coalesce("canonical", "_raw")
    known = (platform != "") & ~text.normalize_key(platform).isin(*NEVER_SUBSCRIPTIONS) & ~F.col("key").isin(*NEVER_SUBSCRIPTIONS)
    return met.select(*df.columns, platform.alias("platform"), known.alias("subscription"))


def one_exam_a_day(sightings: DataFrame) -> DataFrame:
    """identity, date, name, first_seen and spellings of each exam among sightings (topic, identity, date, seen, is_register).

    Spellings with one identity on one day are one exam; those without an
    identity are told apart by their topic. The register's spelling wins, of
    several the one that appeared last; without one, the first seen.
    """
    s = sightings.withColumn("identity", F.when(F.coalesce("identity", F.lit("")) != "", F.col("identity")).otherwise(F.col("topic")))
    spelt = s.groupBy("identity", "date", "topic").agg(F.min("seen").alias("seen"), F.min(F.when(F.col("is_register"), F.col("seen"))).alias("own"))
    name = F.coalesce(F.max(F.when(F.col("own").isNotNull(), F.struct("own", "topic")))["topic"], F.min(F.struct("seen", "topic"))["topic"])
    return spelt.groupBy("identity", "date").agg(name.alias("name"), F.min("seen").alias("first_seen"), F.count(F.lit(1)).alias("spellings"))


def split_jammed(cells: DataFrame, aliases: DataFrame) -> DataFrame:
    """cell and parts: [cell], or both names of a cell that is two known names and nothing else.

    A cell that is itself known stays whole. Of several cuts the last counts,
    if both its parts have LEAST_PART letters or more.
    """
    known = alias_keys(aliases, suffixes=False).select("key")
    distinct = cells.select("cell").distinct().withColumn("key", text.normalize_key(F.col("cell")))
    open_ = distinct.filter("length(key) > 1").join(known, "key", "left_anti")
    cuts = open_.withColumn("cut", F.explode(F.sequence(F.lit(1), F.length("key") - 1)))
    cuts = cuts.withColumn("head", F.substr("key", F.lit(1), F.col("cut"))).withColumn("tail", F.substr("key", F.col("cut") + 1))
    both = cuts.join(known.withColumnRenamed("key", "head"), "head").join(known.withColumnRenamed("key", "tail"), "tail")
    last = both.groupBy("cell", "key").agg(F.max("cut").alias("cut")).filter((F.col("cut") >= LEAST_PART) & (F.length("key") - F.col("cut") >= LEAST_PART))
    pattern = F.concat(F.lit("^((?:[^A-Za-z0-9]*[A-Za-z0-9]){"), F.col("cut").cast("string"), F.lit("})(?s)(.*)$"))
    parts = F.array(*[text.collapse_ws(F.call_function("regexp_extract", F.col("cell"), pattern, F.lit(k))) for k in (1, 2)])
    split = last.select("cell", parts.alias("split")).filter(~F.exists("split", lambda x: x == ""))
    return distinct.join(split, "cell", "left").select("cell", F.coalesce("split", F.array("cell")).alias("parts"))
