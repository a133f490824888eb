"""Candidates of a similarity join by segments and their places.

A matching ratio of r leaves at most (1 - r) of both strings' letters
unmatched. One string is cut into one segment more than that: some segment
stands whole in the other string, and the first one that has no fewer unmatched
letters before it than segments stands exactly as many places off as their
balance says. With one segment more two are whole: the second of them, found alike, has the
first one's unmatched letters and those between before it, so few strings meet by both;
where few letters may be unmatched, two are asked for. So a string asks for a few places of each segment, by lengths,
and whoever shares none of them needn't be compared. What meets is thinned out
by the letters that both have in common before any worker of Python sees it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlake.functions import similarity


#: Unmatched letters up to which strings meet by two segments; with more, the pairs of segments and places would be too many.
TWO_UP_TO = 10


def _lengths(n: Column, least: float) -> Column:
    """Lengths that a string of n letters may resemble."""
    return F.sequence(F.greatest(F.ceil(n * least / (2 - least) - 1e-9), F.lit(1)).cast("int"), F.greatest(F.floor(n * (2 - least) / least + 1e-9), F.lit(1)).cast("int"))


def _unmatched(total: Column, least: float) -> Column:
    """Letters of both strings, ``total`` together, that may be unmatched: they are odd in number if the total is. -1 if the strings can't be alike."""
    most = F.floor(total * (1 - least) + 1e-9)
    return (most - F.abs(total - most) % 2).cast("int")


def _segments(strings: DataFrame, others: DataFrame, own: str, other: str, least: float) -> DataFrame:
    """s with, for each length that the other side has, the cuts of la: number k of segments, and which of them is asked for, i, or which two, i and j (0 without)."""
    sized = strings.select("s", F.length("s").alias(own)).filter(F.col(own) > 0).withColumn(other, F.explode(_lengths(F.col(own), least)))
    sized = sized.join(F.broadcast(others.select(F.length("s").alias(other)).distinct()), other)  # one row a length
    sized = sized.withColumn("most", _unmatched(F.col("la") + F.col("lb"), least)).filter("most >= 0")
    sized = sized.withColumn("spare", F.when(F.col("most") <= TWO_UP_TO, 1).otherwise(0)).withColumn("k", F.col("most") + 1 + F.col("spare"))
    cut = sized.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("spare"))))
    return cut.withColumn("j", F.explode(F.when(F.col("spare") == 1, F.sequence(F.col("i") + 1, F.col("k"))).otherwise(F.array(F.lit(0)))))


def _start(i: str) -> Column:
    return F.floor((F.col(i) - 1) * F.col("la") / F.col("k")).cast("int")


def _piece(i: str, shift: Column) -> Column:
    """Segment i as it stands ``shift`` places off; empty for i = 0."""
    size = F.floor(F.col(i) * F.col("la") / F.col("k")).cast("int") - _start(i)
    return F.when(F.col(i) > 0, F.substring("s", _start(i) + shift + 1, size)).otherwise(F.lit(""))


def segment_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b), each once, of the strings s of both sides among which are all whose matching ratio is ``least`` (more than 1/2) or more.

    Empty strings resemble none. Meeting places are joined by their hashes, so a
    few more pairs may meet, never fewer.
    """
    if not 0.5 < least <= 1:
        raise ValueError(f"segments would be empty below a ratio of 1/2, not so at {least}")
    key = lambda one, two: F.xxhash64("la", "lb", "i", _piece("i", one), "j", _piece("j", two)).alias("key")
    left, right = left.select("s").distinct(), right.select("s").distinct()
    held = _segments(left, right, "la", "lb", least).select(F.col("s").alias("a"), key(F.lit(0), F.lit(0)), "most")
    asked, off = _segments(right, left, "lb", "la", least), F.col("lb") - F.col("la")
    places = lambda about, before, after: F.sequence(F.greatest(about - before, off - after), F.least(about + before, off + after), F.lit(2))
    some = lambda about, before, after: F.greatest(about - before, off - after) <= F.least(about + before, off + after)
    stands = lambda i, shift: (_start(i) + shift >= 0) & (F.floor(F.col(i) * F.col("la") / F.col("k")) + shift <= F.col("lb"))
    first = (F.lit(0), F.col("i") - 1, F.col("k") - F.col("spare") - F.col("i"))
    asked = asked.filter(some(*first)).withColumn("one", F.explode(places(*first))).filter(stands("i", F.col("one")))
    second = (F.col("one"), F.col("j") - F.col("i") - 1, F.col("k") - F.col("j"))
    asked = asked.filter((F.col("j") == 0) | some(*second)).withColumn("two", F.explode(F.when(F.col("j") > 0, places(*second)).otherwise(F.array(F.lit(0)))))
    asked = asked.filter((F.col("j") == 0) | stands("j", F.col("two"))).select(F.col("s").alias("b"), key(F.col("one"), F.col("two")))
    # sizes are estimated as if nothing had been exploded, so neither side may be broadcast by them; edits are no more than unmatched letters
    met = held.hint("merge").join(asked, "key").filter(F.call_function("levenshtein", "a", "b", "most") >= 0)
    return met.select("a", "b").distinct()


def common_letters(a: str, b: str) -> Column:
    """Letters that two strings have in common, repeats counted: no more of them can match."""
    times = lambda s, x: F.length(s) - F.length(F.replace(F.col(s), x))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def may_match(a: str, b: str, least: Column | float) -> Column:
    """Whether the letters in common allow a matching ratio of ``least``."""
    least = least if isinstance(least, Column) else F.lit(least)
    return 2 * common_letters(a, b) >= least * (F.length(a) + F.length(b)) - 1e-9


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b) that meet by a segment and have letters enough in common."""
    return segment_pairs(left, right, least).filter(may_match("a", "b", least))


def alike_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio) of all strings s of both sides whose matching ratio is at least ``least``."""
    met = candidates(left, right, least)
    return met.withColumn("ratio", similarity.matching_ratio("a", "b")).filter(F.col("ratio") >= least)


def ratio_where(condition: Column, a: str, b: str) -> Column:
    """The matching ratio of the rows that a condition selects, 0 elsewhere: only those are worked out."""
    return F.coalesce(similarity.matching_ratio(F.when(condition, F.col(a)), F.when(condition, F.col(b))), F.lit(0.0))
