"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Among all document rates r that give it,
sum(r * size) = target with 0 <= r <= most, the mix takes those nearest to one
copy of each document in relative entropy. The dual of that problem is convex
and has one multiplier a source: r = min(most, exp(multiplier * size / mean
size)). Newton's method finds the multipliers of all sources at once, each
iteration one grouped aggregation; a bracket of every multiplier, halved where
a step leaves it, makes sure that they are met.

A rate depends on source and size alone, so the iterations run over classes of
(source, size). A source of W words has at most sqrt(2 W) classes, as k
different sizes sum up to k * k / 2 words: that bounds what one task rounds.

Rounding goes through a source's classes from the largest size down and spreads
what it took too much or too little over those to come, so a source ends within
the size of its smallest documents of its target. A class's copies are shared evenly among
its documents; the rest go to those with the smallest hash of their doc_id.

Rules: a null text has the size 0; null sources are one source, the last;
documents without words have no say and nothing taken; equal rows are counted
before anything is shuffled and are a row each in the result; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlake.llm.common import checked_broadcast, in_order, materialize

#: Copies of a document at most, and relative distance from the target at which an iteration ends.
MOST, TOLERANCE = 3, 1e-9
#: Documents of a class that are ranked together, and rows that a repeated row is unfolded to at once.
BUCKET, CHUNK = 4096, 65_536
#: Sums are taken over decimals: unlike sums of doubles, they don't depend on the order of the tasks.
EXACT = "decimal(38,6)"

WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, has, name, size, times): the source as a flag and a name, the words of the text, and how often the row occurs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col("source").isNotNull().alias("has"), F.coalesce("source", F.lit("")).alias("name"), size.alias("size"))
    return rows.groupBy("doc_id", "has", "name", "size").agg(F.count(F.lit(1)).alias("times"))


def targets(sources: DataFrame, weights: tuple[int, ...], most: int = MOST) -> DataFrame:
    """sources (has, name, source_size) with ``target``: all words shared by weight, none above ``most`` times its size.

    Sources take the weights in the order of their names, null last. What a
    source can't take is shared again; the level at which all is shared only
    rises, and each round sets at least one more source to its limit.
    """
    ranked, _ = in_order(sources.withColumn("last", ~F.col("has")), ["last", "name"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("row_no") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight).drop("last", "row_no"))
    limit = F.col("source_size") * most
    total, share = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total or 0) / (share or 1), None
    while level != before:
        full = F.col("weight") * F.lit(level) >= limit
        taken, share = ranked.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        before, level = level, (total - (taken or 0)) / share if share else level
    return ranked.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(level)))


def rate(most: int) -> Column:
    """The rate of a document, given its source's multiplier and its size in units of the mean."""
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(math.log(most)))))


def balanced(classes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources (has, name, target ...) with the multiplier at which the rates of their classes (has, name, size, n) meet the target."""
    state = sources.withColumns(
        {"full": F.col("target") >= F.col("source_size") * most, "multiplier": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "met": F.col("source_size") == 0}
    )
    state = materialize(state.withColumn("met", F.col("met") | F.col("full")))
    while (open_ := state.filter("not met")).head(1):
        words = F.col("n") * F.col("size") * rate(most)
        slope = F.when(F.col("multiplier") * F.col("size") / F.col("mean") < math.log(most), words * F.col("size") / F.col("mean"))
        joined = classes.filter("size > 0").join(checked_broadcast(open_), ["has", "name"])
        sums = joined.groupBy("has", "name").agg(F.sum(words.cast(EXACT)).cast("double").alias("given"), F.coalesce(F.sum(slope.cast(EXACT)), F.lit(0)).cast("double").alias("slope"))
        moved = state.join(sums, ["has", "name"], "left").withColumn("over", F.col("given") - F.col("target"))
        moved = moved.withColumns(
            {
                "met": F.col("met") | (F.abs("over") <= F.greatest(F.lit(1e-3), F.col("target") * TOLERANCE)) | F.coalesce(F.col("high") - F.col("low") <= F.abs("multiplier") * 1e-15, F.lit(False)),
                "low": F.when(F.col("over") < 0, F.col("multiplier")).otherwise(F.col("low")),
                "high": F.when(F.col("over") > 0, F.col("multiplier")).otherwise(F.col("high")),
            }
        )
        newton = F.when(F.col("slope") > 0, F.col("multiplier") - F.col("over") / F.col("slope"))
        inside = (newton > F.coalesce("low", F.lit(-math.inf))) & (newton < F.coalesce("high", F.lit(math.inf)))
        halved = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when(F.col("met"), F.col("multiplier")).when(inside, newton).otherwise(halved)
        state = materialize(moved.withColumn("multiplier", step).drop("given", "slope", "over"))
    return state


def round_classes(rows: pd.DataFrame, most: int = MOST) -> pd.DataFrame:
    """Copies of each class of one source, from the largest size down.

    The rates of the classes still to come are scaled by one factor to give what
    is still owed. A class takes the whole number next to its scaled rate among
    those that leave neither less than nothing nor more than the rest can give.
    """
    rows = rows.sort_values("size", ascending=False, kind="stable")
    size, n, rates = (rows[c].to_numpy() for c in ("size", "n", "rate"))
    held = (size * n)[::-1].cumsum()[::-1]
    given = (size * n * rates)[::-1].cumsum()[::-1]
    owed, copies = float(rows["target"].iloc[0]), n.copy()
    for k in range(int((size > 0).sum())):
        rest = held[k + 1] if k + 1 < len(size) else 0
        low, high = math.ceil((owed - most * rest) / size[k]), math.floor(owed / size[k])
        wanted = n[k] * min(rates[k] * owed / given[k], most) if given[k] > 0 else 0
        taken = min(max(math.floor(wanted + 0.5), low), high) if low <= high else math.floor(owed / size[k] + 0.5)
        copies[k] = min(max(taken, 0), most * n[k])
        owed -= float(copies[k] * size[k])
    return rows.assign(copies=copies)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target (both of its source), rate, copies and taken (copies * size) of every document."""
    rows = materialize(sized(docs))
    classes = materialize(rows.groupBy("has", "name", "size").agg(F.sum("times").alias("n")))
    sources = classes.groupBy("has", "name").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    aims = targets(sources, weights, most).withColumn("mean", F.col("source_size") / F.col("documents"))
    state = balanced(classes, aims, most).select("has", "name", "source_size", "target", "mean", "full", "multiplier")
    rated = classes.join(checked_broadcast(state), ["has", "name"]).withColumn("rate", F.when(F.col("source_size") > 0, rate(most)).otherwise(F.lit(1.0)))
    kinds = "has boolean, name string, size long, n long, source_size long, target double, rate double, copies long"
    rated = rated.select("has", "name", "size", "n", "source_size", "target", "rate")
    settled = materialize(rated.groupBy("has", "name").applyInPandas(lambda group: round_classes(group, most), kinds))
    return handed_out(rows, settled)


def handed_out(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """Each document's copies: those of its class by their number, and one more for the first ones by hash of doc_id."""
    whole = ["has", "name", "size"]
    dealt = rows.join(checked_broadcast(settled), whole).withColumn("hash", F.xxhash64("doc_id"))
    dealt = dealt.withColumn("bucket", F.pmod("hash", F.ceil(F.col("n") / BUCKET)))
    within = Window.partitionBy(*whole, "bucket").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("place", F.coalesce(F.sum("times").over(within), F.lit(0)))
    counts = dealt.groupBy(*whole, "bucket").agg(F.sum("times").alias("held"))
    before = Window.partitionBy(*whole).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*whole, "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    ranked = placed.join(starts, [*whole, "bucket"])
    base, more = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    extra = F.least(F.greatest(more - F.col("start") - F.col("place"), F.lit(0)), F.col("times"))
    ranked = ranked.withColumns({"base": base, "extra": extra})
    shares = F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("extra").alias("times")), F.struct(F.col("base").alias("copies"), (F.col("times") - F.col("extra")).alias("times")))
    shared = ranked.select("doc_id", "size", "source_size", "target", "rate", F.inline(shares).alias("copies", "times")).filter("times > 0")
    parts = shared.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(CHUNK).cast("long"))))
    parts = parts.repartition("doc_id", "chunk").withColumn("left", F.least(F.lit(CHUNK), F.col("times") - F.col("chunk")).cast("int"))
    one = parts.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("left"))))
    return one.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
