"""Student ids that were entered wrongly, found by the names beside them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType

from learnlake.functions import similarity, text
from learnlake.functions.similarity import osa

#: What may follow a given name.
TITLES = ("rao", "raju", "babu", "kumar", "naidu", "amma", "appa", "anna")
#: Initials that may stand before an entered name.
INITIALS = 3


def _tails(entered: str, least: int) -> list[str]:
    """An entered name's key without up to INITIALS leading letters, as far as enough is left."""
    return [entered[k:] for k in range(INITIALS + 1) if len(entered) - k >= least]


def _tokens(name: str, least: int) -> list[str]:
    return [w for w in re.findall("[a-z0-9]+", name.lower()) if len(w) >= least]


def _key(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def _near(a: str, b: str, most: int) -> bool:
    return abs(len(a) - len(b)) <= min(most, 3) and osa(a, b) <= most


def _begins(tail: str, key: str) -> bool:
    """A tail of five letters or more that is the key's beginning but for one slip."""
    return len(tail) >= 5 and len(key) >= len(tail) and _near(tail, key[: len(tail)], 1)


def own_name(entered: str, name: str) -> bool:
    """Whether an entered key may well be this name: a beginning or end of one of its words, or one slip away."""
    key = _key(name)
    if not entered or not key:
        return False
    return entered == key or any(
        key.startswith(x) or _begins(x, key) or any(a.startswith(b) or a.endswith(b) for t in _tokens(name, 3) for a, b in ((x, t), (t, x))) or any(_near(x, t, 1) for t in _tokens(name, 3))
        for x in _tails(entered, 3)
    )


def variant(entered: str, name: str) -> bool:
    """Whether it may be this name, garbled: shared runs of four letters, beginnings two slips away, words three away."""

    def alike(x: str, t: str) -> bool:
        runs = any(x[k : k + 4] in t for k in range(len(x) - 3))
        heads = any(_near(x, t[:n], 2) for n in range(max(4, len(x) - 2), min(len(t), len(x) + 2) + 1))
        return x in t or t in x or runs or heads or _near(x, t, 3)

    return any(alike(x, t) for x in _tails(entered, 3) for t in _tokens(name, 3))


def strong(entered: str, name: str) -> bool:
    """Whether it is this name beyond reasonable doubt."""
    key = _key(name)
    if not entered or not key:
        return False

    def whole(x: str) -> bool:
        return (x.startswith(key) or key.startswith(x)) and abs(len(x) - len(key)) <= 2 or _begins(x, key) or _near(x, key, 1)

    def word(x: str, t: str) -> bool:
        return (x.startswith(t) and (len(x) - len(t) <= 2 or x[len(t) :] in TITLES)) or (t.startswith(x) and len(t) - len(x) <= 2) or _near(x, t, 1)

    return entered == key or any(whole(x) or any(word(x, t) for t in _tokens(name, 4)) for x in _tails(entered, 4))


def _judge(rule):
    @pandas_udf(BooleanType())
    def run(entered: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([rule(e or "", n or "") for e, n in zip(entered, name)], dtype=bool)

    return run


def signatures(entered: str) -> list[str]:
    """Strings of which a name shares one with every entered key that is strongly it: see name_signatures."""
    out = set()
    for x in [entered, *_tails(entered, 4)]:
        forms = {x, x[:-1], x[:-2], *(x[: -len(t)] for t in TITLES if x.endswith(t))}
        out |= forms | {x[:k] + x[k + 1 :] for k in range(len(x))}
    return sorted(out)


def name_signatures(name: str) -> list[str]:
    """A name's key and words, their beginnings, and each with one letter left out: one slip leaves a common string."""
    key = _key(name)
    out = set()
    for t in [key, *(key[:n] for n in range(5, len(key))), *_tokens(name, 4)]:
        out |= {t, t[:-1], t[:-2]} | {t[:k] + t[k + 1 :] for k in range(len(t))}
    return sorted(out - {""})


@pandas_udf(ArrayType(StringType()))
def _signatures(entered: pd.Series) -> pd.Series:
    return entered.map(lambda x: signatures(x or ""))


@pandas_udf(ArrayType(StringType()))
def _name_signatures(name: pd.Series) -> pd.Series:
    return name.map(lambda x: name_signatures(x or ""))


def correct_ids(rows: DataFrame, roster: DataFrame, whole: bool = False) -> DataFrame:
    """row_id, new_id and reason of rows (row_id, student_id, name) by a roster (student_id, roster_name).

    Nothing changes where the id is unknown (notfound), where the name is that
    student's (valid) or may be, garbled (variant). Else the only student whose
    name it strongly is takes the row (unique), of several the only one whose
    id is one slip away (nearid); otherwise nocand or ambiguous. Names meet
    students by signatures that every strong match shares, so each meets few.

    With ``whole`` every student of the roster whose name it strongly is counts.
    Without, as the study centre's index has it, only those whose name begins
    with one of the first letters entered and is it by the wide rule too: a
    match by a later word is passed over, and a rival may stay unseen.
    """
    entered = rows.select("row_id", "student_id", text.normalize_key(F.coalesce("name", F.lit(""))).alias("entered"))
    own = entered.join(roster, "student_id", "left")
    asked = own.select("entered", "roster_name").filter("roster_name is not null").distinct()
    fits, may, sure = _judge(own_name), _judge(variant), _judge(strong)
    own_fits = _judge(lambda entered, name: own_name(entered, name) or strong(entered, name)) if whole else fits
    judged = asked.withColumn("fits", own_fits("entered", "roster_name")).withColumn("may", may("entered", "roster_name"))
    own = own.join(judged, ["entered", "roster_name"], "left")
    first = F.when(F.col("roster_name").isNull(), "notfound").when(F.col("fits"), "valid").when(F.col("may"), "variant")
    own = own.withColumn("reason", first).select("row_id", "student_id", "entered", "reason")
    names = own.filter("reason is null").select("entered").distinct().withColumn("mark", F.explode(_signatures("entered")))
    people = roster.withColumn("mark", F.explode(_name_signatures("roster_name"))).select("mark", F.col("student_id").alias("cid"), "roster_name")
    # sizes are estimated as if nothing had been exploded, so neither side may be broadcast by them
    met = names.hint("merge").join(people, "mark").select("entered", "cid", "roster_name").distinct()
    if not whole:
        # a candidate begins with the letter that a tail begins with, and is the name by the wide and by the strict rule
        begins = F.array_contains(F.split(F.substring("entered", 1, INITIALS + 1), ""), F.substring(text.normalize_key(F.col("roster_name")), 1, 1))
        met = met.filter(begins).filter(fits("entered", "roster_name"))
    met = met.filter(sure("entered", "roster_name")).select("entered", "cid")
    found = own.filter("reason is null").select("row_id", "student_id", "entered").join(met, "entered").filter("cid <> student_id")
    found = found.withColumn("close", similarity.osa_distance(F.col("student_id").cast("string"), F.col("cid").cast("string")) <= 1)
    one = found.groupBy("row_id").agg(F.count(F.lit(1)).alias("k"), F.count_if("close").alias("c"), F.min("cid").alias("only"), F.min(F.when(F.col("close"), F.col("cid"))).alias("near"))
    done = own.join(one, "row_id", "left")
    reason = F.coalesce("reason", F.when(F.col("k").isNull(), "nocand").when(F.col("k") == 1, "unique").when(F.col("c") == 1, "nearid").otherwise("ambiguous"))
    done = done.withColumn("reason", reason)
    return done.select("row_id", F.when(F.col("reason") == "unique", F.col("only")).when(F.col("reason") == "nearid", F.col("near")).alias("new_id"), "reason")
