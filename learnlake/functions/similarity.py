"""Similarities: two that Spark has no expression for, as Arrow-batched UDFs over distinct values, and sound keys."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType


def osa(a: str, b: str) -> int:
    """Edit distance with exchanges of neighbours (optimal string alignment)."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


@pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


@pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, as the standard library's difflib defines it."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


#: How letters sound, in an order in which no rule rewrites what a later one looks at. Capitals are
#: letters as written, small ones are sounds, - stands for a silent letter and keeps its place until the end.
SOUNDS = (
    (r"([^C])\1+", "$1"), (r"^(?:KN|GN|PN|AE|WR)", "$0"), (r"^WH", "W"), (r"^X", "S"),
    (r"(?<=M)B$", "-"), ("B", "b"),
    ("C(?=H)", "x"), ("C(?=[IEY])", "s"), ("C", "k"),
    ("D(?=G[IEY])", "j"), ("D", "t"),
    ("G(?=H.)", "-"), ("G(?=N$)", "-"), ("G(?=[IEY])", "j"), ("G", "k"),
    ("P(?=H)", "f"), ("P", "p"), ("S(?=H)", "x"), ("S", "s"), ("T(?=H)", "0"), ("T(?=I[OA])", "x"), ("T", "t"),
    ("(?<=[^AEIOU])H(?=[AEIOU])", "h"), ("H", "-"),
    ("^W|W(?=[AEIOU])", "w"), ("W", "-"), ("^Y|Y(?=[AEIOU])", "y"), ("Y", "-"),
    ("Q", "k"), ("V", "f"), ("Z", "s"), ("X", "ks"), ("(?<!^)[AEIOU]", "-"), ("-", ""),
)


def sound(word: Column) -> Column:
    """A word's key by the rules of Metaphone: words that sound alike have one. Letters A-Z count, whatever their case."""
    key = F.regexp_replace(F.upper(word), "[^A-Z]", "")
    for pattern, sounds in SOUNDS:
        if sounds == "$0":  # of these pairs the second letter is heard
            key = F.when(key.rlike(pattern), F.substr(key, F.lit(2))).otherwise(key)
        else:
            key = F.regexp_replace(key, pattern, sounds)
    return F.regexp_replace(F.upper(key), r"(.)\1+", "$1")


def sound_key(c: Column) -> Column:
    """The sound keys of the a-z0-9 words of a text, with one space between."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1), sound), " ")
