"""Integrity checks: named, graded, counted in one report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    severity: str  #: FATAL or WARN
    problem: str
    rows: DataFrame  #: the offending rows


def report(*checks: Check) -> DataFrame:
    """severity, problem and n of every check, clean ones included."""
    counts = [c.rows.agg(F.lit(c.severity).alias("severity"), F.lit(c.problem).alias("problem"), F.count(F.lit(1)).alias("n")) for c in checks]
    return reduce(DataFrame.unionByName, counts)


def failed(found: DataFrame) -> bool:
    """Whether a fatal check has rows, which ends a load."""
    return not found.filter("severity = 'FATAL' and n > 0").isEmpty()
