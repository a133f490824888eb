"""All study-centre queries by name."""

from __future__ import annotations

from learnlake.plans import analytics, cleaning, elt, lists, relations, scalars, scanner, texts
from learnlake.plans.registry import ORACLE_SQL, QUERIES, Query

GROUPS = (lists, relations, analytics, scanner, scalars, elt, cleaning, texts)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
