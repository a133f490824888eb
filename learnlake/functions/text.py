"""Text expressions. All but ``nfkc`` stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: How a bare date, a remark in brackets at the end, an exam's suffix and a head count at the end are written.
BARE_DATE = r"^\d{1,2}[.\-/ ]\d{1,2}[.\-/ ]\d{2,4}$"
END_BRACKET = r"\s*[\(\[][^\)\]]*[\)\]]\s*$"
EXAM_SUFFIX = r"(?i)\b(grand\s*test|exam|test)\b\s*$"
HEAD_COUNT = r"\(\s*(\d+)\s*\)\s*$"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_key(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def slugify(c: Column) -> Column:
    """Other runs become _, none at the ends; ``unknown`` when nothing is left."""
    core = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(core == "", F.lit("unknown")).otherwise(core)


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no expression."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def strip_exam_suffix(c: Column) -> Column:
    """Without a trailing (...) or [...], a trailing exam, test or grand test, and dots and dashes around; the input where nothing is left."""
    core = F.regexp_replace(c, END_BRACKET, "")
    core = F.btrim(F.regexp_replace(core, EXAM_SUFFIX, ""), F.lit(" .-"))
    return F.when(core == "", c).otherwise(core)


def is_bare_date(c: Column) -> Column:
    return F.trim(c).rlike(BARE_DATE)


def exam_identity_key(c: Column) -> Column:
    """The key under which spellings of an exam's topic meet; null for a bare date or an empty text."""
    cleaned = collapse_ws(c)
    return F.when((cleaned != "") & ~is_bare_date(cleaned), normalize_key(strip_exam_suffix(cleaned)))


def subscription_like(c: Column) -> Column:
    """Starts with subs or subc once spaces and commas are squeezed out."""
    return F.regexp_replace(c, r"[\s,]+", "").rlike("(?i)^sub[sc]")


def member_digits(c: Column) -> Column:
    """The digits of a member number as a long; null where there are none."""
    return F.regexp_replace(c, r"\D", "").try_cast("long")


def anagram_key(c: Column) -> Column:
    """The sorted characters of the normalised key; null for fewer than four."""
    key = normalize_key(c)
    return F.when(F.length(key) >= 4, F.array_join(F.array_sort(F.split(key, "")), ""))


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(F.length(c) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def bigram_dice(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|) over distinct bigrams; 0 without any."""
    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(F.lit(0.0))


def token_dice(a: Column, b: Column) -> Column:
    """Dice over the multisets of a-z0-9 tokens."""
    x, y = (F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1) for c in (a, b))
    count = lambda tokens, t: F.size(F.filter(tokens, lambda v: v == t))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, t: acc + F.least(count(x, t), count(y, t)))
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * both / total).otherwise(F.lit(0.0))


def charset_similarity(a: Column, b: Column) -> Column:
    """1 for equal keys, the ratio of lengths where one holds the other, else the Jaccard index of their letters."""
    x, y = normalize_key(a), normalize_key(b)
    lx, ly = F.array_distinct(F.split(x, "")), F.array_distinct(F.split(y, ""))
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return (
        F.when((x == "") | (y == ""), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .when(F.contains(x, y) | F.contains(y, x), short / long)
        .otherwise(F.size(F.array_intersect(lx, ly)) / F.size(F.array_union(lx, ly)))
    )


def title_agreement(a: Column, b: Column) -> Column:
    """1 for titles that are equal but for case and white space, the ratio of lengths where one holds the other,
    else the Jaccard index of their characters without spaces; 0 where one is empty."""
    x, y = F.lower(collapse_ws(a)), F.lower(collapse_ws(b))
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    cx, cy = (F.array_distinct(F.split(F.replace(z, F.lit(" "), F.lit("")), "")) for z in (x, y))
    return (
        F.when((x == "") | (y == ""), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .when(F.contains(x, y) | F.contains(y, x), short / long)
        .otherwise(F.size(F.array_intersect(cx, cy)) / F.size(F.array_union(cx, cy)))
    )


def person_name(c: Column) -> Column:
    """Dots become spaces, runs of spaces one, lower case."""
    return F.lower(collapse_ws(F.regexp_replace(c, r"\.", " ")))


def word_set(c: Column) -> Column:
    """The sorted distinct words of a name, so that the order of words doesn't matter."""
    return F.array_sort(F.array_distinct(F.split(person_name(c), " ")))


def periodical_id(c: Column) -> Column:
    """P, anything but digits, digits: P-digits; else the trimmed input."""
    t = F.trim(c)
    return F.when(t.rlike(r"(?i)^p\D*\d+$"), F.concat(F.lit("P-"), F.regexp_extract(t, r"(\d+)$", 1))).otherwise(t)


def id_prefix(c: Column) -> Column:
    return F.regexp_extract(c, r"^([A-Za-z]*)", 1)


def id_rest(c: Column) -> Column:
    """What follows the letters and punctuation of an id, without leading zeros."""
    return F.ltrim(F.regexp_replace(c, r"^[A-Za-z]*[^A-Za-z0-9]*", ""), F.lit("0"))


def template_key(c: Column) -> Column:
    """Quoted parts become '...', so that messages of one template group."""
    return F.regexp_replace(c, "'[^']*'", "'...'")


def head_count(c: Column) -> Column:
    """The number in a trailing (n); null without one."""
    return F.regexp_extract(c, HEAD_COUNT, 1).try_cast("int")


def without_head_count(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\(\s*\d+\s*\)\s*$", "")


def mapped(c: Column, table: dict[str, str]) -> Column:
    """Looks a normalised spelling up in a small fixed map; null where it has none."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(F.trim(c))]


# The spellings of gender in the two kinds of export.
GENDER_DAILY = {"m": "Male", "male": "Male", "boy": "Male", "f": "Female", "female": "Female", "girl": "Female"}


def gender_from_markers(male: Column, female: Column) -> Column:
    """Gender from two marker columns; null unless exactly one is marked."""
    m, f = F.coalesce(F.trim(male) != "", F.lit(False)), F.coalesce(F.trim(female) != "", F.lit(False))
    return F.when(m & ~f, F.lit("Male")).when(f & ~m, F.lit("Female"))


def split_list(c: Column) -> Column:
    """The trimmed, non-empty items of a comma-joined cell."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def pad_with_last(a: Column, size: Column) -> Column:
    """An array made as long as ``size`` by repeating its last item; empty ones stay empty."""
    missing = F.greatest(size - F.size(a), F.lit(0))
    return F.when(F.size(a) > 0, F.concat(a, F.array_repeat(F.element_at(a, -1), missing))).otherwise(a)
