"""Cleaning and entity resolution: set operations first, ordered folds on distinct keys only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlake.functions import similarity, text
from learnlake.operators import alike
from learnlake.operators import relational as rel
from learnlake.session import stored

#: Shares and counts of the merge rules (fixed values).
MERGE, REVIEW = 0.90, 0.78
RARE_ROWS, RARE_SHARE = 8, 0.10
RARE_IDS, RARE_ID_SHARE = 5, 0.05
#: Titles that sound alike go to review: how near the keys must be, how long both together, how near the spellings.
SOUND, SOUND_LENGTH, SOUND_SPELLING = 0.95, 6, 0.45


def explode_pairs(df: DataFrame, ids: str, names: str) -> DataFrame:
    """One row for each id and name of two comma-joined cells; the shorter list repeats its last item, equal pairs stay once."""
    a, b = text.split_list(F.col(ids)), text.split_list(F.col(names))
    n = F.greatest(F.size(a), F.size(b))
    zipped = F.zip_with(text.pad_with_last(a, n), text.pad_with_last(b, n), lambda x, y: F.struct(x.alias("item_id"), y.alias("item_name")))
    return df.withColumn("_p", F.explode(F.array_distinct(zipped))).select(*df.columns, "_p.item_id", "_p.item_name")


def numbered_parts(parts: Column) -> Column:
    """The items of an array with the number of their repetition, so that sets of them compare like multisets."""
    at = lambda k: F.size(F.filter(F.slice(parts, F.lit(1), k), lambda y: y == F.element_at(parts, k)))
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.element_at(parts, k), F.lit("#"), at(k).cast("string")))
    return F.when(F.size(parts) > 0, whole).otherwise(F.array().cast("array<string>"))


def meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of distinct strings s of both sides that share one of their first ``keep`` parts, rarest first.

    Each side has s, parts (distinct) and keep. Strings of which at least k
    parts are common, of n in all, share one of the first n - k + 1 of each in
    any one order of all parts; the rare come first, so that lists stay short.
    """
    exploded = [df.select("s", "keep", F.explode("parts").alias("part")) for df in (left, right)]
    often = exploded[0].unionByName(exploded[1]).groupBy("part").agg(F.count(F.lit(1)).alias("often"))
    rank = Window.partitionBy("s").orderBy("often", "part")
    # sizes are estimated as if nothing had been exploded, so no side may be broadcast by them
    first = [e.hint("merge").join(often, "part").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= F.col("keep")) for e in exploded]
    return first[0].select("part", F.col("s").alias("a")).hint("merge").join(first[1].select("part", F.col("s").alias("b")), "part").select("a", "b").distinct()


def _by_dice(df: DataFrame, parts: Column, least: float) -> DataFrame:
    """s with parts and keep for strings of whose parts, by Dice's index, ``least`` may be common."""
    n = F.size("parts")
    return df.select("s", parts.alias("parts")).withColumn("keep", n - F.ceil(n * least / (2 - least) - 1e-9) + 1)


def fold_spellings(spellings: DataFrame, key: str, seen: str) -> DataFrame:
    """key, canonical key and action of each distinct key, in the order in which they were first seen.

    A key joins the first earlier one that is its anagram (four letters or
    more), else the earlier one with the highest matching ratio of at least
    MERGE; from REVIEW on it is marked for review. Which one that is doesn't
    depend on what became of the others, so all keys are decided at once and
    the links are then followed to their first key. One rule holds at any size.
    """
    keys = spellings.select(F.col(key).alias("key"), F.col(seen).alias("seen"))
    order = F.struct("seen", "key")
    letters = F.when(F.length("key") >= 4, F.array_join(F.array_sort(F.split("key", "")), ""))
    groups = keys.withColumn("letters", letters).filter("letters is not null")
    first = groups.groupBy("letters").agg(F.min(order).alias("x")).select("letters", F.col("x.key").alias("first"))
    anagrams = groups.join(first, "letters").filter("first <> key").select("key", F.col("first").alias("target"), F.lit("merge").alias("action"))
    s = keys.select(F.col("key").alias("s"))
    met = alike.segment_pairs(s, s, REVIEW).filter("a <> b")
    own, other = keys.select(F.col("key").alias("a"), order.alias("at")), keys.select(F.col("key").alias("b"), order.alias("before"))
    met = met.join(own, "a").join(other, "b").filter("before < at").filter(alike.may_match("a", "b", REVIEW)).withColumn("ratio", similarity.matching_ratio("a", "b")).filter(F.col("ratio") >= REVIEW)
    best = Window.partitionBy("a").orderBy(F.desc("ratio"), "before")
    best = met.withColumn("_r", F.row_number().over(best)).filter("_r = 1").join(anagrams.select(F.col("key").alias("a")), "a", "left_anti")
    near = best.select(F.col("a").alias("key"), F.col("b").alias("target"), F.when(F.col("ratio") >= MERGE, "merge").otherwise("review").alias("action"))
    linked = anagrams.unionByName(near)
    ends = resolve_chains(linked.filter("action = 'merge'").select(F.col("key").alias("source"), "target"))
    found = keys.select("key").join(linked.select("key", "action"), "key", "left").join(ends.select(F.col("source").alias("key"), "target"), "key", "left")
    return found.select("key", F.coalesce("target", "key").alias("canonical"), F.coalesce("action", F.lit("new")).alias("action"))


def canonicalise(df: DataFrame, column: str, order: str) -> DataFrame:
    """df with ``canonical``: the commonest spelling of the key that the value's key folds into."""
    keyed = df.withColumn("_key", text.normalize_key(F.col(column)))
    spelt = keyed.groupBy("_key", column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    keys = spelt.groupBy("_key").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    folded = fold_spellings(keys.filter("_key <> ''"), "_key", "seen")
    w = Window.partitionBy("canonical").orderBy(F.desc("n"), "seen")
    named = spelt.join(folded.withColumnRenamed("key", "_key"), "_key")
    shown = named.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("canonical", F.col(column).alias("_shown"))
    lookup = folded.join(shown, "canonical").select(F.col("key").alias("_key"), F.col("_shown").alias("canonical"))
    return keyed.join(lookup, "_key", "left").select(*df.columns, F.coalesce("canonical", column).alias("canonical"))


def _followed(at: DataFrame, rounds: int) -> DataFrame:
    """Targets after up to 2 ** rounds steps; a round doubles the steps."""
    for _ in range(rounds):
        nxt = at.select(F.col("source").alias("target"), F.col("target").alias("further"))
        step = stored(at.join(nxt, "target", "left").select("source", F.coalesce("further", "target").alias("next"), "target"))
        done = step.filter("next <> target").isEmpty()
        at = step.select("source", F.col("next").alias("target"))
        if done:
            break
    return at


def resolve_chains(merges: DataFrame) -> DataFrame:
    """(source, target) with targets followed to their end; a walk into a cycle ends where it enters it.

    ``merges`` has one target a source. After as many steps as there are
    merges, whoever still moves is in a cycle, and all its members are met
    there. Their own links are then left out and the rest is followed again.
    """
    at = stored(merges.select("source", "target").filter("source <> target"))
    rounds = max(at.count(), 1).bit_length() + 1
    end = _followed(at, rounds)
    looped = end.join(at.select(F.col("source").alias("target")), "target", "left_semi")
    members = stored(looped.select(F.col("target").alias("source")).distinct())
    if members.isEmpty():
        return end
    still = members.select("source", F.col("source").alias("target"))
    return _followed(at.join(members, "source", "left_anti"), rounds).unionByName(still)


def id_merge_plan(uses: DataFrame) -> DataFrame:
    """title, id, n, suggested and action for ids of a title other than its commonest.

    Rare ids whose digits nearly equal the top one's merge; others are reviewed
    with the reason.
    """
    order = Window.partitionBy("title").orderBy(F.desc("n"), F.length("id"), "id")
    ranked = uses.withColumn("r", F.row_number().over(order))
    top = ranked.filter("r = 1").select("title", F.col("id").alias("top"), F.col("n").alias("top_n"))
    other = ranked.filter("r > 1").join(top, "title")
    same_kind = text.id_prefix(F.col("id")) == text.id_prefix(F.col("top"))
    rare = (F.col("n") <= RARE_IDS) & (F.col("n") <= RARE_ID_SHARE * F.col("top_n"))
    a, b = text.id_rest(F.col("id")), text.id_rest(F.col("top"))
    # an exchange of neighbours is two edits otherwise, so the rest needn't be looked at
    few = F.levenshtein(a, b, 2) >= 0
    near = (a == b) | F.contains(a, b) | F.contains(b, a) | F.coalesce(similarity.osa_distance(F.when(few, a), F.when(few, b)) <= 1, F.lit(False))
    action = F.when(~same_kind, "not_similar").when(~rare, "not_rare").when(near, "merge").otherwise("wrong_id_by_title")
    return other.select("title", "id", "n", F.col("top").alias("suggested"), action.alias("action"))


def near_titles(titles: DataFrame) -> DataFrame:
    """source, target, score, sound and action for rare titles that resemble one before them; (title, n) distinct.

    Titles stand by falling n, then by name. A title of up to RARE_ROWS rows is
    compared with all before it; a commoner one only if each of those has 1 /
    RARE_SHARE times its rows, for which the next before it decides. The score is
    the highest of three: matching ratio, Dice of tokens, Dice of pairs of
    letters. From MERGE on titles merge, from REVIEW on they are for review,
    and so are titles that sound alike. Of several the best score wins, then the
    one that stands nearest. Candidates meet by bounds that the scores imply.
    """
    words = F.regexp_extract_all(F.lower(text.nfkc(F.col("title"))), F.lit("([a-z0-9]+)"), 1)
    t = titles.select("title", "n", words.alias("words")).withColumn("s", F.array_join("words", "")).withColumn("sound", similarity.sound_key(F.array_join("words", " ")))
    t = stored(t)
    sizes = t.groupBy("n").agg(F.min("title").alias("first"))
    sizes = sizes.withColumn("above", F.lead("n").over(Window.orderBy("n")))  # one row for each number of rows that occurs
    counted = t.join(rel.checked_broadcast(sizes), "n")
    may = counted.filter((F.col("n") <= RARE_ROWS) | ((F.col("title") == F.col("first")) & (F.col("n") <= RARE_SHARE * F.col("above"))))
    sides = []
    for df in (may, t):
        s, sounds = df.select("s", "words").filter("s <> ''"), df.select(F.col("sound").alias("s")).filter("s <> ''").distinct()
        pairs = F.when(F.length("s") > 1, text.bigrams(F.col("s"))).otherwise(F.array().cast("array<string>"))
        tokens = s.select(F.array_join("words", " ").alias("s")).distinct()
        sides.append((s.select("s").distinct(), pairs, tokens, sounds))
    (a, pairs, ta, sa), (b, _, tb, sb) = sides
    split = numbered_parts(F.split("s", " "))
    by_letters = alike.candidates(a, b, REVIEW).unionByName(meeting(_by_dice(a, pairs, REVIEW), _by_dice(b, pairs, REVIEW))).distinct()
    by_words = meeting(_by_dice(ta, split, REVIEW), _by_dice(tb, split, REVIEW))
    by_sound = alike.candidates(sa, sb, SOUND)
    joined = lambda met, key: may.select("title", key.alias("a")).join(met, "a").join(t.select(F.col("title").alias("target"), key.alias("b")), "b").select("title", "target")
    met = joined(by_letters, F.col("s")).unionByName(joined(by_words, F.array_join("words", " "))).unionByName(joined(by_sound, F.col("sound"))).distinct()
    own = t.select("title", F.col("n").alias("source_n"), F.col("s").alias("s1"), F.array_join("words", " ").alias("w1"), F.col("sound").alias("k1"))
    other = t.select(F.col("title").alias("target"), F.col("n").alias("target_n"), F.col("s").alias("s2"), F.array_join("words", " ").alias("w2"), F.col("sound").alias("k2"))
    met = met.join(own, "title").join(other, "target").filter("target_n > source_n or (target_n = source_n and target < title)")
    both = (F.length("s1") > 1) & (F.length("s2") > 1)
    dice = F.greatest(text.token_dice(F.col("w1"), F.col("w2")), F.when(both, text.bigram_dice(F.col("s1"), F.col("s2"))).otherwise(F.lit(0.0)))
    # the ratio counts where it may be the highest; keys of one sound decide what the letters leave open
    met = met.withColumn("dice", dice).withColumn("open", alike.may_match("s1", "s2", F.col("dice"))).withColumn("heard", (F.col("k1") != "") & (F.col("k2") != ""))
    met = stored(met)
    met = met.withColumn("score", F.greatest("dice", alike.ratio_where(F.col("open"), "s1", "s2"))).withColumn("sound", alike.ratio_where(F.col("heard"), "k1", "k2"))
    one_sound = (F.col("sound") >= SOUND) & (F.length("k1") + F.length("k2") >= SOUND_LENGTH) & (F.col("score") >= SOUND_SPELLING)
    best = Window.partitionBy("title").orderBy(F.desc("score"), "target_n", F.desc("target"))
    found = met.filter((F.col("score") >= REVIEW) | one_sound).withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    action = F.when(F.col("score") >= MERGE, "merge").otherwise("review")
    return found.select(F.col("title").alias("source"), "target", F.round("score", 4).alias("score"), F.round("sound", 4).alias("sound"), action.alias("action"))


def match_names(names: DataFrame, roster: DataFrame, least: float = 0.84) -> DataFrame:
    """name, student_id and tier: exact, the same words, or one alike and no other.

    Exact tiers are equi joins; only what is left meets the roster's names, by
    bounds that a matching ratio of ``least`` (0.78 or more) implies.
    """
    r = roster.withColumn("norm", text.person_name(F.col("roster_name"))).withColumn("words", text.word_set(F.col("roster_name")))
    n = names.select("name").distinct().withColumn("norm", text.person_name(F.col("name"))).withColumn("words", text.word_set(F.col("name")))

    def only(found: DataFrame, tier: str) -> DataFrame:
        one = found.groupBy("name").agg(F.min("student_id").alias("student_id"), F.countDistinct("student_id").alias("k"))
        return one.filter("k = 1").select("name", "student_id", F.lit(tier).alias("tier"))

    exact = only(n.join(r.select("norm", "student_id"), "norm"), "exact")
    rest = n.join(exact, "name", "left_anti")
    words = only(rest.join(r.select("words", "student_id"), "words"), "words")
    r, rest = stored(r), stored(rest.join(words, "name", "left_anti"))
    close = alike.alike_pairs(r.select(F.col("norm").alias("s")).distinct(), rest.select(F.col("norm").alias("s")).distinct(), least)
    close = rest.select("name", F.col("norm").alias("b")).join(close, "b").join(r.select("student_id", F.col("norm").alias("a")), "a")
    return exact.unionByName(words).unionByName(only(close, "similar"))


def resolve_by_evidence(rows: DataFrame, roster: DataFrame, activity: DataFrame, window: int = 2) -> DataFrame:
    """row_id, student_id and how: rows (row_id, name, date) to the roster's bearers of that name.

    Of several bearers those who hadn't joined by the date go, unless all go; of
    the rest the only one active on that day is it, or, where none was, the
    only one active within ``window`` days. What stays open has no student_id.
    """
    named = rows.withColumn("norm", text.person_name(F.col("name")))
    people = roster.select("student_id", "join_date", text.person_name(F.col("roster_name")).alias("norm")).distinct()
    met = named.join(people, "norm").select("row_id", "date", "student_id", F.coalesce(F.col("join_date") <= F.col("date"), F.lit(True)).alias("joined"))
    own = Window.partitionBy("row_id")
    met = met.withColumn("bearers", F.count(F.lit(1)).over(own)).withColumn("n_joined", F.count_if("joined").over(own))
    left = met.filter(F.col("joined") | (F.col("n_joined") == 0) | F.col("date").isNull()).withColumn("left", F.count(F.lit(1)).over(own))
    days = activity.select("student_id", F.col("date").alias("day")).distinct()
    # a row asks for the few days about its own, so that the join has a student and a day for its key
    asked = left.filter("date is not null").withColumn("day", F.explode(F.sequence(F.date_sub("date", window), F.date_add("date", window))))
    gap = F.abs(F.datediff("day", "date"))
    near = asked.join(days, ["student_id", "day"]).groupBy("row_id", "student_id").agg(F.min(gap).alias("gap"))
    seen = left.join(near, ["row_id", "student_id"], "left")
    on_day, about = F.count_if(F.col("gap") == 0), F.count_if(F.col("gap").isNotNull())
    pick = lambda c: F.min(F.when(c, F.col("student_id")))
    one = seen.groupBy("row_id").agg(
        F.first("bearers").alias("bearers"), F.first("left").alias("left"), on_day.alias("k0"), about.alias("k2"),
        F.min("student_id").alias("any"), pick(F.col("gap") == 0).alias("d0"), pick(F.col("gap").isNotNull()).alias("d2"),
    )
    how = F.when(F.col("bearers") == 1, "name").when(F.col("left") == 1, "join_date").when(F.col("k0") == 1, "same_day").when((F.col("k0") == 0) & (F.col("k2") == 1), "near_day").otherwise("ambiguous")
    found = one.withColumn("how", how)
    student = F.when(F.col("how").isin("name", "join_date"), F.col("any")).when(F.col("how") == "same_day", F.col("d0")).when(F.col("how") == "near_day", F.col("d2"))
    return rows.select("row_id").join(found.select("row_id", student.alias("student_id"), "how"), "row_id", "left").select("row_id", "student_id", F.coalesce("how", F.lit("unknown")).alias("how"))


def merge_snapshot(now: DataFrame, backup: DataFrame, tolerance: int = 2) -> DataFrame:
    """What happens to each backup row (row_id, student_id, date, session, m_in, m_out): fill, near, covered or insert.

    All rows are judged against the table as it was.
    """
    keys = ["student_id", "date"]
    own = backup.select("row_id", *keys, "session", "m_in", "m_out")
    same = own.join(now.select(*keys, "session"), [*keys, "session"], "left_semi").select("row_id", F.lit(1).alias("p"))
    n = now.select(*keys, F.col("m_in").alias("n_in"), F.col("m_out").alias("n_out"))
    met = own.join(n, keys)
    gap = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(True))
    near = met.filter(gap("m_in", "n_in") & gap("m_out", "n_out")).select("row_id", F.lit(2).alias("p"))
    span = now.groupBy(*keys).agg(F.min("m_in").alias("lo"), F.max("m_out").alias("hi"))
    inside = own.join(span, keys).filter((F.col("m_in") >= F.col("lo") - tolerance) & (F.coalesce("m_out", "m_in") <= F.col("hi") + tolerance)).select("row_id", F.lit(3).alias("p"))
    first = same.unionByName(near).unionByName(inside).groupBy("row_id").agg(F.min("p").alias("p"))
    names = F.element_at(F.array(*map(F.lit, ("fill", "near", "covered", "insert"))), F.coalesce("p", F.lit(4)))
    return own.join(first, "row_id", "left").select("row_id", names.alias("action"))


def repair_block_max(marks: DataFrame) -> DataFrame:
    """block, old and new maximum where two marks or more exceed it and the topic's usual maximum fits them all.

    ``marks`` has block, topic, most and marks.
    """
    blocks = marks.groupBy("block", "topic", "most").agg(F.count_if(F.col("marks") > F.col("most")).alias("over"), F.max("marks").alias("high"))
    counted = blocks.groupBy("topic", "most").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("topic").orderBy(F.desc("k"), F.desc("most"))
    usual = counted.withColumn("_r", F.row_number().over(w)).filter("_r = 1 and k >= 2").select("topic", F.col("most").alias("usual"))
    return blocks.join(usual, "topic").filter("over >= 2 and usual >= high").select("block", F.col("most").alias("old"), F.col("usual").alias("new"))


def _year(d: pd.Timestamp, year: int):
    try:
        return d.replace(year=year)
    except ValueError:
        return None


def carry_dates(rows: DataFrame, today, group: str = "sheet", since: str = "2020-01-01", window: int = 60) -> DataFrame:
    """rows (group, line, date) with ``fixed``: implausible dates take the last good one's year, or are null.

    A date is plausible from ``since`` to the day after today and within
    ``window`` days of the last good one. What is good depends on what was
    decided above, so each sheet is one ordered fold.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        first, last = pd.Timestamp(since), pd.Timestamp(today) + pd.Timedelta(days=1)
        good, out = None, []
        frame = frame.sort_values("line")
        for d in pd.to_datetime(frame["date"]):
            ok = lambda x: x is not None and not pd.isna(x) and first <= x <= last and (good is None or abs((x - good).days) <= window)
            x = d if ok(d) else _year(d, good.year) if good is not None and not pd.isna(d) else None
            if ok(x):
                good = x
                out.append(x.date())
            else:
                out.append(None)
        return frame.assign(fixed=out)

    return rows.select(group, "line", "date").groupBy(group).applyInPandas(fold, f"{group} string, line long, date date, fixed date")


def alternate_halves(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Morning and Afternoon by turns over the rows of a group."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("half", F.when((n - 1) % 2 == 0, "Morning").otherwise("Afternoon"))


def operating_hours(m: Column) -> Column:
    """Arrivals from 09:00 to 19:00."""
    return m.between(9 * 60, 19 * 60)
