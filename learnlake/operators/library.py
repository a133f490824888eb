"""The lending library's cells: identifiers that were typed together, run into titles, or torn to pieces.

What is known comes from the file itself: rows that hold one id and one name.
Repairs are joins of distinct cells with what is known.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlake.functions import text
from learnlake.operators import elt
from learnlake.session import stored

#: Agreement with the recorded names that a repair needs, and its lead over the next best.
AGREEMENT, MARGIN = 0.6, 0.05
#: Ids that a torn cell holds at most, digits of an id where nothing else is said, and least digits of a cell.
PIECES, PIECE_DIGITS, CELL_DIGITS = 4, 4, 4
#: Agreement and length from which on a name alone finds its title.
NAME_AGREEMENT, NAME_LETTERS = 0.9, 4
#: Cells that are no id, and how a copy of a numbered book is written.
JUNK, COPY = ("P", "Youtube", "`"), r"^(\d+|P-\d+)/\d+$"


def canonical_id(c: Column) -> Column:
    """P, anything but digits, digits: P-digits; else the input."""
    return F.when(c.rlike(r"^[Pp]\D*\d+$"), F.concat(F.lit("P-"), F.regexp_replace(c, "[^0-9]", ""))).otherwise(c)


def _tokens(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def references(rows: DataFrame, digits: int = PIECE_DIGITS) -> tuple[DataFrame, DataFrame]:
    """(titles, verified) of rows (line, ids, names).

    titles: id, title, n and top (its commonest title, of equals the first seen)
    from rows of one numeric id of up to ``digits`` digits and one name. verified:
    ids that stand alone in a cell and look like ids.
    """
    t = rows.select("line", F.trim(F.coalesce("ids", F.lit(""))).alias("id"), _tokens(F.col("names"), ",").alias("names"))
    well = t.filter(F.col("id").rlike(rf"^[1-9]\d{{0,{digits - 1}}}$") & (F.size("names") == 1)).select("line", "id", F.element_at("names", 1).alias("title"))
    n = well.groupBy("id", "title").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    order = Window.partitionBy("id").orderBy(F.desc("n"), "line")
    titles = n.withColumn("top", F.row_number().over(order) == 1).select("id", "title", "n", "top")
    alone = t.filter(~F.col("id").rlike("[,; ]")).select(canonical_id(F.col("id")).alias("id")).filter(F.col("id").rlike(r"^([1-9]\d{0,5}|P-\d+)$"))
    return titles, alone.distinct()


def expand_cells(rows: DataFrame) -> DataFrame:
    """rows (line, ids) with ``id`` for each id of the cell: split at commas, semicolons, and at spaces between digits.

    Items like 12:25 are times of day and are dropped.
    """
    items = F.filter(_tokens(F.col("ids"), "[,;]"), lambda x: ~x.rlike(r"^\d{1,2}[:;.]\d{1,2}$"))
    single = F.flatten(F.transform(items, lambda x: F.when(x.rlike(r"^\d+(\s+\d+)+$"), F.split(x, r"\s+")).otherwise(F.array(x))))
    return rows.withColumn("id", F.explode(single))


def repair_torn(rows: DataFrame, titles: DataFrame, digits: int = PIECE_DIGITS) -> DataFrame:
    """cell, names and ids: how a cell whose digits were torn apart by commas reads as known ids, or null.

    All readings of as many known ids as there are names are scored by the
    least agreement of an id's titles with the name in its place; the best is
    taken from AGREEMENT on, if it leads the next by more than MARGIN. Every
    reading is tried whose ids have up to ``digits`` digits.
    """
    cells = rows.select("cell", "names").distinct()
    parts = _tokens(F.col("cell"), "[,;]")
    given = cells.withColumn("parts", parts).withColumn("name", _tokens(F.col("names"), ",")).withColumn("m", F.size("name"))
    joined = F.array_join("parts", "")
    part = rf"^\d{{1,{2 * digits - 2}}}$"  # up to six digits where ids have four
    fit = (F.size("parts") >= 2) & F.forall("parts", lambda x: x.rlike(part)) & F.length(joined).between(CELL_DIGITS, PIECES * digits) & F.col("m").between(1, PIECES)
    open_ = given.filter(fit).withColumn("digits", joined)
    # a reading is the lengths of its pieces, of which there are digits ** 4 at most
    lengths = [(m, sum(x), list(x)) for m in range(1, PIECES + 1) for x in product(range(1, digits + 1), repeat=m)]
    lengths = rows.sparkSession.createDataFrame(lengths, "m int, total int, sizes array<int>")
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    read = open_.withColumn("total", F.length("digits")).join(F.broadcast(lengths), ["m", "total"])
    at = lambda k: total(F.slice(F.col("sizes"), F.lit(1), k)) + 1
    ids = F.transform("sizes", lambda y, k: F.substr(F.col("digits"), at(k), y))
    read = read.withColumn("ids", ids).filter("ids <> parts")
    piece = read.select("cell", "names", "name", "m", "ids", F.posexplode("ids").alias("k", "id"))
    scored = piece.join(titles.select("id", "title"), "id").withColumn("agree", text.title_agreement(F.col("title"), F.element_at("name", F.col("k") + 1)))
    each = scored.groupBy("cell", "names", "m", "ids", "k").agg(F.max("agree").alias("agree"))
    whole = each.groupBy("cell", "names", "m", "ids").agg(F.min("agree").alias("agree"), F.count(F.lit(1)).alias("known")).filter("known = m")
    top = whole.groupBy("cell", "names").agg(F.slice(F.reverse(F.array_sort(F.collect_list("agree"))), 1, 2).alias("best"), F.max(F.struct("agree", "ids")).alias("x"))  # at most digits ** 3 readings a cell
    sure = (F.col("x.agree") >= AGREEMENT) & ((F.size("best") == 1) | (F.element_at("best", -1) < F.col("x.agree") - MARGIN))
    fixed = top.filter(sure).select("cell", "names", F.array_join("x.ids", ", ").alias("ids"))
    return cells.join(fixed, ["cell", "names"], "left")


def normalise_ids(records: DataFrame) -> DataFrame:
    """records (line, id, name) with id and name repaired, one row for each id of a cell; ``step`` says what was done.

    In this order: an id in the name's place moves over; a copy's mark goes;
    a number in the name's place gives way to the id's title; a title or junk in
    the id's place leaves it; a title run into an id comes off it; two known
    ids in one cell become two rows; forms of periodicals' ids are made one.
    What can't be verified stays.
    """
    blank = F.coalesce("id", F.lit(""))
    r = records.select("line", blank.alias("raw"), F.coalesce("name", F.lit("")).alias("name"))
    cells = r.select("line", canonical_id(F.col("raw")).alias("cid"), "name")
    valid = stored(cells.filter("cid <> ''").select(F.col("cid").alias("known")).distinct())
    n = cells.filter("cid <> '' and name <> ''").groupBy("cid", "name").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    top = n.withColumn("_r", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("n"), "line"))).filter("_r = 1")
    titles = stored(top.select(F.col("cid").alias("tid"), F.col("name").alias("title")))
    names = stored(r.filter("name <> ''").select(text.collapse_ws(F.col("name")).alias("known_name")).distinct())
    number = r"^\s*\d+\s*$"
    # an id in the name's place
    moved = r.withColumn("as_id", F.when((F.col("raw") == "") & F.col("name").rlike(number), F.trim("name"))).join(valid, F.col("as_id") == F.col("known"), "left")
    moved = moved.withColumn("moved", F.col("known").isNotNull()).withColumn("id0", F.when(F.col("known").isNotNull(), F.col("as_id")).otherwise(F.col("raw"))).drop("known")
    # a copy's mark
    cell = canonical_id(text.collapse_ws(F.col("id0")))
    base = F.regexp_extract("cell", COPY, 1)
    copy = moved.withColumn("cell", cell).withColumn("base", F.when(base != "", base)).join(valid, F.col("base") == F.col("known"), "left")
    copy = copy.withColumn("cell", F.when(F.col("known").isNotNull(), F.col("base")).otherwise(F.col("cell"))).withColumn("copied", F.col("known").isNotNull()).drop("known", "base")
    # a number in the name's place
    named = copy.join(titles, F.col("cell") == F.col("tid"), "left")
    swap = F.col("tid").isNotNull() & (F.col("cell") != "") & F.col("name").rlike(number)
    named = named.withColumn("titled", swap).withColumn("name", F.when(swap, F.col("title")).otherwise(F.col("name"))).drop("tid", "title")
    # a title or junk in the id's place
    asked = named.withColumn("as_title", F.when((F.col("cell") != "") & ~F.col("cell").rlike(r"^\d+$"), F.col("cell"))).join(names, F.col("as_title") == F.col("known_name"), "left")
    is_title, junk = F.col("known_name").isNotNull(), F.col("cell").isin(*JUNK)
    asked = asked.withColumn("left", is_title | junk).withColumn("name", F.when(is_title & (F.col("name") == ""), F.col("cell")).otherwise(F.col("name"))).drop("known_name", "as_title")
    # a title run into an id: all heads that look like an id, the longest title behind one
    rest = asked.filter(~F.col("left") & (F.col("cell") != "")).select("cell").distinct()
    cuts = rest.filter("length(cell) > 3").withColumn("cut", F.explode(F.sequence(F.lit(1), F.length("cell") - 3)))
    cuts = cuts.withColumn("head", F.substr("cell", F.lit(1), F.col("cut"))).withColumn("tail", F.lower(F.substr("cell", F.col("cut") + 1)))
    # a number in the name's place is an id typed there, no title, and would cut longer ids that end in it
    lowered = names.filter(~F.col("known_name").rlike(number)).select(F.lower("known_name").alias("tail")).filter("length(tail) >= 3").distinct()
    cuts = cuts.filter(F.col("head").rlike(r"^(\d+|P-?\d*)$")).join(lowered, "tail")
    cuts = cuts.groupBy("cell").agg(F.min_by("head", "cut").alias("head"))
    # two ids in one cell
    cells2 = rest.join(cuts, "cell", "left").withColumn("now", F.coalesce("head", "cell"))
    tokens = F.transform(F.filter(F.split(F.replace(F.col("now"), F.lit("."), F.lit(" ")), r"[\s'`]+"), lambda x: x != ""), canonical_id)
    one = cells2.withColumn("tokens", tokens)
    apart = one.filter(F.size("tokens") == 2).select("cell", F.col("tokens").alias("two"))
    run = one.filter((F.size("tokens") == 1) & F.col("now").rlike(r"^\d{6,}$")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.length("now") - 1)))
    run = run.select("cell", F.array(F.substr("now", F.lit(1), F.col("cut")), F.substr("now", F.col("cut") + 1)).alias("two"))
    known = lambda df: df.join(valid.withColumnRenamed("known", "k1"), F.element_at("two", 1) == F.col("k1")).join(valid.withColumnRenamed("known", "k2"), F.element_at("two", 2) == F.col("k2")).select("cell", "two")
    single = known(run).groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.first("two").alias("two")).filter("c = 1").select("cell", "two")
    split = known(apart).unionByName(single)
    found = one.join(split, "cell", "left").select("cell", "head", "two")
    done = asked.join(found, "cell", "left")
    ids = F.when(F.col("left"), F.array(F.lit(""))).when(F.col("two").isNotNull(), F.col("two")).otherwise(F.array(F.coalesce("head", "cell")))
    step = (
        F.when(F.col("left"), "id_left").when(F.col("two").isNotNull(), "two_ids").when(F.col("head").isNotNull(), "title_off").when(F.col("moved"), "id_in_name")
        .when(F.col("copied"), "copy").when(F.col("titled"), "number_for_name").when(F.col("cell") != F.col("raw"), "form").otherwise("kept")
    )
    return done.select("line", "raw", "name", step.alias("step"), F.explode(ids).alias("id"))


def blank_fragments(records: DataFrame, verified: DataFrame) -> DataFrame:
    """records (with id) where ids that look like fragments and never stand alone in a cell are blank, and ``blanked``.

    A fragment is short, long or begins with 0.
    """
    known = verified.select(F.col("id").alias("_id"))
    joined = records.join(known, F.col("id") == F.col("_id"), "left")
    gone = F.coalesce(F.col("id").rlike(r"^(0\d{1,5}|\d{1,2}|\d{7,})$") & F.col("_id").isNull(), F.lit(False))
    return joined.withColumn("blanked", gone).withColumn("id", F.when(gone, F.lit("")).otherwise(F.col("id"))).drop("_id")


def ids_by_name(names: DataFrame, titles: DataFrame) -> DataFrame:
    """name and id of names that match exactly one id's title (id, title).

    A match is an agreement of NAME_AGREEMENT or more, or a name of NAME_LETTERS
    letters or more within the title. Texts within one another meet by the first
    letters' run, others by the rarest of their characters, as the agreement implies.
    """
    n = names.select("name").distinct().filter(F.trim("name") != "").withColumn("x", F.lower(text.collapse_ws(F.col("name")))).withColumn("low", F.lower(F.trim("name")))
    t = titles.select("id", "title").distinct().withColumn("y", F.lower(text.collapse_ws(F.col("title")))).withColumn("whole", F.lower("title")).filter("y <> ''")
    k = NAME_LETTERS

    def within(small: DataFrame, a: str, large: DataFrame, b: str) -> DataFrame:
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(b) - (k - 1)), lambda i: F.substr(F.col(b), i, F.lit(k))))
        head = small.filter(F.length(a) >= k).withColumn("run", F.substr(F.col(a), F.lit(1), F.lit(k)))
        return large.filter(F.length(b) >= k).withColumn("run", F.explode(runs)).join(head, "run").filter(F.contains(b, F.col(a)))

    inside = within(n, "low", t, "whole").select("name", "id")
    around = within(t, "y", n, "x").filter(F.length("y") >= NAME_AGREEMENT * F.length("x")).select("name", "id")
    letters = lambda df, c: df.select(F.col(c).alias("s"), F.array_distinct(F.split(F.replace(F.col(c), F.lit(" "), F.lit("")), "")).alias("parts")).distinct()
    # of characters NAME_AGREEMENT of the united set are common; texts within one another have met above
    side = lambda df, c: letters(df, c).withColumn("keep", F.size("parts") - F.ceil(F.size("parts") * NAME_AGREEMENT - 1e-9) + 1)
    met = elt.meeting(side(n, "x"), side(t, "y"))
    close = n.join(met, F.col("x") == F.col("a")).join(t, F.col("y") == F.col("b"))
    close = close.filter(text.title_agreement(F.col("title"), F.col("name")) >= NAME_AGREEMENT).select("name", "id")
    held = inside.unionByName(around).unionByName(close).distinct()
    return held.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.first("id").alias("id")).filter("k = 1").select("name", "id")


def plan_catalogue(uses: DataFrame) -> DataFrame:
    """kind, source, target, action and scope of every merge and review among uses (id, title).

    Titles first; ids are then compared under the titles that these merges give.
    """
    t = elt.near_titles(uses.filter("title <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("n")))
    titles = t.select(F.lit("title").alias("kind"), "source", "target", "action", F.lit(None).cast("string").alias("scope"))
    merged = retitled(uses, titles)
    n = merged.filter("id <> '' and title <> ''").groupBy("title", "id").agg(F.count(F.lit(1)).alias("n"))
    i = elt.id_merge_plan(n)
    return titles.unionByName(i.select(F.lit("id").alias("kind"), F.col("id").alias("source"), F.col("suggested").alias("target"), "action", F.col("title").alias("scope")))


def retitled(uses: DataFrame, plan: DataFrame) -> DataFrame:
    """uses with the titles that the plan's merges give, chains followed."""
    ends = elt.resolve_chains(plan.filter("kind = 'title' and action = 'merge'").select("source", "target"))
    ends = ends.select(F.col("source").alias("title"), F.col("target").alias("_title"))
    return uses.join(ends, "title", "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")


def apply_catalogue(uses: DataFrame, plan: DataFrame) -> DataFrame:
    """uses (id, title) after the plan's merges: what a new snapshot of the table would hold."""
    ids = plan.filter("kind = 'id' and action = 'merge'").select(F.col("scope").alias("title"), F.col("source").alias("id"), F.col("target").alias("_id"))
    named = retitled(uses, plan)
    return named.join(ids, ["title", "id"], "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")


def finalise_catalogue(uses: DataFrame) -> DataFrame:
    """id and title of the catalogue after titles without a name were filled in, merged, and ids made one.

    A use without a title takes its id's commonest; so, at the end, does every id.
    """
    n = uses.filter("id <> '' and title <> ''").groupBy("id", "title").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("id").orderBy(F.desc("n"), "title")
    usual = n.withColumn("_r", F.row_number().over(top)).filter("_r = 1").select("id", F.col("title").alias("_usual"))
    filled = uses.join(usual, "id", "left").withColumn("title", F.when(F.coalesce("title", F.lit("")) == "", F.coalesce("_usual", F.lit(""))).otherwise(F.col("title"))).drop("_usual")
    filled = stored(filled)
    after = apply_catalogue(filled, stored(plan_catalogue(filled)))
    n = after.filter("id <> ''").groupBy("id", "title").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("_r", F.row_number().over(top)).filter("_r = 1").select("id", "title", "n")
