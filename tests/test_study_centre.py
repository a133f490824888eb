"""Study-centre operators: tables of cases, sequential re-statements, and every query against DuckDB."""

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from learnlake.functions import dates, sessions, similarity, text, times
from learnlake.operators import elt, punches, quality
from learnlake.operators import relational as rel
from learnlake.plans import catalogue
from learnlake.sources import files
from learnlake.streaming import punches as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("raw, strict, clamped", [
    ("31.09.2021", None, "2021-09-30"), ("1/2/21", "2021-02-01", "2021-02-01"), ("5-6-1999", "1999-06-05", "1999-06-05"), ("29.02.2023", None, "2023-02-28"),
    ("12/13/2020", None, None), ("", None, None), ("7 8", None, None), ("1.1.27", "1927-01-01", "1927-01-01"), (None, None, None),
])
def test_dates(spark, raw, strict, clamped):
    r = one(spark, dates.parse_date(F.lit(raw)).alias("a"), dates.parse_date(F.lit(raw), clamp_day=True).alias("b"))
    assert (r.a and str(r.a), r.b and str(r.b)) == (strict, clamped)


def test_date_bounds_and_sections(spark):
    r = one(spark, dates.parse_date(F.lit("2.1.2024"), today=F.lit(dt.date(2024, 1, 1))).alias("a"), dates.parse_section_date(F.lit("3/4-21")).alias("b"), dates.parse_section_date(F.lit("3/4")).alias("c"))
    assert (r.a, r.b, r.c) == (None, dt.date(2021, 4, 3), None)


@pytest.mark.parametrize("raw, want", [("9:5", "09:05"), ("9;30", "09:30"), ("930", "09:30"), ("1430", "14:30"), ("25:00", None), ("10.61", None), ("x", None), ('8"15', "08:15")])
def test_times(spark, raw, want):
    assert one(spark, times.parse_time(F.lit(raw)).alias("x")).x == want


def test_renewals_follow_the_definition(spark):
    rng = random.Random(1)
    pairs = [(dt.date(2015, 1, 1) + dt.timedelta(rng.randrange(3000)), dt.date(2018, 1, 1) + dt.timedelta(rng.randrange(3000))) for _ in range(300)] + [(dt.date(2020, 2, 29), dt.date(2021, 2, 28))]

    def plus(d, n):
        return d.replace(year=d.year + n, day=28) if (d.month, d.day) == (2, 29) and (d.year + n) % 4 else d.replace(year=d.year + n)

    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", dates.renewals_needed(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        n = 0
        while plus(r.a, n + 1) < r.b:
            n += 1
        assert r.n == n


@pytest.mark.parametrize("start, end, live, batch, cleaner", [
    (540, 720, ("Morning", 180), ("Morning", 180), "morning"), (540, 780, ("Morning", 240), ("Morning", 240), "morning"), (540, 820, ("Morning", 240), ("Full Day", 240), "full_day"),
    (570, 900, ("Full Day", 270), ("Full Day", 270), "full_day"), (800, 900, ("Afternoon", 100), ("Afternoon", 60), "afternoon"), (540, None, ("Morning", None), ("Morning", None), "open"),
])
def test_session_rules(spark, start, end, live, batch, cleaner):
    a, b = F.lit(start), F.lit(end).cast("int")
    r = one(spark, sessions.live_session(a, b).alias("l"), sessions.live_duration(a, b).alias("lm"), sessions.batch_session(a, b).alias("b"), sessions.batch_duration(a, b).alias("bm"), sessions.cleaner_session(a, b).alias("c"))
    assert ((r.l, r.lm), r.c) == (live, cleaner)
    assert (r.b, r.bm if end else None) == batch


def test_text(spark):
    c = F.lit
    r = one(
        spark, text.collapse_ws(c(" a  b ")).alias("a"), text.slugify(c("--")).alias("b"), text.exam_identity_key(c("Polity Grand Test [2]")).alias("d"), text.exam_identity_key(c("1.2.2021")).alias("e"),
        text.bigram_dice(c("quantative"), c("quantitative")).alias("f"), text.token_dice(c("NCERT Physics"), c("physics ncert")).alias("g"), text.periodical_id(c("p .0247")).alias("h"), text.head_count(c("Math ( 12 )")).alias("i"),
        text.nfkc(c("ＡＢ１")).alias("j"), text.anagram_key(c("abc")).alias("k"), text.id_rest(c("P-0081")).alias("m"), text.template_key(c("bad 'x' and 'y'")).alias("n"), text.subscription_like(c("sub, c x")).alias("o"),
        text.charset_similarity(c("abc"), c("abcd")).alias("p"), text.gender_from_markers(c("x"), c("")).alias("q"), times.recover_decimal(c("18:50"), c(20)).alias("r"), times.duration_label(c(125)).alias("s"),
    )
    assert (r.a, r.b, r.d, r.e, round(r.f, 3), r.g, r.h, r.i) == ("a b", "unknown", "polity", None, 0.947, 1.0, "P-0247", 12)
    assert (r.j, r.k, r.m, r.n, r.o, r.p, r.q, r.r, r.s) == ("AB1", None, "81", "bad '...' and '...'", True, 0.75, "Male", 18.5, "2h 5m")


@pytest.mark.parametrize("a, b, n", [("kitten", "sitting", 3), ("ab", "ba", 1), ("680", "1680", 1), ("", "abc", 3), ("ca", "abc", 3)])
def test_edit_distance(a, b, n):
    assert similarity.osa(a, b) == n


def day(spark, *clock):
    rows = [(k, 1001, dt.datetime(2024, 1, 5, *map(int, t.split(":"))), "0") for k, t in enumerate(clock)]
    return spark.createDataFrame(rows, "punch_id long, student_id long, punch_time timestamp, status string")


@pytest.mark.parametrize("clock, want", [
    (["9:00", "17:00"], [("Full Day", 420)]), (["9:00", "11:00", "15:00", "17:00"], [("Afternoon", 120), ("Morning", 120)]), (["9:00", "12:00"], [("Morning", 180)]),
    (["14:30", "17:00"], [("Afternoon", 150)]), (["9:00", "11:00", "15:00"], [("Morning", 120)]), (["9:00", "9:10", "15:00", "17:00"], [("Afternoon", 120), ("Morning", 10)]),
    (["9:45", "12:40", "14:04", "14:05"], [("Morning", 175)]), (["9:00", "9:01"], []), (["9:00"], []),
])
def test_punch_scenarios(spark, clock, want):
    got = punches.attendance(day(spark, *clock)).collect()
    assert sorted((r["session"], r["minutes"]) for r in got) == want


def test_set_form_equals_sequential_form(spark):
    rng = random.Random(4)
    rows, want = [], []
    for student in range(40):
        clock = sorted(rng.sample(range(480, 1200), rng.randint(1, 9)))
        clock = sorted(clock + [m + 1 for m in clock if rng.random() < 0.3])
        kept = [m for before, m in zip([-9, *clock], clock) if m - before > 1]
        want += [(student, k // 2 + 1, *kept[k : k + 2]) for k in range(0, len(kept) - 1, 2)]
        rows += [(len(rows) + k, student, dt.datetime(2024, 1, 5, m // 60, m % 60), "0") for k, m in enumerate(clock)]
    df = spark.createDataFrame(rows, "punch_id long, student_id long, punch_time timestamp, status string")
    got = punches.pairs(df).filter("m_out is not null").collect()
    assert sorted((r["student_id"], r["pair"], r["m_in"], r["m_out"]) for r in got) == sorted(want)


def test_stream_equals_batch(spark):
    from learnlake.sources import roles

    batch = punches.attendance(roles.punches(spark, SF)).collect()
    streamed = stream.drained_attendance(spark, f"{SF}/events.parquet", F.lit("2024-02-15 12:00:00").cast("timestamp")).collect()
    assert sorted(map(tuple, batch)) == sorted(tuple(r[c] for c in batch[0].asDict()) for r in streamed)


def test_id_merges(spark):
    uses = {"a": {"1680": 433, "680": 5, "168": 1, "801": 4}, "b": {"81": 50, "081": 2}, "c": {"1377": 100, "1377936": 2}, "d": {"1543": 30, "1544": 25}, "e": {"100": 3, "200": 2}, "f": {"P-247": 10, "247": 2}, "g": {"1680": 100, "1860": 1}}
    rows = [(t, i, n) for t, ids in uses.items() for i, n in ids.items()]
    got = {(r["title"], r["id"]): r["action"] for r in elt.id_merge_plan(spark.createDataFrame(rows, "title string, id string, n long")).collect()}
    assert got == {("a", "680"): "merge", ("a", "168"): "merge", ("a", "801"): "wrong_id_by_title", ("b", "081"): "merge", ("c", "1377936"): "merge", ("d", "1544"): "not_rare", ("e", "200"): "not_rare", ("f", "247"): "not_similar", ("g", "1860"): "merge"}


def test_near_titles(spark):
    t = spark.createDataFrame([("NCERT Physics", 20), ("Physics NCERT", 2), ("Polity", 100), ("Polaty", 2), ("Zoology", 3)], "title string, n long")
    got = {r["source"]: (r["target"], r["action"]) for r in elt.near_titles(t).collect()}
    assert got == {"Physics NCERT": ("NCERT Physics", "merge"), "Polaty": ("Polity", "review")}


def test_names_chains_lists_and_dates(spark):
    roster = spark.createDataFrame([(1, "Asha Rao"), (2, "Ravi Kumar"), (3, "Ravi Kumar"), (4, "Meena Iyer")], "student_id long, roster_name string")
    names = spark.createDataFrame([("rao  asha",), ("RAVI.KUMAR",), ("Mena Iyer",), ("Asha Rao",), (None,)], "name string")
    assert sorted((r["name"], r["student_id"], r["tier"]) for r in elt.match_names(names, roster).collect()) == [("Asha Rao", 1, "exact"), ("Mena Iyer", 4, "similar"), ("rao  asha", 1, "words")]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "source string, target string")
    assert {r["source"]: r["target"] for r in elt.resolve_chains(chain).collect()} == {"a": "d", "b": "d", "c": "d", "x": "y"}
    cell = spark.createDataFrame([(1, "3, 4,", "N"), (2, None, "N"), (3, "3,3", "N,N")], "k int, ids string, names string")
    assert sorted(((r["k"], r["item_id"], r["item_name"]) for r in elt.explode_pairs(cell, "ids", "names").collect()), key=str) == [(1, "3", "N"), (1, "4", "N"), (2, None, "N"), (3, "3", "N")]
    sheet = spark.createDataFrame([("s", 1, dt.date(2024, 1, 5)), ("s", 2, dt.date(2022, 1, 6)), ("s", 3, dt.date(2024, 6, 1)), ("s", 4, None)], "sheet string, line long, date date")
    assert [r["fixed"] for r in elt.carry_dates(sheet, dt.date(2024, 1, 30)).orderBy("line").collect()] == [dt.date(2024, 1, 5), dt.date(2024, 1, 6), None, None]


def test_similar_names_meet_the_whole_roster(spark):
    import difflib
    import random

    rng = random.Random(3)
    words = ["Ganesan", "Kumar", "Ali", "Al", "Bo", "Raghavan", "Meena"]
    names = ["Kanesan", "Aji", "Blaa"] + ["".join(rng.choice("abc") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    roster = [(k, w) for k, w in enumerate(words + ["".join(rng.choice("abc") for _ in range(rng.randint(2, 8))) for _ in range(60)])]
    got = elt.match_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(roster, "student_id long, roster_name string")).collect()
    want = {}
    for n in set(names):
        if n.lower() in {w.lower() for _, w in roster}:
            continue
        close = [k for k, w in roster if difflib.SequenceMatcher(None, w.lower(), n.lower()).ratio() >= 0.84]
        if len(close) == 1:
            want[n] = close[0]
    assert want["Kanesan"] == 0 and {r["name"]: r["student_id"] for r in got if r["tier"] == "similar"} == want


def test_spellings_fold_in_order(spark):
    rows = [(1, "Polity"), (2, "polity"), (3, "Politty"), (4, "History"), (5, "Hisotry"), (6, "polity"), (7, None)]
    got = {r["k"]: r["canonical"] for r in elt.canonicalise(spark.createDataFrame(rows, "k long, name string"), "name", "k").collect()}
    assert got == {1: "polity", 2: "polity", 3: "polity", 4: "History", 5: "History", 6: "polity", 7: None}


def test_table_maintenance(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, rel.insert_new(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, rel.upsert(old, new.distinct(), "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [d.count() for d in rel.delete_cascade(old, old.filter("k = 1"), "k", new)] == [1, 3]
    assert rel.fingerprint(old).first() == rel.fingerprint(old.repartition(3)).first()
    found = quality.report(quality.Check("WARN", "x", old), quality.Check("FATAL", "y", old.limit(0)))
    assert not quality.failed(found)


def test_register_headers_with_parts_in_the_wrong_column(spark, tmp_path):
    register = tmp_path / "marks.csv"
    register.write_text(",,Polity,1.2.24,50,\n1,Asha,12,,,40\n,,19.12.2025,A&R Exam,,25 Marks\n1,Asha,12,,,20\n,,,20.12.2025,,\n1,Asha,12,,,7\n,,,,9,\n2,Ravi,13,,,8\n,,Essay,,,\n2,Ravi,13,,,5\n")
    got = files.read_register(spark, str(register)).orderBy("line").collect()
    assert [(r["exam"], r["date"], r["most"], r["marks"]) for r in got] == [
        ("Polity", "1.2.24", "50", "40"), ("A&R Exam", "19.12.2025", "25", "20"), ("A&R Exam", "20.12.2025", "25", "7"), ("A&R Exam", "20.12.2025", "25", "8"), ("Essay", "20.12.2025", "25", "5"),
    ]


def test_files(spark, tmp_path):
    export = tmp_path / "daily.csv"
    export.write_text('﻿Report,,\n\nSl.No,ID NO,Name of the Student,Gender,Date,IN,OUT,Unnamed: 7\n1, 12 ,"Rao, Asha",F,1.1.24,9:00,12:00,\n,,,,,,,\n2,13,B,M,,,,x\n', encoding="utf-8")
    got = files.read_daily_export(spark, str(export)).collect()
    assert [(r["source_row"], r["ID NO"], r["Name of the Student"]) for r in got] == [(4, "12", "Rao, Asha"), (6, "13", "B")]
    register = tmp_path / "marks.csv"
    register.write_text(",,Polity,1.2.24,50,\n1,Asha,12,,,40\n2,Ravi,13,,,x\n,,History,2.2.24,100,\n1,Asha,12,,,77\n")
    got = files.read_register(spark, str(register)).orderBy("line").collect()
    assert [(r["student_id"], r["exam"], r["most"], r["marks"]) for r in got] == [("12", "Polity", "50", "40"), ("13", "Polity", "50", "x"), ("12", "History", "100", "77")]
    members = tmp_path / "m.csv"
    members.write_text("1,A,f\n2,B,f,addr,b,q,g,p,,2020,,,,x,,99\n")
    assert [(r["name"], r["male"], r["phone"]) for r in files.read_members(spark, str(members)).collect()] == [("A", None, None), ("B", "x", "99")]
    ledger = spark.createDataFrame([("f1", dt.datetime(2024, 1, 1)), ("f1", dt.datetime(2024, 1, 1)), ("f2", dt.datetime(2024, 1, 2))], "fingerprint string, punch_time timestamp")
    assert [files.archive(ledger, str(tmp_path / "a")) for _ in range(2)] == [2, 0]
    assert [r["chunk"] for r in files.sheet_chunks(spark.range(5), "id", most_cells=2).collect()] == [0, 0, 1, 1, 2]
    assert not files.write_csv(ledger.limit(0), str(tmp_path / "none")) and files.write_csv(ledger, str(tmp_path / "some"))
    with pytest.raises(ValueError):
        files.write_snapshot(ledger.limit(0), str(tmp_path / "s"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_duckdb(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_give_the_same_rows_however_their_tables_are_dealt(spark, name, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = catalogue.queries()[name](spark, SF).collect()
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, catalogue.queries()[name](spark, str(tmp_path)).collect()))


def test_plans_push_down_and_prune(spark):
    plan = catalogue.queries()["list_date_range"](spark, SF)._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual" in pushed.partition("]")[0] and "props" not in plan.rpartition("ReadSchema")[2]
    plan = catalogue.queries()["any_column_mask"](spark, SF)._jdf.queryExecution().toString()
    assert "o_custkey" not in plan.rpartition("ReadSchema")[2]
