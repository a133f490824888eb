"""Sinks under replays and failures, and copies compared by trees of digests."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from learnlake.operators import hashtree
from learnlake.streaming import sink

CHANGES = "student_id long, date date, version long, change string, m int"
DAY = dt.date(2024, 1, 5)


def batch(spark, *rows):
    return spark.createDataFrame([(s, DAY + dt.timedelta(days=d), v, c, m) for s, d, v, c, m in rows], CHANGES)


def rows(table, spark):
    return sorted((r["student_id"], (r["date"] - DAY).days, r["m"]) for r in table.rows(spark, CHANGES).collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = sink.ChangedTable(str(tmp_path / "t"), ("student_id", "date"), "date")
    assert rows(table, spark) == []
    first = batch(spark, (1, 0, 1, "put", 5), (2, 0, 1, "put", 6), (3, 1, 1, "put", 7), (1, 0, 2, "put", 8))
    second = batch(spark, (2, 0, 2, "gone", None), (3, 1, 2, "gone", None), (4, 2, 1, "put", 9))
    for number, b, want in ((0, first, [(1, 0, 8), (2, 0, 6), (3, 1, 7)]), (1, second, [(1, 0, 8), (4, 2, 9)])):
        for _ in range(2):
            table.apply(b, number)
            assert rows(table, spark) == want
    table.apply(first, 0)  # even one from before
    assert rows(table, spark) == [(1, 0, 8), (4, 2, 9)]


def test_a_batch_that_failed_halfway_is_made_whole_by_its_replay(spark, tmp_path):
    table = sink.ChangedTable(str(tmp_path / "t"), ("student_id", "date"), "date")
    whole = batch(spark, *[(s, s % 4, 1, "put", s) for s in range(20)])
    table.apply(whole.filter("student_id % 3 = 0"), 0)  # what a run that broke may have left
    table.apply(whole, 0)
    assert rows(table, spark) == sorted((s, s % 4, s) for s in range(20))


def test_only_touched_partitions_are_written(spark, tmp_path):
    table = sink.ChangedTable(str(tmp_path / "t"), ("student_id", "date"), "date")
    table.apply(batch(spark, (1, 0, 1, "put", 5), (2, 1, 1, "put", 6)), 0)
    untouched = {p.name for p in (tmp_path / "t" / f"date={DAY}").iterdir()}
    table.apply(batch(spark, (2, 1, 2, "put", 7)), 1)
    assert {p.name for p in (tmp_path / "t" / f"date={DAY}").iterdir()} == untouched and rows(table, spark) == [(1, 0, 5), (2, 1, 7)]


def test_the_archive_holds_each_fingerprint_once(spark, tmp_path):
    add = sink.archive_batch(str(tmp_path / "a"))
    df = lambda *names: spark.createDataFrame([(n, DAY) for n in names], "fingerprint string, archive_day date")
    for number, names in ((0, "aab"), (1, "bcd"), (1, "bcd"), (2, "ad")):
        add(df(*names), number)
    assert sorted(r["fingerprint"] for r in spark.read.parquet(str(tmp_path / "a")).collect()) == ["a", "b", "c", "d"]


def test_what_was_told_is_not_told_again(spark, tmp_path):
    sent = []
    tell = sink.told_once(str(tmp_path / "told"), lambda b, n: sent.append((n, b.count())))
    for number in (0, 0, 1, 1, 0):
        tell(spark.range(number + 1), number)
    assert sent == [(0, 1), (1, 2)]

    def broken(b, n):
        raise RuntimeError("nobody listens")

    with pytest.raises(RuntimeError):
        sink.told_once(str(tmp_path / "told"), broken)(spark.range(1), 2)
    tell(spark.range(1), 2)
    assert sent[-1] == (2, 1)


SCHEMA = "k long, v string, n int"


def copies(spark, folder, changes, count=3000):
    data = {k: (f"v{k % 50}", k % 7) for k in range(count)}
    later = {k: v for k, v in (data | changes).items() if v is not None}
    for name, some in (("old", data), ("new", later)):
        hashtree.write_copy(spark.createDataFrame([(k, *v) for k, v in some.items()], SCHEMA), f"{folder}/{name}", "k")
    return f"{folder}/old", f"{folder}/new"


def test_differences_are_found_and_few_files_read(spark, tmp_path):
    old, new = copies(spark, str(tmp_path), {5: ("other", 1), 17: None, 9999: ("new", 2), 30: (None, 3)})
    buckets = hashtree.differing(spark, old, new)
    assert 1 <= len(buckets) <= 4
    got = hashtree.differences(spark, old, new, SCHEMA, "k").collect()
    assert {r["k"]: r["kind"] for r in got} == {5: "changed", 17: "removed", 9999: "added", 30: "changed"}
    read = hashtree.rows_in(spark, new, buckets, f"{SCHEMA}, _bucket int")
    assert read.select(F.input_file_name()).distinct().count() <= len(buckets)


def test_equal_copies_differ_in_nothing(spark, tmp_path):
    old, new = copies(spark, str(tmp_path), {})
    assert hashtree.differing(spark, old, new) == [] and hashtree.differences(spark, old, new, SCHEMA, "k").count() == 0


def test_null_fields_and_empty_copies(spark, tmp_path):
    hashtree.write_copy(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), "k")
    hashtree.write_copy(spark.createDataFrame([(1, None, None)], SCHEMA), str(tmp_path / "one"), "k")
    got = hashtree.differences(spark, str(tmp_path / "none"), str(tmp_path / "one"), SCHEMA, "k").collect()
    assert [(r["k"], r["kind"]) for r in got] == [(1, "added")]
    assert hashtree.differences(spark, str(tmp_path / "none"), str(tmp_path / "none"), SCHEMA, "k").count() == 0


def test_a_refreshed_summary_equals_a_full_run(spark, tmp_path):
    rng = random.Random(1)
    facts = [(rng.randrange(300), f"f{k}", k) for k in range(2000)]
    later = [f for f in facts if f[0] not in (7, 8) and f[2] % 400] + [(300, "x", 1), (12, "y", 2)]
    for name, some in (("old", facts), ("new", later)):
        hashtree.write_copy(spark.createDataFrame(some, SCHEMA), str(tmp_path / name), "k")
    summary = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("last"))
    state, old, new = (str(tmp_path / x) for x in ("state", "old", "new"))
    hashtree.write_summary(spark.createDataFrame(facts, SCHEMA), state, summary, "k")
    for _ in range(2):  # a second run writes the same again
        buckets = hashtree.refresh(spark, state, old, new, SCHEMA, summary, "k")
        assert 0 < len(buckets) < 30
        want = summary(spark.createDataFrame(later, SCHEMA)).collect()
        assert sorted((r["k"], r["n"], r["last"]) for r in hashtree.read_summary(spark, state).collect()) == sorted((r["k"], r["n"], r["last"]) for r in want)

    def refused(df):
        raise AssertionError("no fact of an unchanged table is read")

    assert hashtree.refresh(spark, state, new, new, SCHEMA, refused, "k") == []


def test_trees_grow_with_the_rows():
    assert [hashtree.levels_for(n, 100) for n in (0, 1600, 1601, 25_600, 25_601)] == [1, 1, 2, 2, 3]
