"""Prefix scans over ranges, and delimited files read in splits."""

import csv
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from learnlake.operators import scan
from learnlake.sources import files


@pytest.fixture
def small_splits(spark):
    """Files are cut every 300 bytes, and small ranges stay apart."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_values_are_carried_over_ranges(small_splits):
    rng = random.Random(2)
    rows = [(k, k if rng.random() < 0.03 else None, rng.choice([1, 2, None])) for k in range(500)]
    ranged = scan.ranges(small_splits.createDataFrame(rows, "k long, head long, n long").repartition(7), "k")
    assert ranged.select(scan.PART).distinct().count() > 1
    got = scan.carried_down(ranged, {"last": F.col("head")}, "k")
    got = scan.totals_before(got, {"before": F.col("n")}, "k").orderBy("k").collect()
    last, total = None, 0
    for r, (k, head, n) in zip(got, rows, strict=True):
        last = k if head is not None else last
        assert (r["k"], r["last"], r["before"]) == (k, last, total)
        total += n or 0


def test_no_scan_has_a_window_over_all_rows(spark):
    """The one window without partitions stands above an aggregate of one row a range."""
    lines = scan.carried_down(scan.ranges(spark.range(10), "id"), {"x": F.col("id")}, "id")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [k for k, line in enumerate(lines) if "Window [" in line]
    assert len(windows) == 2 and any("Aggregate [_part#" in lines[k + 1] for k in windows), "\n".join(lines)


def test_line_breaks_within_quotes_over_several_splits(small_splits, tmp_path):
    """Records of several lines that begin in one split and end in another."""
    rng = random.Random(8)
    texts = ["plain", "a, b", 'said "no"', "two\nlines", "three\n\nlines, \"quoted\"\n", "", "x" * 90, "long\n" * 30]
    rows = [[str(k), rng.choice(texts), rng.choice(texts)] for k in range(120)]
    path = tmp_path / "many.csv"
    with path.open("w", newline="") as f:
        f.write("﻿head,of,file\n")
        csv.writer(f, lineterminator="\n").writerows(rows)
    read = files._parsed(files.numbered_lines(small_splits, str(path)), 3).orderBy("line").collect()
    with path.open(newline="", encoding="utf-8-sig") as f:
        want = list(csv.reader(f))
    assert [[r[f"c{k}"] or "" for k in range(3)] for r in read] == want
    assert files.read_lines(small_splits, str(path)).select("block").distinct().count() > 5


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('1,"a\n2,b\n')
    with pytest.raises(ValueError):
        files.numbered_lines(spark, str(tmp_path / "bad.csv"))


def test_a_register_over_several_splits_is_read_as_one(small_splits, tmp_path):
    lines, want, exam, date, most = ["Sl. No,Name,,,,"], [], None, None, None
    rng = random.Random(5)
    for k in range(200):
        kind = rng.random()
        if kind < 0.1:
            exam, date, most = f"Exam {k}", f"{1 + k % 28}.3.2024", str(k)
            lines.append(rng.choice([f",,{exam},{date},{most},", f",,{date},{exam},,{most} Marks"]))
        elif kind < 0.15:
            lines.append(rng.choice([",,,,,", ",,,,77,", ""]))
        elif kind < 0.2:
            exam = f"Topic {k}"
            lines.append(f",Someone,{exam},,,{k}")
            want.append((exam, date, most, "", str(k)))
        else:
            lines.append(f"{k},Someone,{1000 + k},,,{k}")
            want.append((exam, date, most, str(1000 + k), str(k)))
    path = tmp_path / "register.csv"
    path.write_text("\n".join(lines) + "\n")
    got = files.read_register(small_splits, str(path)).orderBy("line").collect()
    assert [(r["exam"], r["date"], r["most"], r["student_id"], r["marks"]) for r in got] == want
    fixed = files.read_register(small_splits, str(path), {(want[-1][1], want[-1][0], want[-1][4]): "4.5"}).orderBy("line").collect()
    assert fixed[-1]["marks"] == "4.5"


def test_chunks_are_numbered_over_ranges(small_splits):
    got = files.sheet_chunks(small_splits.range(1000).repartition(9), "id", most_cells=7).orderBy("id").collect()
    assert [r["chunk"] for r in got] == [k // 7 for k in range(1000)]


def test_blocks_of_lines_are_bounded(spark, tmp_path, monkeypatch):
    """One split is cut into blocks; lines and records over their ends stay whole."""
    monkeypatch.setattr(files, "BLOCK_LINES", 7)
    path = tmp_path / "lines.csv"
    path.write_text("\n".join(f'{k},"two\nlines"' if k % 3 == 0 else f"{k},one" for k in range(60)) + "\n")
    lines = files.read_lines(spark, str(path)).collect()
    assert sorted(r["line"] for r in lines) == list(range(1, 81)) and max(Counter(r["block"] for r in lines).values()) <= 7
    records = [r["value"] for r in files.numbered_lines(spark, str(path)).orderBy("line").collect()]
    assert records == [f'{k},"two\nlines"' if k % 3 == 0 else f"{k},one" for k in range(60)]
