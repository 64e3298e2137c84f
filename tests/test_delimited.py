"""Delimited files whose texts hold line ends, read in many splits."""

import csv
import random

import pytest

from assaylake.sources import read_assay, write_assay, write_folds
from assaylake.sources.delimited import read_records

SCHEMA = "i long, t string, x double"


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    for k in list(keys)[1:]:
        spark.conf.unset(k)


def _rows(seed, n):
    r = random.Random(seed)
    bits = ["a", '"', "\n", "\t", ",", " ", "é", "\r", '""', "\n\n", "x" * 40, '"\n"', "\\"]
    out = []
    for i in range(n):
        t = "".join(r.choice(bits) for _ in range(r.randrange(0, 9)))
        if i % 37 == 0:
            t = "\n".join("long" * r.randrange(1, 30) for _ in range(60))  # over several splits
        if i % 53 == 0:
            t = "\n" * 700
        out.append((i, t or None, float(i) if i % 3 else None))
    return out


@pytest.mark.parametrize("fmt", ["tsv", "csv"])
@pytest.mark.parametrize("seed", [1, 2])
def test_one_large_part_is_read_by_many_tasks(spark, tmp_path, small_splits, fmt, seed):
    rows = _rows(seed, 240)
    write_assay(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "t"), fmt=fmt)
    assert len(list((tmp_path / "t").glob("part-*"))) == 1
    text = spark.read.option("lineSep", "\n").text(str(tmp_path / "t"))
    assert text.rdd.getNumPartitions() > 30
    assert sorted(map(tuple, read_assay(spark, str(tmp_path / "t"), SCHEMA, fmt).collect())) == rows


def test_foreign_files_with_both_line_ends(spark, tmp_path, small_splits):
    rows = [(i, (t or "").replace("\r", "") or None, x) for i, t, x in _rows(3, 120)]
    for k, end in enumerate(("\n", "\r\n")):
        with open(tmp_path / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["i", "t", "x"])
            w.writerows([(i + 1000 * k, "" if t is None else t, "" if x is None else x) for i, t, x in rows])
            f.write(end * 3)
    got = sorted(map(tuple, read_assay(spark, str(tmp_path), SCHEMA, "csv").collect()))
    assert got == rows + [(i + 1000, t, x) for i, t, x in rows]


def test_split_reading_equals_whole_reading(spark, tmp_path):
    """The same records whatever the size of the splits, also where a sort-merge join brings the parities."""
    rows = _rows(4, 150)
    write_assay(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "t"))
    found = []
    for size, broadcast in (("100", "-1"), ("1000", "10m"), ("64m", "10m")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        found.append(sorted(r["value"] for r in read_records(spark, str(tmp_path / "t")).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def test_folders_name_columns(spark, tmp_path):
    rows = _rows(5, 60)
    df = spark.createDataFrame([(*r, r[0] % 3) for r in rows], SCHEMA + ", fold int")
    write_folds(df, str(tmp_path / "f"))
    got = read_assay(spark, str(tmp_path / "f"), "fold int, i long, t string, x double").collect()
    assert sorted((r["i"], r["t"], r["x"], r["fold"]) for r in got) == [(*r, r[0] % 3) for r in rows]


def test_empty_and_malformed(spark, tmp_path):
    (tmp_path / "none.tsv").write_text("")
    assert read_assay(spark, str(tmp_path / "none.tsv"), SCHEMA).collect() == []
    (tmp_path / "head.tsv").write_text('i\t"t\n2"\tx\n')
    assert read_assay(spark, str(tmp_path / "head.tsv"), SCHEMA).collect() == []
    (tmp_path / "open.tsv").write_text('i\tt\tx\n1\t"never closed\n2\t3\n')
    got = read_assay(spark, str(tmp_path / "open.tsv"), SCHEMA)
    with pytest.raises(Exception):
        got.collect()
