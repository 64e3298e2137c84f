"""Rows bucketed by key: per-key results meet them in place, a hot key is spread."""

import pytest
from pyspark.sql import functions as F

from assaylake.operators import keys
from assaylake.operators.bucketed import KeyedTable


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("a"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("b"), F.col("id") % 4)).alias("b"),
        "id", (F.col("id") * 7 % 101).alias("x"))
    return r.cache()


@pytest.fixture(scope="module")
def kept(rows):
    t = KeyedTable(rows, ["a", "b"], buckets=8, salts=4)
    yield t
    t.drop()


def _rows(df):
    return sorted(map(str, df.collect()))


def test_results_equal_those_by_exchange(rows, kept):
    assert _rows(kept.rows()) == _rows(rows)
    assert _rows(kept.with_group_size()) == _rows(keys.with_group_size(rows, ["a", "b"]))
    want = keys.duplicate_extras(keys.with_group_size(rows, ["a", "b"], "n"), ["a", "b"], ["id"])
    got = kept.with_first(["id"], "is_extra", "n")
    assert _rows(got.select(sorted(got.columns))) == _rows(want.select(sorted(want.columns)))
    spread = rows.groupBy("a", "b").agg((F.max("x") - F.min("x")).alias("range_x"))
    assert _rows(kept.group_range(["x"])) == _rows(spread)


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_rows_are_not_exchanged(spark, kept, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        plan = kept.with_group_size()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
    for line in plan.split("\n"):  # what is exchanged holds partial counts, never the rows' own columns
        if "Exchange" in line:
            assert " id#" not in line
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert 1 <= len(moved) <= 2 and all("__key" in x for x in moved)
    # Each exchange lies above an aggregate.
    lines = plan.split("\n")
    for i, x in enumerate(lines):
        if "Exchange hashpartitioning" in x:
            assert any("Aggregate" in y for y in lines[i + 1:i + 4])


def test_a_hot_key_lies_in_several_buckets(spark, kept):
    hot = spark.table(kept.name).where("a = 1 AND b = 'b0'")
    per = hot.groupBy("__salt").count().collect()
    assert len(per) == 4 and max(r["count"] for r in per) < 2 * min(r["count"] for r in per)


def test_empty_and_single_column_keys(spark):
    t = KeyedTable(spark.createDataFrame([], "k string, v int"), "k", buckets=2)
    assert t.with_group_size().collect() == []
    t.drop()
    t = KeyedTable(spark.createDataFrame([(None, 1), ("null", 2), (None, 3)], "k string, v int"), "k", buckets=2)
    assert {(r["v"], r["group_size"]) for r in t.with_group_size().collect()} == {(1, 2), (2, 1), (3, 2)}
    t.drop()


def test_results_are_handed_to_held_buckets_only(spark):
    """A key's result is shipped once for each bucket with its rows, not for each there may be."""
    t = KeyedTable(spark.range(40).select(F.col("id").alias("k"), F.col("id").alias("v")), ["k"], buckets=4)
    per = t.per_key({"__n": F.count(F.lit(1))}, {"n": F.sum("__n")})
    held = per.select(F.bit_count("__held").alias("h")).collect()
    assert len(held) == 40 and all(r["h"] == 1 for r in held)
    assert t.with_results(per, ["n"]).where("n = 1").count() == 40
    t.drop()
