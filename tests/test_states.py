"""Mergeable consensus states, pair moments, group hooks."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.operators import consensus, consensus_state, moments, udf
from assaylake.plans import catalog as C
from assaylake.schema import Endpoint

ENDS = (Endpoint("x", True, "rel", 0.3), Endpoint("y", False, "abs", 0.5))


def _measured(spark, n, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "c", None, f"k{r.randrange(60)}"]), i, None if r.random() < 0.2 else 1e6 + r.random(),
             None if r.random() < 0.5 else r.random(), f"t{i}") for i in range(n)]
    return spark.createDataFrame(rows, "k string, i long, x double, y double, t string")


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c in x.asDict():
            if isinstance(x[c], float) and y[c] is not None:
                assert x[c] == pytest.approx(y[c], rel=1e-12), c
            else:
                assert x[c] == y[c], c


def test_state_after_batches_equals_one_pass(spark, tmp_path):
    df = _measured(spark, 600, 1).cache()
    want = consensus.consensus(df, ["k"], ENDS, ["i"], ["i", "t"]).orderBy("k").collect()
    flags = consensus.disagreement_flags(df, ["k"], ENDS).orderBy("k").collect()
    for n, order in enumerate(([0, 1, 2, 3], [3, 1, 0, 2])):
        table = consensus_state.StateTable(spark, str(tmp_path / str(n)), ["k"], ENDS, ["i"], ["i", "t"])
        for b in order:
            table.add(df.where(F.col("i") % 4 == b), b)
        table.add(df.where(F.col("i") % 4 == 1), 1)  # tried again: counts once
        _same(table.consensus().orderBy("k").collect(), want)
        _same(table.flags().orderBy("k").collect(), flags)
        table.compact()
        assert len(table._parts()) == 1 and table.has(2)
        table.add(df.where(F.col("i") % 4 == 2), 2)
        _same(table.consensus().orderBy("k").collect(), want)


def test_half_written_batches_do_not_count(spark, tmp_path):
    df = _measured(spark, 100, 2)
    table = consensus_state.StateTable(spark, str(tmp_path), ["k"], ENDS, ["i"])
    with pytest.raises(ValueError, match="no batch"):
        table.state()
    table.add(df, "b1")
    (part,) = list(tmp_path.iterdir())
    (part / "manifest.json").unlink()
    assert not table.has("b1")
    table.add(df, "b1")
    _same(table.consensus().orderBy("k").collect(), consensus.consensus(df, ["k"], ENDS, ["i"]).orderBy("k").collect())


def test_empty_batches(spark, tmp_path):
    df = _measured(spark, 50, 3)
    table = consensus_state.StateTable(spark, str(tmp_path), ["k"], ENDS, ["i"])
    table.add(df.where("false"), 0)
    assert table.consensus().collect() == []
    table.add(df, 1)
    assert table.consensus().count() == df.select("k").distinct().count()


def test_consensus_reads_states_not_measurements(spark, tmp_path):
    table = consensus_state.StateTable(spark, str(tmp_path), ["k"], ENDS, ["i"])
    table.add(_measured(spark, 200, 4), 0)
    plan = table.consensus()._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "Scan parquet" in plan


# --- pair moments -----------------------------------------------------------------

def _pairs(v, cols):
    out = {}
    for i, j in itertools.product(range(v.shape[1]), repeat=2):
        x, y = v[:, i], v[:, j]
        ok = ~np.isnan(x) & ~np.isnan(y)
        x, y = x[ok], y[ok]
        n = len(x)
        r = slope = None
        if n >= 2 and x.std() > 0:
            slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
            if y.std() > 0:
                r = float(np.corrcoef(x, y)[0, 1])
        out[cols[i], cols[j]] = (n, r, slope, None if slope is None else float(y.mean() - slope * x.mean()))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_pair_statistics_equal_numpy(spark, parts):
    r = np.random.default_rng(1)
    v = np.column_stack([r.normal(1e8, 1, 500), r.normal(0, 1, 500), np.full(500, 3.0), r.normal(5, 1e-3, 500)])
    v[:, 3] += 1e-3 * v[:, 1]
    v[r.random(v.shape) < 0.2] = np.nan
    v[:, 1][250:] = np.nan
    cols = ["a", "b-c", "const", "d"]
    df = spark.createDataFrame(pd.DataFrame(v, columns=cols)).repartition(parts)
    want = _pairs(v, cols)
    got = moments.pair_statistics(df, cols).collect()
    assert len(got) == 16
    for g in got:
        n, r_, slope, intercept = want[g["col_x"], g["col_y"]]
        assert g["n"] == n and (g["r"] is None) == (r_ is None) and (g["slope"] is None) == (slope is None)
        assert r_ is None or g["r"] == pytest.approx(r_, rel=1e-6, abs=1e-7)
        assert slope is None or g["slope"] == pytest.approx(slope, rel=1e-6, abs=1e-7)
        far = abs((slope or 0) * np.nanmean(v[:, cols.index(g["col_x"])]))  # what the intercept is the difference of
        assert slope is None or g["intercept"] == pytest.approx(intercept, rel=1e-6, abs=1e-6 * far + 1e-7)


def test_pair_statistics_of_few_and_odd_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, math.inf), (2.0, None, 1.0), (4.0, 3.0, 2.0)], "a double, b double, c double")
    got = {(r["col_x"], r["col_y"]): r for r in moments.pair_statistics(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"]["n"] == 2 and got["a", "b"]["slope"] == pytest.approx(1 / 3)
    assert got["a", "c"]["r"] is None or math.isnan(got["a", "c"]["r"])
    none = {r["n"] for r in moments.pair_statistics(df.where("false"), ["a", "b"]).collect()}
    assert none == {0}


def test_both_statistics_come_from_one_scan_and_one_aggregate(spark):
    plan = C.QUERIES["pair_statistics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and "covar" not in plan and "regr" not in plan
    assert plan.count("MapInPandas") <= 2  # both orientations read one (reused) aggregate


# --- group hooks --------------------------------------------------------------------

def test_half_of_all_rows_in_one_group(spark):
    n = 40_000
    df = spark.range(n).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE concat('k', id % 50) END AS k",
                                   "id AS v")
    def fn(key, batches):
        rows, most, last, ordered = 0, 0, None, True
        for pdf in batches:
            v = pdf["v"].to_numpy()
            ordered &= bool((np.diff(v) > 0).all()) and (last is None or v[0] > last)
            rows, most, last = rows + len(v), max(most, len(v)), v[-1]
        yield pd.DataFrame({"k": [key[0]], "n": [rows], "most": [most], "ordered": [ordered]})

    got = {r["k"]: r for r in udf.map_groups(df, "k", fn, "k string, n long, most long, ordered boolean", ["v"], 500).collect()}
    want = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    assert {k: r["n"] for k, r in got.items()} == want and None in got
    assert all(r["ordered"] and r["most"] <= 500 for r in got.values()) and got["hot"]["n"] == n // 2


def test_a_group_is_gathered_in_runs_not_in_rows(spark):
    """Only a row a run is sorted in the group's task; every kind of column comes through as it was."""
    df = spark.range(0, 30_000, numPartitions=5).selectExpr(
        "CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') WHEN 2 THEN -0.0D ELSE id % 2 END AS k", "id % 2 = 0 AS j",
        "30000 - id AS v", "IF(id % 3 = 0, NULL, concat('s', id)) AS s", "timestamp_seconds(id) AS t",
        "cast(id AS decimal(12, 2)) AS d", "array(id, NULL) AS a", "named_struct('x', id % 4) AS o")
    whole = udf._gathered(df, ["j", "k"], ["v"])
    assert whole.columns == df.columns and whole.dtypes == df.dtypes
    assert sorted(map(str, whole.collect())) == sorted(map(str, df.collect()))
    assert sorted(map(str, udf._gathered(df.select("j"), ["j"], []).collect())) == sorted(map(str, df.select("j").collect()))
    def fn(key, batches):
        v = np.concatenate([b["v"].to_numpy() for b in batches])
        yield pd.DataFrame({"n": [len(v)], "sorted": [bool((np.diff(v) > 0).all())]})

    got = udf.map_groups(df, ["j", "k"], fn, "n long, sorted boolean", ["v"], 500).collect()
    assert sum(r["n"] for r in got) == 30_000 and all(r["sorted"] for r in got)


def test_groups_left_unread_and_groups_without_result(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")

    def first(key, batches):
        if key[0] != 1:
            yield next(batches).head(1)

    got = udf.map_groups(df, ["k"], first, "k long, v long", ["v"], 7).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (2, 2)]


def test_reduced_groups_are_small_before_the_shuffle(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 2 = 0 THEN 1 ELSE CAST(NULL AS INT) END AS k", "id % 3 AS j", "id AS v")
    df = df.repartition(4)

    def part(key, rows):
        return {"n": len(rows), "s": int(rows["v"].sum())}

    def merge(a, b):
        return {"n": a["n"] + b["n"], "s": a["s"] + b["s"]}

    got = udf.reduce_groups(df, ["k", "j"], part, merge, "n long, s long")
    want = df.groupBy("k", "j").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    mean = udf.reduce_groups(df, "j", part, merge, "n long, s long", lambda k, p: {"mean": p["s"] / p["n"]}, "mean double")
    assert {r["j"]: r["mean"] for r in mean.collect()} == {
        r["j"]: r["m"] for r in df.groupBy("j").agg(F.avg("v").alias("m")).collect()}


def test_states_are_merged_once(spark, tmp_path):
    """Global sums take no merging of their own, and the states of one part none at all."""
    df = _measured(spark, 200, 3)
    table = consensus_state.StateTable(spark, str(tmp_path), ["k"], ENDS, ["i"])

    def by_key(out):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        return sum("collect_list" in line for line in plan.split("\n"))

    table.add(df.where("i < 100"), 0)
    table.add(df.where("i >= 100"), 1)
    assert by_key(table.flags()) == by_key(table.consensus()) == 1
    table.compact()
    assert by_key(table.flags()) == by_key(table.consensus()) == 0
