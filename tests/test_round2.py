"""Inputs that earlier versions got wrong, by hand."""

import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from assaylake.operators import answers, consensus, keys, metrics, profile, similarity
from assaylake.operators.fingerprint import sign_fingerprint
from assaylake.plans import catalog as C
from assaylake.schema import Endpoint
from assaylake.sources import read_assay, write_assay

LOGGED = (Endpoint("HLM"), Endpoint("LogD", False))


def test_average_keeps_small_precise_and_long_numbers(spark):
    long = "1234567890123456789012345678901.5"
    texts = [(1, 0, "LogD=0.0000000004"), (2, 0, "LogD=1.1234567894"), (3, 0, f"LogD={long}"),
             (4, 0, "LogD=1.0"), (4, 1, "LogD=2.0")]
    df = spark.createDataFrame(texts, "query_id long, candidate_no long, text string")
    got = {r["query_id"]: r["LogD"] for r in answers.average_answers(df, ["LogD"]).collect()}
    assert got == {1: 4e-10, 2: 1.1234567894, 3: float(Decimal(long)), 4: 1.5}


def test_building_a_query_runs_no_shuffle(spark):
    tracker = spark.sparkContext.statusTracker()
    for name in ("hashed_fingerprint", "pattern_fingerprint", "profile_text", "consensus", "average_answers",
                 "evaluate", "score_end_to_end", "histogram_range"):
        if name in ("score_end_to_end", "histogram_range"):
            continue  # these write an ordered table first, which is a job by design
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        C.QUERIES[name](spark, "/root/testdata/sf0.001")
        jobs = tracker.getJobIdsForGroup(f"build-{name}")
        stages = [s for j in jobs for s in tracker.getJobInfo(j).stageIds]
        assert len(stages) == len(jobs), name  # reading a schema is a job of one stage; a shuffle has two
    spark.sparkContext.setJobGroup("rest", "rest")


@pytest.mark.parametrize("row", [(1.0, float("inf")), (1.0, float("nan")), (1.0, -1.0), (-3.0, 1.0), (1.0, None),
                                 (float("inf"), 1.0)])
def test_scores_refuse_what_is_not_finite(spark, row):
    rows = [(0, "HLM", *row), (1, "HLM", 1.0, 2.0), (2, "HLM", 3.0, 2.5), (3, "LogD", 1.0, 1.0), (4, "LogD", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, endpoint string, ref double, pred double")
    with pytest.raises(Exception, match="not finite"):
        metrics.evaluate(df, LOGGED).collect()
    got = {r["endpoint"]: r for r in metrics.evaluate(df, LOGGED, on_null="skip").collect()}
    assert got["HLM"]["n"] == 2 and all(math.isfinite(r["mean_absolute_error"]) for r in got.values())


def test_scores_need_every_endpoint_and_macro_is_null_aware(spark):
    df = spark.createDataFrame([(0, "LogD", 1.0, 1.5), (1, "LogD", 2.0, 2.0), (2, "HLM", 1.0, 2.0)],
                               "row_id long, endpoint string, ref double, pred double")
    with pytest.raises(Exception, match="required key not present: HLM"):
        metrics.evaluate(df.where("endpoint = 'LogD'"), LOGGED).collect()
    got = {r["endpoint"]: r for r in metrics.evaluate(df, LOGGED).collect()}
    assert got["HLM"]["r2"] is None and got["aggregated"]["r2"] is None
    assert got["aggregated"]["mean_absolute_error"] is not None
    only = metrics.evaluate(df.where("endpoint = 'LogD'"), LOGGED, required=["LogD"]).collect()
    assert {r["endpoint"] for r in only} == {"LogD", "aggregated"}


def test_null_keys_are_not_averaged(spark):
    rows = [(None, 1, 1.0), (None, 2, 1.01), ("a", 3, 1.0), ("a", 4, 1.01)]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    e = (Endpoint("x", False, "abs", 0.3),)
    got = {r["k"]: r for r in consensus.consensus(df, ["k"], e, ["i"], keep=["i"]).collect()}
    assert got[None]["x"] is None and got[None]["i"] == 1 and got["a"]["x"] == pytest.approx(1.005)
    wide = spark.createDataFrame([(None, 1, 1.0), (None, 2, 9.0)], "k string, i long, x double")
    assert [r["x_noisy"] for r in consensus.disagreement_flags(wide, ["k"], e, per_row=True).collect()] == [False] * 2


def test_per_key_results_reach_null_keys(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2), (1, None, 3), (1, 2, 4), (1, 2, 5)],
                               "a int, b int, x int")
    got = {r["x"]: r["group_size"] for r in keys.with_group_size(df, ["a", "b"]).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 2, 5: 2}


def test_raw_rows_are_exchanged_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).selectExpr("id % 7 AS a", "id AS x", "'payload' AS payload")
        plan = keys.with_group_size(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(moved) >= 2 and "coalesce(a" not in "".join(moved[:2])


def test_quantiles_of_a_hot_value(spark):
    v = [5.0] * 9000 + np.linspace(0, 10, 1000).tolist()
    df = spark.createDataFrame([(x,) for x in v], "x double")
    got = {r["p"]: r["value"] for r in profile.exact_quantiles(df, ["x"], [0.0, 0.01, 0.25, 0.5, 0.973, 1.0]).collect()}
    for p, x in got.items():
        assert x == pytest.approx(np.quantile(v, p))
    at = profile._value_positions(profile.to_long_values(df, ["x"]))
    sizes = at.groupBy(profile.F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == len(set(v))  # a value is one row, however many rows hold it


@pytest.mark.parametrize("rng", [None, (0.0, 30.0)])
def test_automatic_bins_as_numpy(spark, rng):
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(5, 1, 2000), [1e6]])
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    got = profile.histogram(df, ["x"], "auto", rng).orderBy("bin").collect()
    counts, edges = np.histogram(v, bins="auto", range=rng)
    assert [g["count"] for g in got] == counts.tolist()
    assert got[-1]["bin_hi"] == pytest.approx(edges[-1])


TEXTS = ['a "q" b', "tab\there", "line\nend", " outer ", "back\\slash", "NA", "nan", 'only "', "a,b", "\\", "cr\rx"]


@pytest.mark.parametrize("fmt", ["tsv", "csv"])
def test_delimited_round_trip(spark, tmp_path, fmt):
    rows = [(i, t, float(i) if i % 3 else None) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "i long, t string, x double")
    write_assay(df.coalesce(1), str(tmp_path / "own"), fmt=fmt)
    back = read_assay(spark, str(tmp_path / "own"), "i long, t string, x double", fmt)
    assert sorted(map(tuple, back.collect())) == rows
    sep = "\t" if fmt == "tsv" else ","
    part = next((tmp_path / "own").glob("part-*"))
    theirs = pd.read_csv(part, sep=sep, keep_default_na=False, na_values={"x": [""]}, lineterminator="\n")
    assert theirs["t"].tolist() == TEXTS
    pd.DataFrame({"i": range(len(TEXTS)), "t": TEXTS, "x": [r[2] for r in rows]}).to_csv(
        tmp_path / "theirs.csv", sep=sep, index=False)
    ours = read_assay(spark, str(tmp_path / "theirs.csv"), "i long, t string, x double", fmt)
    assert sorted(map(tuple, ours.collect())) == rows


def test_missing_words_in_number_columns(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("i\tx\n1\tNA\n2\tnan\n3\t\n4\t1.5\n5\tN/A\n")
    got = read_assay(spark, str(tmp_path / "t.tsv"), "i long, x double").orderBy("i").collect()
    assert [r["x"] for r in got] == [None, None, None, 1.5, None]
    (tmp_path / "bad.tsv").write_text("i\tx\n1\tabc\n")
    with pytest.raises(Exception, match="x is no double: abc"):
        read_assay(spark, str(tmp_path / "bad.tsv"), "i long, x double").collect()


def test_sign_bits_beyond_one_word(spark):
    one, two = [-1.0] * 128, [-1.0] * 128
    one[0] = two[64] = 1.0
    df = spark.createDataFrame([(1, one), (2, two), (3, None), (4, [])], "i long, v array<double>")
    got = {r["i"]: (r["fp"], r["n_bits_set"]) for r in sign_fingerprint(df, "i", "v", 2).collect()}
    assert got == {1: ([1, 0], 1), 2: ([0, 1], 1), 3: (None, None), 4: (None, None)}
    with pytest.raises(Exception, match="vector longer than 64"):
        sign_fingerprint(df, "i", "v", 1).collect()


@pytest.mark.parametrize("threshold", [1 / 3, 0.2, 1.0, 0.999])
def test_threshold_join_of_nested_sets(spark, threshold):
    def row(i, n):
        bits = (1 << n) - 1
        words = [bits >> (64 * j) & (1 << 64) - 1 for j in range(16)]
        return i, [w - (1 << 64) if w >> 63 else w for w in words], n
    sizes = [1, 3, 5, 9, 27, 81, 200, 243, 243, 729, 730, 999, 1000, 1024]
    df = spark.createDataFrame([row(i, n) for i, n in enumerate(sizes)], "id long, fp array<long>, n_bits_set int")
    want = {(i, j) for i, a in enumerate(sizes) for j, b in enumerate(sizes)
            if i < j and min(a, b) / max(a, b) >= threshold}
    for block in (4096, 2):
        got = similarity.tanimoto_join(df, None, 16, threshold, block_size=block).collect()
        assert sorted((r["left_id"], r["right_id"]) for r in got) == sorted(want)


def test_no_replica_is_shuffled(spark):
    for name in ("render_prompts", "replicated_targets"):
        plan = C.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("replica"):]
        assert not [x for x in below.split("\n") if "Exchange" in x and "replica" in x]


def test_jitter_is_drawn_once_for_a_number(spark):
    plan = C.QUERIES["render_prompts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(cast(concat_ws(:, 42") <= 4  # two words of a hash for the context, two for the answer


def test_text_ids(spark):
    rows = [("a", [7], 3), ("b", [3], 2), ("c", [3], 2), ("d", [8], 1), (None, [1], 1)]
    df = spark.createDataFrame(rows, "id string, fp array<long>, n_bits_set int")
    assert {r["id"]: r["best_sim"] for r in similarity.nearest(df, None, 1).collect()} == {
        "a": 2 / 3, "b": 1.0, "c": 1.0, "d": 0.0}
    other = df.where("id > 'b'").withColumn("id", similarity.F.concat("id", similarity.F.lit("2")))
    got = {(r["side"], r["id"]): r["best_sim"] for r in similarity.nearest(df, other, 1).collect()}
    assert got["left", "b"] == 1.0 and got["right", "c2"] == 1.0 and got["right", "d2"] == 1.0
    top = similarity.topk_matches(df, df, 1, [1]).where("query_id = 'b'").collect()
    assert [(r["ref_id"], r["sim"]) for r in top] == [("b", 1.0)]
    assert [(r["left_id"], r["right_id"]) for r in similarity.tanimoto_join(df, None, 1, 1.0).collect()] == [("b", "c")]
