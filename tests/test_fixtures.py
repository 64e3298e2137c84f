"""Hand fixtures pinning the edge semantics (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from assaylake.functions import numeric as num
from assaylake.functions import text as txt
from assaylake.operators import answers, consensus, keys, metrics, profile, prompts, retrieval
from assaylake.operators import similarity as sim
from assaylake.operators import splits
from assaylake.schema import Endpoint

LOGD = (Endpoint("LogD", False, "abs", 0.3),)


def _consensus(spark, values):
    rows = [(i, "k", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "row_id bigint, key string, LogD double")
    out = consensus.consensus(df, ["key"], LOGD, ["row_id"]).collect()[0]
    flag = consensus.disagreement_flags(df, ["key"], LOGD).collect()[0]["LogD_noisy"]
    return out["LogD"], flag


@pytest.mark.parametrize("values, mean, flag", [
    ([1.0, 1.2], 1.1, False),      # 1: within tolerance -> mean
    ([1.0, 1.4], None, True),      # 2: spread 0.4 > 0.3 -> NULL
    ([1.0, None], 1.0, False),     # 3: mean skips NULL
    ([None, None], None, False),   # 4: all NULL -> NULL, not flagged
])
def test_consensus_rules(spark, values, mean, flag):
    got, got_flag = _consensus(spark, values)
    assert got_flag is flag
    assert (got is None and mean is None) or abs(got - mean) < 1e-12


def test_consensus_relative_tolerance_uses_std_over_all_rows(spark):
    rows = [(0, "a", 1.0), (1, "a", 2.0), (2, "b", 5.0), (3, "c", 9.0)]
    df = spark.createDataFrame(rows, "row_id bigint, key string, HLM double")
    ep = (Endpoint("HLM", True, "rel", 0.3),)
    sd = df.agg(F.stddev_samp("HLM")).first()[0]
    out = {r["key"]: r for r in consensus.consensus(df, ["key"], ep, ["row_id"]).collect()}
    assert (1.0 > 0.3 * sd) == (out["a"]["HLM"] is None)
    assert math.isclose(out["b"]["LogHLM"], math.log10(6.0))


def test_group_number(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "row_id bigint, k string")
    got = {r["row_id"]: r["group_no"] for r in keys.group_number(df, ["k"]).collect()}
    assert got == {0: 1, 1: 0, 2: None, 3: 1}


def test_duplicate_extras_null_keys_are_equal(spark):
    df = spark.createDataFrame([(0, "x"), (1, None), (2, "x"), (3, None), (4, "y")],
                               "row_id bigint, k string")
    got = {r["row_id"]: r["is_extra"] for r in keys.duplicate_extras(df, ["k"], ["row_id"]).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False}


def test_extension_suffix(spark):
    df = spark.createDataFrame([("CC |o1:2|",), ("CC",)], "s string")
    assert [r[0] for r in df.select(txt.extension_suffix("s")).collect()] == ["|o1:2|", ""]


def test_log10_ieee_edges(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (10.0,), (None,)], "x double")
    got = [r[0] for r in df.select(num.log10_ieee("x")).collect()]
    assert got[0] == float("-inf") and math.isnan(got[1]) and got[2] == 1.0 and got[3] is None


def _fps(spark, rows):
    """rows: (id, set of bit positions < 64)."""
    data = [(i, [sum(1 << b for b in bits) - (1 << 64 if 63 in bits else 0)], len(bits))
            for i, bits in rows]
    return spark.createDataFrame(data, "id bigint, fp array<bigint>, n_bits_set int")


def test_tanimoto_half(spark):
    left, right = _fps(spark, [(1, {1, 2, 3})]), _fps(spark, [(2, {2, 3, 4})])
    n = sim.nearest(left, right, 1).collect()
    assert {r["side"]: r["best_sim"] for r in n} == {"left": 0.5, "right": 0.5}


def test_tanimoto_empty_vs_empty_is_null(spark):
    left, right = _fps(spark, [(1, set())]), _fps(spark, [(2, set())])
    assert sim.nearest(left, right, 1).count() == 0
    assert sim.similarity_distribution(left, right, 1).count() == 0


@pytest.mark.parametrize("keep_ident, expected", [(False, [0.9, 0.8]), (True, [1.0, 0.9])])
def test_topk_near_identical_rule(spark, keep_ident, expected):
    # query {0..9}; refs: identical (1.0), 9 of 10 bits (0.9), 8 of 10 bits (0.8)
    q = _fps(spark, [(100, set(range(10)))]).withColumn("keep", F.lit(keep_ident))
    r = _fps(spark, [(1, set(range(10))), (2, set(range(9))), (3, set(range(8)))])
    top = sim.topk_matches(q, r, 1, [2], keep_ident_col="keep").orderBy("rank").collect()
    assert [round(t["sim"], 6) for t in top] == expected


def test_topk_ties_break_on_smaller_id(spark):
    q = _fps(spark, [(100, {0, 1})]).withColumn("keep", F.lit(True))
    r = _fps(spark, [(7, {0}), (3, {1}), (5, {0, 2})])
    top = sim.topk_matches(q, r, 1, [2], keep_ident_col="keep").orderBy("rank").collect()
    assert [t["ref_id"] for t in top] == [3, 7]


def _cands(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, candidate_no int, text string")


def test_parse_answers(spark):
    c = _cands(spark, [(1, 0, "LogMDR1-MDCKII=0.45, LogD=3, LogHLM=-1.20")])
    got = [(r["name"], r["value"]) for r in answers.parse_answers(c).orderBy("pair_no").collect()]
    assert got == [("LogMDR1-MDCKII", 0.45), ("LogHLM", -1.2)]


def test_one_void_candidate_voids_the_query(spark):
    c = _cands(spark, [(1, 0, "LogD=1.00"), (1, 1, "no numbers here")])
    row = answers.average_answers(c).collect()[0]
    assert row["LogD"] is None and row["query_id"] == 1


def test_repeated_name_counts_twice(spark):
    c = _cands(spark, [(1, 0, "LogD=1.0, LogD=2.0"), (1, 1, "LogD=3.0")])
    row = answers.average_answers(c).collect()[0]
    assert row["LogD"] == 2.0 and row["LogHLM"] is None


def test_fmt2_matches_python(spark):
    vals = [0.125, 2.675, 1.005, -0.001, 1234567.891]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(num.fmt2("x")).collect()] == [f"{v:.2f}" for v in vals]


def test_kfold_sizes_13_rows(spark):
    df = spark.range(13).withColumnRenamed("id", "row_id")
    folds = splits.kfold(df, ["row_id"], 5, 42)
    sizes = {r["fold"]: (r["n_train"], r["n_val"]) for r in splits.kfold_sizes(folds).collect()}
    assert sorted(v for _, v in sizes.values()) == [2, 2, 3, 3, 3]
    assert all(t + v == 13 for t, v in sizes.values())
    val = folds.where("split = 'val'").select("row_id").collect()
    assert sorted(r[0] for r in val) == list(range(13))


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 10)], "x double")
    got = [r["count"] for r in profile.histogram(df, ["x"], 5).orderBy("bin").collect()]
    assert got == [2, 2, 0, 0, 1]


def test_evaluate_ignores_missing_reference(spark):
    df = spark.createDataFrame([(0, "LogD", None, 5.0), (1, "LogD", 2.0, 2.0)],
                               "row_id bigint, endpoint string, ref double, pred double")
    row = metrics.evaluate(df, LOGD, macro=False).collect()[0]
    assert row["n"] == 1 and row["mean_absolute_error"] == 0.0


def test_training_query_without_endpoints(spark):
    q = spark.createDataFrame([(1, "k1", "p")], "query_id bigint, key string, profile string")
    merged = spark.createDataFrame(
        [], "replica int, query_id bigint, key string, profile string, pos_prop int, "
            "pos_rank int, sim double, props_text string")
    targets = spark.createDataFrame([], "replica int, query_id bigint, prop_ord int, "
                                        "property string, value double")
    out = prompts.render_prompts(q, merged, targets, ["LogD"], "SMILES").collect()[0]
    assert out["question"] == "SMILES: k1, p; Determine " and out["answer"] == ""
    rec = prompts.chat_records(prompts.render_prompts(q, merged, targets, ["LogD"])).collect()[0]
    assert len(rec["record"]["contents"]) == 2


def test_merge_last_write_wins_first_position(spark):
    # key K appears for property 0 at rank 2 and property 1 at rank 1
    nb = spark.createDataFrame(
        [(1, 0, "p0", 1, 10, 0.9, 1.0), (1, 0, "p0", 2, 11, 0.8, 2.0),
         (1, 1, "p1", 1, 11, 0.7, 3.0)],
        "query_id bigint, prop_ord int, property string, rank int, ref_id bigint, sim double, value double")
    refs = spark.createDataFrame([(10, "A", ""), (11, "K", "")], "ref_id bigint, key string, profile string")
    m = {r["key"]: r for r in retrieval.merge_neighbours(nb, refs).collect()}
    assert (m["K"]["pos_prop"], m["K"]["pos_rank"]) == (0, 2)
    assert m["K"]["sim"] == 0.7 and m["K"]["props_text"] == "p0=2.00, p1=3.00"
