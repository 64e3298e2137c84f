"""Plan shape: the physical plans we rely on at scale."""

import re

from assaylake.plans import catalog as C

SF = "/root/testdata/sf0.001"


def _main_plan(df):
    """Formatted physical plan (as ``explain('formatted')`` prints it)."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_consensus_one_key_shuffle(spark):
    df = C.QUERIES["consensus"](spark, SF)
    plan = _main_plan(df)
    main = plan.split("===== Subqueries =====")[0]
    assert len(re.findall(r"hashpartitioning\(l_partkey", main)) == 1
    assert "Window" not in main
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_topk_uses_group_limit(spark):
    df = C.QUERIES["query_reference_sim"](spark, SF)
    assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString() or \
        "WindowGroupLimit" in _main_plan(df)


def test_similarity_has_no_cross_join(spark):
    for name in ("nearest_other", "tanimoto_pairs", "topk_neighbours", "render_prompts"):
        plan = _main_plan(C.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    for name in ("nearest_other", "topk_neighbours"):
        # tanimoto_pairs reads its materialised distribution table instead
        assert "FlatMapCoGroupsInPandas" in _main_plan(C.QUERIES[name](spark, SF)), name


def test_fingerprint_is_native(spark):
    plan = _main_plan(C.QUERIES["hashed_fingerprint"](spark, SF))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "HashAggregate" in plan


def test_group_number_without_global_window(spark):
    plan = _main_plan(C.QUERIES["group_number"](spark, SF))
    # The range sort ran before the checkpoint; the rows are never ordered in
    # one partition (only the per-partition count table is).
    assert "rangepartitioning" not in plan.lower()


def test_smallest_values_limits_before_shuffle(spark):
    plan = _main_plan(C.QUERIES["smallest_values"](spark, SF))
    assert "WindowGroupLimit" in plan


def test_quantiles_do_not_use_percentile_aggregate(spark):
    plan = _main_plan(C.QUERIES["describe_columns"](spark, SF))
    assert "percentile(" not in plan.lower()
