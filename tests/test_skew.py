"""A key holding a third of the rows: results stay whole and nothing goes quadratic."""

import numpy as np
import pandas as pd

from assaylake.operators import consensus, keys
from assaylake.operators import similarity as sim
from assaylake.schema import Endpoint


def test_consensus_with_hot_key(spark):
    rng = np.random.default_rng(5)
    n = 30000
    key = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 5000, n))
    val = rng.normal(10, 2, n)
    pdf = pd.DataFrame({"row_id": np.arange(n), "k": key, "HLM": val})
    df = spark.createDataFrame(pdf).repartition(8)
    ep = (Endpoint("HLM", True, "rel", 0.3),)
    out = {r["k"]: r for r in consensus.consensus(df, ["k"], ep, ["row_id"], keep=["row_id"]).collect()}
    sd = pdf["HLM"].std()
    for k, g in pdf.groupby("k"):
        flagged = g["HLM"].max() - g["HLM"].min() > 0.3 * sd
        got = out[k]["HLM"]
        assert (got is None) == flagged
        if not flagged:
            assert abs(got - g["HLM"].mean()) < 1e-9
        assert out[k]["row_id"] == g["row_id"].min()
    assert len(out) == pdf["k"].nunique()


def test_duplicate_ops_with_hot_key(spark):
    n = 9000
    pdf = pd.DataFrame({"row_id": np.arange(n), "k": np.where(np.arange(n) % 3 == 0, -1, np.arange(n))})
    df = spark.createDataFrame(pdf).repartition(6)
    extras = keys.duplicate_extras(df, ["k"], ["row_id"]).where("is_extra").count()
    assert extras == n // 3 - 1
    members = keys.duplicate_members(df, ["k"]).count()
    assert members == n // 3


def test_hot_identical_group_is_linear(spark):
    n = 3000
    fp = [[7 if i % 3 == 0 else i + 8] for i in range(n)]   # a third share one fingerprint
    rows = [(i, fp[i], bin(fp[i][0]).count("1")) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, fp array<bigint>, n_bits_set int")
    groups = sim.identical_groups(df)
    assert groups.count() == n // 3            # one row per member, not one per pair
    counts = sim.identical_pair_counts(groups).first()
    assert counts["n_identical_pairs"] == (n // 3) * (n // 3 - 1)
