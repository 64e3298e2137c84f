"""Properties: brute-force similarity, partition invariance, round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import numeric as num
from assaylake.operators import keys, metrics, splits
from assaylake.operators import similarity as sim
from assaylake.plans import catalog as C
from assaylake.schema import Endpoint

SF = "/root/testdata/sf0.001"


def _random_fps(seed, n, words=2, density=0.15, dup=3):
    rng = np.random.default_rng(seed)
    bits = rng.random((n, words * 64)) < density
    bits[:dup] = bits[dup:2 * dup]          # a few identical rows
    bits[-1] = False                        # one empty fingerprint
    packed = np.packbits(bits.reshape(n, words, 64)[:, :, ::-1], axis=2).view(">u8")[:, :, 0]
    return bits, packed.astype(np.uint64).view(np.int64)


def _df(spark, ids, packed, bits):
    rows = [(int(i), [int(x) for x in packed[k]], int(bits[k].sum())) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id bigint, fp array<bigint>, n_bits_set int")


def _brute(a, b):
    inter = a.astype(np.int64) @ b.astype(np.int64).T
    union = a.sum(1)[:, None] + b.sum(1)[None, :] - inter
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(union > 0, inter / np.maximum(union, 1), np.nan), inter, union


@pytest.fixture(scope="module")
def data(spark):
    bits_l, packed_l = _random_fps(1, 300)
    bits_r, packed_r = _random_fps(2, 170)
    left = _df(spark, np.arange(300) * 7 + 1, packed_l, bits_l)
    right = _df(spark, np.arange(170) * 5 + 2, packed_r, bits_r)
    return bits_l, bits_r, left, right


def test_nearest_matches_brute_force(spark, data):
    bits_l, bits_r, left, right = data
    s, _, _ = _brute(bits_l, bits_r)
    got = {(r["side"], r["id"]): r["best_sim"]
           for r in sim.nearest(left, right, 2, block_size=64).collect()}
    for k, i in enumerate(np.arange(300) * 7 + 1):
        row = s[k]
        if np.all(np.isnan(row)):
            assert ("left", i) not in got
        else:
            assert got[("left", i)] == pytest.approx(np.nanmax(row), abs=1e-12)
    for k, j in enumerate(np.arange(170) * 5 + 2):
        col = s[:, k]
        if not np.all(np.isnan(col)):
            assert got[("right", j)] == pytest.approx(np.nanmax(col), abs=1e-12)


def test_self_nearest_and_distribution(spark, data):
    bits_l, _, left, _ = data
    s, inter, union = _brute(bits_l, bits_l)
    np.fill_diagonal(s, np.nan)
    got = {r["id"]: r["best_sim"] for r in sim.nearest(left, None, 2, block_size=50).collect()}
    for k, i in enumerate(np.arange(300) * 7 + 1):
        if not np.all(np.isnan(s[k])):
            assert got[i] == pytest.approx(np.nanmax(s[k]), abs=1e-12)
    iu = np.triu_indices(300, 1)
    valid = union[iu] > 0
    want = {}
    for a, b in zip(inter[iu][valid], union[iu][valid]):
        want[(int(a), int(b))] = want.get((int(a), int(b)), 0) + 1
    dist = sim.similarity_distribution(left, None, 2, exclude="lower", block_size=50).collect()
    assert {(r["inter"], r["uni"]): r["n_pairs"] for r in dist} == want
    dist2 = sim.similarity_distribution(left, None, 2, exclude="self", block_size=50).collect()
    assert sum(r["n_pairs"] for r in dist2) == 2 * sum(want.values())


def test_topk_matches_brute_force(spark, data):
    bits_l, bits_r, left, right = data
    s, inter, _ = _brute(bits_l, bits_r)
    lids, rids = np.arange(300) * 7 + 1, np.arange(170) * 5 + 2
    keep = F.col("id") % 2 == 0
    q = left.withColumn("keep", keep)
    top = sim.topk_matches(q, right, 2, [4], keep_ident_col="keep", block_size=40).collect()
    got = {}
    for r in top:
        got.setdefault(r["query_id"], []).append((r["rank"], r["ref_id"]))
    pcl, pcr = bits_l.sum(1), bits_r.sum(1)
    for k, i in enumerate(lids):
        cand = []
        for j in range(170):
            if np.isnan(s[k, j]):
                continue
            ident = inter[k, j] == pcl[k] == pcr[j] and pcr[j] > 0
            if ident and i % 2 == 1:
                continue
            cand.append((-s[k, j], rids[j]))
        want = [rid for _, rid in sorted(cand)[:4]]
        assert [rid for _, rid in sorted(got.get(i, []))] == want


def test_tanimoto_symmetric_bounded(spark, data):
    bits_l, _, left, _ = data
    pairs = sim.tanimoto_join(left, None, 2, 0.3, block_size=70).collect()
    s, _, _ = _brute(bits_l, bits_l)
    ids = list(np.arange(300) * 7 + 1)
    want = {(ids[a], ids[b]) for a in range(300) for b in range(a + 1, 300)
            if not np.isnan(s[a, b]) and s[a, b] >= 0.3}
    assert {(r["left_id"], r["right_id"]) for r in pairs} == want
    assert all(0 <= r["sim"] <= 1 for r in pairs)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_consensus_partition_invariant(spark, n):
    m = C.measurements(spark, SF).repartition(n)
    from assaylake.operators.consensus import consensus
    out = consensus(m, C.LINEITEM_KEY, C.LINEITEM_ENDPOINTS, C.LINEITEM_ORDER,
                    keep=["l_orderkey"]).orderBy(*C.LINEITEM_KEY).collect()
    base = consensus(C.measurements(spark, SF), C.LINEITEM_KEY, C.LINEITEM_ENDPOINTS,
                     C.LINEITEM_ORDER, keep=["l_orderkey"]).orderBy(*C.LINEITEM_KEY).collect()
    assert [r["l_orderkey"] for r in out] == [r["l_orderkey"] for r in base]
    for a, b in zip(out, base):
        for c in ("l_quantity", "l_tax"):
            assert (a[c] is None) == (b[c] is None)
            if a[c] is not None:
                assert a[c] == pytest.approx(b[c], rel=1e-12)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_kfold_partition_invariant_and_disjoint(spark, n):
    df = spark.range(101).withColumnRenamed("id", "row_id").repartition(n)
    f = splits.assign_folds(df, ["row_id"], 5, 42).collect()
    base = {r["row_id"]: r["val_fold"] for r in
            splits.assign_folds(spark.range(101).withColumnRenamed("id", "row_id"), ["row_id"], 5, 42)
            .collect()}
    assert {r["row_id"]: r["val_fold"] for r in f} == base
    sizes = np.bincount(list(base.values()), minlength=5)
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == 101


def test_row_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(3).permutation(500)], "v bigint")
    rows = keys.row_index(df.repartition(7), ["v"], "i").collect()
    assert sorted((r["v"], r["i"]) for r in rows) == [(v, v) for v in range(500)]


def test_log_roundtrip(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 3.0, 1234.5, -0.5)], "x double")
    got = df.select("x", num.unlog10p1(num.log10p1("x")).alias("y")).collect()
    assert all(abs(r["x"] - r["y"]) < 1e-9 * max(1, abs(r["x"])) for r in got)


def test_r2_at_most_one_and_macro_is_mean(spark):
    df = C.evaluation_input(spark, SF)
    eps = (Endpoint("A"), Endpoint("N", log_encoded=False), Endpoint("R"))
    rows = {r["endpoint"]: r for r in metrics.evaluate(df, eps).collect()}
    per = [rows[e] for e in ("A", "N", "R")]
    assert all(r["r2"] <= 1 for r in per)
    assert rows["aggregated"]["r2"] == pytest.approx(np.mean([r["r2"] for r in per]))
    assert rows["aggregated"]["mean_absolute_error"] == pytest.approx(
        np.mean([r["mean_absolute_error"] for r in per]))


def test_required_key_check(spark):
    df = spark.createDataFrame([(0, "LogD", 1.0, 1.0)], "row_id bigint, endpoint string, ref double, pred double")
    with pytest.raises(Exception, match="required key not present: HLM"):
        metrics.evaluate(df, (Endpoint("LogD", False),), required=["LogD", "HLM"]).collect()
    with pytest.raises(Exception, match="required key not present: HLM"):
        metrics.evaluate(df, (Endpoint("LogD", False), Endpoint("HLM"))).collect()


def test_null_prediction_raises(spark):
    df = spark.createDataFrame([(0, "LogD", 1.0, None)], "row_id bigint, endpoint string, ref double, pred double")
    with pytest.raises(Exception, match="1 predictions are missing or not finite"):
        metrics.evaluate(df, (Endpoint("LogD", False),)).collect()


def test_scan_roundtrip_turns_nan_into_null(spark, tmp_path):
    from assaylake.sources import read_assay, write_assay
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5), (3, None)], "row_id bigint, x double")
    path = str(tmp_path / "t")
    write_assay(df, path)
    back = {r["row_id"]: r["x"] for r in read_assay(spark, path, "row_id bigint, x double").collect()}
    assert back == {1: None, 2: 1.5, 3: None}


def test_union_keeps_case_clashing_columns(spark):
    from assaylake.sources import union_assays
    a = spark.createDataFrame([("c1",)], "smiles string")
    b = spark.createDataFrame([("C2",)], "SMILES string")
    u = union_assays(a, b, tags=["train", "external"])
    assert set(u.columns) == {"smiles", "smiles_external", "split"}


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8])
def test_threshold_join_with_popcount_pruning(spark, threshold):
    rng = np.random.default_rng(7)
    dens_l = rng.uniform(0.02, 0.6, 220)[:, None]
    dens_r = rng.uniform(0.02, 0.6, 130)[:, None]
    bits_l = rng.random((220, 128)) < dens_l
    bits_r = rng.random((130, 128)) < dens_r
    bits_r[:5] = bits_l[:5]
    pack = lambda b: np.packbits(b.reshape(len(b), 2, 64)[:, :, ::-1], axis=2).view(">u8")[:, :, 0] \
        .astype(np.uint64).view(np.int64)
    left = _df(spark, np.arange(220), pack(bits_l), bits_l)
    right = _df(spark, np.arange(130) + 1000, pack(bits_r), bits_r)
    s, _, _ = _brute(bits_l, bits_r)
    want = {(int(a), int(b) + 1000) for a, b in zip(*np.nonzero(np.nan_to_num(s, nan=-1) >= threshold))}
    got = sim.tanimoto_join(left, right, 2, threshold, block_size=30).collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == want
