"""Matrix-product intersections, and pairs that are made where they are found."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from assaylake.operators import bit_products, prefix_join
from assaylake.operators import similarity as sim


def _packed(bits):
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8")


def _rows(seed, n, bits, copies=0):
    """Sets of all sizes, the empty and the whole one among them, and copies."""
    r = np.random.default_rng(seed)
    out = r.random((n, bits)) < r.uniform(0, 1, n)[:, None]
    out[0], out[1] = False, True
    return np.concatenate((out, out[r.integers(0, n, copies)]))


def _df(spark, bits, ids):
    rows = [(None if i is None else int(i), [int(x) for x in w.view(np.int64)], int(b.sum()))
            for i, w, b in zip(ids, _packed(bits), bits)]
    return spark.createDataFrame(rows, "id bigint, fp array<bigint>, n_bits_set int")


@pytest.mark.parametrize("words", [1, 3, 4, 16, 40])
def test_products_are_the_intersections(words):
    for n, m in ((1, 3), (50, 31), (130, 200)):
        a, b = _rows(n, max(n, 2), 64 * words)[:n], _rows(m + 1, m, 64 * words)
        a, b = (x[np.argsort(x.sum(1), kind="stable")] for x in (a, b))
        got = bit_products.intersections(*(bit_products.Sets(_packed(x), x.sum(1)) for x in (a, b)))
        assert (got == a.astype(int) @ b.astype(int).T).all()


def test_digits_do_not_run_over():
    """Half-full sets have more bits in common than a digit holds."""
    bits = np.zeros((6, 1024), bool)
    bits[:, :512] = True
    s = bit_products.Sets(_packed(bits), bits.sum(1))
    assert (bit_products.intersections(s, s) == 512).all() and len(bit_products._runs(s, s)) > 1


@pytest.mark.parametrize("threshold", [0.3, 0.5, 2 / 3, 0.8, 1.0])
def test_least_intersections_are_those_of_the_similarity(threshold):
    need = prefix_join._least(threshold, 256)
    for both in range(1, 513):
        inter = np.arange(0, both // 2 + 1)
        reached = inter[inter / (both - inter) >= threshold]
        assert (need[both] == reached[0]) if len(reached) else need[both] > both // 2


def _pairs_of(bits, ids, other, other_ids, threshold):
    """Pairs of rows by their ids, with how often each comes."""
    inter = bits.astype(int) @ other.astype(int).T
    union = bits.sum(1)[:, None] + other.sum(1)[None, :] - inter
    s = np.where(union > 0, inter / np.maximum(union, 1), 0)
    out = Counter()
    for i, j in zip(*np.nonzero(s >= threshold)):
        if ids is not other_ids:
            out[ids[i], other_ids[j]] += 1
        elif i < j and (s[i, j] < 1 or ids[i] != ids[j]):
            out[min(ids[i], ids[j]), max(ids[i], ids[j])] += 1
    return out


@pytest.mark.parametrize("density", [1, 0.06])
def test_rows_of_copies_and_repeated_ids_are_paired(spark, density):
    """Each row with each, copies and repeated ids included, for full and for sparse sets."""
    bits, other = _rows(1, 90, 128, 40), _rows(2, 60, 128, 20)
    r = np.random.default_rng(3)
    bits, other = (x & (r.random(x.shape) < density) for x in (bits, other))
    bits[100:110], other[:10] = bits[:10], bits[5:15]
    ids, other_ids = [int(k) for k in np.arange(130) // 2 + 7], list(range(80))
    for threshold in (0.4, 1.0):
        for right, right_ids in ((None, ids), (other, other_ids)):
            df = None if right is None else _df(spark, right, right_ids)
            got = sim.tanimoto_join(_df(spark, bits, ids), df, 2, threshold, block_size=20).collect()
            want = _pairs_of(bits, ids, bits if right is None else right, right_ids, threshold)
            assert Counter((r["left_id"], r["right_id"]) for r in got) == want


def test_rows_without_an_id_go_with_a_copy_that_has_one(spark):
    schema = "id bigint, fp array<bigint>, n_bits_set int"
    big = (1 << 53) + 1
    a = spark.createDataFrame([(None, [7], 3), (big, [7], 3), (None, [1], 1), (1, [3], 2)], schema)
    b = spark.createDataFrame([(8, [7], 3), (None, [3], 2)], schema)
    got = sim.tanimoto_join(a, b, 1, 0.6).collect()
    assert Counter((r["left_id"], r["right_id"]) for r in got) == Counter([(None, 8), (big, 8), (1, 8)])
    assert (1, big) in {tuple(r)[:2] for r in sim.tanimoto_join(a, None, 1, 0.6).collect()}


def test_pairs_of_rows_are_not_sent_on(spark):
    """Pairs are rows of the result where they are found: no join or exchange comes after."""
    df = _df(spark, _rows(4, 60, 128, 10), list(range(70)))
    plan = sim.tanimoto_join(df, None, 2, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    after = plan[:plan.index("MapInPandas")]
    assert "Join" not in after and "Repartition" not in after


def test_copies_leave_the_task_in_pieces(monkeypatch):
    """Pairs of rows of one or of two fingerprints with many copies, a piece at a time."""
    monkeypatch.setattr(prefix_join, "_PIECE", 1000)
    n = 300
    words = np.where(np.arange(2 * n) < n, (1 << 60) - 1, (1 << 50) - 1)
    one = pd.DataFrame({"__id": np.arange(2 * n), "__pc": np.where(np.arange(2 * n) < n, 60, 50), "__w0": words})
    fn = prefix_join._kernel(1, 0.5, True, 0, members=True)
    frames = list(fn((-1, 5, 0, 5, 0), iter([one.assign(__side=0), one.assign(__side=1)])))
    assert sum(map(len, frames)) == 2 * n * (2 * n - 1) // 2 and max(map(len, frames)) <= 1000
    pairs = pd.concat(frames)
    assert (pairs["left_id"] < pairs["right_id"]).all() and not pairs.duplicated(["left_id", "right_id"]).any()


def test_nearest_meets_only_windows_that_can_better_a_row(monkeypatch):
    """Windows of other popcounts are left out row by row, not by the worst row of a chunk."""
    monkeypatch.setattr(sim, "_WINDOW", 64)
    bits = _rows(5, 1200, 256)
    bits[600:] = bits[:600] ^ (np.arange(256) == 9)
    bits = bits[bits.sum(1) > 0]
    lonely = np.zeros((1, 256), bool)
    lonely[0, ::3] = True
    bits = np.concatenate((bits, lonely))
    words = _packed(bits).view(np.int64)
    pdf = pd.DataFrame({"__id": np.arange(len(bits)), "__pc": bits.sum(1), "__best": -1.0,
                        **{f"__w{j}": words[:, j] for j in range(4)}})
    cells, plain = [], bit_products.intersections
    monkeypatch.setattr(bit_products, "intersections", lambda a, b: (cells.append(len(a) * len(b)), plain(a, b))[1])
    out = sim.nearest_kernel(4, True)((0, 0), pdf, pdf).set_index("__id")["best"]
    inter = bits.astype(int) @ bits.astype(int).T
    s = inter / (bits.sum(1)[:, None] + bits.sum(1)[None, :] - inter)
    np.fill_diagonal(s, -1)
    assert np.allclose(out.sort_index(), s.max(axis=1)) and sum(cells) < 0.35 * len(bits) ** 2


def test_single_rows_are_counted_without_weights(monkeypatch):
    """Only pairs with a fingerprint of several rows are weighed."""
    bits = _rows(6, 400, 128)
    words = _packed(bits).view(np.int64)
    n = np.where(np.arange(400) < 10, 3, 1)
    pdf = pd.DataFrame({"__id": np.arange(400), "__pc": bits.sum(1), "__n": n, "__w0": words[:, 0], "__w1": words[:, 1]})
    weighed, plain = [], sim._summed
    monkeypatch.setattr(sim, "_summed", lambda code, *a: (weighed.append(code.size), plain(code, *a))[1])
    got = sim.distribution_kernel(2, None)((0, 1), pdf, pdf)
    assert got["n_pairs"].sum() == n.sum() ** 2 - n[bits.sum(1) == 0].sum() ** 2
    assert sum(weighed) <= 2 * 10 * 400
