"""Fingerprint index (nearest, top-k) and prefix join: brute force, pruning counts, copies."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.operators import fp_index, prefix_join
from assaylake.operators import similarity as sim


def _pack(bits):
    n, k = bits.shape
    return np.packbits(bits.reshape(n, k // 64, 64), axis=2, bitorder="little").view("<u8")[:, :, 0].astype(
        np.uint64).view(np.int64)


def _df(spark, bits, ids=None):
    packed = _pack(bits)
    ids = range(len(bits)) if ids is None else ids
    rows = [(int(i), [int(x) for x in packed[k]], int(bits[k].sum())) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id bigint, fp array<bigint>, n_bits_set int")


def _sims(a, b):
    inter = a.astype(np.int64) @ b.astype(np.int64).T
    union = a.sum(1)[:, None] + b.sum(1)[None, :] - inter
    return np.where(union > 0, inter / np.maximum(union, 1), np.nan)


def _mixed(seed, n, bits=128):
    """Sparse and full sets, copies, near copies and empty ones."""
    r = np.random.default_rng(seed)
    out = r.random((n, bits)) < r.uniform(0.01, 0.7, n)[:, None]
    out[: n // 8] = out[n // 8: n // 4][: n // 8]
    for k in range(n // 4, n // 2):
        out[k] = out[r.integers(0, n // 4)]
        out[k, r.integers(0, bits, 3)] ^= True
    out[-2:] = False
    return out


def _clustered(seed, n, bits=256, centres=12):
    r = np.random.default_rng(seed)
    middle = r.random((centres, bits)) < 0.25
    out = middle[r.integers(0, centres, n)].copy()
    flip = r.random((n, bits)) < 0.02
    return out ^ flip


# --- threshold join --------------------------------------------------------------

@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("cut", [None, 0, 10_000])
def test_class_pairs_equal_brute_force(spark, threshold, cut):
    """Whatever share of the sizes goes to lists (all, none, the cheapest), with one or two inputs."""
    bits, other = _mixed(1, 240), _mixed(2, 150)
    other[:9] = bits[5:14]
    for right in (None, other):
        a = _df(spark, bits)
        lc, _ = sim.classes(sim.prepare(a, "id", "fp", 2), 2)
        rc = None if right is None else sim.classes(sim.prepare(_df(spark, right), "id", "fp", 2), 2)[0]
        got = prefix_join.class_pairs(lc, rc, 2, threshold, block_size=30, cut=cut).collect()
        pairs = {(r["left_class"], r["right_class"]): r["sim"] for r in got}
        assert len(pairs) == len(got)  # each pair once
        s = _sims(bits, bits if right is None else right)
        ids = [[r["__id"] for r in c.collect()] for c in (lc, lc if right is None else rc)]
        want = {(i, j): s[i, j] for i in ids[0] for j in ids[1]
                if (right is not None or i < j) and not np.isnan(s[i, j]) and s[i, j] >= threshold}
        assert set(pairs) == set(want)
        assert all(pairs[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_sparse_sets_go_to_lists_and_full_ones_to_blocks(spark):
    r = np.random.default_rng(4)
    listed = []
    for density in (0.01, 0.6):
        c, _ = sim.classes(sim.prepare(_df(spark, r.random((3000, 1024)) < density), "id", "fp", 16), 16)
        rows = c.where("__pc > 0").drop("__n").withColumn("__side", F.lit(0))
        starts = sim.popcount_buckets(0.8, 1024)
        ranked = prefix_join._ranked(rows, 16, prefix_join._rarity(rows, 16), prefix_join.prefix_lengths(0.8, 1024), starts)
        cut = prefix_join._cheapest_cut(ranked, len(starts), 1024, True)
        listed.append(ranked.where(F.col("__b") < cut).count())
    assert listed[0] > 2800 and listed[1] == 0


def test_postings_do_not_grow_with_the_blocks(spark):
    """A row is sent once for each rare bit of its prefix, not once for each block of the other rows."""
    r = np.random.default_rng(5)
    sent = []
    for n in (1500, 6000):
        c, _ = sim.classes(sim.prepare(_df(spark, r.random((n, 1024)) < 0.01), "id", "fp", 16), 16)
        rows = c.where("__pc > 0").drop("__n").withColumn("__side", F.lit(0))
        starts = sim.popcount_buckets(0.8, 1024)
        ranked = prefix_join._ranked(rows, 16, prefix_join._rarity(rows, 16), prefix_join.prefix_lengths(0.8, 1024), starts)
        posts = prefix_join._posted(ranked, len(starts))
        subs = prefix_join._sub_blocks(posts, 500)
        sent.append(prefix_join._sent(posts, subs, subs, "__l", "__r").count() / n)
    assert sent[1] < 1.5 * sent[0]


def test_many_copies_give_no_pair_list(spark):
    n = 100_000
    same = spark.range(n).selectExpr("id", "array(7L, 0L) AS fp", "3 AS n_bits_set")
    more = spark.createDataFrame([(n, [15, 0], 4), (n + 1, [15, 0], 4), (n + 2, [0, 1], 1), (n + 3, [0, 0], 0),
                                  (n + 4, [0, 0], 0)], "id bigint, fp array<bigint>, n_bits_set int")
    rows, pairs = prefix_join.tanimoto_links(same.unionByName(more), 2, 0.5)
    assert [tuple(p) for p in pairs.collect()] == [(0, n, 0.75)]
    counted = {tuple(r)[:3]: r["count"] for r in rows.groupBy("class_id", "n_copies", "n_links").count().collect()}
    assert counted == {(0, n - 1, n + 1): n, (n, 1, n + 1): 2, (n + 2, 0, 0): 1, (n + 3, 0, 0): 2}


def test_links_of_text_ids(spark):
    rows = [("a", [7], 3), ("b", [3], 2), ("c", [3], 2), ("d", [8], 1)]
    df = spark.createDataFrame(rows, "id string, fp array<long>, n_bits_set int")
    links, pairs = prefix_join.tanimoto_links(df, 1, 0.6)
    assert {tuple(r) for r in links.collect()} == {("a", "a", 0, 2), ("b", "b", 1, 2), ("c", "b", 1, 2), ("d", "d", 0, 0)}
    assert [tuple(p)[:2] for p in pairs.collect()] == [("a", "b")]


# --- nearest and top-k -------------------------------------------------------------

@pytest.mark.parametrize("make", [_mixed, _clustered])
def test_nearest_equals_brute_force(spark, make):
    bits, other = make(1, 700), make(2, 300)
    words = bits.shape[1] // 64
    other[:5] = bits[:5]
    s = _sims(bits, bits)
    np.fill_diagonal(s, np.nan)
    got = {r["id"]: r["best_sim"] for r in sim.nearest(_df(spark, bits), None, words, block_size=40).collect()}
    assert set(got) == set(np.flatnonzero(~np.isnan(s).all(axis=1)).tolist())
    assert all(v == pytest.approx(np.nanmax(s[k]), abs=1e-12) for k, v in got.items())
    both = sim.nearest(_df(spark, bits), _df(spark, other), words, block_size=40).collect()
    s = _sims(bits, other)
    for side, own in (("left", s), ("right", s.T)):
        got = {r["id"]: r["best_sim"] for r in both if r["side"] == side}
        assert set(got) == set(np.flatnonzero(~np.isnan(own).all(axis=1)).tolist())
        assert all(v == pytest.approx(np.nanmax(own[k]), abs=1e-12) for k, v in got.items())


def test_nearest_divides_once_for_a_size(monkeypatch):
    """Ratios are made for the best of the right rows with as many bits; own rows are left out, repeated ids too."""
    bits = _mixed(21, 600)
    words, ids = _pack(bits), np.arange(600) // 2
    rows = pd.DataFrame({"__id": ids, "__pc": bits.sum(1), "__best": -1.0, "__w0": words[:, 0], "__w1": words[:, 1]})
    cells, plain = [], sim._sims
    monkeypatch.setattr(sim, "_sims", lambda inter, *a: (cells.append(inter.size), plain(inter, *a))[1])
    out = sim.nearest_kernel(2, True)((0, 0), rows, rows)
    s = _sims(bits, bits)
    s[ids[:, None] == ids[None, :]] = np.nan
    best = pd.Series(np.nan_to_num(s, nan=-1.0).max(axis=1), index=bits.sum(1))
    assert sorted(out["best"]) == pytest.approx(sorted(best[best >= 0]))
    assert sum(cells) < 600 * 600 / 2, sum(cells)


def test_index_discards_blocks_of_clustered_rows(spark):
    bits = _clustered(3, 6000, centres=8)
    report = {}
    got = {r["id"]: r["best_sim"] for r in sim.nearest(_df(spark, bits), None, 4, block_size=128, report=report).collect()}
    s = _sims(bits, bits)
    np.fill_diagonal(s, np.nan)
    assert all(v == pytest.approx(np.nanmax(s[k]), abs=1e-12) for k, v in got.items()) and len(got) == len(bits)
    assert report["row_visits"] < 0.6 * report["row_block_pairs"], report
    assert report["partial_rows"] < 0.4 * report["row_block_pairs"], report


def test_topk_visits_and_emits_less(spark):
    bits, refs = _clustered(5, 1500, centres=8), _clustered(5, 6000, centres=8)
    r = np.random.default_rng(6)
    mask = r.choice([1, 2, 3], len(refs))
    ref_df = _df(spark, refs).join(spark.createDataFrame([(i, int(m)) for i, m in enumerate(mask)], "id long, m long"), "id")
    report, ks = {}, [3, 5]
    q = _df(spark, bits).withColumn("keep", F.col("id") % 3 != 0)
    got = {}
    for x in sim.topk_matches(q, ref_df, 4, ks, pmask_col="m", keep_ident_col="keep", block_size=128,
                              report=report).collect():
        got.setdefault((x["query_id"], x["prop"]), []).append((x["rank"], x["ref_id"]))
    s = _sims(bits, refs)
    for i in range(len(bits)):
        for p, k in enumerate(ks):
            cand = [j for j in np.flatnonzero(mask >> p & 1) if i % 3 or s[i, j] < 1]
            want = sorted(cand, key=lambda j: (-s[i, j], j))[:k]
            assert [j for _, j in sorted(got[i, p])] == want, (i, p)
    assert report["row_visits"] < 0.7 * report["row_block_pairs"], report
    assert report["partial_rows"] < 0.5 * sum(ks) * report["row_block_pairs"], report


def test_topk_compares_copies_once(spark):
    """Copies among queries and references cost nothing, and the smaller ids stand first among them."""
    few, other = _mixed(11, 40), _mixed(12, 30)
    r = np.random.default_rng(13)
    bits, refs = few[r.integers(0, 40, 1200)], np.concatenate((other, few[:9]))[r.integers(0, 39, 900)]
    mask, keep = r.choice([1, 3], len(refs)), r.random(len(bits)) < 0.5
    q = _df(spark, bits).join(spark.createDataFrame([(i, bool(k)) for i, k in enumerate(keep)], "id long, keep boolean"), "id")
    ref_df = _df(spark, refs).join(spark.createDataFrame([(i, int(m)) for i, m in enumerate(mask)], "id long, m long"), "id")
    report, ks, got = {}, [3, 2], {}
    for x in sim.topk_matches(q, ref_df, 2, ks, pmask_col="m", keep_ident_col="keep", block_size=64,
                              report=report).collect():
        got.setdefault((x["query_id"], x["prop"]), []).append((x["rank"], x["ref_id"]))
    s = _sims(bits, refs)
    for i in range(len(bits)):
        for p, k in enumerate(ks):
            cand = [j for j in np.flatnonzero(mask >> p & 1) if not np.isnan(s[i, j]) and (keep[i] or s[i, j] < 1)]
            assert [j for _, j in sorted(got.get((i, p), []))] == sorted(cand, key=lambda j: (-s[i, j], j))[:k], (i, p)
    assert report["row_block_pairs"] <= 2 * 40 * 3 and report["partial_rows"] <= 2 * 40 * 2 * sum(ks), report


def test_topk_of_repeated_ids_and_own_rows(spark):
    """A repeated id shares its ranks among its rows; without references a query never meets its own rows."""
    bits = _mixed(14, 60)
    ids = [0, 0, 1, 1, *range(4, 60)]
    bits[1] = bits[0]
    got = {}
    for x in sim.topk_matches(_df(spark, bits, ids), None, 2, [3], block_size=16).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["ref_id"], x["sim"]))
    s = _sims(bits, bits)
    for i in set(ids):
        cand = [(-s[a, b], ids[b]) for a in range(60) if ids[a] == i for b in range(60)
                if ids[b] != i and not np.isnan(s[a, b])]
        want = [(n, j, pytest.approx(-v)) for n, (v, j) in enumerate(sorted(cand)[:3], 1)]
        assert sorted(got.get(i, [])) == want, i


def test_topk_without_references_or_properties(spark):
    q, refs = _df(spark, _mixed(1, 40)), _df(spark, _mixed(2, 30))
    none = refs.where("false").withColumn("m", F.lit(1))
    assert sim.topk_matches(q, none, 2, [2], pmask_col="m").collect() == []
    unasked = refs.withColumn("m", F.lit(0))
    assert sim.topk_matches(q, unasked, 2, [2], pmask_col="m").collect() == []
    few = sim.topk_matches(q, refs.where("id < 2"), 2, [5]).groupBy("query_id").count().collect()
    assert few and all(r["count"] <= 2 for r in few)


def test_more_masks_than_groups(spark, monkeypatch):
    monkeypatch.setattr(fp_index, "MAX_GROUPS", 2)
    bits, refs = _mixed(1, 60), _mixed(2, 80)
    df = _df(spark, refs).withColumn("m", F.col("id") % 7 + 1)
    got = {}
    for x in sim.topk_matches(_df(spark, bits), df, 2, [2, 3, 1], pmask_col="m", block_size=16).collect():
        got.setdefault((x["query_id"], x["prop"]), []).append((x["rank"], x["ref_id"]))
    s = _sims(bits, refs)
    for i in range(len(bits)):
        for p, k in enumerate((2, 3, 1)):
            cand = [j for j in range(len(refs)) if (j % 7 + 1) >> p & 1 and not np.isnan(s[i, j])]
            assert [j for _, j in sorted(got.get((i, p), []))] == sorted(cand, key=lambda j: (-s[i, j], j))[:k]


def test_visits_never_miss(spark):
    """Every row at least as similar as asked for lies in a block to be visited."""
    bits = np.vstack([_mixed(7, 400), _mixed(8, 300)])
    w, pc = _pack(bits).view(np.uint64), bits.sum(1).astype(np.int64)
    index = fp_index.FpIndex(2, fp_index._farthest_first(w, 8), fp_index._quantile_buckets(
        dict(zip(*np.unique(pc, return_counts=True))), 128), 1, np.zeros(1, np.int64), 25)
    cell = index.cells(w, pc, np.zeros(len(w), np.int64))
    index.starts = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=8 * fp_index.BUCKETS * fp_index.LEVELS))))
    place = np.empty(len(w), np.int64)
    place[np.argsort(cell, kind="stable")] = np.arange(len(w))
    s = np.nan_to_num(_sims(bits, bits))
    for beat in (0.2, 0.5, 0.9, 1.0):
        row, block = index.visits(w, pc, np.full((len(w), 1), beat))
        seen = set(zip(row.tolist(), block.tolist()))
        i, j = np.nonzero(s >= beat)
        assert all((a, b) in seen for a, b in zip(i.tolist(), (place[j] // 25).tolist()))


def test_distribution_weighs_copies(spark):
    bits = np.vstack([_mixed(11, 60)] * 3)
    s_inter = bits.astype(np.int64) @ bits.astype(np.int64).T
    s_union = bits.sum(1)[:, None] + bits.sum(1)[None, :] - s_inter
    for exclude, pairs in (("lower", np.triu_indices(len(bits), 1)), ("self", np.nonzero(~np.eye(len(bits), dtype=bool)))):
        want = {}
        for a, b in zip(s_inter[pairs].tolist(), s_union[pairs].tolist()):
            if b:
                want[a, b] = want.get((a, b), 0) + 1
        got = sim.similarity_distribution(_df(spark, bits), None, 2, exclude=exclude, block_size=16).collect()
        assert {(r["inter"], r["uni"]): r["n_pairs"] for r in got} == want


def test_sums_beyond_doubles_are_exact():
    code, weight = np.array([0, 1, 0]), np.array([(1 << 53) + 1, 5, 2])
    assert sim._summed(code, weight, 2).tolist() == [(1 << 53) + 3, 5]


def test_pairs_leave_the_task_in_pieces():
    """However many pairs two blocks have, a task holds one piece of them."""
    n = 5000
    pdf = pd.DataFrame({"__id": np.arange(2 * n), "__pc": 60, "__w0": (1 << 60) - 1, "__side": np.arange(2 * n) % 2})
    fn = prefix_join._kernel(1, 0.5, False, 0)
    frames = list(fn((-1, 5, 0, 5, 0), iter([pdf[:n], pdf[n:]])))
    assert sum(map(len, frames)) == n * n
    assert max(map(len, frames)) <= prefix_join._ROWS * sim._SUB
    counted = prefix_join._kernel(1, 0.5, False, 0, counted=True)
    links, = counted((-1, 5, 0, 5, 0), iter([pdf.assign(__rows=2)]))
    assert len(links) == 2 * n and (links["__links"] == 2 * n).all()


def test_distribution_of_wide_and_weighted_rows():
    """Counts by (intersection, union) are those of all pairs, for narrow and wide fingerprints alike."""
    rng = np.random.default_rng(5)
    for words in (1, 16, 40):
        bits = rng.random((2, 50, 64 * words)) < rng.random((2, 50, 1))
        bits[:, 0] = False
        n = rng.integers(1, 4, (2, 50))
        frames = []
        for k in range(2):
            w = np.ascontiguousarray(np.packbits(bits[k], axis=1, bitorder="little")).view("<i8")
            frames.append(pd.DataFrame({"__id": np.arange(50), "__pc": bits[k].sum(axis=1), "__n": n[k],
                                        **{f"__w{j}": w[:, j] for j in range(words)}}))
        want = Counter()
        for i in range(50):
            for j in range(50):
                if union := int((bits[0, i] | bits[1, j]).sum()):
                    want[int((bits[0, i] & bits[1, j]).sum()), union] += int(n[0, i] * n[1, j])
        got = sim.distribution_kernel(words, None)((0, 0), *frames)
        assert {(r.inter, r.uni): r.n_pairs for r in got.itertuples()} == want
