"""Tanimoto similarity over packed fingerprints, without a cross join.

Tanimoto(a, b) = |a & b| / (|a| + |b| - |a & b|); empty-vs-empty is NULL
(never a match). Both inputs are ``(id, fp array<bigint>, n_bits_set)``.

Execution. Rows are hashed into blocks of at most ``block_size`` rows. A
block of the left side meets every block of the right side (for a self join
only the block pairs ``a <= b``) in one ``cogroup(...).applyInPandas`` task,
keyed by the block pair: each row is shipped once per block it has to meet,
which is the communication an all-pairs comparison needs. Inside a task a
small NumPy kernel intersects the rows in tiles
(:mod:`assaylake.operators.bit_products`) and **reduces immediately** -- per-row maxima, exact top-k, or counts per
distinct ``(intersection, union)`` -- so no pair is ever emitted as a row and
no task holds more than two bounded blocks. Spark then merges the partial
results with ordinary aggregates and windows.

Prepared fingerprints are checkpointed (``spark.checkpoint.dir``): they are
read once per block pair and survive executor loss.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.operators import bit_products, fp_index, udf
from assaylake.operators.keys import qcol, row_index
from assaylake.session import cut_lineage, ensure_importable

DEFAULT_BLOCK = 4096
_CHUNK = 256
_SUB = 4096         # right rows compared with a chunk at a time
_WINDOW = 2048      # right rows of similar popcount that are bounded together
_TILE = 384         # left rows multiplied with a window at a time
DISTRIBUTION_BLOCK = 16 * DEFAULT_BLOCK  # rows of a block where only counts leave the task
_SLICE = 16         # left rows whose codes are made at a time
_DENSE = 1 << 22    # cells of (intersection, sizes) counted in one array
_SIM_BITS = 40      # sim -> floor(sim * 2^40): distinct ratios stay distinct
_POS_BITS = 20      # position inside a right block (block_size <= 2^20)


def prepare(df: DataFrame, id_col: str, fp_col: str, n_words: int,
            extra: Sequence[str] = ()) -> DataFrame:
    """``(__id, __pc, __w0.., extra)`` for rows with a fingerprint, checkpointed."""
    ensure_importable(df.sparkSession)  # the kernels run in Python workers
    words = [F.col(fp_col).getItem(j).alias(f"__w{j}") for j in range(n_words)]
    pc = sum((F.bit_count(F.col(fp_col).getItem(j)) for j in range(n_words)), F.lit(0))
    out = df.where(F.col(fp_col).isNotNull()).select(
        qcol(id_col).cast("bigint").alias("__id"), pc.cast("bigint").alias("__pc"),
        *words, *[qcol(c) for c in extra])
    return cut_lineage(out)


def _numbered(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with integer ids, and the table ``(__sid, id)`` that undoes it.

    Integer ids are used as they are (None); others get their positions in
    order, so ties are broken as they would be on the ids themselves.
    """
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        return df, None
    ids = row_index(df.select(qcol(id_col)).where(qcol(id_col).isNotNull()).distinct(), [id_col], "__sid")
    return (df.join(ids, id_col).drop(id_col).withColumnRenamed("__sid", id_col),
            ids.select("__sid", qcol(id_col).alias("__text_id")))


def _named(out: DataFrame, ids: DataFrame | None, col: str) -> DataFrame:
    """``out`` with the integer ids of ``col`` turned back into the table's own."""
    if ids is None:
        return out
    back = out.join(ids, qcol(col) == F.col("__sid"))
    return back.select(*[(F.col("__text_id") if c == col else qcol(c)).alias(c) for c in out.columns])


def _n_blocks(n: int, block_size: int) -> int:
    return max(1, math.ceil(n / block_size))


def _plan(left: DataFrame, right: DataFrame | None, block_size: int, min_tasks: int):
    nl = left.count()
    nr = nl if right is None else right.count()
    bl, br = _n_blocks(nl, block_size), _n_blocks(nr, block_size)
    # Enough block pairs to keep every core busy, without tiny blocks.
    while bl * br < min_tasks and (nl / bl > 256 or nr / br > 256):
        if nl / bl >= nr / br:
            bl += 1
        else:
            br += 1
    if right is None:
        bl = br = max(bl, br)
    return bl, br


def _cogrouped(left: DataFrame, right: DataFrame | None, bl: int, br: int):
    blk = lambda n: F.pmod(F.xxhash64("__id"), F.lit(n)).cast("int")
    if right is None:
        lt = left.withColumn("__lb", blk(bl))
        lside = lt.withColumn("__rb", F.explode(F.sequence("__lb", F.lit(bl - 1))))
        # Fresh attribute ids for the right side: a cogroup of two plans with
        # the same ids would resolve the right side's columns wrongly.
        rt = lt.select(*[F.col(c).alias("__rb" if c == "__lb" else c) for c in lt.columns])
        rside = rt.withColumn("__lb", F.explode(F.sequence(F.lit(0), F.col("__rb"))))
    else:
        lside = (left.withColumn("__lb", blk(bl))
                 .withColumn("__rb", F.explode(F.sequence(F.lit(0), F.lit(br - 1)))))
        rside = (right.withColumn("__rb", blk(br))
                 .withColumn("__lb", F.explode(F.sequence(F.lit(0), F.lit(bl - 1)))))
    # A task's time is in its pairs, not its bytes: partitions are counted, not sized.
    tasks = udf.n_tasks(left.sparkSession, bl * br)
    lside, rside = (d.repartition(tasks, "__lb", "__rb") for d in (lside, rside))
    return lside.groupBy("__lb", "__rb").cogroup(rside.groupBy("__lb", "__rb"))


def _min_tasks(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


# --- NumPy kernel ------------------------------------------------------------

def _arrays(pdf: pd.DataFrame, n_words: int):
    pdf = pdf.sort_values("__id", kind="stable")
    ids = pdf["__id"].to_numpy(np.int64)
    pc = pdf["__pc"].to_numpy(np.int64)
    w = np.ascontiguousarray(
        np.stack([pdf[f"__w{j}"].to_numpy(np.int64) for j in range(n_words)], axis=1)
    ).view(np.uint64)
    return pdf, ids, pc, w


def _sims(inter, pcl, pcr):
    union = pcl[:, None] + pcr[None, :] - inter
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = np.where(union > 0, inter / np.maximum(union, 1), np.nan)
    return union, sim


def _windows(pcr: np.ndarray) -> list[np.ndarray]:
    """Columns of a right block in windows of similar popcount."""
    order = np.argsort(pcr, kind="stable")
    return [order[a:a + _SUB] for a in range(0, len(order), _SUB)]


def _bounds(pcl: np.ndarray, pcr: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """Upper bound of the similarities of a left chunk (sorted by popcount) to each window:
    Tanimoto(a, b) <= min(|a|, |b|) / max(|a|, |b|)."""
    lo = np.array([pcr[w[0]] for w in windows], float)
    hi = np.array([pcr[w[-1]] for w in windows], float)
    a, z = float(pcl[0]), float(pcl[-1])
    return np.where(hi < a, hi / max(a, 1.0), np.where(lo > z, z / np.maximum(lo, 1.0), 1.0))


def _by_popcount(ids, pc, w):
    order = np.argsort(pc, kind="stable")
    return order, ids[order], pc[order], w[order]


def nearest_kernel(n_words: int, self_join: bool):
    """``(__id, best)`` of the left rows that find a better match here than their ``__best``
    (below 0: none yet). Each row meets the window of its own popcount, then those whose
    popcounts leave room for a better match: Tanimoto(a, b) <= min(|a|, |b|) / max(|a|, |b|)."""
    def fn(key, lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({"__id": np.array([], np.int64), "best": np.array([], float)})
        lp, idl, pcl, wl = _arrays(lp, n_words)
        _, idr, pcr, wr = _arrays(rp, n_words)
        order, idl, pcl, wl = _by_popcount(idl, pcl, wl)
        _, idr, pcr, wr = _by_popcount(idr, pcr, wr)
        before = lp["__best"].to_numpy(float)[order]
        best = before.copy()
        own = np.isin(idr, idl) if self_join else None
        starts = np.arange(0, len(idr), _WINDOW)
        lo, hi = pcr[starts], pcr[np.minimum(starts + _WINDOW, len(idr)) - 1]
        a = pcl[:, None]
        bound = np.where(hi < a, hi / np.maximum(a, 1), np.where(lo > a, a / np.maximum(lo, 1), 1.0))
        first = bound.argmax(axis=1)

        def compare(c: int, which: np.ndarray) -> None:
            cols = slice(starts[c], min(starts[c] + _WINDOW, len(idr)))
            size = np.flatnonzero(np.diff(pcr[cols], prepend=-1))  # first column of each popcount
            right = bit_products.Sets(wr[cols], pcr[cols])
            mine = cols.start + np.flatnonzero(own[cols]) if self_join else np.zeros(0, np.int64)
            for s in range(0, len(which), _TILE):
                rows = which[s:s + _TILE]
                inter = bit_products.intersections(bit_products.Sets(wl[rows], pcl[rows]), right)
                if mine.size:
                    at = mine - cols.start
                    inter[:, at] = np.where(idl[rows, None] == idr[None, mine], -1, inter[:, at])
                # Among right rows with as many bits the largest intersection is the best.
                top = np.maximum.reduceat(inter, size, axis=1)
                _, sim = _sims(top, pcl[rows], pcr[cols][size])
                sim[top < 0] = np.nan
                best[rows] = np.maximum(best[rows], np.nan_to_num(sim, nan=-1.0).max(axis=1))

        for nearest_first in (True, False):
            for c in range(len(starts)):
                which = np.flatnonzero((bound[:, c] > best) & ((first == c) == nearest_first))
                if len(which):
                    compare(c, which)
        better = best > before
        return pd.DataFrame({"__id": idl[better], "best": best[better]})
    return fn


def _summed(code: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Exact int64 sums of ``weight`` by ``code``."""
    if not len(code) or float(weight.max()) * len(code) < float(1 << 53):
        return np.bincount(code, weights=weight, minlength=size).astype(np.int64)
    out = np.zeros(max(size, int(code.max()) + 1), np.int64)
    np.add.at(out, code, weight)
    return out


def distribution_kernel(n_words: int, exclude: str | None):
    """Pairs of rows by (intersection, union); a distinct fingerprint stands for its ``__n`` rows.

    Rows come by popcount, so the pairs compared at a time have few distinct
    ``(intersection, sum of sizes)``: these are counted as small numbers.
    """
    bits = 64 * n_words
    width = 2 * bits + 1                     # sum of sizes <= 2L, intersection <= L
    dense = (bits + 1) * width <= _DENSE

    def fn(key, lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"inter": np.array([], np.int64), "uni": np.array([], np.int64),
                              "n_pairs": np.array([], np.int64)})
        if lp.empty or rp.empty:
            return empty
        diagonal = exclude is not None and key[0] == key[1]
        acc = np.zeros((bits + 1, width), np.int64) if dense else None
        keys, counts = [], []

        def count(left, right) -> None:
            (nl, idl, pcl, wl), (nr, idr, pcr, wr) = left, right
            for t in range(0, len(idr), _SUB):
                cols = slice(t, min(len(idr), t + _SUB))
                window = bit_products.Sets(wr[cols], pcr[cols])
                for s in range(0, len(idl), _TILE):
                    rows = slice(s, min(len(idl), s + _TILE))
                    inter = bit_products.intersections(bit_products.Sets(wl[rows], pcl[rows]), window)
                    least = pcl[rows][0] + pcr[cols][0]
                    span = int(pcl[rows][-1] + pcr[cols][-1] - least + 1)
                    code = np.empty(inter.shape, np.int64)
                    for a in range(0, len(code), _SLICE):  # what is held then stays in the cache
                        part, pc = code[a:a + _SLICE], pcl[rows][a:a + _SLICE]
                        np.multiply(inter[a:a + _SLICE], np.int64(span), out=part)
                        part += (pc - least)[:, None]
                        part += pcr[cols]
                    weight = None if nl is None and nr is None else np.broadcast_to(
                        (1 if nl is None else nl[rows, None]) * (1 if nr is None else nr[None, cols]), code.shape)
                    if diagonal:
                        own = idl[rows, None] < idr[None, cols]
                        code, weight = code[own], None if weight is None else weight[own]
                    cell = np.bincount(code.ravel()) if weight is None else _summed(code.ravel(), weight.ravel(), 0)
                    if dense:
                        cell = np.append(cell, np.zeros(-len(cell) % span, np.int64)).reshape(-1, span)
                        acc[:len(cell), least:least + span] += cell
                    else:
                        u = np.flatnonzero(cell)
                        keys.append(u // span * width + u % span + least)
                        counts.append(cell[u])

        # Most rows stand for themselves alone: their pairs need no weights.
        for left in _weighted(lp, n_words):
            for right in _weighted(rp, n_words):
                count(left, right)
        if dense:
            u = np.flatnonzero(acc)
            c = acc.ravel()[u]
        else:
            u, inv = np.unique(np.concatenate(keys), return_inverse=True)
            c = _summed(inv, np.concatenate(counts), len(u))
        u, c = u[u > 0], c[u > 0]  # two empty sets have no similarity
        if exclude == "self":
            c = c * 2  # ordered pairs (i, j) and (j, i)
        return pd.DataFrame({"inter": u // width, "uni": u % width - u // width, "n_pairs": c})
    return fn


def _weighted(pdf: pd.DataFrame, n_words: int):
    """Rows of each distinct fingerprint (None: one of each), ids, popcounts and words, by
    popcount; first the fingerprints of single rows, then the others."""
    pdf, ids, pc, w = _arrays(pdf, n_words)
    order, ids, pc, w = _by_popcount(ids, pc, w)
    n = pdf["__n"].to_numpy(np.int64)[order]
    for some, single in ((n == 1, True), (n != 1, False)):
        if some.any():
            yield None if single else n[some], ids[some], pc[some], w[some]


def topk_kernel(n_words: int, ks: Sequence[int]):
    """Per left row and property p: the ks[p] best right rows with bit p of ``__pmask``
    that are at least as similar as the row's ``__floor{p}`` (below 0: any).

    Order: similarity descending, right id ascending (exact: the similarity
    is turned into an integer that keeps distinct ratios distinct, joined
    with the row's position in the id-sorted block). The right block is taken
    in windows of similar popcount, the likeliest first, until the popcount
    bound shows that no other window can change a result. A left row with
    ``__keep_ident`` false skips right rows with an identical fingerprint.
    """
    ks = list(ks)

    def fn(key, lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        cols_out = {"__qid": np.array([], np.int64), "__prop": np.array([], np.int32),
                    "__rid": np.array([], np.int64), "sim": np.array([], float)}
        if lp.empty or rp.empty:
            return pd.DataFrame(cols_out)
        lp, idl, pcl, wl = _arrays(lp, n_words)
        rp, idr, pcr, wr = _arrays(rp, n_words)
        order, idl, pcl, wl = _by_popcount(idl, pcl, wl)
        keep_ident = lp["__keep_ident"].to_numpy(bool)[order]
        pmask = rp["__pmask"].to_numpy(np.int64)
        has = [((pmask >> p) & 1) == 1 for p in range(len(ks))]
        asked = [p for p in range(len(ks)) if has[p].any()]
        floor = {p: np.floor(lp[f"__floor{p}"].to_numpy(float)[order] * float(1 << _SIM_BITS)).astype(np.int64)
                 for p in asked}
        last = (1 << _POS_BITS) - 1
        pos_key = last - np.arange(len(idr), dtype=np.int64)  # smaller ids first among equals
        windows = _windows(pcr)
        out_q, out_p, out_r, out_s = [], [], [], []
        for s in range(0, len(idl), _CHUNK):
            rows = slice(s, min(len(idl), s + _CHUNK))
            best = {p: np.full((rows.stop - s, ks[p]), -1, np.int64) for p in asked}
            bound = _bounds(pcl[rows], pcr, windows)
            for c in np.argsort(-bound, kind="stable"):
                # Windows come by falling bound: stop when no k-th best can be reached or tied any more.
                top = int(bound[c] * (1 << _SIM_BITS))
                if all(top < np.maximum(best[p].min(axis=1) >> _POS_BITS, floor[p][rows]).min() for p in asked):
                    break
                cols = windows[c]
                inter = bit_products.counted(wl[rows], wr[cols])
                union, sim = _sims(inter, pcl[rows], pcr[cols])
                valid = union > 0
                ident = (inter == pcl[rows, None]) & (inter == pcr[None, cols]) & (pcr[None, cols] > 0)
                valid &= ~(ident & ~keep_ident[rows, None])
                simkey = np.floor(np.nan_to_num(sim) * float(1 << _SIM_BITS)).astype(np.int64)
                comp_all = np.where(valid, (simkey << _POS_BITS) | pos_key[None, cols], -1)
                for p in asked:
                    mine = has[p][cols]  # the references that have this property
                    if not mine.any():
                        continue
                    comp = comp_all if mine.all() else comp_all[:, mine]
                    both = np.concatenate((best[p], comp), axis=1)
                    best[p] = np.partition(both, both.shape[1] - ks[p], axis=1)[:, both.shape[1] - ks[p]:]
            for p in asked:
                who, slot = np.nonzero((best[p] >= 0) & (best[p] >> _POS_BITS >= floor[p][rows, None]))
                j = last - (best[p][who, slot] & last)
                inter = np.bitwise_count(wl[s + who] & wr[j]).sum(axis=1, dtype=np.int64)
                out_q.append(idl[s + who])
                out_p.append(np.full(len(who), p, np.int32))
                out_r.append(idr[j])
                out_s.append(inter / (pcl[s + who] + pcr[j] - inter))
        if not out_q:
            return pd.DataFrame(cols_out)
        return pd.DataFrame({"__qid": np.concatenate(out_q), "__prop": np.concatenate(out_p),
                             "__rid": np.concatenate(out_r), "sim": np.concatenate(out_s)})
    return fn


# --- operators ---------------------------------------------------------------

def classes(prepared: DataFrame, n_words: int) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints of prepared rows and who has them.

    ``(__id, __n, __pc, __w0..)``: one row for each distinct fingerprint, named
    by its smallest id, with its number of rows (written once); and the
    membership ``(__id, __class, __n, __pc)`` of all rows. Equal fingerprints
    are found by an aggregate with a map-side step and joined back on the
    words, so a group of any size is never in one task.
    """
    words = [f"__w{j}" for j in range(n_words)]
    distinct = cut_lineage(prepared.groupBy(*words).agg(
        F.min("__id").alias("__id"), F.count(F.lit(1)).alias("__n"), F.first("__pc").alias("__pc")))
    own = distinct.select(*words, F.col("__id").alias("__class"), "__n")
    return distinct, prepared.join(own, words).select("__id", "__class", "__n", "__pc")


def _query_classes(prepared: DataFrame, n_words: int) -> tuple[DataFrame, DataFrame]:
    """Distinct ``(fingerprint, __keep_ident)`` of prepared queries and who has them.

    ``(__id, __pc, __w0.., __keep_ident)``, numbered anew (ids may repeat with
    other fingerprints), and the membership ``(__qid, __class)`` of all rows.
    """
    same = [*[f"__w{j}" for j in range(n_words)], "__keep_ident"]
    distinct = cut_lineage(prepared.groupBy(*same).agg(F.first("__pc").alias("__pc"))
                           .withColumn("__id", F.monotonically_increasing_id()))
    own = distinct.select(*same, F.col("__id").alias("__class"))
    return distinct, prepared.join(own, same).select(F.col("__id").alias("__qid"), "__class")


def _first_references(prepared: DataFrame, n_words: int, k: int) -> DataFrame:
    """The ``k`` smallest ids of each ``(fingerprint, __pmask)``: as ties go to the smaller
    id, no other row of these can be among a query's ``k`` best."""
    same = [*[f"__w{j}" for j in range(n_words)], "__pmask"]
    w = Window.partitionBy(*same).orderBy("__id")
    return cut_lineage(prepared.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= k).drop("__nth"))


def _two_rounds(queries: DataFrame, refs: DataFrame, n_words: int, block_size: int, n_groups: int, kernel,
                schema: str, settle, report: dict | None, wide: int = 1) -> tuple[DataFrame, DataFrame]:
    """Each query against the block it would stand in, then against those that can still better what it has.

    ``settle(partial)`` turns the first round's rows into ``(kept, bounds)``:
    the rows to keep and ``(__id, bounds...)``, merged into the queries for
    the second round by ``bounds.columns``. The last ``n_groups`` of these
    are the similarities to beat in each group of references.
    """
    n_queries = queries.count()
    chunk, block = fp_index.sizes(n_queries, refs.count(), block_size, _min_tasks(queries), wide)
    index, placed = fp_index.build(refs, n_words, block, n_groups)
    q = fp_index.in_chunks(queries, index, chunk)
    met = fp_index.home_blocks(q, index)
    n_chunks = -(-n_queries // chunk)
    tasks = udf.n_tasks(queries.sparkSession, n_chunks * index.n_blocks)
    first = cut_lineage(fp_index.meet(met, placed, kernel, schema, udf.n_tasks(queries.sparkSession, n_chunks)))
    kept, bounds = settle(first)
    names = [c for c in bounds.columns if c != "__id"]
    again = (q.drop(*names).join(bounds, "__id", "left")
             .withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in names}))
    left = fp_index.other_blocks(again, index, names[-n_groups:])
    if report is not None:
        left, met = cut_lineage(left), cut_lineage(met)
    second = fp_index.meet(left, placed, kernel, schema, tasks)
    if report is not None:
        second = cut_lineage(second)
        visited = [d.select("__chunk", F.explode("__blocks")).distinct().count() for d in (met, left)]
        report.update(block_pairs=q.select("__chunk").distinct().count() * index.n_blocks, visited=sum(visited),
                      row_visits=sum(d.agg(F.sum(F.size("__blocks"))).first()[0] or 0 for d in (met, left)),
                      row_block_pairs=queries.count() * index.n_blocks,
                      partial_rows=first.count() + second.count())
    return kept, second


def _best_of(queries: DataFrame, refs: DataFrame, n_words: int, self_join: bool, block_size: int,
             report: dict | None = None) -> DataFrame:
    """``(__id, best)`` of prepared distinct rows; rows with no comparable partner are absent."""
    def settle(partial):
        best = cut_lineage(partial.groupBy("__id").agg(F.max("best").alias("best")))
        return best, best.select("__id", F.col("best").alias("__best"))

    zero = F.lit(0).cast("bigint").alias("__group")
    words = ["__id", "__pc", *[f"__w{j}" for j in range(n_words)]]
    kept, second = _two_rounds(queries.select(*words, zero, F.lit(-1.0).alias("__best")), refs.select(*words, zero),
                               n_words, block_size, 1, nearest_kernel(n_words, self_join),
                               "__id bigint, best double", settle, report, wide=8)
    return kept.unionByName(second).groupBy("__id").agg(F.max("best").alias("best"))


def nearest(left: DataFrame, right: DataFrame | None, n_words: int, id_col: str = "id",
            fp_col: str = "fp", block_size: int = DEFAULT_BLOCK, sides: str = "both",
            report: dict | None = None) -> DataFrame:
    """Closest-match similarity of every row.

    ``sides`` ('both', 'left' or 'right') tells which rows are asked for.

    ``right=None``: self join, the row itself excluded -> ``(id, best_sim)``.
    Otherwise ``(side, id, best_sim)``: ``side='left'`` rows carry their best
    match on the right, ``side='right'`` the reverse. Rows with no comparable
    partner are absent.

    Equal fingerprints are collapsed first (in a self join a row with a twin
    is done with that). Distinct ones are laid out by distance to pivots and
    popcount (:mod:`assaylake.operators.fp_index`); each is compared with the
    block it stands in, and then only with blocks that the triangle inequality
    and the popcounts do not rule out. A ``report`` dict is filled with the
    block pairs there are, those visited, and the rows tasks emitted.
    """
    left, l_ids = _numbered(left, id_col)
    lp, l_rows = classes(prepare(left, id_col, fp_col, n_words), n_words)
    if right is None:
        twin = (F.col("__n") > 1) & (F.col("__pc") > 0)
        best = _best_of(lp.where(~twin), lp, n_words, True, block_size, report)
        out = l_rows.join(best.withColumnRenamed("__id", "__class"), "__class", "left").select(
            F.col("__id").alias(id_col), F.when(twin, 1.0).otherwise(F.col("best")).alias("best_sim"))
        return _named(out.where("best_sim IS NOT NULL"), l_ids, id_col)
    right, r_ids = _numbered(right, id_col)
    rp, r_rows = classes(prepare(right, id_col, fp_col, n_words), n_words)

    def side(name, queries, rows, refs, ids):
        best = _best_of(queries, refs, n_words, False, block_size, report)
        out = rows.join(best.withColumnRenamed("__id", "__class"), "__class").select(
            F.lit(name).alias("side"), F.col("__id").alias(id_col), F.col("best").alias("best_sim"))
        return _named(out, ids, id_col)

    found = [side("left", lp, l_rows, rp, l_ids)] if sides != "right" else []
    if sides != "left":
        found.append(side("right", rp, r_rows, lp, r_ids))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def similarity_distribution(left: DataFrame, right: DataFrame | None, n_words: int,
                            id_col: str = "id", fp_col: str = "fp",
                            exclude: str | None = None,
                            block_size: int = DISTRIBUTION_BLOCK) -> DataFrame:
    """Exact distribution of pair similarities: ``(inter, uni, n_pairs)``.

    ``right=None`` compares the table with itself: ``exclude='lower'`` counts
    each unordered pair once (strict upper triangle), ``'self'`` every
    ordered pair i != j. Every statistic of the full similarity matrix
    (min, max, histograms, counts at a value) follows from this table, whose
    size is bounded by the number of distinct ratios, not by the pairs. Equal
    fingerprints are compared once, with the number of their rows as weight.
    """
    if right is None and exclude not in ("lower", "self"):
        raise ValueError("a self comparison needs exclude='lower' or 'self'")
    lp, _ = classes(prepare(left, id_col, fp_col, n_words), n_words)
    rp = None if right is None else classes(prepare(right, id_col, fp_col, n_words), n_words)[0]
    bl, br = _plan(lp, rp, block_size, 2 * _min_tasks(left))
    schema = "inter bigint, uni bigint, n_pairs bigint"
    part = _cogrouped(lp, rp, bl, br).applyInPandas(
        distribution_kernel(n_words, exclude if right is None else None), schema)
    if right is None:  # pairs of rows with the same fingerprint
        pairs = F.col("__n") * (F.col("__n") - 1)
        pairs = pairs if exclude == "self" else F.expr("__n * (__n - 1) div 2")
        part = part.unionByName(lp.where("__n > 1 AND __pc > 0").select(
            F.col("__pc").alias("inter"), F.col("__pc").alias("uni"), pairs.cast("bigint").alias("n_pairs")))
    dist = part.groupBy("inter", "uni").agg(F.sum("n_pairs").cast("bigint").alias("n_pairs"))
    # Small (bounded by the distinct ratios) and read several times by the
    # statistics built on it: materialise once instead of re-running the join.
    return cut_lineage(dist)


def similarity_histogram(dist: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of the similarities in a distribution table.

    Edges span [min, max] of the observed similarities; the last bin is
    closed. Output ``(bin, bin_lo, bin_hi, count)`` with empty bins as 0.
    """
    sims = dist.select((F.col("inter") / F.col("uni")).alias("sim"), "n_pairs")
    rng = sims.agg(F.struct(F.min("sim").alias("mn"), F.max("sim").alias("mx"))).scalar()
    mn, mx = rng.getField("mn"), rng.getField("mx")
    lo = F.when(mx == mn, mn - 0.5).otherwise(mn)
    hi = F.when(mx == mn, mx + 0.5).otherwise(mx)
    idx = F.least(F.floor((F.col("sim") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    counts = sims.groupBy(idx.cast("bigint").alias("bin")).agg(F.sum("n_pairs").alias("count"))
    edges = dist.agg(F.lit(1).alias("__one")).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    width = (hi - lo) / bins
    return (edges.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("bin_lo"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def topk_matches(queries: DataFrame, refs: DataFrame | None, n_words: int, ks: Sequence[int],
                 id_col: str = "id", fp_col: str = "fp", pmask_col: str | None = None,
                 keep_ident_col: str | None = None,
                 block_size: int = DEFAULT_BLOCK, report: dict | None = None) -> DataFrame:
    """Top-k references per (query, property): ``(query_id, prop, ref_id, sim, rank)``.

    ``ks[p]`` is the k of property p; a reference takes part in property p
    when bit p of ``pmask_col`` is set (all properties when None). Queries
    whose ``keep_ident_col`` is false skip references with an identical
    fingerprint (the near-identical rule: Tanimoto 1 means equal sets).
    Ties: similarity descending, then reference id ascending.

    Queries with the same fingerprint (and ``keep_ident``) have the same
    references and are compared once; of references with the same fingerprint
    and properties, those with the ``k`` smallest ids stand for all.

    Two rounds: a query first meets, for each set of properties, the block in
    which it would stand itself, and so learns a k-th best; the second round
    ships it only to blocks that can hold an equal or a better one, and takes
    no lesser row from them. ``report`` as in :func:`nearest`.
    """
    queries, q_ids = _numbered(queries, id_col)
    refs, r_ids = (None, q_ids) if refs is None else _numbered(refs, id_col)
    if refs is None and pmask_col:
        raise ValueError("a property mask needs a separate reference table")
    every = (1 << len(ks)) - 1
    keep = F.coalesce(F.col(keep_ident_col).cast("boolean"), F.lit(False)) if keep_ident_col else F.lit(True)
    prepared = prepare(queries.withColumn("__keep_ident", keep), id_col, fp_col, n_words, ["__keep_ident"])
    lp, members = _query_classes(prepared, n_words)
    own_row = refs is None
    wanted = list(ks)
    if own_row:
        rp = prepared.drop("__keep_ident").withColumn("__pmask", F.lit(every).cast("bigint"))
        # A query's own rows are among its class's references: one, if ids do not repeat.
        most = prepared.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        ks = [k + most for k in ks]
    else:
        mask = F.col(pmask_col).cast("bigint").bitwiseAND(F.lit(every)) if pmask_col else F.lit(every)
        rp = prepare(refs.withColumn("__pmask", mask.cast("bigint")).where("__pmask <> 0"), id_col, fp_col, n_words,
                     ["__pmask"])
    rp = _first_references(rp, n_words, max(ks))
    # References with the same properties are a group of the index, with a bound of its own.
    masks = [r["__pmask"] for r in rp.select("__pmask").distinct().limit(fp_index.MAX_GROUPS + 1).collect()]
    masks = sorted(masks) if 0 < len(masks) <= fp_index.MAX_GROUPS else [every]
    group = F.lit(0)
    for g, m in enumerate(masks[1:], 1):
        group = F.when(F.col("__pmask") == m, g).otherwise(group)
    floors = [f"__floor{p}" for p in range(len(ks))]
    w = Window.partitionBy("__qid", "__prop").orderBy(F.desc("sim"), F.asc("__rid"))

    def slots(sizes):
        return F.element_at(F.array(*[F.lit(k) for k in sizes]), F.col("__prop") + 1)

    def ranked(found, sizes):
        top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(sizes))
        return top.where(F.col("rank") <= slots(sizes))

    def settle(partial):
        best = cut_lineage(ranked(partial, ks).drop("rank"))
        kth = best.groupBy("__qid", "__prop").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("sim"))
        kth = kth.where(F.col("n") == slots(ks)).groupBy(F.col("__qid").alias("__id")).agg(
            *[F.coalesce(F.max(F.when(F.col("__prop") == p, F.col("sim"))), F.lit(-1.0)).alias(f)
              for p, f in enumerate(floors)])
        own = [[F.col(floors[p]) for p in range(len(ks)) if m >> p & 1] for m in masks]
        return best, kth.select("__id", *floors, *[(F.least(*c) if len(c) > 1 else c[0]).alias(f"__beat{g}")
                                                   for g, c in enumerate(own)])

    zero = F.lit(0).cast("bigint")
    lp = lp.select("*", zero.alias("__group"), *[F.lit(-1.0).alias(f) for f in floors])
    kept, second = _two_rounds(lp, rp.withColumn("__group", group.cast("bigint")), n_words, block_size, len(masks),
                               topk_kernel(n_words, ks), "__qid bigint, __prop int, __rid bigint, sim double",
                               settle, report)
    of_class = ranked(kept.unionByName(second), ks).drop("rank").withColumnRenamed("__qid", "__class")
    found = members.join(of_class, "__class").drop("__class")
    if own_row:
        found = found.where("__qid <> __rid")
    out = ranked(found, wanted).select(
        F.col("__qid").alias("query_id"), F.col("__prop").alias("prop"),
        F.col("__rid").alias("ref_id"), "sim", "rank")
    return _named(_named(out, q_ids, "query_id"), r_ids, "ref_id")


def identical_groups(df: DataFrame, id_col: str = "id", fp_col: str = "fp",
                     count_col: str = "n_bits_set") -> DataFrame:
    """Rows sharing their exact, non-empty fingerprint with another row.

    Tanimoto is 1 exactly when two non-empty sets are equal, so the pairs a
    similarity join would report at ~1 are the pairs inside these groups.
    Output ``(id, twin_group, n_partners)``: the group's smallest id and the
    number of other members. A group-by on the fingerprint (partial
    aggregation, then an equi-join that AQE splits if one group is huge);
    the quadratic pair list is never built.
    """
    base = df.where(F.col(fp_col).isNotNull() & (F.col(count_col) > 0))
    groups = (base.groupBy(fp_col)
              .agg(F.count(F.lit(1)).alias("__n"), F.min(qcol(id_col)).alias("twin_group"))
              .where(F.col("__n") > 1))
    return (base.join(groups, fp_col)
            .select(qcol(id_col), "twin_group", (F.col("__n") - 1).cast("bigint").alias("n_partners")))


def identical_pair_counts(groups: DataFrame) -> DataFrame:
    """Rows with an identical partner and ordered identical pairs (both orientations)."""
    return groups.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows_identical"),
                      F.sum("n_partners").cast("bigint").alias("n_identical_pairs"))


def identical_pairs_head(groups: DataFrame, id_col: str, n: int = 10) -> DataFrame:
    """The first ``n`` identical pairs ``(i, j)`` in (i, j) order (a report).

    Only the ``n`` smallest rows with a partner can start one of the first
    ``n`` pairs, and each needs at most ``n`` partners, so at most n*n
    candidate pairs are formed.
    """
    groups = cut_lineage(groups)  # read twice below
    first = groups.orderBy(qcol(id_col)).limit(n).select(
        F.col(id_col).alias("i"), "twin_group")
    members = groups.select(F.col(id_col).alias("j"), F.col("twin_group"))
    w = Window.partitionBy("i").orderBy("j")
    cand = (first.join(members, "twin_group").where(F.col("i") != F.col("j"))
            .withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n))
    return cand.orderBy("i", "j").limit(n).select("i", "j")


def pair_rows(pairs: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """``pairs(i, j)`` with the columns of both rows, prefixed ``i_`` and ``j_``.

    Meant for short pair lists: the rows are filtered by the pairs' ids first.
    """
    cols = [c for c in rows.columns if c != id_col]
    for side in ("i", "j"):
        own = rows.select(qcol(id_col).alias(side), *[qcol(c).alias(f"{side}_{c}") for c in cols])
        pairs = pairs.join(own, side, "left")
    return pairs


def popcount_buckets(threshold: float, bits: int) -> list[int]:
    """First popcount of each bucket, 1 to ``bits``, so that pairs that reach the
    threshold lie in the same or adjacent buckets.

    Tanimoto(a, b) <= min(|a|, |b|) / max(|a|, |b|): from a bucket's last
    popcount ``z`` a partner has at most ``z / threshold``, which is in the
    next bucket, as that ends at its first popcount over the threshold. The
    bounds are exact integers; the threshold is lowered by far less than two
    similarities can differ, for the rounding of the similarity itself.
    """
    t = Fraction(threshold) * (1 - Fraction(1, 1 << 40))
    starts = [1]
    while (nxt := math.floor(starts[-1] / t) + 1) <= bits:
        starts.append(nxt)
    return starts


def tanimoto_join(left: DataFrame, right: DataFrame | None, n_words: int, threshold: float, id_col: str = "id",
                  fp_col: str = "fp", **options) -> DataFrame:
    """Pairs that reach a threshold; see :func:`assaylake.operators.prefix_join.tanimoto_join`."""
    from assaylake.operators import prefix_join
    return prefix_join.tanimoto_join(left, right, n_words, threshold, id_col, fp_col, **options)
