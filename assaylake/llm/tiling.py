"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences (A-Z lower-cased). Karp-Rabin
hashes of all windows of ``min_match`` words are the seeds (an item of fewer
words has one window, of its own length); document seeds are thinned by a
fixed-size bitmap of the item seeds and joined with them on hash and words. A
pair that shares p of an item's windows covers at most ``min_match * p`` of its
words, so pairs that cannot reach the threshold are dropped by counts before any
seeds are brought together. For each (document, item) pair left, the longest
match not yet marked is marked as a tile, again and again, until none of
``min_match`` words is left. Tiles may lie anywhere and in any order, so reordered passages count.
A document is contaminated by an item if the tiles cover at least
``min_coverage`` of the item's words.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import (arrow_map, ascii_words, batch_of, cut_lineage, hash_bitmap, in_bitmap, key_of, mix64,
                                  renamed, with_key)

MIN_MATCH = 4
MIN_COVERAGE = 0.6
LOG2_BITS = 26
_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for t in range(size):
        h = h * _BASE + x[t:t + n]
    return mix64(h)


def greedy_tiles(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Tiles ``(document word, item word, words)`` from matching windows of ``size`` words.

    Windows that follow each other on a diagonal form one match. The longest
    unmarked match is taken first, ties by place in the document, then in the
    item; a match that meets marked words is cut down to its unmarked runs.
    """
    matches, left = [], set(pairs)
    for d, i in sorted(left):
        if (d - 1, i - 1) in left:
            continue
        n = 1
        while (d + n, i + n) in left:
            n += 1
        matches.append((-(n + size - 1), d, i))
    heapq.heapify(matches)
    in_doc, in_item, tiles = set(), set(), []
    while matches:
        n, d, i = heapq.heappop(matches)
        free = [k for k in range(-n) if d + k not in in_doc and i + k not in in_item]
        if len(free) == -n:
            tiles.append((d, i, -n))
            in_doc.update(range(d, d - n))
            in_item.update(range(i, i - n))
            continue
        start = 0
        for at in range(1, len(free) + 1):
            if at == len(free) or free[at] != free[at - 1] + 1:
                if at - start >= size:
                    heapq.heappush(matches, (-(at - start), d + free[start], i + free[start]))
                start = at
    return tiles


def _seeds(bits, size: int):
    """Seeds with their words; with ``bits`` only those that may be an item's."""
    def run(batches):
        table = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for b in batches:
            doc, pos, hs, body = [], [], [], []
            for k, t in enumerate(b.column("text")):
                words = ascii_words(t.as_py())
                h = window_hashes(words, size)
                at = np.arange(len(h)) if table is None else np.flatnonzero(in_bitmap(table, LOG2_BITS, h))
                if len(at):
                    doc.append(np.full(len(at), k))
                    pos.append(at)
                    hs.append(h[at])
                    body += [b" ".join(words[i:i + size]) for i in at.tolist()]
            if doc:
                rows = pa.array(np.concatenate(doc))
                yield batch_of(doc_id=b.column("doc_id").take(rows), row_hash=b.column("row_hash").take(rows),
                               pos=np.concatenate(pos).astype(np.int32), h=np.concatenate(hs).view(np.int64),
                               body=pa.array(body, pa.binary()))

    return run


_SEED_SCHEMA = "doc_id long, row_hash long, pos int, h long, body binary"


def _counted(items: DataFrame) -> DataFrame:
    """``items`` with ``n_words``."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([len(ascii_words(t.as_py())) for t in b.column("text")], pa.int64())],
                names=[*b.schema.names, "n_words"])

    return arrow_map(items, run, "doc_id long, row_hash long, text binary, n_words long")


_PAIR = ["doc_id", "row_hash", "item_id", "item_hash"]


def _tiled(docs: DataFrame, items: DataFrame, size: int, least: float) -> DataFrame:
    """Coverage of the pairs of ``docs`` and counted ``items`` that share a window of ``size`` words."""
    item_seeds = cut_lineage(arrow_map(items.drop("n_words"), _seeds(None, size), _SEED_SCHEMA))
    bits = docs.sparkSession.sparkContext.broadcast(hash_bitmap(item_seeds, "h", LOG2_BITS))
    doc_seeds = arrow_map(with_key(docs), _seeds(bits, size), _SEED_SCHEMA)
    right = item_seeds.select(F.col("doc_id").alias("item_id"), F.col("row_hash").alias("item_hash"),
                              F.col("pos").alias("ipos"), "h", "body")
    met = cut_lineage(doc_seeds.join(right, ["h", "body"]).select(*_PAIR, "pos", "ipos"))
    # Windows of the item that the pair shares, against the words it has to cover.
    lengths = items.select(F.col("doc_id").alias("own_id"), F.col("row_hash").alias("own_hash"), "n_words")
    shared = met.select(*_PAIR, "ipos").distinct().groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("shared"))
    able = shared.join(lengths, F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("item_hash") == F.col("own_hash")))
    able = able.where(F.col("shared") * size >= F.col("n_words") * least).select(
        *[F.col(c).alias(f"able_{c}") for c in _PAIR], "n_words")
    on = [F.col(c).eqNullSafe(F.col(f"able_{c}")) for c in _PAIR]
    seeds = met.join(able, on).groupBy(*_PAIR, "n_words").agg(F.collect_set(F.struct("pos", "ipos")).alias("seeds"))

    def run(batches):
        for b in batches:
            tiles = [greedy_tiles([(s["pos"], s["ipos"]) for s in row], size)
                     for row in b.column("seeds").to_pylist()]
            yield batch_of(doc_id=b.column("doc_id"), row_hash=b.column("row_hash"), item_id=b.column("item_id"),
                           item_hash=b.column("item_hash"),
                           covered=np.array([sum(t[2] for t in x) for x in tiles], np.int64),
                           n_words=b.column("n_words"), n_tiles=np.array([len(x) for x in tiles], np.int64))

    return arrow_map(seeds, run, "doc_id long, row_hash long, item_id long, item_hash long, covered long, "
                                 "n_words long, n_tiles long")


def tile_coverage(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, least: float = 0.0) -> DataFrame:
    """``doc_id, row_hash, item_id, item_hash, covered, n_words, n_tiles`` of every pair that shares a seed.

    ``docs`` has ``doc_id, text`` and ``benchmark`` has ``item_id, text``. Null
    and empty texts share nothing. Pairs that cannot cover the share ``least``
    of the item may be left out. A pair's seeds are at most the document's
    windows times the item's equal windows and are tiled in one row.
    """
    items = cut_lineage(_counted(with_key(benchmark.select(F.col("item_id").alias("doc_id"), "text")).distinct()))
    short = items.where(F.col("n_words").between(1, min_match - 1)).select("n_words").distinct().collect()
    out = _tiled(docs, items.where(F.col("n_words") >= min_match), min_match, least)
    for size in sorted(r["n_words"] for r in short):  # fewer than min_match sizes
        out = out.unionByName(_tiled(docs, items.where(F.col("n_words") == size), size, least))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH,
                 min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each contaminated document: ``doc_id, row_hash``, the item covered best
    (``item_id, coverage, n_tiles``; ties to the smallest id) and ``n_items`` over the threshold.

    Rows equal in doc_id and text are one document. Null and empty texts, on
    either side, are in no finding; neither are any where a table is empty.
    Null ids are ids like others; other columns are ignored whatever their
    names. Texts are read whole, one at a time.
    """
    pairs = tile_coverage(docs, benchmark, min_match, min_coverage).withColumn("coverage", F.col("covered") / F.col("n_words"))
    best = F.max_by(F.struct("item_id", "coverage", "n_tiles"), F.struct("coverage", -F.col("item_id")))
    return (pairs.where(F.col("coverage") >= min_coverage).groupBy("doc_id", "row_hash")
            .agg(best.alias("b"), F.count(F.lit(1)).alias("n_items"))
            .select("doc_id", "row_hash", "b.*", "n_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH,
                      min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, all columns kept."""
    bad = contaminated(docs, benchmark, min_match, min_coverage).select(
        F.col("doc_id").alias("bad_id"), F.col("row_hash").alias("bad_hash"))
    rows, names = renamed(docs)
    doc_id, row_hash = key_of(names)
    keyed = rows.withColumns({"id": doc_id, "hash": row_hash})
    return keyed.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")),
                      "left_anti").select(*[F.col(k).alias(c) for c, k in names.items()])


def op7_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with the item and how much of it the tiles cover."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row_hash")
