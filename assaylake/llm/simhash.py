"""SimHash near-duplicates through an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most ``d`` bits differ in at most
``d`` of their eight bytes, so they share at least ``8 - d`` positional bytes
``(position, value)``. The count filter keeps exactly the pairs that reach this
tally. A posting list of one positional byte would hold 1/256 of the corpus,
and tallying over such lists is quadratic; the lists here are therefore those
of ``8 - d`` bytes at once: a pair reaches the tally if and only if it meets in
one of the ``C(8, d)`` lists it is posted to (28 for two bits). Only distinct
fingerprints are posted, so copies cost nothing, and a list holds at most
``256 ** d`` members, however many documents there are. Pairs are verified on
their differing bits inside the list, in chunks, and each list hands on a
spanning forest of its links only (fewer edges than members).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow_map, ascii_words, batch_of, cut_lineage, key_of, renamed, with_key
from assaylake.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
_CHUNK = 1 << 15  # shingles unpacked to bits at a time
_PAIR_ROWS = 512  # left rows of a list compared at a time


def text_fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of one text: bit set if set in over half the shingle hashes."""
    words = ascii_words(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))) if n > 1 or \
        len(words) == shingle_words else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at:at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, row_hash, fp`` (signed 64 bits) of every row; no text and no word give 0."""
    def run(batches):
        for b in batches:
            fps = np.array([text_fingerprint(t.as_py(), shingle_words) for t in b.column("text")],
                           dtype=np.uint64).view(np.int64)
            yield batch_of(doc_id=b.column("doc_id"), row_hash=b.column("row_hash"), fp=fps)

    return arrow_map(with_key(docs), run, "doc_id long, row_hash long, fp long")


def shared_bytes(diff: np.ndarray) -> np.ndarray:
    """Number of equal bytes at equal positions of two fingerprints, from their bitwise difference."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return 8 - np.bitwise_count((((diff & low) + low) | diff) & ~low)


def _forest(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside one posting list, as index pairs."""
    n, need = len(members), 8 - max_bits
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for lo in range(0, n, _PAIR_ROWS):
        diff = members[lo:lo + _PAIR_ROWS, None] ^ members[None, lo:]
        # Tally the shared positional bytes, keep the pairs that reach the minimum, then verify their bits.
        i, j = np.nonzero(np.triu(shared_bytes(diff) >= need, 1))
        near = np.bitwise_count(diff[i, j]) <= max_bits
        for a, b in zip((i[near] + lo).tolist(), (j[near] + lo).tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                found.append((a, b))
    return found


def _list_links(max_bits: int):
    """Links of posting lists that arrive sorted by (combo, bytes)."""
    def links(combo, key, fp):
        edge = np.flatnonzero((combo[1:] != combo[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate(([0], edge))
        sizes = np.diff(np.concatenate((starts, [len(fp)])))
        two = starts[sizes == 2]
        diff = fp[two] ^ fp[two + 1]
        near = (shared_bytes(diff) >= 8 - max_bits) & (np.bitwise_count(diff) <= max_bits)
        us, vs = [fp[two[near]]], [fp[two[near] + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            pairs = _forest(fp[s:s + n], max_bits)
            if pairs:
                at = np.array(pairs)
                us.append(fp[s + at[:, 0]])
                vs.append(fp[s + at[:, 1]])
        return batch_of(u=np.concatenate(us).view(np.int64), v=np.concatenate(vs).view(np.int64))

    def run(batches):
        held = None  # the last list so far, which may go on in the next batch
        for b in batches:
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield links(*(c[:cut] for c in cols))
        if held is not None:
            yield links(*held)

    return run


def fingerprint_links(distinct_fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(u, v)`` that connect all fingerprints ``fp`` differing in at most ``max_bits`` bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits from 0 to 3")
    masks = [int.from_bytes(bytes(255 if i in kept else 0 for i in range(8)), "little", signed=True)
             for kept in combinations(range(8), 8 - max_bits)]
    posts = distinct_fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("combo", "mask"))
    posts = posts.select("combo", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp")
    posts = posts.repartition("combo", "bytes").sortWithinPartitions("combo", "bytes", "fp")
    return arrow_map(posts, _list_links(max_bits), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, row_hash, fp, root, component_id`` of every row of ``docs(doc_id, text)``.

    ``root`` is the smallest fingerprint of the row's component and
    ``component_id`` the smallest doc_id reachable over links, the row's own
    included. Null and empty texts have fingerprint zero and are linked like
    any other; a null doc_id is ignored where a component has another id and
    gives a null component_id otherwise. Repeated rows are returned as often
    as they occur. An empty table gives an empty table.
    """
    fps = cut_lineage(fingerprints(docs, shingle_words))
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(fingerprint_links(classes.select("fp"), max_bits))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(lowest, "root")
    return fps.join(by_fp, "fp").select("doc_id", "row_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` less near-duplicates, all columns kept.

    Of each component the row with the smallest doc_id stays (nulls last, then
    the smallest text hash), once if it is repeated.
    """
    last = F.lit((1 << 63) - 1)
    found = near_duplicates(docs, shingle_words, max_bits)
    place = F.struct(F.coalesce(F.col("doc_id"), last).alias("id"), F.col("row_hash").alias("hash"))
    keep = found.groupBy("root").agg(F.min(place).alias("k")).select("k.id", "k.hash")
    rows, names = renamed(docs)
    doc_id, row_hash = key_of(names)
    keyed = rows.withColumns({"id": F.coalesce(doc_id, last), "hash": row_hash})
    return (keyed.join(keep, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
            .select(*[F.col(k).alias(c) for c, k in names.items()]))


def op3_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
