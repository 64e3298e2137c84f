"""Helpers shared by the text-pipeline operators.

Python code runs in tasks only, batch by batch through Arrow; Spark decides
the partitioning. A document row is identified by ``(doc_id, row_hash)`` with
``row_hash = xxhash64(text)``, so rows that share an id but not a text stay
apart, and rows equal in both are one document with one verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.session import cut_lineage, ensure_importable

__all__ = ["table", "with_key", "arrow_map", "batch_of", "slices", "hash_bitmap", "in_bitmap", "mix64",
           "cut_lineage", "ascii_words", "renamed", "key_of", "like_documents"]

SLICE_BYTES = 2_000_000
BITS_PER_ROW = 32768  # bits held by one bitmap_construct_agg value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_key(docs: DataFrame, *extra: Column | str) -> DataFrame:
    """``doc_id, row_hash, text`` (and more); the text is handed over as bytes, null as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.xxhash64(text).alias("row_hash"), text.cast("binary").alias("text"), *extra)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with this package made importable in the workers."""
    ensure_importable(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batch_of(**columns) -> pa.RecordBatch:
    """Record batch from pyarrow or numpy arrays by name."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of text, one row at least.

    Bounds what a task holds of its texts' words, whatever the rows of a batch.
    """
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        z = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, z - at)
        at = z


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread all 64 bits of each hash (multiply and xor-shift rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hash_bitmap(hashes: DataFrame, column: str, log2_bits: int) -> bytes:
    """Bitmap of ``2**log2_bits`` bits with the top bits of every hash set.

    The size is fixed, whatever the number of hashes, so it may be broadcast.
    It only thins out rows before a join on the full hash: more hashes mean
    more rows that pass in vain, never a lost one.
    """
    pos = F.shiftrightunsigned(F.col(column), 64 - log2_bits)
    rows = (hashes.select(pos.alias("pos"))
            .groupBy((F.col("pos") / BITS_PER_ROW).cast("bigint").alias("part"))
            .agg(F.bitmap_construct_agg(F.col("pos") % BITS_PER_ROW).alias("bits")).collect())
    out = bytearray((1 << log2_bits) // 8)
    width = BITS_PER_ROW // 8
    for r in rows:
        out[r["part"] * width:(r["part"] + 1) * width] = r["bits"]
    return bytes(out)


def in_bitmap(bits: np.ndarray, log2_bits: int, hashes: np.ndarray) -> np.ndarray:
    """Mask of the unsigned 64-bit ``hashes`` whose bit is set in ``bits`` (uint8)."""
    pos = hashes >> np.uint64(64 - log2_bits)
    return (bits[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1


def ascii_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D) with A-Z lower-cased."""
    return text.lower().split()


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns called ``c0, c1, ...`` and those names by the old ones, so that no name
    a caller may use can clash with one used here."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def key_of(names: dict[str, str]) -> tuple[Column, Column]:
    """``doc_id`` and ``row_hash`` of renamed documents."""
    text = F.coalesce(F.col(names["text"]), F.lit(""))
    return F.col(names["doc_id"]).cast("bigint"), F.xxhash64(text)


def like_documents(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of ``docs`` with a new text and, where there is one, its new length."""
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns]
