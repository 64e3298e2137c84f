"""Repeated pieces of texts: find the first occurrence of each, cut the others out.

Shared by the sentence-span and line-chunk operators. Pieces are counted by
hash first; a fixed-size bitmap of the repeated hashes then lets the second
pass over the texts hand on only pieces that may repeat, so unique text is
never shuffled for the search.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assaylake.llm.common import BITS_PER_ROW, cut_lineage, hash_bitmap, key_of, renamed
from assaylake.session import ensure_importable

LOG2_BITS = 26


def repeated_bitmap(hashes: DataFrame, fewest: int = LOG2_BITS, most: int = LOG2_BITS) -> tuple[bytes, int]:
    """Bitmap of the values of ``h`` that occur more than once, and its size as a power of two.

    Eight bits for each such value, within the two bounds.
    """
    again = hashes.groupBy("h").count().where("count > 1").select("h")
    if fewest < most:
        again = cut_lineage(again)
        most = min(max((8 * again.count()).bit_length(), fewest), most)
    return hash_bitmap(again, "h", most), most


def not_first(pieces: DataFrame, same: list[str], place: list[str]) -> DataFrame:
    """``pieces`` that are not at the first ``place`` of their key ``same`` (nulls first).

    One aggregate with partial sums finds the first places. They are written
    before the join that brings them back, so that both of its sides come
    straight from a shuffle and AQE can split a key with many rows.
    """
    at = F.struct(*place)
    first = pieces.groupBy(*same).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    first = first.where(~F.col("__first").eqNullSafe(F.col("__last"))).drop("__last")
    first = cut_lineage(first)
    return pieces.join(first, same).where(~at.eqNullSafe(F.col("__first"))).drop("__first")


def may_hold(rows: DataFrame, row_hash: str, hashes: DataFrame, name: str) -> DataFrame:
    """``rows`` with the flag ``name``: false only if ``row_hash`` is not among the values of the
    column of that name in ``hashes``.

    Looks up one bit of a bitmap that is broadcast in pieces of 4 kB; its
    ``2 ** LOG2_BITS`` bits are all there can be.
    """
    at = F.shiftrightunsigned(F.col(row_hash), 64 - LOG2_BITS)
    part, bit = (F.shiftright(at, 15)).alias("bits_part"), at.bitwiseAND(F.lit(BITS_PER_ROW - 1))
    bits = hashes.select(part, bit.alias("bit")).groupBy("bits_part").agg(
        F.bitmap_construct_agg("bit").alias("bits_held"))
    joined = rows.withColumns({"own_part": F.shiftright(at, 15), "own_bit": bit.cast("int")}).join(
        F.broadcast(bits), F.col("own_part") == F.col("bits_part"), "left")
    byte = F.conv(F.hex(F.substring("bits_held", F.shiftright("own_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.col("own_bit").bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("own_part", "own_bit", "bits_part", "bits_held")


def cut_texts(docs: DataFrame, cuts: DataFrame, rebuild, more: str) -> DataFrame:
    """``docs`` with ``text`` rebuilt where ``cuts(doc_id, row_hash, cut)`` has a row.

    ``rebuild(text, cut) -> text``, and the list ``cut`` is kept as column
    ``more``, in place of a column of that name. Only the texts to be cut go
    to Python, and only those that a bitmap of their hashes lets pass are
    shuffled for the join; the others stay where they are.
    """
    docs = docs.drop(more)
    ensure_importable(docs.sparkSession)
    cuts = cut_lineage(cuts)

    @F.arrow_udf(StringType())
    def rebuilt(text: pa.Array, cut: pa.Array) -> pa.Array:
        return pa.array([None if t is None else rebuild(t, c) for t, c in
                         zip(text.to_pylist(), cut.to_pylist())], pa.string())

    rows, names = renamed(docs)
    doc_id, row_hash = key_of(names)
    keyed = may_hold(rows.withColumns({"id": doc_id, "row_hash": row_hash}), "row_hash", cuts, "may")
    right = cuts.select(F.col("doc_id").alias("cut_id"), F.col("row_hash").alias("cut_hash"), "cut")
    hit = keyed.where("may").join(
        right, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("row_hash") == F.col("cut_hash")), "left")
    text = F.col(names["text"])
    hit = hit.withColumn("new", F.coalesce(rebuilt(F.when(F.col("cut").isNotNull(), text), F.col("cut")), text))
    rest = keyed.where("NOT may").withColumns({"cut": F.lit(None).cast(cuts.schema["cut"].dataType), "new": text})
    both = hit.select(*names.values(), "cut", "new").unionByName(rest.select(*names.values(), "cut", "new"))
    now = {"text": F.col("new")}
    if "n_chars" in names:
        now["n_chars"] = F.when(F.col("cut").isNull(), F.col(names["n_chars"]).cast("bigint")).otherwise(
            F.length("new").cast("bigint"))
    return both.select(*[now.get(c, F.col(k)).alias(c) for c, k in names.items()], F.col("cut").alias(more))
