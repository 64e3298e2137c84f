"""Line dedup on content-defined chunks of lines.

A rolling hash over the hashes of the last ``window`` lines ends a chunk
wherever its value is divisible by ``divisor``. A boundary depends on the
lines next to it only, so lines put in or taken out elsewhere do not move the
boundaries of a passage. Below these chunks lies a finest level, where every
line ends a chunk: as a chunk of one line is too short, each is joined with
those after it up to ``min_lines`` lines with text. A passage of several lines
is thereby found whatever stands around it, without a boundary inside it. A
chunk of either level that occurs in more than one place is removed everywhere
but at its first place, after its bytes have been compared.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow_map, batch_of, cut_lineage, in_bitmap, mix64, with_key
from assaylake.llm.cuts import LOG2_BITS, cut_texts, not_first, repeated_bitmap

WINDOW = 2
DIVISOR = 4
MIN_LINES = 2
_BASE = 0x9E3779B97F4A7C15


def chunk_ends(lines: list[bytes], window: int = WINDOW, divisor: int = DIVISOR) -> list[int]:
    """Ends (exclusive line numbers) of the chunks of a text's lines; the last is ``len(lines)``."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    rolling = np.zeros(len(h), np.uint64)
    for back in range(min(window, len(h))):
        rolling[back:] += h[:len(h) - back] * np.uint64(pow(_BASE, back, 1 << 64))
    ends = (np.flatnonzero(mix64(rolling) % np.uint64(divisor) == 0) + 1).tolist()
    return ends if ends and ends[-1] == len(lines) else [*ends, len(lines)]


def leveled_chunks(text: bytes, window: int, divisor: int, min_lines: int) -> list[tuple[int, int, bytes, int]]:
    """``(first line, end line, bytes, level)`` of the chunks of both levels with at least ``min_lines`` lines
    that have text; level 0 are the content-defined ones, and a chunk of both levels comes once, as such."""
    lines = text.split(b"\n")
    full = [i for i, x in enumerate(lines) if x != b"" and not x.isspace()]
    if len(full) < min_lines:
        return []
    found = {(a, z + 1): 1 for a, z in zip(full, full[min_lines - 1:])}
    start = 0
    for end in chunk_ends(lines, window, divisor):
        if bisect_left(full, end) - bisect_left(full, start) >= min_lines:
            found[start, end] = 0
        start = end
    return [(a, z, b"\n".join(lines[a:z]), level) for (a, z), level in sorted(found.items())]


def chunks(text: bytes, window: int, divisor: int, min_lines: int) -> list[tuple[int, int, bytes]]:
    """``(first line, end line, bytes)`` of the chunks of both levels."""
    return [c[:3] for c in leveled_chunks(text, window, divisor, min_lines)]


def _rows(bits, window: int, divisor: int, min_lines: int):
    """Without ``bits`` the hashes of all chunks; with them the chunks that may repeat."""
    def run(batches):
        table = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for b in batches:
            found = [(k, *c) for k, t in enumerate(b.column("text"))
                     for c in leveled_chunks(t.as_py(), window, divisor, min_lines)]
            h = np.fromiter((xxhash.xxh64_intdigest(c[3]) for c in found), np.uint64, len(found))
            if table is None:
                yield batch_of(h=h.view(np.int64))
                continue
            hit = np.flatnonzero(in_bitmap(table, LOG2_BITS, h)).tolist()
            doc = pa.array([found[i][0] for i in hit], pa.int64())
            yield batch_of(doc_id=b.column("doc_id").take(doc), row_hash=b.column("row_hash").take(doc),
                           a=pa.array([found[i][1] for i in hit], pa.int32()),
                           z=pa.array([found[i][2] for i in hit], pa.int32()), h=h[hit].view(np.int64),
                           body=pa.array([found[i][3] for i in hit], pa.binary()),
                           level=pa.array([found[i][4] for i in hit], pa.int32()))

    return run


def _without(text: str, cut: list[dict]) -> str:
    lines = text.split("\n")
    gone = {i for c in cut for i in range(c["a"], c["z"])}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone)


def dedup_lines(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR,
                min_lines: int = MIN_LINES, removed: str = "removed") -> DataFrame:
    """``docs`` with repeated chunks of lines removed, and ``removed``, the list of line ranges
    with the level that found them (0: content-defined chunks, 1: the finest level).

    That column takes the name given, in place of a column of the same name.

    The first place is that of the smallest (doc_id, text hash, line), null
    ids first. Chunks overlap: a line at the first place of one chunk goes if
    it is also in a chunk that stands earlier, so each line that goes still
    stands in an earlier place. ``removed`` is null where nothing was. Null texts stay null,
    empty ones empty; a text whose chunks all stand elsewhere becomes empty
    and its row stays. Rows equal in id and text are one document: they lose
    the same lines and do not make each other repeated. ``n_chars``, where
    there is one, follows the text.
    """
    keyed = with_key(docs)
    hashes = arrow_map(keyed, _rows(None, window, divisor, min_lines), "h long")
    bits = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(hashes)[0])
    pieces = cut_lineage(arrow_map(keyed, _rows(bits, window, divisor, min_lines),
                                   "doc_id long, row_hash long, a int, z int, h long, body binary, level int"))
    again = not_first(pieces, ["h", "body"], ["doc_id", "row_hash", "a"])
    cuts = again.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("a", "z", "level")).alias("cut"))
    return cut_texts(docs, cuts, _without, removed)


def lines_in(ranges: Column) -> Column:
    """Number of different lines in a list of line ranges; 0 for null."""
    lines = F.array_distinct(F.flatten(F.transform(ranges, lambda c: F.sequence(c["a"], c["z"] - 1))))
    return F.coalesce(F.array_size(lines), F.lit(0)).cast("bigint")


def op10_line_dedup(spark, sf_dir):
    """Documents without repeated line chunks, with the number of lines removed, and of those among
    them that a content-defined chunk explains."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    in_chunks = F.filter("removed", lambda c: c["level"] == 0)
    return out.select("doc_id", "text", lines_in(F.col("removed")).alias("n_lines_removed"),
                      lines_in(in_chunks).alias("n_lines_in_chunks"))
