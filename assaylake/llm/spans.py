"""Substring dedup on sliding spans of sentences.

Sentences end at ``.``, ``!`` or ``?`` before white space, and at line ends.
One of more than ``LONG`` words is split further, after each word whose hash is
the smallest of some ``WINDOW`` consecutive words and that two words follow at
least, and its parts count as sentences. Whether a word ends a part depends on the words near it only, so a
passage of over 50 words is met wherever it stands, with or without sentence
marks; at most ``2 * WINDOW`` words stay at an end that is inside a sentence.
For every sentence the shortest run of consecutive sentences that starts with
it, and the shortest that ends with it, with at least ``min_sentences``
sentences and ``min_words`` words, is hashed over its words (A-Z lower-cased,
white space ignored). Runs are joined over the whole corpus by hash, and every
sentence covered by a run that is not at its first place is removed. The two
directions together cover a repeated passage up to both of its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow_map, batch_of, cut_lineage, in_bitmap, mix64, slices, with_key
from assaylake.llm.cuts import cut_texts, not_first, repeated_bitmap

MIN_SENTENCES = 2
MIN_WORDS = 25
LONG, WINDOW = 12, 7  # 51 words less 2 * WINDOW at the one end and 2 * WINDOW - 2 at the other are MIN_WORDS
FEWEST_BITS, MOST_BITS = 20, 29  # of the bitmap of repeated runs: 64 MB at most, whatever the corpus
HASHED = 1 << 20  # bytes of words hashed at a time
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

_WHITE = b" \t\n\r\v\f"
_SPACE = np.isin(np.arange(256), list(_WHITE))
_MARK = np.isin(np.arange(256), list(b".!?"))
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A"):ord("Z") + 1] += np.uint64(32)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, HASHED), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if len(known) == HASHED:  # longer ones are not kept
            _POWERS[base] = known
    return known[:n]


def _prefix_hashes(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each pair, whatever stands before it."""
    n = len(values)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(base, n), dtype=np.uint64)))
    return (sums[ends] - sums[starts]) * _powers(pow(base, -1, 1 << 64), n + 1)[starts]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word with A-Z lower-cased."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED, side="right")))
        first = starts[at]
        values = _LOWER[data[first:ends[to - 1]]] + np.uint64(1)
        out.append(_prefix_hashes(values, _BASES[0], starts[at:to] - first, ends[at:to] - first))
        at = to
    return mix64(np.concatenate(out) + (ends - starts).astype(np.uint64))


def units(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Sentences, and the parts of long ones, of all texts in order, by one pass over their bytes.

    For each its text's number, where it ends there (in bytes, with the white
    space after it), its number of words and two hashes of them. Every text
    has one at least.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    doc_start = np.concatenate(([0], doc_end[:-1])) if len(texts) else doc_end
    black = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a word may start here, whatever stands before
    edge[doc_start] = edge[0] = edge[-1] = True
    start = np.flatnonzero(black & (edge[:-1] | ~np.concatenate(([False], black[:-1]))))
    end = np.flatnonzero(black & (edge[1:] | ~np.concatenate((black[1:], [False])))) + 1
    del black
    # Sentences end after white space that holds a line end or stands after a mark.
    doc = np.searchsorted(doc_end, start, side="right")
    upto_doc = np.searchsorted(start, doc_end)
    after = np.concatenate((start[1:], [0]))[:len(start)]
    inner = np.concatenate((doc[1:] == doc[:-1], [False]))[:len(start)]
    lines = np.flatnonzero(data == 10)

    def broken(a, z):
        return np.searchsorted(lines, z) > np.searchsorted(lines, a)

    stop = np.flatnonzero(inner)
    stop = stop[_MARK[data[end[stop] - 1]] | broken(end[stop], after[stop])]
    first = np.concatenate(([0], upto_doc[:-1])) if len(texts) else upto_doc
    led = np.flatnonzero(first < upto_doc)
    led = led[broken(doc_start[led], start[first[led]])]
    word = _word_hashes(data, start, end)

    def sorted_units(*more):
        ends = np.concatenate((doc_end, after[stop], start[first[led]], *[start[m] for m in more]))
        upto = np.concatenate((upto_doc, stop + 1, first[led], *more))
        of = np.concatenate((np.arange(len(texts)), doc[stop], led, *[doc[m] for m in more]))
        order = np.lexsort((ends, of))
        return of[order], ends[order], upto[order]

    of, ends, upto = sorted_units()
    size = np.diff(upto, prepend=0)
    if len(word) >= WINDOW and size.max() > LONG:
        seen = np.lib.stride_tricks.sliding_window_view(word, WINDOW)[:, ::-1]
        last = np.arange(WINDOW - 1, len(word))
        left = np.repeat(np.where(size > LONG, upto, 0), size)  # end of each word's sentence, if that is long
        whole = (left[last] > 0) & (left[last] == left[last - WINDOW + 1])
        cuts = np.unique((last - seen.argmin(axis=1))[whole]) + 1
        cuts = cuts[cuts < left[cuts - 1] - 1]  # no part of one word at the end
        of, ends, upto = sorted_units(cuts)
        size = np.diff(upto, prepend=0)
    keys = [mix64(_prefix_hashes(word, b, upto - size, upto) + size.astype(np.uint64)) for b in _BASES]
    return of, ends - doc_start[of], size, *keys


def sentence_ends(text: bytes) -> list[int]:
    """Byte offsets where sentences and the parts of long ones end, each with the white space after it."""
    return units([text])[1].tolist()


def sentences(text: bytes) -> list[bytes]:
    ends = sentence_ends(text)
    return [text[a:z] for a, z in zip([0, *ends], ends)]


def runs(words: np.ndarray, doc: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of every run; ``doc`` numbers the sentences' texts in order."""
    n = len(words)
    i = np.arange(n)
    before = np.concatenate(([0], np.cumsum(words)))
    # Shortest run from i on, and shortest run that ends with i.
    end = np.maximum(np.searchsorted(before, before[:-1] + min_words) - 1, i + min_sentences - 1)
    start = np.minimum(np.searchsorted(before, before[1:] - min_words, side="right") - 1, i - min_sentences + 1)
    a, z = np.concatenate((i, start)), np.concatenate((end, i))
    inside = (a >= 0) & (z < n)
    a, z = a[inside], z[inside]
    same = doc[a] == doc[z]
    both = np.unique(a[same] * np.int64(n) + z[same])
    return both // max(n, 1), both % max(n, 1)


def _rows(bits, log2_bits: int, min_sentences: int, min_words: int):
    """Without ``bits`` the hashes of all runs; with them the runs that may repeat."""
    def one(b: pa.RecordBatch, table) -> pa.RecordBatch:
        doc, ends, words, key, key2 = units([t.as_py() for t in b.column("text")])
        a, z = runs(words, doc, min_sentences, min_words)
        length = (z - a).astype(np.uint64)
        h = mix64(_prefix_hashes(key, _BASES[0], a, z + 1) + length)
        if table is None:
            return batch_of(h=h.view(np.int64))
        hit = in_bitmap(table, log2_bits, h)
        a, z, h, length = a[hit], z[hit], h[hit], length[hit]
        h2 = mix64(_prefix_hashes(key2, _BASES[1], a, z + 1) + length)
        first = np.concatenate(([True], doc[1:] != doc[:-1]))[:len(doc)]
        starts = np.where(first, 0, np.concatenate(([0], ends[:-1]))[:len(doc)])
        at = pa.array(doc[a])
        return batch_of(doc_id=b.column("doc_id").take(at), row_hash=b.column("row_hash").take(at),
                        a=starts[a].astype(np.int32), z=ends[z].astype(np.int32), h=h.view(np.int64),
                        h2=h2.view(np.int64))

    def run(batches):
        table = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for b in batches:
            for part in slices(b):
                yield one(part, table)

    return run


def _without(text: str, cut: list[dict]) -> str:
    whole, out, at = text.encode(), [], 0
    for a, z in sorted((c["a"], c["z"]) for c in cut):
        if a > at:
            out.append(whole[at:a])
        at = max(at, z)
    return (b"".join(out) + whole[at:]).rstrip(_WHITE).decode()


def dedup_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the sentences of repeated runs, and ``removed``, the list of byte ranges.

    The first place is that of the smallest (doc_id, text hash, offset), null
    ids first. It stays whole, but where a run that begins inside it occurs
    again before it ends: a text that says one sentence over and over keeps
    the shortest run of it. ``removed`` is null where nothing was. Null texts
    stay null, empty ones empty; a text that stands elsewhere as a whole
    becomes empty and its row stays. A text with fewer sentences or words than
    a run needs is left alone. Rows equal in id and text are one document:
    they lose the same sentences and do not make each other repeated.
    ``n_chars``, where there is one, follows the text; other columns come
    through, whatever their names. Texts are taken about 2 MB at a time, a
    longer one alone; time is linear in its length. No rows give no rows.

    The bitmap that thins out the second pass has eight bits for each repeated
    hash, from 2**20 to 2**29 bits. With more repeated hashes than that, more
    runs pass it in vain, up to all of them; the join decides on 128 bits.
    """
    keyed = with_key(docs)
    hashes = arrow_map(keyed, _rows(None, 0, min_sentences, min_words), "h long")
    bits, log2_bits = repeated_bitmap(hashes, FEWEST_BITS, MOST_BITS)
    bits = docs.sparkSession.sparkContext.broadcast(bits)
    pieces = cut_lineage(arrow_map(keyed, _rows(bits, log2_bits, min_sentences, min_words),
                                   "doc_id long, row_hash long, a int, z int, h long, h2 long"))
    again = not_first(pieces, ["h", "h2"], ["doc_id", "row_hash", "a"])
    cuts = again.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("a", "z")).alias("cut"))
    return cut_texts(docs, cuts, _without, "removed")


def op2_substring_dedup(spark, sf_dir):
    """Documents without repeated sentence runs, with the number of runs found again."""
    out = dedup_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "text", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint")
                      .alias("n_repeated_runs"))
