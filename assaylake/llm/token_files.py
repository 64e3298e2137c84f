"""Token-id files with Elias-Fano document boundaries.

A shard is two binary files for one range of documents, in ascending doc_id
order:

``<shard>.ids``  the concatenated token ids of its documents, little-endian,
                 2 bytes each if the vocabulary allows, else 4.
``<shard>.idx``  header of seven int64 (magic, id width, documents, ids, null
                 doc_ids, smallest doc_id, version) and two Elias-Fano
                 sequences: the document ends inside the shard, and the
                 non-null doc_ids less the smallest.

An Elias-Fano sequence of n non-decreasing numbers up to u keeps
``l = floor(log2(u / n))`` low bits of each packed, and the high parts in
unary, n ones in at most ``n + u / 2**l`` bits: about ``2 + log2(u / n)`` bits
a document where a table of offsets takes 64. ``select(i)`` finds the i-th one
from sampled positions (one int32 pair for 512 ones) and a short scan.

Spark range-partitions whole texts by doc_id, each task tokenizes and streams
its range to a shard, and the manifest (one row for a shard) is what Spark
commits: a file that a lost or repeated attempt leaves behind is in no
manifest and never read.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.llm.bpe import word_patterns
from assaylake.llm.common import arrow_map, batch_of, cut_lineage, with_key
from assaylake.session import ensure_checkpoint_dir

MAGIC, VERSION = 0x454C4641, 1
END_ID = 2
SAMPLE = 512
CACHE_WORDS = 1_000_000  # word pieces whose ids a worker remembers; only speed depends on it


# --- Elias-Fano ---------------------------------------------------------

class EliasFano:
    """Compressed non-decreasing sequence with constant-time-like ``select``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        # For every SAMPLE-th one: the byte that holds it and the ones before that byte.
        self._at = np.searchsorted(ones, np.arange(0, n, SAMPLE), side="right").astype(np.int32)
        self._before = np.where(self._at > 0, ones[self._at - 1], 0) if n else np.zeros(0, np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        """Encode non-negative, non-decreasing int64 ``values``."""
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = np.zeros((n + (top >> low_bits) + 8) // 8, dtype=np.uint8)
        if n:
            where = (values >> low_bits) + np.arange(n)
            np.bitwise_or.at(high, where >> 3, (1 << (where & 7)).astype(np.uint8))
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.int64)
            low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, dtype=np.uint8)
        return cls(n, low_bits, low, high)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], dtype="<i8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple["EliasFano", int]:
        n, low_bits, n_low, n_high = np.frombuffer(data, "<i8", 4, at).tolist()
        low = np.frombuffer(data, np.uint8, n_low, at + 32)
        high = np.frombuffer(data, np.uint8, n_high, at + 32 + n_low)
        return cls(n, low_bits, low, high), at + 32 + n_low + n_high

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return out

    def select(self, i: int) -> int:
        """The i-th number, read from the sampled position nearest before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, seen = int(self._at[i // SAMPLE]), int(self._before[i // SAMPLE])
        while seen + (c := int(self.high[byte]).bit_count()) <= i:
            byte, seen = byte + 1, seen + c
        bits = int(self.high[byte])
        for _ in range(i - seen):
            bits &= bits - 1
        where = byte * 8 + (bits & -bits).bit_length() - 1
        return ((where - i) << self.low_bits) | int(self._lows(np.array([i]))[0])

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """The numbers from the lo-th to before the hi-th: one scan from the sampled position before lo,
        over the bytes that hold their ones and no others."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, np.int64)
        byte, seen = int(self._at[lo // SAMPLE]), int(self._before[lo // SAMPLE])
        after = (hi - 1) // SAMPLE + 1  # the next sampled one stands behind all that are asked for
        last = int(self._at[after]) + 1 if after < len(self._at) else len(self.high)
        where = np.flatnonzero(np.unpackbits(self.high[byte:last], bitorder="little"))[lo - seen:hi - seen] + 8 * byte
        i = np.arange(lo, hi)
        return ((where - i) << self.low_bits) | self._lows(i)

    def values(self) -> np.ndarray:
        """All numbers in order (one pass over the unary part)."""
        where = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        i = np.arange(self.n)
        return ((where - i) << self.low_bits) | self._lows(i)

    def n_bytes(self) -> int:
        return len(self.low) + len(self.high)


# --- Tokenizing ---------------------------------------------------------

class TextEncoder:
    """Ids of whole texts from a byte-level BPE file of the ``tokenizers`` library.

    Byte-level BPE first cuts a text into words, and merges never cross words.
    A text of common characters is cut by the pattern of
    :func:`assaylake.llm.bpe.word_patterns` and the ids of its words, which the
    library gives, are remembered; any other text, and one that holds a special
    token's string, goes to the library whole. Both ways give the ids of
    ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.dtype = dtype
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.kind = {"<u2": "H", "<u4": "I"}[dtype]
        self.word, self.other = word_patterns(self.tok.pre_tokenizer.pre_tokenize_str)
        self.cache: dict[str, bytes] = {}  # by word

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = [array(self.kind, e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for a in found:
                a.byteswap()
        return [a.tobytes() for a in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        words: list[list[str]] = []
        plain, whole = [], []
        for i, t in enumerate(texts):
            if (t.isascii() or not self.other.search(t)) and not any(s in t for s in self.special):
                plain.append(i)
                words.append(self.word.findall(t))
            else:
                whole.append(i)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = list(set(chain.from_iterable(words)).difference(cache))
        cache.update(zip(new, self._ids(new)))
        for i, w in zip(plain, words):
            out[i] = b"".join(map(cache.__getitem__, w))
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = ids
        return out


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, dtype: str) -> TextEncoder:
    """The worker's encoder for this file (kept between tasks with its cache)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = TextEncoder(path, dtype)
    return _ENCODERS[path, dtype]


# --- Files --------------------------------------------------------------

def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID,
                      slice_texts: int = 256) -> DataFrame:
    """Write shards of ``docs(doc_id, text)`` under ``folder``; return their committed manifest.

    A null text is an empty one (its ids are the end id alone); rows with a
    null doc_id come first; repeated rows are written as often as they occur.
    ``folder`` is a URI that driver and executors share. The manifest has
    ``shard, path, n_docs, n_ids`` for every range that has rows; no rows give
    none. Other columns are ignored whatever their names; long texts are taken
    whole.
    """
    from tokenizers import Tokenizer
    vocab = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocab <= 1 << 16 else "<u4"

    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        store, base = _open_fs(folder)
        name = f"{base}/{shard:06d}-{uuid.uuid4().hex}"
        enc, end = encoder(tokenizer_path, dtype), np.array([end_id], dtype=dtype).tobytes()
        ids, lengths, sink = [], [], None
        for b in batches:
            for at in range(0, b.num_rows, slice_texts):
                part = b.slice(at, slice_texts)
                if sink is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(name + ".ids")
                texts = [t.decode("utf-8") for t in part.column("text").to_pylist()]
                coded = [x + end for x in enc.encode(texts)]
                sink.write(b"".join(coded))
                lengths.append(np.fromiter(map(len, coded), np.int64, len(coded)))
                ids.append(part.column("doc_id"))
        if sink is None:
            return
        sink.close()
        n_ids = np.concatenate(lengths) // np.dtype(dtype).itemsize
        flat = [x for a in ids for x in a.to_pylist()]
        known = np.array([x for x in flat if x is not None], dtype=np.int64)
        low = int(known[0]) if len(known) else 0
        head = np.array([MAGIC, np.dtype(dtype).itemsize, len(flat), int(n_ids.sum()),
                         len(flat) - len(known), low, VERSION], dtype="<i8")
        with store.open_output_stream(name + ".idx") as out:
            out.write(head.tobytes() + EliasFano.of(np.cumsum(n_ids)).to_bytes()
                      + EliasFano.of(known - low).to_bytes())
        yield batch_of(shard=np.array([shard]), path=[name], n_docs=np.array([len(flat)]),
                       n_ids=np.array([int(n_ids.sum())]))

    ranged = (with_key(docs).repartitionByRange("doc_id", "row_hash")
              .sortWithinPartitions("doc_id", "row_hash").select("doc_id", "text"))
    return cut_lineage(arrow_map(ranged, run, "shard long, path string, n_docs long, n_ids long"))


class TokenShard:
    """Random access to one shard: boundaries and doc_ids by ``select``, ids by slice."""

    def __init__(self, folder: str, path: str):
        store, _ = _open_fs(folder)
        with store.open_input_file(path + ".idx") as f:
            data = f.read()
        magic, self.width, self.n_docs, self.n_ids, self.n_null, self.low, _ = np.frombuffer(
            data, "<i8", 7).tolist()
        if magic != MAGIC:
            raise ValueError(f"no token index: {path}.idx")
        self.ends, at = EliasFano.from_bytes(data, 56)
        self.keys, _ = EliasFano.from_bytes(data, at)
        self.file = store.open_input_file(path + ".ids")
        self.dtype = f"<u{self.width}"

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.low + self.keys.select(i - self.n_null)

    def span(self, lo: int, hi: int) -> tuple[np.ndarray, list[int | None]]:
        """Ends and doc_ids of the documents from lo to before hi."""
        null = min(max(self.n_null - lo, 0), hi - lo)
        keys = self.keys.select_range(max(lo - self.n_null, 0), max(hi - self.n_null, 0)) + self.low
        return self.ends.select_range(lo, hi), [None] * null + keys.tolist()

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.read(a, b)

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids from a to b of the shard's concatenated array."""
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), self.dtype)


def read_token_files(manifest: DataFrame, folder: str, span_docs: int = 2048) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files.

    ``start`` counts the ids of all documents before it over all shards, in
    doc_id order; the sum over shards before is a window over one row a shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                s = TokenShard(folder, path)
                first = 0
                for lo in range(0, s.n_docs, span_docs):
                    hi = min(lo + span_docs, s.n_docs)
                    ends, keys = s.span(lo, hi)
                    starts = np.concatenate(([first], ends[:-1]))
                    ids = s.read(first, int(ends[-1])).astype("<u4")
                    crc = [zlib.crc32(ids[a:z]) for a, z in zip((starts - first).tolist(), (ends - first).tolist())]
                    yield batch_of(doc_id=pa.array(keys, pa.int64()), start=starts + base, n_tokens=ends - starts,
                                   ids_crc32=np.array(crc, dtype=np.int64))
                    first = int(ends[-1])

    return arrow_map(based.repartition("path"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def op8_token_files(spark, sf_dir):
    """Token files of all documents, and what is read back from them."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "token_files")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(manifest, folder)
