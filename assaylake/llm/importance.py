"""Quality classifier by importance resampling.

Two generative bag-of-n-grams models over hashed buckets are counted: the raw
model over every document, the target model over labelled good documents. The
n-grams are word unigrams and bigrams, the beginnings of a word of several
lengths in letters, its end, and the word trigram that repeats one word. A document's log importance weight is
the sum of its n-grams' log ratios of target to raw, over the square root of
its length; ratios that are not clearly below one say nothing about quality
here and count as one. Adding Gumbel noise to ``sharpness`` times the log
weight and taking the k largest draws k documents without replacement with
probabilities in proportion to ``weight ** sharpness``.

Raw counts cover all documents: each task folds its words into one fixed-size
table, and the tables are summed block by block. What reaches the driver is
the summed table (its size is a parameter) and the scores of the bounded
sample of labelled documents.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import chain, repeat
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from assaylake.llm.common import arrow_map, batch_of, cut_lineage, mix64, slices, with_key
from assaylake.session import ensure_importable

LABEL_SAMPLE = 20_000  # labelled rows used, those with the smallest hash of their doc_id
PREFIX_LETTERS, SUFFIX_BYTES = (4, 5, 6), 3  # in letters: a stem with accents has more bytes
SPACES = (1 << 18, *[1 << 18 for _ in PREFIX_LETTERS], 1 << 16)  # buckets of words, beginnings and ends
PAIRS = 1 << 18  # buckets of word bigrams, after those of words
SMOOTHING = 0.3  # pseudo-count of a bucket in either model
CLEAR = -0.5  # log ratios above this count as zero
DEVIATIONS = 4.0  # and so do those whose target count is less than this many deviations short
SHARPNESS = 8.0
SEED = 42
BLOCK = 4096
FAN_IN = 32
TOTAL = sum(SPACES) + PAIRS
_SAME = b"\x00same"  # stands for the trigram of one word three times; no word holds a zero byte
_HELD_WORDS = 300_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def buckets(words: list[bytes]) -> np.ndarray:
    """Bucket numbers of each word's n-grams, one row for each space.

    The mark of a repeated word is no word: its beginnings and its end are empty.
    """
    out = np.empty((len(SPACES), len(words)), np.int64)
    plain = [b"" if w == _SAME else w for w in words]
    heads = [w[:4 * max(PREFIX_LETTERS)].decode("utf-8", "ignore") for w in plain]
    parts = (words, *[[h[:n] for h in heads] for n in PREFIX_LETTERS], [w[-SUFFIX_BYTES:] for w in plain])
    at = 0
    for row, (size, part) in enumerate(zip(SPACES, parts)):
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(row)), np.uint64, len(words))
        out[row] = (h % np.uint64(size)).astype(np.int64) + at
        at += size
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hash of each word from which those of its bigrams are made."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(len(SPACES))), np.uint64, len(words))


def pair_buckets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bucket numbers of word bigrams, from the words' hashes."""
    return (mix64(first * _GOLDEN + second) % np.uint64(PAIRS)).astype(np.int64) + sum(SPACES)


def ngrams(text: bytes) -> list[bytes]:
    """Words of a text, with one mark for every word that repeats the two before it.

    The bigrams are the neighbours in this list, but for those with a mark."""
    words = text.split()
    if not any(map(eq, words, words[2:])):
        return words
    return words + [_SAME] * sum(a == b == c for a, b, c in zip(words, words[1:], words[2:]))


class _Words(dict):
    """Words met since the last clearing, numbered, with their hashes by number."""

    def __init__(self):
        super().__init__()
        self.same = _hashes([_SAME])[0]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hashes = np.zeros(0, np.uint64)

    def learn(self, new: list[bytes]) -> None:
        self.update(zip(new, range(len(self), len(self) + len(new))))
        self.hashes = np.concatenate((self.hashes, _hashes(new)))

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Word numbers of all texts in a row with each one's text, and bigram buckets with theirs."""
        flat = list(chain.from_iterable(texts))
        new = set(flat).difference(self)
        if len(self) + len(new) > _HELD_WORDS:
            self.forget()
            new = set(flat)
        if new:
            self.learn(list(new))
        word = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        h = self.hashes[word]
        ok = (text[1:] == text[:-1]) & (h[1:] != self.same)  # marks stand behind the words
        return word, text, pair_buckets(h[:-1][ok], h[1:][ok]), text[1:][ok]


class _Table(_Words):
    """Raw and target counts of hashed n-grams; words are folded in whenever many distinct ones are held."""

    def __init__(self):
        self.counts, self.n = np.zeros((2, TOTAL), np.int64), np.zeros((2, 0), np.int64)
        super().__init__()

    def forget(self) -> None:
        if len(self):
            for row in buckets(list(self)):
                for k in range(2):
                    self.counts[k] += np.bincount(row, weights=self.n[k], minlength=TOTAL).astype(np.int64)
        self.n = np.zeros((2, 0), np.int64)
        super().forget()

    def learn(self, new: list[bytes]) -> None:
        super().learn(new)
        self.n = np.concatenate((self.n, np.zeros((2, len(new)), np.int64)), axis=1)

    def add(self, texts: list[list[bytes]], target: np.ndarray) -> None:
        """Count the n-grams of all texts, and as target those of the texts marked so."""
        word, text, pair, of = self.read(texts)
        for k, (w, p) in enumerate(((word, pair), (word[target[text]], pair[target[of]]))):
            self.n[k] += np.bincount(w, minlength=len(self))
            self.counts[k, sum(SPACES):] += np.bincount(p - sum(SPACES), minlength=PAIRS)


def count_ngrams(docs: DataFrame, target_ids: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts of all buckets, over every row of ``docs``."""
    def run(batches):
        table = _Table()
        for b in batches:
            for part in slices(b):
                ids = part.column("doc_id").to_pylist()
                table.add([ngrams(t) for t in part.column("text").to_pylist()],
                          np.fromiter((d in target_ids.value for d in ids), bool, len(ids)))
        table.forget()
        both = table.counts.reshape(2, -1, BLOCK)
        some = np.flatnonzero(both.any(axis=(0, 2)))
        yield batch_of(block=some, counts=pa.array([both[:, k].tobytes() for k in some.tolist()], pa.binary()))

    def total(pdf):
        import pandas as pd
        s = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [s.tobytes()], "part": pdf["part"].iloc[:1]})

    parts = arrow_map(with_key(docs), run, "block long, counts binary")
    out = np.zeros((2, TOTAL // BLOCK, BLOCK), np.int64)
    # FAN_IN tables of a block are summed at a time, until one is left, however many tasks there were.
    parts = cut_lineage(parts.withColumn("part", F.spark_partition_id()))
    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        most //= FAN_IN
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy(
            "block", "part").applyInPandas(total, "block long, counts binary, part int")
        if not most:
            break
    for r in parts.collect():
        out[:, r["block"]] = np.frombuffer(r["counts"], np.int64).reshape(2, BLOCK)
    return out[0].ravel(), out[1].ravel()


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING,
               clear: float = CLEAR, deviations: float = DEVIATIONS) -> np.ndarray:
    """Log of target to raw probability of each bucket, zero unless clearly negative.

    Twice the root of a count varies by chance with a standard deviation of
    about one, whatever the count, so that is how far a target count is short.
    """
    out, at = np.zeros(TOTAL), 0
    for size in (*SPACES, PAIRS):
        r, t = raw[at:at + size], target[at:at + size]
        expected = r * (t.sum() / max(r.sum(), 1))
        ratio = np.log((t + smoothing) / (expected + smoothing))
        sure = (ratio < clear) & (2 * (np.sqrt(expected + 0.375) - np.sqrt(t + 0.375)) >= deviations)
        out[at:at + size] = np.where(sure, ratio, 0.0)
        at += size
    out[buckets([_SAME])[1:, 0]] = 0.0  # the mark counts once, as a word
    return out


class _Scores(_Words):
    """Words with the summed log ratios of their own n-grams."""

    def __init__(self, ratios: np.ndarray):
        self.ratios = ratios
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.own = np.zeros(0)

    def learn(self, new: list[bytes]) -> None:
        super().learn(new)
        self.own = np.concatenate((self.own, self.ratios[buckets(new)].sum(axis=0)))


def log_weights(texts: list[bytes], scores: _Scores) -> list[float]:
    """Log importance weight of each text; zero without words."""
    split = [ngrams(t) for t in texts]
    word, text, pair, of = scores.read(split)
    total = (np.bincount(text, weights=scores.own[word], minlength=len(split))
             + np.bincount(of, weights=scores.ratios[pair], minlength=len(split)))
    return (total / np.sqrt(np.maximum(1, [len(w) for w in split]))).tolist()


def gumbel(doc_id: Column, row_hash: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise from the row's key; the same under any partitioning."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, row_hash), 11).cast("double")
    return -F.log(-F.log((h + 0.5) / float(1 << 53)))


def scored(docs: DataFrame, model: Broadcast, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``row_hash, log_weight, perturbed``; the rows keep their place."""
    ensure_importable(docs.sparkSession)

    @F.arrow_udf(DoubleType())
    def weight(text: pa.Array) -> pa.Array:
        held, out = _scores_of(model.value), []
        for part in slices(batch_of(text=text)):
            out += log_weights(part.column("text").to_pylist(), held)
        return pa.array(out, pa.float64())

    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"row_hash": F.xxhash64(text), "log_weight": weight(text.cast("binary"))})
    noise = gumbel(F.col("doc_id").cast("bigint"), F.col("row_hash"), seed)
    return out.withColumn("perturbed", sharpness * F.col("log_weight") + noise)


_HELD: dict[str, _Scores] = {}


def _scores_of(model: tuple[str, np.ndarray]) -> _Scores:
    """The worker's word scores for this model (kept between batches and tasks)."""
    name, ratios = model
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = _Scores(ratios)
    return _HELD[name]


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """Exact k-th largest double of a column, by four counting passes over 16 bits each.

    None if there are fewer than k values. Nothing is sorted, and a pass
    returns at most 65,536 counts.
    """
    # Doubles in the order of their bits: flip all bits of negatives, the sign bit of the rest.
    def ordered(rows):
        for b in rows:
            bits = b.column(0).to_numpy(zero_copy_only=False).astype(np.float64).view(np.uint64)
            sign = np.uint64(1 << 63)
            yield batch_of(v=np.where(bits & sign, ~bits, bits | sign).view(np.int64))

    v = cut_lineage(arrow_map(values.select(F.col(column).cast("double")).where(F.col(column).isNotNull()),
                              ordered, "v long"))
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        here = v if shift == 48 else v.where(F.shiftrightunsigned("v", shift + 16) == F.lit(prefix))
        digit = F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(0xFFFF))
        for r in sorted(here.groupBy(digit.alias("d")).count().collect(), key=lambda r: -r["d"]):
            if left <= r["count"]:
                prefix = (prefix << 16) | r["d"]
                break
            left -= r["count"]
        else:
            return None
    bits = np.array([prefix], np.uint64)
    sign = np.uint64(1 << 63)
    return float(np.where(bits & sign, bits ^ sign, ~bits).view(np.float64)[0])


@dataclass
class Selection:
    """What ``fit`` found: the model, the number of documents to draw and the last one's value."""

    model: Broadcast
    k: int
    least: float  # k-th largest perturbed log weight; -inf if all stay
    scores: DataFrame  # doc_id, row_hash, log_weight, perturbed of every document


def best_cut(values: np.ndarray, good: np.ndarray) -> float:
    """Cut that parts good (above) from other rows with the fewest errors.

    -inf if one kind is missing. Cuts that reject half of the good rows or more are not considered.
    """
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(values, kind="stable")
    v, g = values[order], good[order]
    errors = np.concatenate(([0], np.cumsum(g))) + (~g).sum() - np.concatenate(([0], np.cumsum(~g)))
    errors[1:-1][v[1:] == v[:-1]] = len(v) + 1  # equal values stay together
    errors[np.concatenate(([0], np.cumsum(g))) >= max(1, g.sum() / 2)] = len(v) + 1
    at = int(errors.argmin())
    return -np.inf if at == 0 else float((v[at - 1] + v[at]) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample: int = LABEL_SAMPLE, sharpness: float = SHARPNESS,
        seed: int = SEED, k: int | None = None, carry: bool = False) -> Selection:
    """Count both models and settle how many documents to draw.

    Of the labelled rows at most ``sample`` are used: half of the good ones
    (quality 1, not toxic) make the target model, the other half and the
    other rows of that half give the cut of the perturbed weights with the
    fewest errors, and ``k`` is the number of documents above it. Rows with
    a null id or label are ignored; of repeated ids the worst labels count.
    Without good labelled documents, or without other ones, all stay. With
    ``carry`` the scores hold the documents' rows, as column ``row``.
    """
    spark = docs.sparkSession
    known = (labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id")
             .agg(F.min("quality").alias("q"), F.max("toxic").alias("t")))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = known.orderBy(order, "doc_id").limit(sample).select(
        "doc_id", ((F.col("q") == 1) & (F.col("t") == 0)).alias("good"),
        (order.bitwiseAND(F.lit(1)) == 0).alias("train")).collect()
    sc = spark.sparkContext
    raw, target = count_ngrams(docs, sc.broadcast(frozenset(r["doc_id"] for r in rows if r["train"] and r["good"])))
    model = sc.broadcast((uuid.uuid4().hex, log_ratios(raw, target) if target.any() else np.zeros(TOTAL)))
    held_out = [(r["doc_id"], r["good"]) for r in rows if not r["train"]]
    marks = F.broadcast(spark.createDataFrame(held_out, "id long, good boolean"))
    marked = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("id"))
    seen = (scored(marked, model, sharpness, seed)
            .groupBy("id").agg(F.min("perturbed").alias("v"), F.first("good").alias("good")).collect())
    cut = best_cut(np.array([r["v"] for r in seen], float), np.array([r["good"] for r in seen], bool)) \
        if target.any() else -np.inf
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    scores = cut_lineage(scored(docs.select("doc_id", "text", *carried), model, sharpness, seed).drop("text"))
    if k is None:
        k = scores.where(F.col("perturbed") >= F.lit(cut)).count()
    least = kth_largest(scores, "perturbed", k) if k else np.inf
    return Selection(model, k, -np.inf if least is None else least, scores)


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """``docs`` with ``row_hash, log_weight, perturbed, kept``: kept is the Gumbel top k.

    Null and empty texts have log weight zero; a null doc_id is part of the
    noise's key like any other. Rows that tie with the k-th are kept with it
    (only rows equal in id and text tie). Columns of ``docs`` with one of the
    four names are replaced.
    """
    docs = docs.drop("row_hash", "log_weight", "perturbed", "kept")
    found = fit(docs, labels, k=k)
    return scored(docs, found.model).withColumn("kept", F.col("perturbed") >= F.lit(found.least))


def keep_drawn(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, all columns kept; texts are scored once and no row is shuffled."""
    found = fit(docs, labels, k=k, carry=True)
    return found.scores.where(F.col("perturbed") >= F.lit(found.least)).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_quality_classifier(spark, sf_dir):
    """Log importance weight of every document and whether the resampling keeps it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = fit(docs, labels)
    return found.scores.select("doc_id", "log_weight", (F.col("perturbed") >= F.lit(found.least)).alias("kept"))
