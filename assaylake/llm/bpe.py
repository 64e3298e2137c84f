"""Byte-level BPE by backtracking, in time linear in the text.

BPE applies the merge of lowest rank, leftmost first, until none is left. Its
result is the only sequence of tokens whose neighbours are all *compatible*:
two tokens are compatible if BPE, run on the bytes of both, never merges
across their border. So no merge has to be replayed:

* one Aho-Corasick pass finds the longest token that starts at each place;
* tokens are laid from the left, longest first, and a token stays only if it
  is compatible with the one before it. Else its longest prefix that is a
  token is tried; where none is left, the place is dead and the token before
  it is taken back. No place dies twice, so the work is linear;
* compatibility is looked up in a table, filled as pairs are met.

Decoding gathers the tokens' bytes from one blob by an offset table.

Texts are cut into words as the tokenizer's pre-tokenizer does. For the common
characters (``COMMON``) it is asked once for the class of each, and a pattern
of these classes cuts the text. A word starts at every blank that a visible
character follows, so a text with other characters is first cut there, and the
parts that hold some go to the pre-tokenizer itself. A worker remembers the ids
of the words it has met.
"""

from __future__ import annotations

import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow_map, batch_of, slices, table, with_key

CACHE_BYTES = 96_000_000  # of words and their ids that a worker remembers; only speed depends on it
PAIRS = 1_000_000         # entries of the compatibility table before it is started anew
STRETCH = 1_000_000       # characters whose words are held at a time
COMMON = [*range(0x250), *range(0x2000, 0x2070)]  # Latin letters, digits, marks and blanks
_CUT = re.compile(r" (?=\S)")


def word_patterns(split) -> tuple[re.Pattern, re.Pattern]:
    """Pattern of the words of a text of common characters, and of any other character.

    ``split`` is the pre-tokenizer's function of a text; it is asked once for
    the class of each common character.
    """
    classes: dict[str, list[str]] = {"letter": [], "number": [], "mark": [], "blank": []}
    for ch in map(chr, COMMON):
        kind = next((k for k, first in (("letter", "a"), ("number", "1"), ("mark", "!"))
                     if len(split(first + ch)) == 1), "blank")
        classes[kind].append(re.escape(ch))
    letter, number, mark, blank = ("".join(c) for c in classes.values())
    # Fixed value: the pattern of byte-level pre-tokenizers, with the classes written out.
    word = (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[{mark}]+"
            f"|[{blank}]+(?![^{blank}])|[{blank}]+")
    return re.compile(word), re.compile("[^" + "".join(re.escape(chr(c)) for c in COMMON) + "]")


class BytePairs:
    """Encoder and decoder for one ``tokenizers`` file of a byte-level BPE.

    ``encode`` equals the library's ``encode(text, add_special_tokens=False)``
    without truncation and padding, ``decode`` its ``decode(ids,
    skip_special_tokens=False)``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _require(spec)
        self._split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._specials = re.compile("|".join(
            re.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None

        size = 1 + max([*vocab.values(), *self.added.values()])
        self.words: list[str] = [""] * size  # in the alphabet that stands for bytes
        for word, i in vocab.items():
            self.words[i] = word
        self.length = list(map(len, self.words))
        self._merges(spec["model"]["merges"], vocab)
        self.prefix = [next((vocab[w[:k]] for k in range(len(w) - 1, 0, -1) if w[:k] in vocab), -1)
                       for w in self.words]
        self.search = ahocorasick.Automaton()
        for word, i in vocab.items():
            self.search.add_word(word, i)
        self.search.make_automaton()

        raw = byte_alphabet()
        pieces = [bytes(raw[c] for c in w) for w in self.words]
        for word, i in self.added.items():
            pieces[i] = word.encode()
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces], dtype=np.int64)))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._known: dict[str, bytes] = {}
        self._held = 0
        self._alphabet = {b: c for c, b in raw.items()}
        self._word, self._other = word_patterns(self._split)

    def _merges(self, merges, vocab) -> None:
        """Rank, halves and result of every merge."""
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = [-1] * len(self.words)
        self.halves: list[tuple[int, int] | None] = [None] * len(self.words)
        for k, m in enumerate(merges):
            left, right = m if isinstance(m, list) else m.split(" ")
            both = vocab[left + right]
            if self.rank[both] >= 0:
                raise ValueError(f"two merges give token {both}")
            self.rank[both], self.halves[both] = k, (vocab[left], vocab[right])
            self.merged[vocab[left], vocab[right]] = both

    # --- encoding -----------------------------------------------------------

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one edge of ``token`` while it is built, first byte first."""
        out = [token]
        while (h := self.halves[out[-1]]) is not None:
            out.append(h[side])
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps the border between ``a`` and ``b``.

        Plays the building of both forward: at each moment one token stands
        at either side of the border, until the next merge replaces one. A
        merge across the border comes first if its rank is below that of the
        next merge on the left, and not above that of the next on the right
        (among equal ranks BPE takes the leftmost).
        """
        if (known := self._pairs.get((a, b))) is not None:
            return known
        left, right, never = self._edge(a, 1), self._edge(b, 0), len(self.rank)
        i = j = 0
        good = True
        while good:
            next_l = self.rank[left[i + 1]] if i + 1 < len(left) else never
            next_r = self.rank[right[j + 1]] if j + 1 < len(right) else never
            across = self.merged.get((left[i], right[j]))
            if across is not None and self.rank[across] < next_l and self.rank[across] <= next_r:
                good = False
            elif next_l == never and next_r == never:
                break
            elif next_l <= next_r:
                i += 1
            else:
                j += 1
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        self._pairs[a, b] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-tokenized word, given in the byte alphabet."""
        longest = [-1] * len(word)
        for end, i in self.search.iter(word):
            longest[end + 1 - self.length[i]] = i  # later ends are longer
        dead = bytearray(len(word) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(word):
            end = at + self.length[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(word) else -1
            elif (token := self.prefix[token]) < 0:
                dead[at] = 1
                token = out.pop()  # its end is dead now: a prefix of it is next
                at -= self.length[token]
        return out

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not self._other.search(text):
            return self._word.findall(text)
        out = []
        for k, part in enumerate(_CUT.split(text)):
            part = " " + part if k else part
            if self._other.search(part):
                out += [part[a:z] for _, (a, z) in self._split(part)]
            else:
                out += self._word.findall(part)
        return out

    def _new(self, word: str) -> bytes:
        ids = self.encode_word(word.encode().decode("latin-1").translate(self._alphabet))
        coded = np.array(ids, "<u4").tobytes()
        size = 4 * len(word) + len(coded) + 200
        if self._held + size > CACHE_BYTES:
            self._known.clear()
            self._held = 0
        if size <= CACHE_BYTES // 64:
            self._known[word] = coded
            self._held += size
        return coded

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens, a stretch at a time."""
        out, at, known = [], 0, self._known
        while at < len(text):
            cut = _CUT.search(text, at + STRETCH) if at + STRETCH < len(text) else None
            end = cut.start() if cut else len(text)
            out.append(b"".join([known.get(w) or self._new(w) for w in self._words(text[at:end])]))
            at = end
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text (uint32); the strings of added tokens in it are those tokens."""
        out, at = [], 0
        for m in self._specials.finditer(text) if self._specials else ():
            out += [self._plain(text[at:m.start()]), np.array([self.added[m.group()]], "<u4").tobytes()]
            at = m.end()
        out.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(out), "<u4")

    # --- decoding -----------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, gathered from the blob by the offset table."""
        ids = ids.astype(np.int64)
        first = self.offsets[ids]
        size = self.offsets[ids + 1] - first
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        where = np.repeat(first - ends + size, size) + np.arange(ends[-1])
        return self.blob[where].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, as in the library."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def byte_alphabet() -> dict[str, int]:
    """Byte by the character that stands for it: visible Latin-1 ones for
    themselves, the others for U+0100 and on in ascending order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _require(spec: dict) -> None:
    """Only what the method covers: plain byte-level BPE over all bytes, added tokens taken as they stand."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = [name for name, bad in {
        "normalizer": spec.get("normalizer"), "pre-tokenizer": pre.get("type") != "ByteLevel",
        "prefix space": pre.get("add_prefix_space"), "words uncut": not pre.get("use_regex", True),
        "model": model["type"] != "BPE", "dropout": model.get("dropout"),
        "ignore_merges": model.get("ignore_merges"), "prefixes": model.get("continuing_subword_prefix"),
        "word ends": model.get("end_of_word_suffix"), "decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "bytes": not set(byte_alphabet()) <= set(model["vocab"]),
        "added tokens": any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]),
    }.items() if bad]
    if odd:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(odd)}")


_LOADED: dict[str, BytePairs] = {}


def byte_pairs(path: str) -> BytePairs:
    """The worker's encoder for this file (kept between tasks with its tables)."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids binary, decoded binary`` of every row of ``docs(doc_id, text)``.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` is UTF-8.
    One row for each row: a null text is an empty one (no ids, nothing
    decoded), a null doc_id stays null, repeated rows are repeated, other
    columns are ignored whatever their names, an empty table gives no rows.
    Whole texts are taken, about 2 MB of them at a time; a longer text alone.
    """
    def run(batches):
        coder = byte_pairs(tokenizer_path)
        for b in batches:
            for part in slices(b):
                ids = [coder.encode(t.decode("utf-8", "replace")) for t in part.column("text").to_pylist()]
                yield batch_of(doc_id=part.column("doc_id"),
                               ids=pa.array([x.tobytes() for x in ids], pa.binary()),
                               decoded=pa.array([coder.decode(x).encode() for x in ids], pa.binary()))

    return arrow_map(with_key(docs).select("doc_id", "text"), run, "doc_id long, ids binary, decoded binary")


def op13_bpe(spark, sf_dir):
    """Ids of all documents and what they decode to, as digests."""
    import public_tokenizers
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
