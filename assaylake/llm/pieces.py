"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

Every segmentation of a text into the model's pieces is a path in a lattice.
A piece weighs ``1 / (rank + 1) ** alpha`` by its rank in the model, and a
segmentation is drawn with probability in proportion to the product of its
weights: a forward pass sums the weights of all paths to every position, a
backward pass draws the last piece, then the one before it, and so on. The
random numbers are hashes of the row's key and the place, so a row's
segmentation is the same on every run and under any partitioning.

No piece holds a blank mark after another character, so paths never cross the
place before a blank, and the lattice falls apart into units (a word with the
blanks before it). Units met before keep their filtered lattice; the backward
draws of all units of a batch are made together. Characters outside the
model's alphabet, and the blank mark itself, become byte pieces: any text is
encoded, and decoding gives it back byte for byte.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assaylake.llm.common import arrow_map, batch_of, mix64, slices, with_key

ALPHA = 0.5
SEED = 42
MARK = "▁"  # stands for a blank in pieces
_UNITS = re.compile(" *[^ \n▁]+|[\n▁]| +")
_HELD_UNITS = 100_000  # units whose lattices a worker holds; only speed depends on it
_LONG = 64  # characters; longer units are filtered one by one, with rescaling
_BLOCK = 100_000  # units drawn together
_SLICE_BYTES = 1_000_000  # text segmented together, at least one whole text
_GOLDEN = 0x9E3779B97F4A7C15


class PieceModel:
    """Pieces, weights and byte ids of a SentencePiece model file."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        other = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.pieces: dict[str, tuple[int, float]] = {}
        self.text = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.text[i] = bytes([int(piece[3:-1], 16)])
            elif not other[i]:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {i} holds a blank after another character")
                blank = piece.replace(MARK, " ")
                self.pieces[blank] = (i, float(len(self.pieces) + 1) ** -alpha)
                self.text[i] = blank.encode()
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self._trie()
        self.forget()

    def _trie(self) -> None:
        """Trie of the pieces as sorted keys ``node << 21 | code point`` with the node each leads to."""
        nodes = {"": 0}
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        edges = sorted((nodes[s[:-1]] << 21 | ord(s[-1]), v) for s, v in nodes.items() if s)
        self._edge = np.array([e for e, _ in edges], np.int64)
        self._to = np.array([v for _, v in edges], np.int64)
        self._id = np.full(len(nodes), -1, np.int32)
        self._weight = np.zeros(len(nodes))
        for p, (i, w) in self.pieces.items():
            self._id[nodes[p]], self._weight[nodes[p]] = i, w

    def forget(self) -> None:
        """Forget all lattices. Row r's candidates stand from ``begin[r]`` on, ``end[r]`` excluded."""
        self.rows: dict[str, int] = {}  # unit -> row of its first character
        self._n_rows = self._n_cands = 0
        self._end = np.zeros(1 << 16, np.int64)
        self._begin = np.zeros(1 << 16, np.int64)
        self._size = np.zeros(1 << 16, np.int64)  # characters of the unit, in its first row
        self._cum = np.zeros(1 << 17)
        self._len = np.zeros(1 << 17, np.int32)
        self._pid = np.zeros(1 << 17, np.int32)

    def _append(self, counts, cum, length, pid) -> int:
        """Add rows with their candidates; returns the first row's number."""
        r, c = self._n_rows, self._n_cands
        for names, need in ((("_end", "_begin", "_size"), r + len(counts)), (("_cum", "_len", "_pid"), c + len(cum))):
            for name in names:
                if need > len(a := getattr(self, name)):
                    setattr(self, name, np.concatenate((a, np.zeros(max(len(a), need - len(a)), a.dtype))))
        ends = c + np.cumsum(counts)
        self._end[r:r + len(counts)], self._begin[r:r + len(counts)] = ends, ends - counts
        z = c + len(cum)
        self._cum[c:z], self._len[c:z], self._pid[c:z] = cum, length, pid
        self._n_rows, self._n_cands = r + len(counts), z
        return r

    def _candidates(self, units: list[str]):
        """``(start, length, id, weight)`` of every piece in every unit, over the joined characters.

        A character without a piece of its own has the id ``-1 - code point``.
        """
        text = "".join(units)
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        last = np.repeat(np.cumsum(sizes), sizes)  # end of each character's unit
        at, node, k = np.arange(len(cps)), np.zeros(len(cps), np.int64), 0
        found = []
        while len(at):
            key = node << 21 | cps[at + k]
            e = np.minimum(np.searchsorted(self._edge, key), len(self._edge) - 1)
            ok = self._edge[e] == key
            at, node, k = at[ok], self._to[e[ok]], k + 1
            whole = self._id[node] >= 0
            found.append((at[whole], np.full(int(whole.sum()), k), self._id[node[whole]], self._weight[node[whole]]))
            more = at + k < last[at]
            at, node = at[more], node[more]
        single = np.zeros(len(cps), bool)
        single[found[0][0]] = True
        bare = np.flatnonzero(~single | (cps == ord(MARK)))
        found.append((bare, np.ones(len(bare), np.int64), (-1 - cps[bare]).astype(np.int32), np.ones(len(bare))))
        return sizes, *map(np.concatenate, zip(*found))

    def _learn(self, units: list[str]) -> None:
        """Filter the lattices of new units forward, all units of up to ``_LONG`` characters at once."""
        short = [u for u in units if len(u) <= _LONG]
        if short:
            sizes, start, length, pid, weight = self._candidates(short)
            n = int(sizes.sum())
            first = np.cumsum(sizes) - sizes
            unit_of = np.repeat(np.arange(len(sizes)), sizes)
            end = start + length - 1  # row: the piece's last character
            order = np.lexsort((end, end - first[unit_of[end]]))  # by depth in the unit, then by row
            start, length, pid, weight, end = (x[order] for x in (start, length, pid, weight, end))
            depth = end - first[unit_of[end]]
            share = np.empty(len(start))
            before = np.concatenate(([True], unit_of[1:] != unit_of[:-1]))
            total = np.zeros(n)  # summed weights of all paths to the end of each character
            cuts = np.searchsorted(depth, np.arange(int(sizes.max()) + 1))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                s = start[a:z]
                into = np.where(before[s], 1.0, total[s - 1]) * weight[a:z]
                row, where = np.unique(end[a:z], return_inverse=True)
                sums = np.bincount(where, weights=into)
                total[row] = sums
                share[a:z] = into / sums[where]
            order = np.argsort(end, kind="stable")
            end, share = end[order], share[order]
            counts = np.bincount(end, minlength=n)
            r = self._append(counts, np.cumsum(share) - end, length[order], pid[order])
            self._size[first + r] = sizes
            self.rows.update(zip(short, (first + r).tolist()))
        for u in units:
            if len(u) > _LONG:
                self._learn_long(u)

    def _learn_long(self, unit: str) -> None:
        _, start, length, pid, weight = self._candidates([unit])
        order = np.argsort(start + length, kind="stable")
        start, length, pid, weight = (x[order] for x in (start, length, pid, weight))
        counts = np.bincount(start + length - 1, minlength=len(unit))
        forward, share = [1.0], []
        rows = iter(zip(start.tolist(), weight.tolist()))
        for n in counts.tolist():
            into = [forward[s] * w for s, w in (next(rows) for _ in range(n))]
            total = sum(into)
            share += [x / total for x in into]
            forward.append(total)
            if total < 1e-150:  # only the ratios within the reach of a piece matter
                for y in range(max(0, len(forward) - _LONG), len(forward)):
                    forward[y] *= 1e150
        cum = np.cumsum(share) - np.repeat(np.arange(len(unit)), counts)
        self.rows[unit] = r = self._append(counts, cum, length, pid)
        self._size[r] = len(unit)

    def _draw(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all units in a row, and the number of ids of each; ``keys``: one for each unit."""
        if len(self.rows) > _HELD_UNITS:
            self.forget()
        new = list({u for u in units if u not in self.rows})
        if new:
            self._learn(new)
        first = np.fromiter(map(self.rows.__getitem__, units), np.int64, len(units))
        left = self._size[first]
        live, step, drawn = np.arange(len(units)), 0, []
        while len(live):
            u = (mix64(keys[live] + np.uint64(step * _GOLDEN & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            rows = first[live] + left[live] - 1
            j, end = self._begin[rows], self._end[rows] - 1
            on = np.flatnonzero((self._cum[j] <= u) & (j < end))
            while len(on):
                j[on] += 1
                on = on[(self._cum[j[on]] <= u[on]) & (j[on] < end[on])]
            drawn.append((live, self._pid[j]))
            rest = left[live] - self._len[j]
            left[live] = rest
            live = live[rest > 0]
            step += 1
        n = np.zeros(len(units), np.int64)
        for who, _ in drawn:
            n[who] += 1
        ends, ids = np.cumsum(n), np.empty(int(n.sum()), np.int32)
        for step, (who, pid) in enumerate(drawn):
            ids[ends[who] - 1 - step] = pid
        if (ids < 0).any():
            coded = [self.byte_id[list(chr(-1 - i).encode())] for i in ids[ids < 0].tolist()]
            width = np.ones(len(ids), np.int64)
            width[ids < 0] = [len(c) for c in coded]
            n = np.add.reduceat(width, ends - n)
            ids = np.repeat(ids, width)
            ids[ids < 0] = np.concatenate(coded)
        return ids, n

    def sample(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
        """Sampled piece ids of each text; ``keys`` are unsigned 64-bit row keys."""
        split = [_UNITS.findall(" " + t) if t else [] for t in texts]
        per_text = np.array([len(s) for s in split], np.int64)
        flat = [u for s in split for u in s]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        key = np.repeat(mix64((keys ^ np.uint64(seed)) + np.uint64(_GOLDEN)), per_text) + place.astype(np.uint64)
        key = mix64(key)
        parts = [self._draw(flat[a:a + _BLOCK], key[a:a + _BLOCK]) for a in range(0, len(flat), _BLOCK)]
        if not parts:
            return [np.zeros(0, np.int32) for _ in texts]
        ids, n = map(np.concatenate, zip(*parts))
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(per_text)]
        return np.split(ids, ends[:-1])

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids from ``sample``; the blank put before the text goes."""
        return b"".join(map(self.text.__getitem__, ids))[1:].decode()


_MODELS: dict[tuple[str, float], PieceModel] = {}


def model(path: str, alpha: float) -> PieceModel:
    """The worker's model (kept between tasks; lattices are forgotten at a task's end)."""
    if (path, alpha) not in _MODELS:
        _MODELS[path, alpha] = PieceModel(path, alpha)
    return _MODELS[path, alpha]


def encode_texts(docs: DataFrame, model_path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``doc_id, row_hash, ids, lossless``: one sampled segmentation of every row's whole text.

    The row's key is its doc_id (null counts as zero) and its text's hash, so
    rows equal in both get the same segmentation. Null and empty texts have no
    pieces. ``lossless`` tells that decoding the ids gave the text back.
    """
    def run(batches):
        m = model(model_path, alpha)
        for b in batches:
            for part in slices(b, size=_SLICE_BYTES):
                texts = [t.decode() for t in part.column("text").to_pylist()]
                known = part.column("doc_id").fill_null(0).to_numpy().view(np.uint64)
                ids = m.sample(texts, part.column("row_hash").to_numpy().view(np.uint64) ^ mix64(known), seed)
                same = [m.decode(i.tolist()) == t for i, t in zip(ids, texts)]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                yield batch_of(doc_id=part.column("doc_id"), row_hash=part.column("row_hash"),
                               ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                               lossless=pa.array(same, pa.bool_()))
        m.forget()

    return arrow_map(with_key(docs), run, "doc_id long, row_hash long, ids array<int>, lossless boolean")


def decode_ids(encoded: DataFrame, model_path: str, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, row_hash, text`` from the ids of ``encode_texts``; no ids give the empty text."""
    def run(batches):
        m = model(model_path, alpha)
        for b in batches:
            yield batch_of(doc_id=b.column("doc_id"), row_hash=b.column("row_hash"),
                           text=pa.array([m.decode(i or []) for i in b.column("ids").to_pylist()], pa.string()))

    return arrow_map(encoded.select("doc_id", "row_hash", "ids"), run, "doc_id long, row_hash long, text string")


def op4_sentencepiece(spark, sf_dir):
    """A sampled segmentation of every document, and whether decoding gave its text back."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "ids", "lossless")
