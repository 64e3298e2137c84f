"""Intersections of many packed sets with many others, as matrix products.

|a & b| is the product of two 0/1 vectors, and a float32 holds whole numbers up
to 2^24 exactly, so three left rows share one matrix row as the digits of a
number, 8 bits each. A product's digits must stay below 256: words are taken in
runs whose intersections cannot exceed that, and a set with more than half of
all bits is replaced by its complement, |a & b| = |b| - |~a & b|.
"""

from __future__ import annotations

import numpy as np

_DIGIT = 255     # most that a digit holds
_ROWS = 16       # left rows whose words are combined at a time: what is held then stays in the cache
_FEW_WORDS = 3   # fewer words than this are counted as they are


class Sets:
    """Packed rows, ordered by popcount: the left or right side of :func:`intersections`."""

    def __init__(self, w: np.ndarray, pc: np.ndarray):
        self.w, self.pc, self.bits = w, np.asarray(pc, np.int64), 64 * w.shape[1]
        self.full = int(np.searchsorted(self.pc, self.bits // 2, side="right"))  # from here on complements
        self._sums = self._left = self._right = None

    def __len__(self) -> int:
        return len(self.w)

    def _plain(self) -> np.ndarray:
        return np.concatenate((self.w[:self.full], ~self.w[self.full:])) if self.full < len(self.w) else self.w

    def _bits(self) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(self._plain()).astype("<u8").view(np.uint8), axis=1, bitorder="little")

    @property
    def sums(self) -> np.ndarray:
        """Bits before each word, by row."""
        if self._sums is None:
            self._sums = np.zeros((self.w.shape[1] + 1, len(self.w)), np.int32)
            np.cumsum(np.bitwise_count(self._plain()).T, axis=0, dtype=np.int32, out=self._sums[1:])
        return self._sums

    @property
    def left(self) -> np.ndarray:
        """Three rows in one: rows k, k + third and k + 2 * third."""
        if self._left is None:
            third, bits = -(-len(self.w) // 3), self._bits()
            self._left = bits[:third].astype(np.float32)
            for k in (1, 2):
                part = bits[k * third:(k + 1) * third]
                self._left[:len(part)] += part * np.float32(256 ** k)
        return self._left

    @property
    def right(self) -> np.ndarray:
        if self._right is None:
            self._right = self._bits().astype(np.float32)
        return self._right


def _runs(left: Sets, right: Sets) -> list[tuple[int, int]]:
    """Runs of words in which no two rows have more than ``_DIGIT`` bits in common."""
    runs, a, words = [], 0, left.w.shape[1]
    for z in range(1, words + 1):
        if z - a > 3 and min(int((s.sums[z] - s.sums[a]).max()) for s in (left, right)) > _DIGIT:
            runs.append((a, z - 1))
            a = z - 1
    return [*runs, (a, words)]


def counted(wl: np.ndarray, wr: np.ndarray) -> np.ndarray:
    """Bits in common of every left with every right row, word by word."""
    n, m, k = len(wl), len(wr), wl.shape[1]
    out, cols = np.zeros((n, m), np.int16 if 64 * k < 1 << 15 else np.int32), np.ascontiguousarray(wr.T)
    both, count = np.empty((_ROWS, m), np.uint64), np.empty((_ROWS, m), np.uint8)
    for s in range(0, n, _ROWS):
        rows = wl[s:s + _ROWS]
        acc, b, c = out[s:s + _ROWS], both[:len(rows)], count[:len(rows)]
        for j in range(k):
            np.bitwise_and(rows[:, j, None], cols[j], out=b)
            np.bitwise_count(b, out=c)
            acc += c
    return out


def intersections(left: Sets, right: Sets) -> np.ndarray:
    """Bits in common of every left with every right row."""
    n, m = len(left), len(right)
    if left.w.shape[1] < _FEW_WORDS or not n or not m:
        return counted(left.w, right.w)
    third = -(-n // 3)
    out = np.zeros((3 * third, m), np.int16 if left.bits < 1 << 15 else np.int32)
    product, digits = np.empty((third, m), np.float32), np.empty((third, m), "<i4")
    for a, z in _runs(left, right):
        np.matmul(left.left[:, 64 * a:64 * z], right.right[:, 64 * a:64 * z].T, out=product)
        np.copyto(digits, product, casting="unsafe")
        parts = digits.view(np.uint8).reshape(third, m, 4)
        for k in range(3):
            out[k * third:(k + 1) * third] += parts[:, :, k]
    out = out[:n]
    f, g, kind = left.full, right.full, out.dtype
    out[f:, :g] = right.pc[:g].astype(kind) - out[f:, :g]
    out[:f, g:] = left.pc[:f, None].astype(kind) - out[:f, g:]
    out[f:, g:] += (right.pc[g:] - left.bits).astype(kind)
    out[f:, g:] += left.pc[f:, None].astype(kind)
    return out
