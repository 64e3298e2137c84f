"""Packed bit-set fingerprints of text keys and named feature profiles.

A fingerprint is ``array<bigint>`` of ``n_bits / 64`` words (bit ``b`` is bit
``b % 64`` of word ``b // 64``) plus ``n_bits_set``; it is NULL when the
input is unusable (NULL or no token).

- :func:`hashed_fingerprint`: token n-grams (n = 1 .. radius + 1) of the
  whole text hashed into ``n_bits`` bits -- the circular-fingerprint idea
  (environments of growing radius, hashed and folded) applied to tokens.
  Tokens and shingles come from native functions; the bits are OR-ed by one
  ``groupBy(id)`` aggregate whose partial step runs before the shuffle, so
  only one row of words per document and task is shuffled.
- :func:`pattern_fingerprint`: one bit per pattern of a fixed dictionary
  (the substructure-key idea); a pure projection, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.numeric import fmt2, trunc_int
from assaylake.functions.text import word_tokens
from assaylake.operators.keys import qcol


def _grams(df: DataFrame, id_col: str, tokens_col: str, longest: int) -> tuple[DataFrame, list[Column]]:
    """``df`` with a row for each token and those that follow it, and the shingles of 1 .. ``longest`` tokens that start there.

    Shifted arrays are zipped and unnested, so shingles are joined, and hashed,
    in generated code instead of in a lambda called for each of them. Single
    tokens are taken once a text: their shingle is NULL on the rows left over.
    Shingles that would pass the end are NULL; a text without token keeps a row.
    """
    toks = qcol(tokens_col)
    shifted = [F.slice(toks, k + 1, F.greatest(F.size(toks) - k, F.lit(0))) for k in range(1, longest)]
    names = ["__once", *[f"__t{k}" for k in range(longest)]]
    zipped = F.arrays_zip(F.array_distinct(toks), toks, *shifted)
    rows = df.select(qcol(id_col), F.inline_outer(zipped).alias(*names))
    grams = [F.col("__once")]
    for n in range(2, longest + 1):
        parts = [p for k in range(n) for p in (F.lit(" "), F.col(f"__t{k}"))][1:]
        grams.append(F.concat(*parts))
    return rows, grams


def _bit_of(gram: Column, n_bits: int, hash_fn: str) -> Column:
    if hash_fn == "md5":
        h = F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("bigint")
    elif hash_fn == "xxhash64":
        h = F.when(gram.isNotNull(), F.xxhash64(gram))
    else:
        raise ValueError("hash_fn must be 'md5' or 'xxhash64'")
    return F.pmod(h, F.lit(n_bits))


def _pack(bit: Column, n_words: int) -> list[Column]:
    """Per-word bit_or aggregates of ``1 << (bit % 64)`` for ``bit // 64 == j``."""
    word = F.shiftright(bit, 6)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))
    return [F.bit_or(F.when(word == j, mask)).alias(f"__w{j}") for j in range(n_words)]


def _finish(df: DataFrame, id_col: str, n_words: int, out: str) -> DataFrame:
    words = [F.coalesce(F.col(f"__w{j}"), F.lit(0).cast("bigint")) for j in range(n_words)]
    present = F.lit(False)
    for j in range(n_words):
        present = present | F.col(f"__w{j}").isNotNull()
    fp = F.when(present, F.array(*words))
    count = sum((F.bit_count(w) for w in words), F.lit(0)).cast("int")
    return df.select(qcol(id_col), fp.alias(out),
                     F.when(present, count).alias("n_bits_set"))


def hashed_fingerprint(df: DataFrame, id_col: str, text_col: str, radius: int = 2,
                       n_bits: int = 1024, fold_case: bool = True, hash_fn: str = "md5",
                       out: str = "fp") -> DataFrame:
    """``(id, fp, n_bits_set)`` from token shingles of the whole text."""
    if n_bits % 64:
        raise ValueError("n_bits must be a multiple of 64")
    n_words = n_bits // 64
    tokens = df.select(qcol(id_col), word_tokens(qcol(text_col), fold_case).alias("__t"))
    rows, grams = _grams(tokens, id_col, "__t", radius + 1)
    bits = rows.select(qcol(id_col), F.explode(F.array(*[_bit_of(g, n_bits, hash_fn) for g in grams])).alias("__b"))
    packed = bits.groupBy(qcol(id_col)).agg(*_pack(F.col("__b"), n_words))
    return _finish(packed, id_col, n_words, out)


def sign_fingerprint(df: DataFrame, id_col: str, vector_col: str, n_words: int, out: str = "fp") -> DataFrame:
    """``(id, fp, n_bits_set)``: bit i set where element i is positive.

    NULL and empty vectors have no fingerprint; a vector of more than
    ``64 * n_words`` elements raises.
    """
    v = qcol(vector_col)

    def word(j):
        part = F.slice(v, 64 * j + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))

    words = [word(j) for j in range(n_words)]
    fits = F.size(v) <= 64 * n_words
    fp = F.when(F.size(v) > 0, F.when(fits, F.array(*words)).otherwise(
        F.raise_error(F.lit(f"vector longer than {64 * n_words} elements")).cast("array<bigint>")))
    count = sum((F.bit_count(w) for w in words), F.lit(0)).cast("int")
    return df.select(qcol(id_col), fp.alias(out), F.when(F.size(v) > 0, count).alias("n_bits_set"))


_META = set(".^$*+?{}[]\\|()")
_ESCAPES = {"n": "\n", "t": "\t"}


def _as_literal(pattern: str) -> str | None:
    """The plain text a pattern matches when it has no regex operator, else None."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in _ESCAPES:
                out.append(_ESCAPES[nxt])
            elif nxt in _META:
                out.append(nxt)
            else:
                return None
            i += 2
            continue
        if ch in _META:
            return None
        out.append(ch)
        i += 1
    return "".join(out)


def _doubled_letter(pattern: str) -> str | None:
    """``[Xx]{2}`` -> 'xx' (a match lower-cases to it; the converse needs the regex)."""
    import re
    m = re.fullmatch(r"\[([A-Z])([a-z])\]\{2\}", pattern)
    if m and m.group(1).lower() == m.group(2):
        return m.group(2) * 2
    return None


def pattern_test(text: Column, lowered: Column, pattern: str) -> Column:
    """Boolean "pattern occurs in text", exact, with cheap paths.

    A pattern without regex operators is a substring test; a doubled-letter
    class runs its regex only where the lower-cased text holds the pair.
    """
    lit = _as_literal(pattern)
    if lit is not None:
        return text.contains(lit)
    pair = _doubled_letter(pattern)
    if pair is not None:
        return lowered.contains(pair) & text.rlike(pattern)
    return text.rlike(pattern)


def pattern_fingerprint(df: DataFrame, id_col: str, text_col: str, patterns: Sequence[str],
                        out: str = "fp", keep: Sequence[str] = ()) -> DataFrame:
    """``(id, fp, n_bits_set, keep...)``: bit i set when ``patterns[i]`` is found."""
    n_words = max(1, (len(patterns) + 63) // 64)
    df = df.withColumn("__lower", F.lower(qcol(text_col)))
    text, lowered = qcol(text_col), F.col("__lower")
    words = []
    for j in range(n_words):
        w = F.lit(0).cast("bigint")
        for i in range(64 * j, min(64 * (j + 1), len(patterns))):
            bit = F.lit(1 << (i % 64) if i % 64 < 63 else -(1 << 63)).cast("bigint")
            hit = pattern_test(text, lowered, patterns[i])
            w = w.bitwiseOR(F.when(hit, bit).otherwise(F.lit(0).cast("bigint")))
        words.append(w)
    fp = F.when(text.isNotNull(), F.array(*words))
    count = sum((F.bit_count(w) for w in words), F.lit(0)).cast("int")
    return df.select(qcol(id_col), fp.alias(out), F.when(text.isNotNull(), count).alias("n_bits_set"),
                     *[qcol(c) for c in keep])


def profile_text(text_col: str, features: Sequence[tuple[str, object, str]],
                 out: str = "profile", shared=None) -> Column:
    """Render named features as ``name=value, ...``.

    ``features`` holds ``(name, fn, kind)``: ``fn`` maps the text column to a
    numeric Column; ``kind`` is ``'int'`` (truncated) or ``'2f'`` (two
    decimals). NULL input renders as ''. ``shared``, a function of the text,
    is evaluated once for each text, and its value passed to every ``fn`` as
    the second argument.
    """
    text = qcol(text_col)

    def rendered(*value) -> Column:
        parts = []
        for name, fn, kind in features:
            v = fn(text, *value)
            shown = trunc_int(v).cast("string") if kind == "int" else fmt2(v)
            parts.append(F.concat(F.lit(f"{name}="), shown))
        return F.concat_ws(", ", *parts)

    # A lambda binds the value: named twice in an expression it would be computed twice.
    shown = rendered() if shared is None else F.transform(F.array(shared(text)), lambda v: rendered(v))[0]
    return F.when(text.isNull(), F.lit("")).otherwise(shown).alias(out)
