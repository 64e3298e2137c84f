"""Text column functions: suffixes, components, tokens, answer pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The answer-parsing pattern of the workflow. A property name
# (word characters, optionally hyphen-joined) followed by '=' and a number
# with a decimal point. (?U) makes Java's \w and \d Unicode-aware, as
# Python's are.
ANSWER_PAIR_REGEX = r"(?U)(\w+(?:-\w+)*?)=(-?\d+\.\d+)"
# ---------------------------------------------------------------------------

# Word separator for shingle tokens: anything but a Unicode letter or digit.
TOKEN_SPLIT_REGEX = r"[^\p{L}\p{N}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension_suffix(c) -> Column:
    """Suffix from the first '|' (inclusive), else ''. NULL stays NULL."""
    c = _c(c)
    pos = F.instr(c, "|")
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(pos > 0, c.substr(pos, F.length(c)))
            .otherwise(F.lit("")))


def largest_component(c, sep: str = ".") -> Column:
    """Longest ``sep``-separated component; the first one wins a tie."""
    import re
    parts = F.split(_c(c), re.escape(sep))
    return F.aggregate(parts, F.lit(""),
                       lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))


def word_tokens(c, fold_case: bool = True) -> Column:
    """Array of non-empty letter/digit runs of the whole text."""
    c = _c(c)
    if fold_case:
        c = F.lower(c)
    return F.filter(F.split(c, TOKEN_SPLIT_REGEX), lambda t: t != F.lit(""))


def answer_names(c) -> Column:
    return F.regexp_extract_all(F.trim(_c(c)), F.lit(ANSWER_PAIR_REGEX), 1)


def answer_values(c) -> Column:
    return F.regexp_extract_all(F.trim(_c(c)), F.lit(ANSWER_PAIR_REGEX), 2)
