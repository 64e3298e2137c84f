"""Quality rules, lines first.

Each line with a word is judged by rules on its punctuation (it ends like a
sentence, does not shout, and is not made of symbols), on navigation (entries
between separators) and on boilerplate phrases. Failing lines are removed. A
document is then rejected if the lines removed held more than ``max_lost`` of
its words, or if it fails the base rules on its whole text: fewer than 50
words, or over half of its words in three-word windows that it repeats.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow_map, batch_of, slices, with_key

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_LOST_PCT = 50
SHOUTS = 3
SYMBOL_SHARE = 10  # a symbol for every so many words fails a line
# Patterns are the same text for Python and for DuckDB.
SENTENCE_END = r"""[.!?…:;,"'”’»)\]][ \t\r\v\f]*$"""
SHOUT = r"!!|\?\?"
SYMBOL = r"[#*$%&|<>{}]"
SEPARATORS = r"(?:[|»›·•>].*){2}"
BOILERPLATE = (r"(?i)lorem ipsum|enable javascript|cookie policy|privacy policy|terms of (?:use|service)|"
               r"all rights reserved|click here|sign in|sign up|powered by|skip to content|back to top")
BASE_SYMBOLS = "#*$%&|<>"
_END, _SHOUT, _SYMBOL, _NAV, _BOILER = map(re.compile, (SENTENCE_END, SHOUT, SYMBOL, SEPARATORS, BOILERPLATE))
_SPACES = " \t\n\v\f\r"


def n_words(text: str) -> int:
    return len(text.encode().split())


def line_fails(line: str, words: int) -> bool:
    """Whether a line of so many words breaks a punctuation, navigation or boilerplate rule."""
    return (not _END.search(line) or len(_SHOUT.findall(line)) >= SHOUTS
            or SYMBOL_SHARE * len(_SYMBOL.findall(line)) > words
            or _NAV.search(line) is not None or _BOILER.search(line) is not None)


def judge_lines(text: str) -> tuple[str, int]:
    """The text without failing lines, and the words they held. Lines without words stay."""
    kept, lost = [], 0
    for line in text.split("\n"):
        n = n_words(line)
        if n and line_fails(line, n):
            lost += n
        else:
            kept.append(line)
    return "\n".join(kept), lost


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more, the first one included."""
    if len(words) < 4:
        return 0
    # Equal windows have equal hashes, so windows whose hash is alone are out; the rest are compared.
    h = np.fromiter(map(hash, words), np.int64, len(words))
    h = h[:-2] * 1_000_003 + h[1:-1] * 8_191 + h[2:]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate((order[1:][same], order[:-1][same]))).tolist()
    count = Counter((words[i], words[i + 1], words[i + 2]) for i in maybe)
    covered = set()
    for i in maybe:
        if count[words[i], words[i + 1], words[i + 2]] > 1:
            covered.update((i, i + 1, i + 2))
    return len(covered)


def measures(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and repeated words of a text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()]
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, BASE_SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words))


_OUT = ("doc_id long, row_hash long, text string, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, lost_words long")


def clean_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT,
                max_lost_pct: int = MAX_LOST_PCT, with_text: bool = True) -> DataFrame:
    """``doc_id``, the cleaned ``text`` and the measures and verdicts of every row of ``docs(doc_id, text)``.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` are of the
    whole text, ``lost_words`` of the lines removed; ``base_failed`` and
    ``kept`` are the verdicts. A null text is an empty one: it has no words,
    fails the base rules and its cleaned text is empty. Repeated rows are
    returned as often as they occur.
    """
    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            texts = [t.decode() for t in b.column("text").to_pylist()]
            judged = [judge_lines(t) for t in texts]
            m = np.array([measures(t) for t in texts], np.int64).reshape(-1, 5)
            yield batch_of(doc_id=b.column("doc_id"), row_hash=b.column("row_hash"),
                           text=pa.array([j[0] if with_text else None for j in judged], pa.string()),
                           n_words=m[:, 0], word_chars=m[:, 1], n_symbols=m[:, 2], n_dup_lines=m[:, 3],
                           n_repeat_words=m[:, 4], lost_words=np.array([j[1] for j in judged], np.int64))

    out = arrow_map(with_key(docs), run, _OUT).drop("row_hash")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return (out.withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed")
                        & (100 * F.col("lost_words") <= max_lost_pct * F.col("n_words"))))


def op5_quality_rules(spark, sf_dir):
    """Measures and verdicts of the quality rules for every document."""
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_words")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_WORD = r"[^\x20\x09-\x0D]+"
OP5_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS words FROM t),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
ln AS (SELECT r, line, len(regexp_extract_all(line, '{_WORD}')) AS n FROM l),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines,
         coalesce(sum(n) FILTER (WHERE NOT regexp_matches(line, '{_sql(SENTENCE_END)}')
             OR len(regexp_extract_all(line, '{_sql(SHOUT)}')) >= {SHOUTS}
             OR {SYMBOL_SHARE} * len(regexp_extract_all(line, '{_sql(SYMBOL)}')) > n
             OR regexp_matches(line, '{_sql(SEPARATORS)}') OR regexp_matches(line, '{_sql(BOILERPLATE)}')), 0)
             AS lost_words
  FROM ln WHERE n > 0 GROUP BY r),
pos AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w WHERE len(words) >= 3),
win AS (SELECT r, i, a, lead(a, 1) OVER (PARTITION BY r ORDER BY i) AS b,
               lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM pos),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY r),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words)
         AND 100 * lost_words <= {MAX_LOST_PCT} * n_words AS kept,
       lost_words
FROM m
"""
