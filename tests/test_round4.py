"""Shingles are joined and hashed in generated code, with the bits a plain loop gives."""

import hashlib

import pytest

from assaylake.operators import fingerprint, udf

ROWS = [(1, "a b c"), (2, "A a a, a"), (3, "one"), (4, "x y"), (5, ""), (6, None), (7, "?!"), (8, "a b a b a b c"),
        (9, "p q"), (9, "r s t"), (None, "u v"), (None, "w")]


def _expected(radius, n_bits):
    bits = {}
    for key, text in ROWS:
        words = (text or "").lower().replace(",", " ").replace("?!", "").split()
        grams = {" ".join(words[i:i + n]) for n in range(1, radius + 2) for i in range(len(words) - n + 1)}
        bits.setdefault(key, set()).update(
            int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % n_bits for g in grams)
    return {k: b or None for k, b in bits.items()}


@pytest.mark.parametrize("radius, n_bits", [(2, 1024), (0, 192), (3, 256)])
def test_bits_of_all_shingles(spark, radius, n_bits):
    got = fingerprint.hashed_fingerprint(spark.createDataFrame(ROWS, "id long, text string"), "id", "text", radius,
                                         n_bits).collect()
    assert len(got) == len({k for k, _ in ROWS})
    found = {r["id"]: r["fp"] and {64 * j + b for j, w in enumerate(r["fp"]) for b in range(64) if w >> b & 1} for r in got}
    assert found == _expected(radius, n_bits)
    assert {r["id"]: r["n_bits_set"] for r in got} == {k: v and len(v) for k, v in found.items()}


def test_no_lambda_is_called_for_a_shingle(spark):
    df = spark.createDataFrame(ROWS, "id long, text string")
    plan = fingerprint.hashed_fingerprint(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "array_distinct" in plan


@pytest.mark.parametrize("hash_fn", ["md5", "xxhash64"])
def test_a_text_without_word_has_no_fingerprint(spark, hash_fn):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "id long, text string")
    got = {r["id"]: r["n_bits_set"] for r in fingerprint.hashed_fingerprint(df, "id", "text", hash_fn=hash_fn).collect()}
    assert got == {1: None, 2: None, 3: 1}


def test_texts_are_handed_over_in_pieces_of_bounded_bytes(spark):
    def seen(a, b, more=0):
        """Bytes handed over with a row, below zero for a row that comes alone."""
        size = int(a.str.len().fillna(0).sum() + b.str.len().fillna(0).sum())
        return a.str.len() * 0 + (size if len(a) > 1 else -size) + more

    rows = [(i, "x" * 50_000, None if i % 7 == 0 else "y" * 1_000) for i in range(100)] + [(100, "z" * 3_000_000, "")]
    df = spark.createDataFrame(rows, "id long, a string, b string").coalesce(1)
    got = udf.with_column_batch(df, "n", seen, "a", "b", return_type="bigint").collect()
    assert [r["id"] for r in got] == list(range(101)) and [r["a"] for r in got] == [r[1] for r in rows]
    assert all(0 < r["n"] <= udf.PIECE_BYTES + 51_000 for r in got[:100]) and got[100]["n"] == -3_000_000
    more = udf.with_column_batch(df, "n", seen, "a", "b", return_type="bigint", more=5).collect()
    assert [r["n"] for r in more] == [r["n"] + 5 for r in got]


def test_values_of_pieces_keep_their_kind(spark):
    def first(a):
        return a.str[:1]

    df = spark.createDataFrame([(1, "ab", 1.5), (2, None, 2.5), (3, "", None)], "id long, `a b` string, v double")
    got = {r["id"]: r["o"] for r in udf.with_column_batch(df, "o", first, "a b", return_type="string").collect()}
    assert got == {1: "a", 2: None, 3: ""}
    plain = udf.with_column_batch(df, "o", lambda v: v * 2, "v", return_type="double").collect()
    assert {r["id"]: r["o"] for r in plain} == {1: 3.0, 2: 5.0, 3: None}
    none = udf.with_column_batch(df.where("id > 5"), "o", first, "a b", return_type="string")
    assert none.collect() == []
