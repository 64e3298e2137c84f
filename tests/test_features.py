"""Features by content: each distinct text once, and only new texts on later requests."""

import pytest
from pyspark.sql import functions as F

from assaylake.operators import features, fingerprint
from assaylake.plans import catalog as C

SF = "/root/testdata/sf0.001"


def _sized(texts):
    return texts.select(features.KEY, F.length("text").alias("n"), F.monotonically_increasing_id().alias("mark"))


def _rows(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, n int")


def test_copies_are_computed_once(spark):
    df = _rows(spark, [(1, "a b", 9), (2, "a b", 9), (3, None, 9), (4, None, 9), (5, "", 9), (None, "a b", 9)])
    got = features.by_content(df, "id", "text", _sized).collect()
    assert {(r["id"], r["n"]) for r in got} == {(1, 3), (2, 3), (3, None), (4, None), (5, 0), (None, 3)}
    assert len({r["mark"] for r in got if r["n"] == 3}) == 1 and len(got) == 6


def test_only_new_texts_are_computed(spark, tmp_path):
    asked = []

    def compute(texts):
        asked.append(sorted(r["text"] or "" for r in texts.collect()))
        return _sized(texts)

    def table(settings=1):
        return features.FeatureTable(spark, str(tmp_path), "t", {"s": settings}, compute)

    first = _rows(spark, [(1, "a", 0), (2, "bb", 0), (3, "a", 0), (4, None, 0)])
    assert {(r["id"], r["n"]) for r in table().of(first, "id", "text").collect()} == {(1, 1), (2, 2), (3, 1), (4, None)}
    more = _rows(spark, [(7, "bb", 0), (8, "ccc", 0), (9, "", 0), (10, None, 0)])
    assert {(r["id"], r["n"]) for r in table().of(more, "id", "text").collect()} == {(7, 2), (8, 3), (9, 0), (10, None)}
    table().of(first.unionByName(more), "id", "text").collect()
    assert asked == [["", "a", "bb"], ["", "ccc"]]
    table(2).of(more, "id", "text").collect()
    assert len(asked) == 3  # other settings are another table
    assert table().of(first.where("false"), "id", "text").collect() == []


def test_half_written_parts_are_not_read(spark, tmp_path):
    table = features.FeatureTable(spark, str(tmp_path), "t", {}, _sized)
    table.of(_rows(spark, [(1, "a", 0)]), "id", "text")
    (part,) = [p for p in (tmp_path / table.folder.rsplit("/", 1)[1]).iterdir()]
    (part / "manifest.json").unlink()
    assert table.known() is None
    assert [r["n"] for r in table.of(_rows(spark, [(1, "a", 0)]), "id", "text").collect()] == [1]


def test_a_second_query_hashes_nothing(spark, monkeypatch):
    first = {r["doc_id"]: (r["fp"], r["n_bits_set"]) for r in C.document_fps(spark, SF).collect()}

    def never(*_, **__):
        raise AssertionError("hashed again")

    monkeypatch.setattr(fingerprint, "hashed_fingerprint", never)
    again = C.document_fps(spark, SF)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan
    assert {r["doc_id"]: (r["fp"], r["n_bits_set"]) for r in again.collect()} == first
    monkeypatch.undo()
    direct = fingerprint.hashed_fingerprint(C.documents(spark, SF), "doc_id", "text", C.FP_RADIUS, C.FP_BITS)
    assert {r["doc_id"]: (r["fp"], r["n_bits_set"]) for r in direct.collect()} == first


@pytest.mark.parametrize("name", ["hashed_fingerprint", "profile_text"])
def test_each_text_moves_once(spark, name):
    """Bringing equal texts together is the only exchange that holds texts."""
    plan = C.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert 1 <= len(moved) <= 2  # distinct texts by key; the rows' keys where they are not broadcast
