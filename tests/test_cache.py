"""Write-once tables with a manifest; truths that are NaN."""

import json
import shutil

import pytest

from assaylake.operators import metrics
from assaylake.schema import Endpoint
from assaylake.sources import cache, cached


def _never():
    raise AssertionError("built again")


def _folder(base, name):
    (one,) = [p for p in (base / name).iterdir()]
    return one


@pytest.mark.parametrize("fmt", ["parquet", "tsv"])
def test_built_once_for_the_same_settings(spark, tmp_path, fmt):
    rows = [(1, "a\nb", None), (2, None, 1.5)]
    df = spark.createDataFrame(rows, "i long, t string, x double")
    for build in (lambda: df, _never, _never):
        got = cached(spark, str(tmp_path), "t", build, {"k": 1}, fmt=fmt)
        assert sorted(map(tuple, got.collect())) == rows
    assert cached(spark, str(tmp_path), "t", lambda: df.where("i = 1"), {"k": 2}, fmt=fmt).count() == 1
    assert cached(spark, str(tmp_path), "t", _never, {"k": 1}, fmt=fmt).count() == 2


def test_a_table_without_its_manifest_is_not_finished(spark, tmp_path):
    df = spark.range(10)
    cached(spark, str(tmp_path), "t", lambda: df)
    folder = _folder(tmp_path, "t")
    (folder / cache.MANIFEST).unlink()  # a run that died before it was done
    assert cache.complete(spark, str(folder)) is None
    assert cached(spark, str(tmp_path), "t", lambda: spark.range(7)).count() == 7
    assert cached(spark, str(tmp_path), "t", _never).count() == 7  # and what it left is not read


@pytest.mark.parametrize("harm", ["lost", "cut", "added", "torn"])
def test_files_that_do_not_match_the_manifest(spark, tmp_path, harm):
    cached(spark, str(tmp_path), "t", lambda: spark.range(100).repartition(4))
    folder = _folder(tmp_path, "t")
    manifest = json.loads((folder / cache.MANIFEST).read_text())
    part = sorted((folder / manifest["data"]).glob("part-*"))[0]
    if harm == "lost":
        part.unlink()
    elif harm == "cut":
        part.write_bytes(part.read_bytes()[:-1])
    elif harm == "added":
        shutil.copy(part, part.with_name("part-more.parquet"))
    else:
        (folder / cache.MANIFEST).write_text('{"format": "parq')
    assert cache.complete(spark, str(folder)) is None
    assert cached(spark, str(tmp_path), "t", lambda: spark.range(3)).count() == 3


def test_changed_inputs_are_another_table(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    first = cache.cache_key(spark, {}, [source])
    assert cache.cache_key(spark, {}, [source]) == first
    spark.range(6).write.mode("overwrite").parquet(source)
    assert cache.cache_key(spark, {}, [source]) != first


def test_an_empty_table_is_finished_too(spark, tmp_path):
    for build in (lambda: spark.range(0), _never):
        got = cached(spark, str(tmp_path), "t", build)
        assert got.columns == ["id"] and got.collect() == []


def test_nan_truths_are_missing(spark):
    nan = float("nan")
    rows = [(0, "HLM", nan, 1.0), (1, "HLM", nan, None), (2, "HLM", 1.0, 2.0), (3, "HLM", 3.0, 2.5), (4, "HLM", None, nan),
            (5, "LogD", 1.0, 1.5), (6, "LogD", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "row_id long, endpoint string, ref double, pred double")
    ends = (Endpoint("HLM"), Endpoint("LogD", False))
    got = {r["endpoint"]: r for r in metrics.evaluate(df, ends).collect()}
    want = {r["endpoint"]: r for r in metrics.evaluate(df.where("NOT isnan(ref)"), ends).collect()}
    assert got == want and got["HLM"]["n"] == 2
    bad = df.unionByName(spark.createDataFrame([(9, "HLM", 1.0, nan)], df.schema))
    with pytest.raises(Exception, match="1 predictions are missing or not finite"):
        metrics.evaluate(bad, ends).collect()
