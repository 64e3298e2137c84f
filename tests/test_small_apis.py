"""Small APIs: alignment, references, flattening, write-once cache, column picks, paths."""

import json

from assaylake import functions as fn
from assaylake.operators import keys, metrics
from assaylake.schema import Endpoint
from assaylake.sources import flatten_records, prompt_path, read_assay, write_assay, write_chat_jsonl

EPS = (Endpoint("HLM"), Endpoint("LogD", log_encoded=False))


def test_align_and_extract(spark):
    preds = spark.createDataFrame([(1, 1.0, 2.5), (2, 0.0, 3.0)],
                                  "row_id bigint, pred_LogHLM double, pred_LogD double")
    refs = spark.createDataFrame([(1, 9.0, 2.0), (2, None, 3.5)],
                                 "row_id bigint, HLM double, LogD double")
    p = metrics.extract_predictions(preds, EPS, ["row_id"])
    assert {r["row_id"]: r["HLM"] for r in p.collect()} == {1: 9.0, 2: 0.0}
    r = metrics.extract_references(refs, EPS, ["row_id"])
    long = metrics.align(p, r, ["row_id"], EPS)
    got = {(x["row_id"], x["endpoint"]): (x["ref"], x["pred"]) for x in long.collect()}
    assert got[(1, "HLM")] == (9.0, 9.0) and got[(2, "LogD")] == (3.5, 3.0)
    scores = {x["endpoint"]: x for x in metrics.evaluate(long, EPS).collect()}
    assert scores["HLM"]["n"] == 1 and scores["HLM"]["mean_absolute_error"] == 0.0


def test_flatten_without_labels_keeps_ids(spark):
    df = spark.createDataFrame([("CCO", '{"HLM": 1.5}'), ("CCN", "{}")], "smiles string, y string")
    assert flatten_records(df, "smiles", "y", []).columns == ["smiles"]
    rows = {r["smiles"]: r["HLM"] for r in flatten_records(df, "smiles", "y", ["HLM"]).collect()}
    assert rows == {"CCO": 1.5, "CCN": None}


def test_write_once_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    write_assay(spark.createDataFrame([(1,)], "x bigint"), path, mode="ignore")
    write_assay(spark.createDataFrame([(2,)], "x bigint"), path, mode="ignore")
    assert [r["x"] for r in read_assay(spark, path, "x bigint").collect()] == [1]


def test_endpoint_columns(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0, 3.0)], "smiles string, a double, b double, c double")
    assert keys.endpoint_columns(df, start=1) == ["a", "b", "c"]
    assert keys.endpoint_columns(df, exclude=["smiles", "b"]) == ["a", "c"]


def test_near_equality_as_numpy(spark):
    rows = [(1.0, True), (1.0 + 1e-5, True), (1.0 + 1.1e-5, False), (0.99, False), (None, None)]
    df = spark.createDataFrame(rows, "x double, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", fn.is_close("x")).collect())


def test_rejected_keys_are_dropped(spark):
    df = spark.createDataFrame([("a",), (None,), ("",)], "k string")
    assert [r["k"] for r in keys.drop_rejected(df, "k").collect()] == ["a", ""]


def test_output_name_and_uri(spark, tmp_path):
    path = prompt_path(f"file:{tmp_path}/", 5, 3)
    assert path == f"file:{tmp_path}/records_top5target_3ext_train.jsonl"
    write_chat_jsonl(spark.sql("SELECT named_struct('a', 1, 'b', cast(null AS string)) AS record"), path)
    lines = [x for p in (tmp_path / path.rsplit("/", 1)[1]).glob("part-*") for x in p.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"a": 1}]
