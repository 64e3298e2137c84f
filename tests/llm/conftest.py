import os
import sys

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_texts import prose  # noqa: E402

CLASHES = ["row_hash", "h", "fp", "count", "removed", "component_id", "perturbed", "pos", "ids", "kept", "cut"]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                     StructField("lang", StringType()), StructField("source", StringType()),
                     StructField("n_chars", LongType()), *[StructField(c, IntegerType()) for c in CLASHES]])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with every column null somewhere and extra columns whose names operators use too."""
    def make(texts):
        rows = [(d, t, None if k % 3 else "en", None if k % 2 else "s", None if t is None or k % 5 == 4 else len(t),
                 *[k if k % 4 else None for _ in CLASHES]) for k, (d, t) in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)
    return make


@pytest.fixture(scope="session")
def nasty():
    """Texts that are null, empty, blank, very long, tied and repeated, with null ids among them."""
    long = prose(30_000, 7)
    copy = prose(120, 1)
    return [(None, None), (None, "no id here, but a text"), (1, None), (2, ""), (3, " \t\n \n"), (4, long),
            (5, "x" * 70_000), (6, copy), (7, copy), (7, copy), (8, copy + " tail"), (9, "one"), (9, "two"),
            (10, "ünï ▁   code\r\nnext\x00zero 日本語 🙂"), (-3, prose(200, 3)), (11, long + "\n" + copy)]
