"""Proxy inputs: the driver's tables in the roles of the assay workflow.

- measurements: ``lineitem`` rows, key ``(l_partkey, l_suppkey)``, four
  endpoints, explicit row order (the order tuple is unique at every scale).
- structures: ``documents.text`` keyed by ``doc_id``; sparse endpoints from
  ``labels``; external reference set ``benchmark``.
- dense fingerprints: sign bits of ``embeddings.embedding``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.schema import Endpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINEITEM_KEY = ["l_partkey", "l_suppkey"]
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINEITEM_ENDPOINTS = (
    Endpoint("l_quantity", True, "rel", 0.3, 0.5, "log_"),
    Endpoint("l_extendedprice", True, "rel", 0.3, 0.5, "log_"),
    Endpoint("l_discount", True, "rel", 0.2, 0.001, "log_"),
    Endpoint("l_tax", True, "rel", 0.2, None, "log_"),
)
LINEITEM_VALUES = [e.name for e in LINEITEM_ENDPOINTS]


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as repeated measurements; zero discount/tax = not measured."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"))


def r6(c):
    """Round to 6 places as ``round(x * 1e6) / 1e6`` (same steps as the oracle)."""
    return F.round(c * F.lit(1e6)) / F.lit(1e6)
