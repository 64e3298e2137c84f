"""Answer texts -> numbers: parse pairs, average per query, attach to rows.

Candidates are a table ``(query_id, candidate_no, text)``. Parsing is a
native regex over the whole text; averaging is one ``groupBy(query_id)``
aggregate with conditional means, so a query with many candidates is
combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.numeric import unlog10p1
from assaylake.functions.text import answer_names, answer_values
from assaylake.operators.keys import qcol
from assaylake.schema import ENDPOINTS, PROPERTIES, Endpoint


def parse_answers(candidates: DataFrame, query_col: str = "query_id",
                  candidate_col: str = "candidate_no", text_col: str = "text",
                  outer: bool = False) -> DataFrame:
    """Every ``name=number`` pair: ``(query, candidate, pair_no, name, value)``.

    Numbers need a decimal point (``LogD=3`` is not a pair). ``outer`` keeps
    candidates without any pair as one row with NULL name/value.
    """
    pairs = F.arrays_zip(answer_names(qcol(text_col)).alias("name"),
                         answer_values(qcol(text_col)).alias("value"))
    explode = F.posexplode_outer if outer else F.posexplode
    exploded = candidates.select(qcol(query_col), qcol(candidate_col),
                                 explode(pairs).alias("pos", "pair"))
    return exploded.select(
        query_col, candidate_col,
        F.when(F.col("pair").isNotNull(), F.col("pos") + 1).cast("int").alias("pair_no"),
        F.col("pair.name").alias("name"), F.col("pair.value").try_cast("double").alias("value"))


def average_answers(candidates: DataFrame, properties: Sequence[str] = PROPERTIES,
                    strict: bool = True, query_col: str = "query_id",
                    candidate_col: str = "candidate_no", text_col: str = "text") -> DataFrame:
    """Mean of each property's parsed values over all candidates of a query.

    A property never mentioned is NULL. With ``strict`` one candidate without
    any pair voids the whole query (all NULL, the row is kept); otherwise
    such candidates are skipped. Names outside ``properties`` are ignored.
    """
    parsed = parse_answers(candidates, query_col, candidate_col, text_col, outer=True)
    void = F.max(F.col("pair_no").isNull().cast("int")) == 1
    aggs = [void.alias("__void")]
    for p in properties:
        v = F.when(F.col("name") == p, F.col("value"))
        aggs.append(F.avg(v).alias(p))
    agg = parsed.groupBy(query_col).agg(*aggs)
    cols = [qcol(query_col)]
    for p in properties:
        cols.append((F.when(~F.col("__void"), qcol(p)) if strict else qcol(p)).alias(p))
    return agg.select(*cols)


def prefix_columns(df: DataFrame, cols: Sequence[str], prefix: str = "pred_") -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in cols})


def attach_predictions(rows: DataFrame, preds: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows joined with their predictions (a row without one keeps NULLs)."""
    return rows.join(preds, on, "left")


def back_transform_predictions(df: DataFrame, endpoints: Sequence[Endpoint] = ENDPOINTS,
                               prefix: str = "pred_") -> DataFrame:
    """Add ``pred_{name}`` = 10^x - 1 for every log-encoded endpoint."""
    return df.select("*", *[unlog10p1(qcol(f"{prefix}{e.log_name}")).alias(f"{prefix}{e.name}")
                            for e in endpoints if e.log_encoded])
