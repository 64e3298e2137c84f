"""Predictions vs references: back-transform, align, MAE / R^2 per endpoint.

Input is long form ``(row_id, endpoint, ref, pred)``; everything is one
``groupBy(endpoint)`` aggregate (single pass: n, mean |e|, SSE, variance of y)
plus a macro row, so it scales with the rows and shuffles one row per
endpoint and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.numeric import log10p1, unlog10p1
from assaylake.operators.keys import qcol
from assaylake.schema import ENDPOINTS, Endpoint


def extract_predictions(df: DataFrame, endpoints: Sequence[Endpoint] = ENDPOINTS,
                        id_cols: Sequence[str] = (), pred_prefix: str = "pred_") -> DataFrame:
    """``pred_{log_name}`` -> bare endpoint name on the linear scale.

    Log-encoded endpoints get 10^x - 1 and lose their log prefix; the others
    pass through.
    """
    cols = [qcol(c) for c in id_cols]
    for e in endpoints:
        src = qcol(f"{pred_prefix}{e.log_name}")
        cols.append((unlog10p1(src) if e.log_encoded else src).alias(e.name))
    return df.select(*cols)


def extract_references(df: DataFrame, endpoints: Sequence[Endpoint] = ENDPOINTS,
                       id_cols: Sequence[str] = ()) -> DataFrame:
    return df.select(*[qcol(c) for c in id_cols], *[qcol(e.name) for e in endpoints])


def to_long(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str],
            value_name: str, var_name: str = "endpoint") -> DataFrame:
    return df.unpivot([qcol(c) for c in id_cols], [qcol(c) for c in cols], var_name, value_name)


def align(preds: DataFrame, refs: DataFrame, id_cols: Sequence[str],
          endpoints: Sequence[Endpoint] = ENDPOINTS) -> DataFrame:
    """Long ``(id..., endpoint, ref, pred)`` via an equi-join on (id, endpoint)."""
    names = [e.name for e in endpoints]
    p = to_long(preds, id_cols, names, "pred")
    r = to_long(refs, id_cols, names, "ref")
    return r.join(p, [*id_cols, "endpoint"], "inner")


def evaluate(long_df: DataFrame, endpoints: Sequence[Endpoint] = ENDPOINTS,
             on_null: str = "error", macro: bool = True,
             required: Sequence[str] | None = None) -> DataFrame:
    """MAE and R^2 per endpoint (+ an ``aggregated`` macro row).

    Rows whose reference is NULL or NaN have no truth and are ignored. Endpoints that are not
    log-encoded are scored as is; the others after log10(x + 1) on both
    sides. R^2 = 1 - SSE/SST with the usual corner cases: 1.0 when SSE = SST
    = 0, 0.0 when only SST = 0, NULL below two rows. A missing prediction
    where a reference exists, a NaN prediction, and an infinity on either side
    or a number that has no logarithm, raise with ``on_null='error'``; the rows are skipped
    with ``'skip'``. Every name in ``required`` (all endpoints unless given)
    must have rows. The macro row is the mean over the endpoints, NULL where
    one of them has no value.

    One aggregate over the rows; the checks are raised by the same job, when
    the result is computed.
    """
    if on_null not in ("error", "skip"):
        raise ValueError("on_null must be 'error' or 'skip'")
    names = [e.name for e in endpoints]
    required = names if required is None else list(required)
    is_log = F.col("endpoint").isin([e.name for e in endpoints if e.log_encoded])
    y = F.when(is_log, log10p1(F.col("ref"))).otherwise(F.col("ref"))
    p = F.when(is_log, log10p1(F.col("pred"))).otherwise(F.col("pred"))
    finite = F.lit(True)
    for c in ("ref", "pred", "y", "p"):
        finite = finite & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf"))
    rows = (long_df.where(F.col("endpoint").isin(list(dict.fromkeys([*names, *required]))))
            .select("endpoint", F.nanvl(F.col("ref").cast("double"), F.lit(None).cast("double")).alias("ref"), F.col("pred").cast("double").alias("pred"))
            .withColumns({"y": y, "p": p})
            .withColumn("ok", F.coalesce(finite, F.lit(False)))
            .withColumns({"yy": F.when(F.col("ok"), F.col("y")), "err": F.when(F.col("ok"), F.col("y") - F.col("p"))}))
    per = rows.groupBy("endpoint").agg(
        F.count("yy").alias("n"),
        F.avg(F.abs("err")).alias("mean_absolute_error"),
        F.sum(F.col("err") ** 2).alias("sse"),
        F.var_pop("yy").alias("vy"),
        F.count_if(F.col("ref").isNotNull() & ~F.col("ok")).alias("n_bad"))
    # One row holds the few endpoints, so that a name without rows can be told.
    got = per.agg(F.collect_list(F.struct(*per.columns)).alias("per"))
    seen = F.transform("per", lambda x: x["endpoint"])
    missing = F.array_except(F.array(*[F.lit(k) for k in required]).cast("array<string>"), seen)
    n_bad = F.aggregate("per", F.lit(0).cast("bigint"), lambda a, x: a + x["n_bad"])
    fine = F.when(F.size(missing) > 0, F.raise_error(F.concat(
        F.lit("required key not present: "), F.array_join(missing, ", "))).cast("boolean"))
    if on_null == "error":
        fine = fine.when(n_bad > 0, F.raise_error(F.concat(
            n_bad.cast("string"), F.lit(" predictions are missing or not finite where a reference exists")))
            .cast("boolean"))
    per = (got.where(fine.otherwise(F.lit(True))).select(F.inline("per"))
           .where(F.col("endpoint").isin(names)))
    # SST = n * population variance (Spark's central-moment aggregate is
    # numerically stable and mergeable across partitions).
    sst = F.col("vy") * F.col("n")
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
          .when(sst == 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("sse") / sst))
    per = per.select("endpoint", "n", "mean_absolute_error", r2.alias("r2"))
    if not macro:
        return per

    def mean(c):
        return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(c)

    mac = per.agg(F.lit("aggregated").alias("endpoint"), F.sum("n").alias("n"),
                  mean("mean_absolute_error"), mean("r2"))
    return per.unionByName(mac)
