"""Reconcile repeated measurements: disagreement flags and consensus values.

Rule: per key and endpoint, the spread (max - min) of the measurements is
compared with a tolerance, either a fraction of the endpoint's sample
standard deviation over all input rows or an absolute value. A spread
strictly above the tolerance flags the (key, endpoint) and its consensus
value becomes NULL; otherwise the consensus is the mean (NULLs skipped).
Other columns come from the key's first row in the given order.

Plan: the standard deviations are one scalar subquery returning a struct
(one partial/final aggregate over the input, run once, folded in as a
literal); everything per key is a single
``groupBy().agg()`` with map-side partial aggregation, so one shuffle of at
most one row per key and map task. No window holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.numeric import log10p1
from assaylake.operators.keys import _names, attach_by_key, qcol
from assaylake.schema import Endpoint


def endpoint_std(df: DataFrame, endpoints: Sequence[Endpoint], prefix: str = "sd_") -> DataFrame:
    """Sample standard deviation of each endpoint over all rows (one row)."""
    return df.agg(*[F.stddev_samp(qcol(e.name)).alias(f"{prefix}{e.name}") for e in endpoints])


def std_subquery(df: DataFrame, endpoints: Sequence[Endpoint]) -> Column | None:
    """All relative-tolerance standard deviations as ONE scalar subquery (a struct).

    One pass over the input, run once; every tolerance reads a field of it.
    """
    rel = [e for e in endpoints if e.tol_kind == "rel"]
    if not rel:
        return None
    return df.agg(F.struct(*[F.stddev_samp(qcol(e.name)).alias(e.name) for e in rel])).scalar()


def tolerance(e: Endpoint, std: Column | None) -> Column:
    if e.tol_kind == "abs":
        return F.lit(float(e.tol))
    if e.tol_kind != "rel":
        raise ValueError(f"unknown tolerance kind {e.tol_kind!r}")
    return std.getField(e.name) * F.lit(float(e.tol))


def _group_stats(df: DataFrame, key: Sequence[str], endpoints: Sequence[Endpoint],
                 order: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for e in endpoints:
        aggs += [F.min(qcol(e.name)).alias(f"__min_{e.name}"),
                 F.max(qcol(e.name)).alias(f"__max_{e.name}"),
                 F.avg(qcol(e.name)).alias(f"__avg_{e.name}")]
    if order:
        first_cols = list(order) + [c for c in keep if c not in order]
        aggs.append(F.min(F.struct(*[qcol(c) for c in first_cols])).alias("__first"))
    return df.groupBy(*[qcol(k) for k in key]).agg(*aggs)


def _flag(e: Endpoint, std: Column | None, has_key: Column) -> Column:
    spread = F.col(f"__max_{e.name}") - F.col(f"__min_{e.name}")
    return F.coalesce(has_key & (spread > tolerance(e, std)), F.lit(False))


def _has_key(key: Sequence[str]) -> Column:
    """Rows with a NULL in the key are not repeats of each other: no flag, no mean."""
    ok = F.lit(True)
    for k in key:
        ok = ok & qcol(k).isNotNull()
    return ok


def disagreement_flags(df: DataFrame, key: Sequence[str], endpoints: Sequence[Endpoint],
                       per_row: bool = False, suffix: str = "_noisy") -> DataFrame:
    """Per key (or, with ``per_row``, on every row) a flag per endpoint.

    An all-NULL group is not flagged, and neither are rows whose key holds a
    NULL: they are different things without a name, not repeats.
    """
    key = _names(key)
    std = std_subquery(df, endpoints)
    stats = _group_stats(df, key, endpoints)
    flags = stats.select(*[qcol(k) for k in key],
                         *[_flag(e, std, _has_key(key)).alias(f"{e.name}{suffix}") for e in endpoints])
    return attach_by_key(df, flags, key) if per_row else flags


def consensus(df: DataFrame, key: Sequence[str], endpoints: Sequence[Endpoint],
              order: Sequence[str], keep: Sequence[str] = (), log: bool = True) -> DataFrame:
    """One row per key: first-row columns, consensus means, log10(x+1) columns.

    Output: key columns, ``keep`` columns of the first row, ``n_rows``, one
    column per endpoint (mean or NULL when flagged) and, with ``log``, a
    ``Endpoint.log_name`` column for every log-encoded endpoint, computed
    after averaging. Of the rows whose key holds a NULL the first one of each
    key stays, with NULL endpoints.
    """
    key = _names(key)
    std = std_subquery(df, endpoints)
    stats = _group_stats(df, key, endpoints, order, keep)
    out = [qcol(k) for k in key]
    out += [F.col("__first").getField(c).alias(c) for c in keep]
    out.append(F.col("n_rows"))
    for e in endpoints:
        out.append(F.when(_has_key(key) & ~_flag(e, std, _has_key(key)), F.col(f"__avg_{e.name}")).alias(e.name))
    res = stats.select(*out)
    if log:
        res = res.select("*", *[log10p1(qcol(e.name)).alias(e.log_name)
                                for e in endpoints if e.log_encoded])
    return res
