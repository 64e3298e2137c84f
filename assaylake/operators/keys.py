"""Key operators: row ids, duplicate groups, group numbers, first rows.

Per-key statistics are computed with ``groupBy().agg()`` (partial aggregation
before the shuffle, so a key holding a large share of the rows is combined
map-side) and attached back to rows with a null-safe equi-join; AQE's skew
join splits a hot key's partition on that join. No operator here collects a
group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.session import cut_lineage


def qcol(name: str) -> Column:
    """Column by plain name; names may contain hyphens or dots."""
    return F.col(f"`{name}`")


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def attach_by_key(df: DataFrame, per_key: DataFrame, key: Sequence[str],
                  how: str = "left") -> DataFrame:
    """Join per-key results back to rows; NULL keys match each other.

    Rows with a whole key take a plain equi-join, which uses the partitioning
    that the per-key aggregate left (a null-safe join hashes other expressions
    and moves both sides again). Rows with a NULL in the key are joined apart.
    """
    key = _names(key)
    tmp = {k: f"__key{i}" for i, k in enumerate(key)}
    whole = F.lit(True)
    for k in key:
        whole = whole & qcol(k).isNotNull()
    values = [c for c in per_key.columns if c not in key]
    cols = [*[qcol(c) for c in df.columns], *[qcol(c) for c in values]]
    with_key = df.where(whole).join(per_key, key, how).select(*cols)
    right = per_key.where(~whole).select(*[qcol(k).alias(tmp[k]) for k in key], *[qcol(c) for c in values])
    cond = [qcol(k).eqNullSafe(F.col(tmp[k])) for k in key]
    without = df.where(~whole).join(right, cond, how).select(*cols)
    return with_key.unionByName(without)


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_idx",
              num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` without a global window.

    The rows are range-partitioned and sorted on ``order``; each row takes
    its offset inside its partition plus the row count of all earlier
    partitions. Only the per-partition counts (one row per partition) are
    combined in one place. The tagged rows are checkpointed so the counts
    and the positions come from the same materialisation.
    """
    order = _names(order)
    cols = df.columns
    # Without an explicit count AQE may merge adjacent range partitions
    # (order is kept), so small inputs do not fan out into empty tasks.
    ranged = (df.repartitionByRange(num_partitions, *[qcol(c) for c in order]) if num_partitions
              else df.repartitionByRange(*[qcol(c) for c in order]))
    tagged = (ranged
              .sortWithinPartitions(*[qcol(c) for c in order])
              .select("*", F.spark_partition_id().alias("__part"),
                      F.monotonically_increasing_id().alias("__mono")))
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0))
                            .cast("bigint").alias("__off"))
    local = F.col("__mono") - F.shiftleft(F.col("__part").cast("bigint"), 33)
    return (tagged.join(F.broadcast(offsets), "__part")
            .select(*[qcol(c) for c in cols], (F.col("__off") + local).alias(name)))


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Fresh row positions (``reset_index``) following an explicit order."""
    return row_index(df, order, name)


def group_number(df: DataFrame, key: Sequence[str], name: str = "group_no") -> DataFrame:
    """Dense 0-based number of each row's key in key order; NULL key -> NULL."""
    key = _names(key)
    not_null = F.lit(True)
    for k in key:
        not_null = not_null & qcol(k).isNotNull()
    distinct = df.select(*[qcol(k) for k in key]).where(not_null).distinct()
    numbered = row_index(distinct, key, name)
    return attach_by_key(df, numbered, key)


def group_sizes(df: DataFrame, key: Sequence[str], name: str = "group_size") -> DataFrame:
    key = _names(key)
    return df.groupBy(*[qcol(k) for k in key]).agg(F.count(F.lit(1)).alias(name))


def with_group_size(df: DataFrame, key: Sequence[str], name: str = "group_size") -> DataFrame:
    return attach_by_key(df, group_sizes(df, key, name), key)


def duplicate_members(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows of keys that occur more than once (pandas ``keep=False``)."""
    return with_group_size(df, key).where(F.col("group_size") > 1)


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[qcol(c) for c in _names(order)])


def duplicate_extras(df: DataFrame, key: Sequence[str], order: Sequence[str],
                     name: str = "is_extra") -> DataFrame:
    """Flag every member but the first of its key (pandas ``duplicated()``)."""
    key = _names(key)
    first = df.groupBy(*[qcol(k) for k in key]).agg(
        F.min(_order_struct(order)).alias("__first"))
    out = attach_by_key(df, first, key)
    return out.withColumn(name, _order_struct(order) != F.col("__first")).drop("__first")


def duplicate_key_count(df: DataFrame, key: Sequence[str],
                        name: str = "n_duplicated_keys") -> DataFrame:
    """Number of distinct non-NULL keys with more than one row."""
    key = _names(key)
    not_null = F.lit(True)
    for k in key:
        not_null = not_null & qcol(k).isNotNull()
    sizes = group_sizes(df.where(not_null), key)
    return sizes.agg(F.count_if(F.col("group_size") > 1).cast("bigint").alias(name))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str],
                  cols: Sequence[str] | None = None) -> DataFrame:
    """First row of each key in ``order`` (``~duplicated()``); NULL is a key.

    A ``min`` over a struct led by the order columns is a partial/final
    aggregate, unlike ``row_number() = 1`` which needs a whole group in one
    task.
    """
    key, order = _names(key), _names(order)
    cols = [c for c in (cols if cols is not None else df.columns) if c not in key]
    payload = [c for c in cols if c not in order]
    first = F.min(F.struct(*[qcol(c) for c in order + payload])).alias("__first")
    agg = df.groupBy(*[qcol(k) for k in key]).agg(first)
    return agg.select(*[qcol(k) for k in key],
                      *[F.col("__first").getField(c).alias(c) for c in cols])


def group_range(df: DataFrame, key: Sequence[str], cols: Sequence[str],
                order: Sequence[str] | None = None, members: str = "all",
                prefix: str = "range_") -> DataFrame:
    """max - min of each column per key; NULL keys are dropped.

    ``members='extras'`` keeps only the later members of each key (the
    workflow's view), so a key with two rows shows range 0.
    """
    key = _names(key)
    src = df
    if members == "extras":
        if order is None:
            raise ValueError("members='extras' needs an order")
        src = duplicate_extras(df, key, order).where(F.col("is_extra"))
    elif members != "all":
        raise ValueError("members must be 'all' or 'extras'")
    not_null = F.lit(True)
    for k in key:
        not_null = not_null & qcol(k).isNotNull()
    return (src.where(not_null).groupBy(*[qcol(k) for k in key])
            .agg(*[(F.max(qcol(c)) - F.min(qcol(c))).alias(f"{prefix}{c}") for c in cols]))


def normalise_keys(df: DataFrame, col: str, rules, reject=(), out: str = "key") -> DataFrame:
    """Apply Column rewrite ``rules`` in order; any ``reject`` rule -> NULL key.

    ``rules`` are functions Column -> Column; ``reject`` are functions
    Column -> boolean Column evaluated on the rewritten value.
    """
    c = qcol(col)
    for rule in rules:
        c = rule(c)
    bad = F.lit(False)
    for r in reject:
        bad = bad | F.coalesce(r(c), F.lit(False))
    return df.withColumn(out, F.when(c.isNull() | bad, F.lit(None).cast("string")).otherwise(c))


def reject_count(df: DataFrame, key: str, name: str = "n_rejected") -> DataFrame:
    return df.agg(F.count_if(qcol(key).isNull()).cast("bigint").alias(name))


def drop_rejected(df: DataFrame, key: str) -> DataFrame:
    return df.where(qcol(key).isNotNull())


def endpoint_columns(df: DataFrame, exclude: Sequence[str] = (), start: int = 0) -> list[str]:
    """Column names from position ``start`` on, minus ``exclude`` (positional picks by name)."""
    return [c for c in df.columns[start:] if c not in set(exclude)]


def head_ordered(df: DataFrame, order: Sequence[str], n: int = 10, desc: bool = False) -> DataFrame:
    """First (or, with ``desc``, last) ``n`` rows in an explicit total order (a report).

    Planned as a per-partition top-n followed by one merge of n rows per task.
    """
    cols = [qcol(c).desc() if desc else qcol(c).asc() for c in _names(order)]
    return df.orderBy(*cols).limit(n)


def shape(df: DataFrame, stage: str) -> DataFrame:
    """``(stage, n_rows, n_cols)`` of a table."""
    return df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("bigint").alias("n_cols"))
