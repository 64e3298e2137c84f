"""Hooks for a user's own per-row code, on Arrow batches.

The library's operators are native expressions; these hooks exist for code
that only exists in Python (a user's featuriser or scorer). Both run on
Arrow record batches inside the tasks Spark already has (no driver round
trip, no per-row Python call).

For code that needs whole groups there are two hooks. :func:`map_groups` hands
a group over as a stream of bounded batches in a given order, so a group of
any size fits; it runs in one task, as its rows have to come in order.
:func:`reduce_groups` is for results that can be put together from parts: the
parts are made where the rows are, before anything is shuffled, so a hot group
costs one small row a batch.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.operators.keys import _names, qcol
from assaylake.session import ensure_importable

GROUP_ROWS = 10_000  # rows of a group handed over at a time, at most
PIECE_BYTES = 1 << 20  # of texts handed to a function of columns at a time
_PLAIN = {T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(),
          T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string()}


def _pieces(cols: Sequence[pa.Array]) -> Iterator[tuple[int, int]]:
    """``(start, rows)`` of runs of rows whose texts have ``PIECE_BYTES`` in all, or one row's more."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64) for c in cols))
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE_BYTES)) + 1).tolist(), len(ends)]
    return ((a, z - a) for a, z in zip(cuts, cuts[1:]) if z > a)


def _on_texts(fn: Callable[..., pd.Series], kind: pa.DataType, kwargs: dict):
    """``fn`` on pieces of an Arrow batch of texts: only a piece's texts are Python objects at a time."""
    def run(*cols: pa.Array) -> pa.Array:
        done = []
        for at, rows in _pieces(cols):
            out = pd.Series(fn(*[c.slice(at, rows).to_pandas() for c in cols], **kwargs))
            if len(out) != rows:
                raise ValueError(f"{len(out)} values for {rows} rows")
            try:
                done.append(pa.Array.from_pandas(out, type=kind, safe=False))
            except (pa.ArrowInvalid, pa.ArrowTypeError):
                done.append(pa.Array.from_pandas(out).cast(kind, safe=False))
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return run


def with_column_batch(df: DataFrame, out: str, fn: Callable[..., pd.Series], *cols: str,
                      return_type: str = "double", **kwargs) -> DataFrame:
    """``out = fn(series_1, ..., series_n, **kwargs)`` per Arrow batch (``pandas_udf``).

    A batch is bounded by its rows; where all columns are texts and the result
    is a plain value, ``fn`` gets it in pieces bounded by their bytes.
    """
    names = list(cols)
    ensure_importable(df.sparkSession)
    kind = _PLAIN.get(type(T.DataType.fromDDL(return_type)) if isinstance(return_type, str) else type(return_type))
    if names and kind is not None and all(type(df.schema[c].dataType) is T.StringType for c in names):
        return df.withColumn(out, F.arrow_udf(_on_texts(fn, kind, kwargs), return_type)(*[qcol(c) for c in names]))

    def run(batch: pd.DataFrame) -> pd.Series:
        return fn(*[batch[c] for c in names], **kwargs)

    udf = F.pandas_udf(run, return_type)
    return df.withColumn(out, udf(F.struct(*[F.col(f"`{c}`").alias(c) for c in names])))


def map_batches(df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str,
                **kwargs) -> DataFrame:
    """``fn(batch_df, **kwargs) -> DataFrame`` over every batch (``mapInPandas``)."""
    ensure_importable(df.sparkSession)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch, **kwargs)

    return df.mapInPandas(run, schema)


def _key_of(pdf: pd.DataFrame, key: Sequence[str], at: int) -> tuple:
    return tuple(None if pd.isna(v) else v for v in (pdf[k].iat[at] for k in key))


def _runs(batches: Iterator[pd.DataFrame], key: Sequence[str], rows: int) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Sorted batches cut where the key changes, ``rows`` rows at most."""
    for pdf in batches:
        new = np.zeros(len(pdf), bool)
        for k in key:
            v, before = pdf[k], pdf[k].shift()
            new |= ((v != before) & ~(v.isna() & before.isna())).to_numpy()
        cuts = sorted({0, *np.flatnonzero(new).tolist(), *range(0, len(pdf), rows)}) if len(pdf) else []
        for a, z in zip(cuts, [*cuts[1:], len(pdf)]):
            yield _key_of(pdf, key, a), pdf.iloc[a:z]


def _changes(col: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    if pa.types.is_nested(col.type):
        return np.ones(len(col) - 1, bool)  # not compared: every row is a run of its own
    if pa.types.is_floating(col.type):
        col = col.view(pa.int64() if col.type.bit_width == 64 else pa.int32())  # NaN equals itself
    a, b = col.slice(0, len(col) - 1), col.slice(1)
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return differ.to_numpy(zero_copy_only=False)


def _gathered(df: DataFrame, key: Sequence[str], order: Sequence[str], tasks: int | None = None) -> DataFrame:
    """``df`` with each group in one partition, sorted by ``key`` and ``order``.

    Rows are sorted in ranges of ``(key, order)``, in as many tasks as there
    are; what reaches the task of a group are runs of sorted rows, a row of
    arrays each, which only have to be put in the order of the ranges. So that
    task holds columns instead of sorting rows.
    """
    by = [qcol(c) for c in [*key, *order]]
    ranges = (df.repartitionByRange(*by) if order else df).sortWithinPartitions(*by)
    rest = [c for c in df.columns if c not in key] or list(key[:1])
    arrays = [f"__a{i}" for i in range(len(rest))]

    def runs(batches):
        part, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.ones(b.num_rows, bool)
            if b.num_rows > 1:
                new[1:] = np.logical_or.reduce([_changes(b.column(k)) for k in key])
            first = np.flatnonzero(new)
            cuts = pa.array(np.append(first, b.num_rows), pa.int32())
            cols = [*(b.column(k).take(pa.array(first)) for k in key), pa.array(np.full(len(first), part), pa.int32()),
                    pa.array(np.arange(nth, nth + len(first)), pa.int64()),
                    *(pa.ListArray.from_arrays(cuts, b.column(c)) for c in rest)]
            nth += len(first)
            yield pa.RecordBatch.from_arrays(cols, [*key, "__part", "__nth", *arrays])

    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key]
    kinds += ["__part int", "__nth bigint",
              *(f"{a} array<{df.schema[c].dataType.simpleString()}>" for a, c in zip(arrays, rest))]
    keys = [qcol(k) for k in key]
    by_key = [tasks, *keys] if tasks else keys
    packed = ranges.mapInArrow(runs, ", ".join(kinds)).repartition(*by_key).sortWithinPartitions(*keys, "__part", "__nth")
    rows = packed.select(*keys, F.inline(F.arrays_zip(*arrays)))
    at = {c: a for a, c in zip(arrays, rest)}
    return rows.select(*[qcol(c) if c in key else F.col(at[c]).alias(c) for c in df.columns])


def _each_group(grouped: DataFrame, key: Sequence[str], fn: Callable, schema: str, batch_rows: int) -> DataFrame:
    """``fn`` over the groups of a table that has them one after another."""
    def run(batches):
        for k, parts in itertools.groupby(_runs(batches, key, batch_rows), key=lambda x: x[0]):
            yield from fn(k, (pdf for _, pdf in parts))

    return grouped.mapInPandas(run, schema)


def n_tasks(spark, n_groups: int) -> int:
    """Partitions for ``n_groups`` groups that take long for their bytes: enough for all cores, a few groups each."""
    return max(4 * spark.sparkContext.defaultParallelism, n_groups // 8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_groups(df: DataFrame, key: Sequence[str] | str, fn: Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
               schema: str, order: Sequence[str] = (), batch_rows: int = GROUP_ROWS, tasks: int | None = None) -> DataFrame:
    """``fn(key, batches) -> Iterator[DataFrame]`` for every group, its rows sorted by ``order``.

    ``batches`` yields the group's rows in pandas frames of ``batch_rows`` rows
    at most, one after another; what ``fn`` leaves unread is skipped. NULL is a
    key like any other (None in the tuple). Rows are sorted by Spark in ranges,
    many to a group, which spill; Python holds one batch. ``tasks``: partitions
    of the groups, for groups that take long for their bytes.
    """
    key = _names(key)
    ensure_importable(df.sparkSession)
    return _each_group(_gathered(df, key, order, tasks), key, fn, schema, batch_rows)


def reduce_groups(df: DataFrame, key: Sequence[str] | str, partial: Callable[[tuple, pd.DataFrame], dict],
                  merge: Callable[[dict, dict], dict], state: str, finish: Callable[[tuple, dict], dict] | None = None,
                  schema: str | None = None) -> DataFrame:
    """One row a group from parts that merge.

    ``partial(key, rows) -> dict`` makes a part (the fields of ``state``) from
    some of a group's rows, ``merge(a, b)`` one of two, and ``finish(key, part)``
    the result row's fields (``schema``); without it the merged part is the
    result. The result must not depend on how rows are dealt to parts.
    """
    key = _names(key)
    ensure_importable(df.sparkSession)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)

    def row(k, fields):
        return {**dict(zip(key, k)), **fields}

    def parts(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame([row(tuple(None if pd.isna(v) else v for v in (k if isinstance(k, tuple) else (k,))),
                                        partial(k, rows)) for k, rows in pdf.groupby(key, dropna=False, sort=False)])

    def merged(k, batches):
        whole = None
        for pdf in batches:
            for r in pdf.drop(columns=key).to_dict("records"):
                whole = r if whole is None else merge(whole, r)
        yield pd.DataFrame([row(k, finish(k, whole) if finish else whole)])

    small = df.mapInPandas(parts, f"{kinds}, {state}")
    keys = [qcol(k) for k in key]
    grouped = small.repartition(*keys).sortWithinPartitions(*keys)
    return _each_group(grouped, key, merged, f"{kinds}, {schema or state}", GROUP_ROWS)
