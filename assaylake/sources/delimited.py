"""Delimited files with quoted line ends, read in splits.

A quoted field may hold line ends, so a task that starts in the middle of a
file cannot tell from its own bytes whether it starts inside a field. But the
number of quotes before it can: a line starts a record exactly if that number
is even (quotes inside a quoted field are doubled). So

1. every split counts its quotes and its lines, for either case;
2. a running sum over the splits of a file (one row a split) tells each which
   case holds, and in which split a record that runs into it began;
3. every line then knows its record. Records of one line, all but a few, go
   on as they are; only the lines of longer ones are brought together, by the
   place where their record began, also across splits.

A field that holds a quote must itself be quoted. Whole lines are read by
Spark's text source, from any file system it knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.session import ensure_importable

_FILE, _BLOCK = "__file", "__block"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines with the file and the offset of the split that reads them."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("*", F.col("_metadata.file_path").alias(_FILE),
                       F.col("_metadata.file_block_start").alias(_BLOCK))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where the split changes, each with its (file, offset)."""
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column(_BLOCK).to_numpy()
        file = b.column(_FILE)
        other = (np.diff(block) != 0) | pc.not_equal(file.slice(1), file.slice(0, b.num_rows - 1)).to_numpy(
            zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            yield (file[a].as_py(), int(block[a])), b.slice(a, z - a)


class _Split:
    """Quotes and lines of one split, line by line."""

    def __init__(self):
        self.odd, self.lines, self.count, self.last = 0, 0, [0, 0], [-1, -1]

    def take(self, value: pa.Array) -> tuple[np.ndarray, ...]:
        """Number, quote parity before it, own parity, and last possible record start of each
        line, if the split starts outside a field and if it starts inside one."""
        n = len(value)
        own = pc.count_substring(value, '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1
        total = np.cumsum(own)
        before = (self.odd + total - own) & 1
        number = self.lines + np.arange(n)
        starts = []
        for case in (0, 1):
            hit = before == case
            start = np.maximum(np.maximum.accumulate(np.where(hit, number, -1)), self.last[case])
            self.count[case] += int(hit.sum())
            self.last[case] = int(start[-1])
            starts.append(start)
        self.odd = int(self.odd + total[-1]) & 1
        self.lines += n
        return number, before, own, *starts


def _placed_lines(lines: DataFrame) -> DataFrame:
    def run(batches):
        now, split = None, None
        for key, b in _runs(batches):
            if key != now:
                now, split = key, _Split()
            number, before, own, start0, start1 = split.take(b.column("value"))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (number, before, own, start0, start1))],
                                             names=[*b.schema.names, "__no", "__before", "__own", "__start0", "__start1"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.mapInArrow(run, f"{fields}, __no long, __before long, __own long, __start0 long, __start1 long")


def _splits(lines: DataFrame) -> DataFrame:
    """``(file, offset, inside, owner, owner_line)`` of each split: whether it starts inside a
    field, and where the record that runs into it began."""
    def row(key, s):
        return pa.RecordBatch.from_pylist([{
            _FILE: key[0], _BLOCK: key[1], "odd": s.odd, "n0": s.count[0], "n1": s.count[1], "l0": s.last[0],
            "l1": s.last[1]}])

    def run(batches):
        now, split = None, None
        for key, b in _runs(batches):
            if key != now:
                if now is not None:
                    yield row(now, split)
                now, split = key, _Split()
            split.take(b.column("value"))
        if now is not None:
            yield row(now, split)

    counted = lines.select("value", _FILE, _BLOCK).mapInArrow(
        run, f"{_FILE} string, {_BLOCK} long, odd long, n0 long, n1 long, l0 long, l1 long")
    before = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    known = counted.withColumn("__inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    known = known.withColumn("__last", F.when(F.col("__inside") == 0, F.when(F.col("n0") > 0, F.col("l0")))
                             .otherwise(F.when(F.col("n1") > 0, F.col("l1"))))
    start = F.when(F.col("__last").isNotNull(), F.struct(F.col(_BLOCK).alias("block"), F.col("__last").alias("line")))
    return known.withColumn("__owner", F.last(start, ignorenulls=True).over(before)).select(
        _FILE, _BLOCK, "__inside", "__owner")


def read_records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """``value`` (and the folder's partition columns): the text of each record, without its line end.

    Blank lines between records are left out, and with ``header`` the first
    record of each file. A carriage return at the end of a record counts as
    part of its line end. Splits follow ``spark.sql.files.maxPartitionBytes``.
    """
    ensure_importable(spark)
    lines = _lines(spark, path)
    more = [c for c in lines.columns if c not in ("value", _FILE, _BLOCK)]
    # One row a split: Spark broadcasts it while it is small, and else sorts both sides.
    at = _placed_lines(lines).join(_splits(lines), [_FILE, _BLOCK])
    start = F.when(F.col("__inside") == 0, F.col("__start0")).otherwise(F.col("__start1"))
    whole = (F.col("__before") == F.col("__inside")) & (F.col("__own") == 0)
    began = F.when(start >= 0, F.struct(F.col(_BLOCK).alias("block"), start.alias("line"))).otherwise(F.col("__owner"))
    at = at.select(*more, "value", _FILE, _BLOCK, "__no", whole.alias("__whole"), began.alias("__began"))
    kept = at.where("__whole").select(*more, "value", "__began")
    parts = F.array_sort(F.collect_list(F.struct(_BLOCK, "__no", "value")))
    long = at.where("NOT __whole").groupBy(_FILE, "__began").agg(
        *[F.first(f"`{c}`").alias(c) for c in more],
        F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value")).select(*more, "value", "__began")
    out = kept.unionByName(long)
    if header:
        out = out.where("NOT (__began.block = 0 AND __began.line = 0)")
    text = F.regexp_replace("value", "\r$", "")
    return out.select(*more, F.when(F.col("value").endswith("\r"), text).otherwise(F.col("value")).alias("value")).where(
        "value <> ''")


def read_delimited(spark: SparkSession, path: str | list[str], schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """Columns of ``schema``, in its order, from files with a header; ``options`` as for Spark's CSV reader.

    Columns of ``schema`` that the folders name (``fold=1``) come from there;
    the others are taken by position. A malformed record raises.
    """
    records = read_records(spark, path)
    named = {c.lower(): c for c in records.columns if c != "value"}
    inside = T.StructType([f for f in schema.fields if f.name.lower() not in named])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inside.fields)
    row = F.from_csv("value", ddl, {**options, "mode": "FAILFAST"})
    parsed = records.select(*[F.col(f"`{c}`") for c in named.values()], row.alias("__row"))
    declared = [F.col("__row").getField(f.name).alias(f.name) if f.name.lower() not in named
                else F.col(f"`{named[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in schema.fields]
    extra = [F.col(f"`{c}`") for low, c in named.items() if low not in {f.name.lower() for f in schema.fields}]
    return parsed.select(*declared, *extra)
