"""Rows kept by key, so that per-key results meet them without moving them again.

Counts, first rows and ranges of a key are small, but attaching them to the
rows exchanges the rows each time. A :class:`KeyedTable` exchanges them once:
it writes them bucketed by key and by one of ``salts`` spreading numbers, and
every later aggregate and join reads the buckets as they lie. The salt spreads
a hot key over ``salts`` buckets; a per-key result is put together from at
most ``salts`` partial ones, and handed to each of the key's buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators.keys import _names, _order_struct, qcol
from assaylake.session import ensure_checkpoint_dir, track_written

KEY, SALT, HELD = "__key", "__salt", "__held"
SALTS = 8  # at most 64: the buckets that hold a key are the bits of a number


class KeyedTable:
    """``df`` written in ``buckets`` buckets by ``key``; NULL is a key like any other.

    ``buckets`` should follow the size of the table (about 128 MB each); by
    default it is the session's number of shuffle partitions. The files lie in
    the checkpoint folder; :meth:`drop` removes the table's name, and
    ``session.drop_intermediates`` the files.
    """

    def __init__(self, df: DataFrame, key: Sequence[str], buckets: int | None = None, salts: int = SALTS):
        if not 1 <= salts <= 64:
            raise ValueError("salts must be 1 to 64")
        self.spark, self.key, self.salts = df.sparkSession, _names(key), salts
        self.columns = df.columns
        self.name = f"keyed_{uuid.uuid4().hex}"
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/tables/{self.name}"
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # One text for the whole key, with its NULLs: equal keys are equal texts.
        text = F.to_json(F.struct(*[qcol(k).alias(f"k{i}") for i, k in enumerate(self.key)]),
                         {"ignoreNullFields": "false"})
        salt = F.pmod(F.xxhash64(*[qcol(c) for c in df.columns]), F.lit(salts)).cast("int")
        (df.withColumns({KEY: text, SALT: salt}).repartition(buckets, KEY, SALT)
         .write.bucketBy(buckets, KEY, SALT).sortBy(KEY, SALT).format("parquet").option("path", path)
         .saveAsTable(self.name))
        track_written(path)

    def rows(self) -> DataFrame:
        """The rows as they were given."""
        return self.spark.table(self.name).drop(KEY, SALT)

    def per_key(self, partial: dict[str, Column], merged: dict[str, Column]) -> DataFrame:
        """Key columns and ``merged`` aggregates over the ``partial`` aggregates of each of the key's buckets."""
        rows = self.spark.table(self.name)
        parts = rows.groupBy(KEY, SALT).agg(*[F.first(qcol(k)).alias(f"__k{i}") for i, k in enumerate(self.key)],
                                            *[c.alias(n) for n, c in partial.items()])
        keys = [F.first(f"__k{i}").alias(f"__k{i}") for i in range(len(self.key))]
        # Which of the key's buckets hold rows, one bit each: only these are handed the result.
        held = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(SALT)))
        return parts.groupBy(KEY).agg(*keys, held.alias(HELD), *[c.alias(n) for n, c in merged.items()])

    def with_results(self, results: DataFrame, columns: Sequence[str]) -> DataFrame:
        """All rows with ``columns`` of a :meth:`per_key` result; only that result is exchanged."""
        salts = F.sequence(F.lit(0), F.lit(self.salts - 1))
        if HELD in results.columns:
            salts = F.filter(salts, lambda s: F.getbit(HELD, s) == 1)
        per = results.select(KEY, *columns, F.explode(salts).alias(SALT))
        return self.spark.table(self.name).join(per, [KEY, SALT]).drop(KEY, SALT)

    def with_group_size(self, name: str = "group_size") -> DataFrame:
        sizes = self.per_key({"__n": F.count(F.lit(1))}, {name: F.sum("__n").cast("bigint")})
        return self.with_results(sizes, [name])

    def with_first(self, order: Sequence[str], name: str = "is_extra", size: str | None = None) -> DataFrame:
        """Rows with a flag on every member but the first of its key and, if named, the key's size."""
        found = self.per_key({"__f": F.min(_order_struct(order)), "__n": F.count(F.lit(1))},
                             {"__first": F.min("__f"), **({size: F.sum("__n").cast("bigint")} if size else {})})
        out = self.with_results(found, ["__first", *([size] if size else [])])
        return out.withColumn(name, _order_struct(order) != F.col("__first")).drop("__first")

    def group_range(self, cols: Sequence[str], prefix: str = "range_") -> DataFrame:
        """Key columns and the largest less the smallest value of each of ``cols``."""
        low = {f"__a{i}": F.min(qcol(c)) for i, c in enumerate(cols)}
        high = {f"__z{i}": F.max(qcol(c)) for i, c in enumerate(cols)}
        out = self.per_key(low | high, {f"{prefix}{c}": F.max(f"__z{i}") - F.min(f"__a{i}") for i, c in enumerate(cols)})
        return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(self.key)],
                          *[qcol(f"{prefix}{c}") for c in cols])

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
