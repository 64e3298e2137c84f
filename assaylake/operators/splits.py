"""Reproducible k-fold split.

Rows are ordered by ``md5(seed:id)`` and cut into k contiguous folds whose
sizes differ by at most one, the first ``n mod k`` folds taking the extra
row (the KFold size rule). The position in that order comes from
:func:`row_index` (range partitioning, no single-partition window), and the
result depends only on the ids and the seed, never on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.keys import _names, qcol, row_index


def hash_order_key(id_cols: Sequence[str], seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[qcol(c).cast("string") for c in id_cols]))


def assign_folds(df: DataFrame, id_cols: Sequence[str], k: int = 5, seed: int = 42,
                 fold_col: str = "val_fold") -> DataFrame:
    """Each row's validation fold (0..k-1)."""
    id_cols = _names(id_cols)
    hashed = df.withColumn("__h", hash_order_key(id_cols, seed))
    ranked = row_index(hashed, ["__h", *id_cols], "__i")
    n = ranked.agg(F.count(F.lit(1))).scalar()
    q = F.floor(n / F.lit(k))
    r = n - q * F.lit(k)
    i = F.col("__i")
    big = r * (q + 1)
    fold = (F.when(i < big, F.floor(i / (q + 1)))
            .otherwise(r + F.floor((i - big) / F.when(q > 0, q))))
    return ranked.withColumn(fold_col, fold.cast("int")).drop("__h", "__i")


def kfold(df: DataFrame, id_cols: Sequence[str], k: int = 5, seed: int = 42,
          fold_col: str = "fold", split_col: str = "split") -> DataFrame:
    """k copies of the table, tagged ``train`` / ``val`` per fold."""
    folds = assign_folds(df, id_cols, k, seed, "__val")
    return (folds.withColumn(fold_col, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn(split_col, F.when(F.col(fold_col) == F.col("__val"), F.lit("val"))
                        .otherwise(F.lit("train")))
            .drop("__val"))


def kfold_sizes(folds: DataFrame, fold_col: str = "fold", split_col: str = "split") -> DataFrame:
    return folds.groupBy(fold_col).agg(
        F.count_if(F.col(split_col) == "train").cast("bigint").alias("n_train"),
        F.count_if(F.col(split_col) == "val").cast("bigint").alias("n_val"))
