"""Central moments of every pair of columns from one scan.

Each task turns its batches into matrix products and keeps, for each pair of
columns, the count, means and centred sums over the rows that have both
values. These are merged pairwise, so no sum of squares is ever taken about
anything but a mean close to its own. Correlations and least-squares lines are
both read off the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.keys import qcol
from assaylake.session import ensure_importable

_STATE = "i int, j int, n double, mx double, my double, sxx double, syy double, sxy double"


class Moments:
    """Counts, means and centred sums of all ordered pairs of p columns."""

    def __init__(self, p: int):
        self.n, self.mx, self.sxx, self.sxy = (np.zeros((p, p)) for _ in range(4))

    def add(self, x: np.ndarray) -> None:
        """Rows of values, NaN where there is none."""
        there = np.isfinite(x)
        odd = np.isinf(x)
        m = there.astype(float)
        n = m.T @ m
        with np.errstate(invalid="ignore", divide="ignore"):
            centre = np.where(m.sum(0) > 0, np.where(there, x, 0.0).sum(0) / m.sum(0), 0.0)
            z = np.where(there, x - centre, 0.0)
            s = z.T @ m                                   # of column i over rows that have j too
            shift = np.where(n > 0, s / n, 0.0)
            self._merge(n, centre[:, None] + shift, (z * z).T @ m - s * shift, z.T @ z - s * shift.T)
        if odd.any():  # an infinity makes its pairs undefined
            both = (there | odd).astype(float)
            hit = (odd.astype(float).T @ both + both.T @ odd.astype(float)) > 0
            for a in (self.mx, self.sxx, self.sxy):
                a[hit] = np.nan
            self.n[hit] = np.maximum(self.n[hit], 1)

    def _merge(self, n, mx, sxx, sxy) -> None:
        total = self.n + n
        part = np.where(total > 0, n / np.maximum(total, 1), 0.0)
        dx = np.where(n > 0, np.where(self.n > 0, mx - self.mx, 0.0), 0.0)
        weight = self.n * part
        self.sxx += np.where(n > 0, sxx + weight * dx * dx, 0.0)
        self.sxy += np.where(n > 0, sxy + weight * dx * dx.T, 0.0)
        self.mx = np.where(self.n > 0, self.mx + dx * part, np.where(n > 0, mx, 0.0))
        self.n = total

    def frame(self) -> pd.DataFrame:
        i, j = np.triu_indices(len(self.n))
        return pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": self.n[i, j], "mx": self.mx[i, j],
                             "my": self.mx[j, i], "sxx": self.sxx[i, j], "syy": self.sxx[j, i], "sxy": self.sxy[i, j]})


def _merged(parts):
    """One state from an array of states, in a fixed order (Chan's update, two at a time)."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mx", "my", "sxx", "syy", "sxy")])

    def step(a, b):
        n = a["n"] + b["n"]
        part = F.when(n > 0, b["n"] / n).otherwise(0.0)
        dx, dy, w = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * part
        return F.struct(n.alias("n"), (a["mx"] + dx * part).alias("mx"), (a["my"] + dy * part).alias("my"),
                        (a["sxx"] + b["sxx"] + w * dx * dx).alias("sxx"),
                        (a["syy"] + b["syy"] + w * dy * dy).alias("syy"),
                        (a["sxy"] + b["sxy"] + w * dx * dy).alias("sxy"))

    return F.aggregate(F.array_sort(parts), zero, step)


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(i, j, n, mx, my, sxx, syy, sxy)`` for each pair ``i <= j`` of positions in ``cols``.

    Over the rows where both values are present (NULL and NaN are missing): count,
    means, and sums of squares and products about them. One scan; each task
    leaves one row a pair.
    """
    ensure_importable(df.sparkSession)
    names = list(cols)
    values = df.select(*[qcol(c).cast("double").alias(f"c{k}") for k, c in enumerate(names)])

    def run(batches):
        m = Moments(len(names))
        for pdf in batches:
            m.add(pdf.to_numpy(dtype=float, na_value=np.nan))
        yield m.frame()

    parts = values.mapInPandas(run, _STATE)
    state = F.struct("n", "mx", "my", "sxx", "syy", "sxy")
    merged = parts.groupBy("i", "j").agg(_merged(F.collect_list(state)).alias("s")).select("i", "j", "s.*")
    # A table without rows leaves no task to tell of its pairs.
    pairs = df.sparkSession.createDataFrame(
        [(i, j) for i in range(len(names)) for j in range(i, len(names))], "i int, j int")
    return pairs.join(merged, ["i", "j"], "left").fillna(0.0, ["n"])


def _named(m: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Both orientations of each pair, with the columns' names."""
    names = F.array(*[F.lit(c) for c in cols])
    one = m.select(names[F.col("i")].alias("col_x"), names[F.col("j")].alias("col_y"), "n", "mx", "my", "sxx", "syy", "sxy")
    other = m.where("i <> j").select(names[F.col("j")].alias("col_x"), names[F.col("i")].alias("col_y"), "n",
                                     F.col("my").alias("mx"), F.col("mx").alias("my"), F.col("syy").alias("sxx"),
                                     F.col("sxx").alias("syy"), "sxy")
    return one.unionByName(other)


def pair_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(col_x, col_y, n, r, slope, intercept)`` of every ordered pair, the diagonal included.

    Pearson's r is NULL where a column is constant, the line ``y = slope * x +
    intercept`` where x is; both below two rows.
    """
    m = _named(pair_moments(df, cols), cols)
    spread = F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy"))
    slope = F.when((F.col("n") >= 2) & (F.col("sxx") > 0), F.col("sxy") / F.col("sxx"))
    return m.select("col_x", "col_y", F.col("n").cast("bigint").alias("n"),
                    F.when((F.col("n") >= 2) & (spread > 0), F.col("sxy") / spread).alias("r"),
                    slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))
