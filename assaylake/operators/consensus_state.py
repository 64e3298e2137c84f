"""Consensus of measurements that arrive in batches, without reading old ones again.

The consensus of a key needs of its measurements only a *state*: how many
there are, mean and central moment, smallest and largest value of each
endpoint, and the first row. States of two sets of measurements merge into
the state of both. So a batch leaves one row for each of its keys, and the
consensus is read off the merged states, global standard deviations included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.numeric import log10p1
from assaylake.operators.keys import _names, qcol
from assaylake.schema import Endpoint
from assaylake.sources import cache

_MOMENTS = ("n", "mean", "m2", "low", "high")


def _moments(e: Endpoint) -> Column:
    v = qcol(e.name).cast("double")
    n = F.count(v)
    return F.struct(n.alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2"), F.min(v).alias("low"),
                    F.max(v).alias("high")).alias(f"s_{e.name}")


def consensus_state(df: DataFrame, key: Sequence[str], endpoints: Sequence[Endpoint], order: Sequence[str],
                    keep: Sequence[str] = ()) -> DataFrame:
    """One row a key: ``key..., n_rows, s_<endpoint> (n, mean, m2, low, high)..., first``."""
    first = F.struct(*[qcol(c) for c in [*order, *[c for c in keep if c not in order]]])
    return df.groupBy(*[qcol(k) for k in _names(key)]).agg(
        F.count(F.lit(1)).alias("n_rows"), *[_moments(e) for e in endpoints], F.min(first).alias("first"))


def _merge(a, b):
    """State of the measurements of both (Chan's update); one without measurements changes nothing."""
    n = a["n"] + b["n"]
    part, d = b["n"] / n, b["mean"] - a["mean"]
    both = F.struct(n.alias("n"), (a["mean"] + d * part).alias("mean"),
                    (a["m2"] + b["m2"] + a["n"] * part * d * d).alias("m2"),
                    F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def merge_states(states: DataFrame, key: Sequence[str]) -> DataFrame:
    """Several states a key -> one; in an order that does not depend on their arrival.

    A key brings one row for each batch that had it, whatever its measurements.
    """
    moments = [c for c in states.columns if c.startswith("s_")]

    def merged(c):
        kind = states.schema[c].dataType.simpleString()
        none = F.struct(F.lit(0).cast("bigint").alias("n"), *[F.lit(None).cast("double").alias(m) for m in _MOMENTS[1:]])
        return F.aggregate(F.array_sort(F.collect_list(qcol(c))), none.cast(kind), _merge).alias(c)

    return states.groupBy(*[qcol(k) for k in _names(key)]).agg(
        F.sum("n_rows").alias("n_rows"), *[merged(c) for c in moments], F.min("first").alias("first"))


def _global_std(state: DataFrame, endpoints: Sequence[Endpoint]) -> Column | None:
    """Sample standard deviations over all measurements, from the states: one scalar subquery.

    A key may have several states: sums over them are those over the merged ones.
    """
    rel = [e.name for e in endpoints if e.tol_kind == "rel"]
    if not rel:
        return None

    def s(e, m):
        return F.col(f"`s_{e}`").getField(m)

    totals = state.agg(F.struct(*[F.struct(
        F.sum(s(e, "n")).alias("n"), (F.sum(s(e, "n") * s(e, "mean")) / F.sum(s(e, "n"))).alias("mean")).alias(e)
        for e in rel])).scalar()
    # About the mean of all: nothing is cancelled.
    off = [F.sum(s(e, "m2") + s(e, "n") * F.pow(s(e, "mean") - totals.getField(e).getField("mean"), F.lit(2))) for e in rel]
    return state.agg(F.struct(*[
        F.when(F.sum(s(e, "n")) > 1, F.sqrt(o / (F.sum(s(e, "n")) - 1))).alias(e) for e, o in zip(rel, off)])).scalar()


def _flags(state: DataFrame, key: Sequence[str], endpoints: Sequence[Endpoint],
           parts: DataFrame | None = None) -> dict[str, Column]:
    from assaylake.operators.consensus import _has_key, tolerance
    std = _global_std(state if parts is None else parts, endpoints)

    def spread(e):
        s = F.col(f"`s_{e.name}`")
        return s.getField("high") - s.getField("low")

    return {e.name: F.coalesce(_has_key(key) & (spread(e) > tolerance(e, std)), F.lit(False)) for e in endpoints}


def flags_of_state(state: DataFrame, key: Sequence[str], endpoints: Sequence[Endpoint], suffix: str = "_noisy",
                   parts: DataFrame | None = None) -> DataFrame:
    """Disagreement flags of each key, as :func:`assaylake.operators.consensus.disagreement_flags`.

    ``parts``: the states as they were before they were merged, if at hand;
    global sums are taken from them, so that nothing is merged for these.
    """
    key = _names(key)
    flags = _flags(state, key, endpoints, parts)
    return state.select(*[qcol(k) for k in key], *[f.alias(f"{e}{suffix}") for e, f in flags.items()])


def consensus_of_state(state: DataFrame, key: Sequence[str], endpoints: Sequence[Endpoint],
                       keep: Sequence[str] = (), log: bool = True, parts: DataFrame | None = None) -> DataFrame:
    """What :func:`assaylake.operators.consensus.consensus` gives for all measurements behind the state.

    ``parts`` as in :func:`flags_of_state`.
    """
    from assaylake.operators.consensus import _has_key
    key = _names(key)
    flags = _flags(state, key, endpoints, parts)
    means = [F.when(_has_key(key) & ~flags[e.name], F.col(f"`s_{e.name}`").getField("mean")).alias(e.name)
             for e in endpoints]
    res = state.select(*[qcol(k) for k in key], *[F.col("first").getField(c).alias(c) for c in keep], "n_rows", *means)
    if log:
        res = res.select("*", *[log10p1(qcol(e.name)).alias(e.log_name) for e in endpoints if e.log_encoded])
    return res


class StateTable:
    """States of the batches met so far, in a folder; a batch counts once whatever is tried again.

    Each batch is a part named by its id, which exists once its manifest does
    (:mod:`assaylake.sources.cache`), so ``add`` may be called again after a
    failure, or from ``foreachBatch`` with the epoch as id. Reading merges the
    parts by key: the work grows with the keys of the batches, not with their
    measurements. :meth:`compact` writes the merged state as one part.
    """

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str], endpoints: Sequence[Endpoint],
                 order: Sequence[str], keep: Sequence[str] = ()):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), _names(key)
        self.endpoints, self.order, self.keep = endpoints, order, keep

    def _part(self, batch_id) -> str:
        return f"{self.folder}/batch-{hashlib.sha256(str(batch_id).encode()).hexdigest()[:24]}"

    def has(self, batch_id) -> bool:
        known = cache.complete(self.spark, self._part(batch_id)) is not None
        return known or any(self._part(batch_id).rsplit("/", 1)[1] in m.get("holds", ()) for m in self._parts())

    def _parts(self) -> list[dict]:
        """Finished parts; those that a compacted one holds are left out."""
        found = cache.parts(self.spark, self.folder)
        held = {h for m in found for h in m.get("holds", ())}
        return [m for m in found if m["name"] not in held]

    def add(self, batch: DataFrame, batch_id) -> None:
        """Fold a batch's measurements in; nothing happens if this batch was added before."""
        if not self.has(batch_id):
            state = consensus_state(batch, self.key, self.endpoints, self.order, self.keep)
            cache.write_part(self.spark, self._part(batch_id), state)

    def _written(self, parts: list[dict]) -> DataFrame:
        """The states of parts as they lie: one row for each key of each part."""
        if not parts:
            raise ValueError("no batch has been added")
        files = [f for m in parts for f in m["files"]]
        schema = cache.schema_of(parts[0])
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        """One row a key; a single part has no more, and is read as it lies."""
        parts = self._parts()
        written = self._written(parts)
        return written if len(parts) == 1 else merge_states(written, self.key)

    def compact(self) -> None:
        """One part for all that are there; later batches are added beside it."""
        parts = self._parts()
        if len(parts) > 1:
            holds = sorted({m["name"] for m in parts} | {h for m in parts for h in m.get("holds", ())})
            name = hashlib.sha256("\n".join(holds).encode()).hexdigest()[:24]
            cache.write_part(self.spark, f"{self.folder}/merged-{name}", self.state(), more={"holds": holds})

    def consensus(self, log: bool = True) -> DataFrame:
        return consensus_of_state(self.state(), self.key, self.endpoints, self.keep, log, self._written(self._parts()))

    def flags(self) -> DataFrame:
        return flags_of_state(self.state(), self.key, self.endpoints, parts=self._written(self._parts()))
