"""Neighbour retrieval for every query and property at once.

Per query and property (in a fixed order, each with its own k): the k most
similar references that have a value for that property, similarity
descending then reference position ascending; for training queries the
references with an identical fingerprint (Tanimoto 1) are dropped *before*
the cut to k. Similarity is computed once per (query, reference) pair by
the blocked kernel; properties are applied as a bit mask inside it.

Neighbours are then merged by their key (the reference's canonical key):
a key that shows up for several properties or reference rows becomes one
neighbour whose position is its first appearance (property order, then
rank), whose value per property is the last one written (highest rank) and
whose similarity is the last one written overall -- the reading order of
the workflow's nested loops, written as aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.numeric import hashed_gauss
from assaylake.operators import similarity as sim
from assaylake.operators.keys import qcol


def property_mask(props: Sequence[str]):
    m = F.lit(0).cast("bigint")
    for i, p in enumerate(props):
        m = m.bitwiseOR(F.when(qcol(p).isNotNull(), F.lit(1 << i).cast("bigint"))
                        .otherwise(F.lit(0).cast("bigint")))
    return m


def property_values(refs: DataFrame, props: Sequence[str], ref_id: str = "ref_id") -> DataFrame:
    """Long form ``(ref_id, prop_ord, property, value)`` of the present values."""
    rows = F.array(*[F.struct(F.lit(i).alias("prop_ord"), F.lit(p).alias("property"),
                              qcol(p).cast("double").alias("value")) for i, p in enumerate(props)])
    return (refs.select(qcol(ref_id).alias("ref_id"), F.inline(rows))
            .where(F.col("value").isNotNull()))


def topk_neighbours(queries: DataFrame, refs: DataFrame, props: Sequence[tuple[str, int]],
                    n_words: int, query_id: str = "query_id", ref_id: str = "ref_id",
                    fp_col: str = "fp", is_test_col: str = "is_test",
                    block_size: int = sim.DEFAULT_BLOCK) -> DataFrame:
    """``(query_id, prop_ord, property, rank, ref_id, sim, value)``.

    ``queries``: query_id, fp, is_test. ``refs``: ref_id, fp and one nullable
    column per property. ``props``: (property, k) in prompt order.
    """
    names = [p for p, _ in props]
    q = queries.select(qcol(query_id).alias("id"), qcol(fp_col).alias("fp"),
                       qcol(is_test_col).alias("__test"))
    r = refs.select(qcol(ref_id).alias("id"), qcol(fp_col).alias("fp"),
                    property_mask(names).alias("__mask"))
    top = sim.topk_matches(q, r, n_words, [k for _, k in props], "id", "fp",
                           pmask_col="__mask", keep_ident_col="__test", block_size=block_size)
    vals = property_values(refs, names, ref_id)
    return (top.withColumnRenamed("prop", "prop_ord")
            .join(vals, ["ref_id", "prop_ord"])
            .select("query_id", "prop_ord", "property", "rank", "ref_id", "sim", "value"))


def jittered(value, seed: int, sd: float, replica, query, prop, last):
    """``value`` plus a N(0, sd) draw keyed by (seed, replica, query, property, last)."""
    key = F.concat_ws(":", F.lit(str(seed)), replica.cast("string"), query.cast("string"), prop, last)
    return value + hashed_gauss(key, sd)


def merge_neighbours(nb: DataFrame, ref_keys: DataFrame) -> DataFrame:
    """One row per (query, neighbour key), before any replication.

    ``ref_keys``: ``(ref_id, key, profile)``. Output: ``query_id, key, profile,
    pos_prop, pos_rank, sim``, ``props``, the neighbour's ``(prop_ord,
    property, value, ref_id)`` in property order, and ``props_text``, their
    text. All exchanges are on keys that start with the query.
    """
    j = nb.join(ref_keys, "ref_id")
    last = F.max_by(F.struct("ref_id", "value", "sim"), F.col("rank"))
    per_prop = j.groupBy("query_id", "key", "prop_ord", "property").agg(
        last.alias("last"), F.min("rank").alias("first_rank"), F.first("profile").alias("profile"))
    piece = F.struct("prop_ord", "property", F.col("last.value").alias("value"), F.col("last.ref_id").alias("ref_id"))
    merged = per_prop.groupBy("query_id", "key").agg(
        F.min(F.struct("prop_ord", "first_rank")).alias("pos"),
        F.max_by(F.col("last.sim"), F.col("prop_ord")).alias("sim"),
        F.first("profile").alias("profile"),
        F.array_sort(F.collect_list(piece)).alias("props"))
    return merged.select("query_id", "key", "profile", F.col("pos.prop_ord").alias("pos_prop"),
                         F.col("pos.first_rank").alias("pos_rank"), "sim", "props",
                         props_text("props", lambda x: x["value"]).alias("props_text"))


def props_text(props, value):
    """``name=value, ...`` of a ``props`` array; ``value`` maps an element to its number.

    The numbers are made by a step of their own: :func:`fmt2` names its
    argument five times, and a draw of jitter would be made each time.
    """
    from assaylake.functions.numeric import fmt2
    shown = F.transform(props, lambda x: F.struct(x["property"].alias("property"), value(x).alias("value")))
    return F.array_join(F.transform(shown, lambda x: F.concat(x["property"], F.lit("="), fmt2(x["value"]))), ", ")


def query_targets(queries: DataFrame, props: Sequence[str], query_id: str = "query_id",
                  replicas: int | None = None, seed: int = 42,
                  jitter_sd: float = 0.02) -> DataFrame:
    """A training query's own present values: ``(replica, query_id, prop_ord, property, value)``."""
    long = property_values(queries.withColumnRenamed(query_id, "__qid"), props, "__qid") \
        .withColumnRenamed("ref_id", "query_id")
    if replicas:
        long = long.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
        jkey = F.concat_ws(":", F.lit(str(seed)), F.col("replica").cast("string"),
                           F.col("query_id").cast("string"), F.col("property"), F.lit("q"))
        long = long.withColumn("value", F.col("value") + hashed_gauss(jkey, jitter_sd))
    else:
        long = long.withColumn("replica", F.lit(0))
    return long.select("replica", "query_id", "prop_ord", "property", "value")
