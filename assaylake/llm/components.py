"""Connected components of an edge table, as rounds of joins.

Alternates the large-star and small-star steps of MapReduce connected
components: every node is linked to the smallest node it has seen until all
edges are stars. A round is two ``groupBy().min()`` with partial aggregation
and a join back, which AQE splits where one node holds many edges; edges are
written to the checkpoint folder after each round. Nothing is collected but
the count of edges that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import cut_lineage

MAX_ROUNDS = 60  # rounds grow with the logarithm of the longest path; this only stops a bug


def _star(sym: DataFrame, keep) -> DataFrame:
    """Link each neighbour that ``keep`` allows to the smallest of the node's neighbourhood."""
    low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (sym.join(low, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is its component's smallest node.

    Edges may repeat, point either way or loop; a node that has loops only is
    not returned. An empty table gives an empty table.
    """
    flat = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    flat = cut_lineage(flat)
    for _ in range(MAX_ROUNDS):
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).distinct()
        # Small star: u keeps its smaller neighbours and itself, all linked to the smallest.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct())
        new = cut_lineage(small)
        changed = new.join(flat, ["u", "v"], "left_anti").limit(1).count() or \
            flat.join(new, ["u", "v"], "left_anti").limit(1).count()
        flat = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return (flat.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(flat.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
