"""Render retrieval-augmented chat records.

Record = ``struct<systemInstruction: struct<parts: array<struct<text>>>,
contents: array<struct<role, parts: array<struct<text>>>>>``. Training
records have a user turn (context, question) and a model turn (the answer);
test records only the user turn. Lists inside a record are bounded by the
number of neighbour slots and properties, so the per-query
``collect_list`` never holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.numeric import fmt2
from assaylake.operators.retrieval import jittered, props_text

# ---------------------------------------------------------------------------
# The record text format of the workflow.
NEIGHBOUR_SEP = "; "
FIELD_SEP = ", "
SIMILARITY_LABEL = "Similarity: "
ASK = "Determine "
# ---------------------------------------------------------------------------


def render_prompts(queries: DataFrame, merged: DataFrame, targets: DataFrame | None,
                   properties: Sequence[str], label: str = "SMILES",
                   replicas: int | None = None, seed: int = 42, jitter_sd: float = 0.02) -> DataFrame:
    """``(replica, query_id, context, question, answer)`` per query and replica.

    ``queries``: query_id, key, profile; ``merged``: :func:`merge_neighbours`
    (without ``props`` the neighbours' ``props_text`` is used as it is);
    ``targets``: :func:`query_targets` without replicas. With ``targets``
    (training) the question asks for the query's present properties and the
    answer lists them; without (test) the question asks for all
    ``properties`` and the answer is NULL. A query without neighbours gets an
    empty context. Neighbours stand in the order of their first appearance.

    Everything is gathered once per query; replicas are exploded by the last
    projection, which draws each value's jitter and writes the text, so no
    replicated row is ever shuffled.
    """
    last = "props" if "props" in merged.columns else "props_text"
    nb = merged.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("pos_prop", "pos_rank", "key", "profile", "sim", last))).alias("__nb"))
    out = queries.select("query_id", "key", "profile").join(nb, "query_id", "left")
    if targets is not None:
        t = targets.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct("prop_ord", "property", "value"))).alias("__t"))
        out = out.join(t, "query_id", "left")
    out = out.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))) if replicas else F.lit(0))

    def value(x, last):
        if not replicas:
            return x["value"]
        return jittered(x["value"], seed, jitter_sd, F.col("replica"), F.col("query_id"), x["property"], last)

    def values(n):
        return n["props_text"] if last == "props_text" else props_text(
            n["props"], lambda x: value(x, x["ref_id"].cast("string")))

    context = F.array_join(F.transform("__nb", lambda n: F.concat(
        F.lit(f"{label}: "), n["key"], F.lit(FIELD_SEP), n["profile"], F.lit(FIELD_SEP + SIMILARITY_LABEL),
        fmt2(n["sim"]), F.lit(FIELD_SEP), values(n))), NEIGHBOUR_SEP)
    if targets is not None:
        names = F.coalesce(F.array_join(F.transform("__t", lambda x: x["property"]), FIELD_SEP), F.lit(""))
        answer = F.coalesce(props_text(F.col("__t"), lambda x: value(x, F.lit("q"))), F.lit(""))
    else:
        names = F.lit(FIELD_SEP.join(properties))
        answer = F.lit(None).cast("string")
    head = F.concat(F.lit(f"{label}: "), F.col("key"), F.lit(FIELD_SEP), F.col("profile"),
                    F.lit(NEIGHBOUR_SEP + ASK))
    return out.select("replica", "query_id", F.coalesce(context, F.lit("")).alias("context"),
                      F.concat(head, names).alias("question"), answer.alias("answer"))


def chat_records(prompts: DataFrame, system_instruction: str | None = None) -> DataFrame:
    """``(replica, query_id, record)``; the model turn only where an answer exists."""
    part = lambda c: F.array(F.struct(c.alias("text")))
    user = F.struct(F.lit("user").alias("role"),
                    F.array(F.struct(F.col("context").alias("text")),
                            F.struct(F.col("question").alias("text"))).alias("parts"))
    model = F.struct(F.lit("model").alias("role"), part(F.col("answer")).alias("parts"))
    contents = F.when(F.col("answer").isNull(), F.array(user)).otherwise(F.array(user, model))
    system = (F.struct(part(F.lit(system_instruction)).alias("parts")) if system_instruction
              else F.lit(None).cast("struct<parts:array<struct<text:string>>>"))
    return prompts.select("replica", "query_id",
                          F.struct(system.alias("systemInstruction"),
                                   contents.alias("contents")).alias("record"))
