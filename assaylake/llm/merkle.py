"""Merkle manifest of a table as a persistent tree, with path-copying versions.

Rows are leaves. The leaves of a group, in order, are the lowest level of its
tree: while a level has more than one node, every ``FANOUT`` consecutive ones
become one node, their hash. The groups' roots, in order, are the leaves of
one more tree of the same kind.

A *version* of the tree with one leaf replaced copies only that leaf's
ancestors; all other nodes are shared with the tree as it was. The lower
``BLOCK_LEVELS`` levels of an ancestor path lie in one aligned block of 4,096
leaves, which a task holds and whose versions it makes there; above it, the
version goes on as a row along the path of its block, which Spark has joined to
it. The levels above are built the same way, a block of 4,096 nodes a task and
round, so n leaves take ``log(n) / log(4096)`` rounds and no task ever holds
more than a block.

Digests are lower-case hex SHA-256, and hex text is what a node hashes; tables
hold them as 32 bytes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import cut_lineage, table
from assaylake.operators.keys import row_index
from assaylake.session import ensure_importable

FANOUT = 8
BLOCK_LEVELS = 4  # levels of a block, which has FANOUT ** BLOCK_LEVELS leaves
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:binary,after:binary>>"


def digest(hex_text: str) -> str:
    return hashlib.sha256(hex_text.encode()).hexdigest()


# --- one block, in a task -----------------------------------------------------

def levels_of(n: int) -> int:
    """Levels above n leaves: until one node is left."""
    k = 0
    while n > 1:
        n, k = -(-n // FANOUT), k + 1
    return k


def block_levels(nodes: list[str], n: int, depth: int = BLOCK_LEVELS) -> list[list[str]]:
    """All levels inside one block of a group of ``n`` nodes, lowest first; the last has one node."""
    out = [nodes]
    for _ in range(min(depth, levels_of(n))):
        low = out[-1]
        out.append([digest("".join(low[i:i + FANOUT])) for i in range(0, len(low), FANOUT)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The other nodes of the run of node ``i`` and of each ancestor's, before and after it."""
    out = []
    for level in levels[:-1]:
        first = i - i % FANOUT
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + FANOUT])))
        i //= FANOUT
    return out


def copied_path(node: str, path: list[tuple[str, str]]) -> list[str]:
    """The version of a tree that has ``node`` in place of one of its own: the
    copied ancestors alone, lowest first; what ``path`` names stays shared."""
    out = []
    for before, after in path:
        node = digest(before + node + after)
        out.append(node)
    return out


def _pack(path: list[tuple[str, str]]) -> list[dict]:
    return [{"before": bytes.fromhex(b), "after": bytes.fromhex(a)} for b, a in path]


def _unpack(path: list[dict]) -> list[tuple[str, str]]:
    return [(p["before"].hex(), p["after"].hex()) for p in path]


# --- the tree, by Spark --------------------------------------------------------

def _with_block(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / FANOUT ** depth).cast("bigint"))


def _tops(nodes: DataFrame, depth: int) -> DataFrame:
    """``nodes(group, idx, n, hash)`` -> the same columns for the top of each block."""
    def run(key, t):
        t = t.sort_by("idx")
        n = t.column("n")[0].as_py()
        top = block_levels([h.hex() for h in t.column("hash").to_pylist()], n, depth)[-1][0]
        return pa.table({"group": [key[0].as_py()], "idx": [key[1].as_py()], "n": [-(-n // FANOUT ** depth)],
                         "hash": pa.array([bytes.fromhex(top)], pa.binary())})

    own = _with_block(nodes, depth).select("group", "block", "idx", "n", "hash")
    return own.groupBy("group", "block").applyInArrow(
        run, "group string, idx long, n long, hash binary")


def _paths(nodes: DataFrame, most: int, depth: int) -> DataFrame:
    """``nodes(group, idx, n, hash)`` -> ``group, idx, path, subroot``: what lies beside each node's
    ancestors up to its group's root. ``most`` is the greatest ``n`` of a group."""
    def run(key, t, above=None):
        t = t.sort_by("idx")
        levels = block_levels([h.hex() for h in t.column("hash").to_pylist()], t.column("n")[0].as_py(), depth)
        upper = above.column("path")[0].as_py() if above is not None else []
        root = above.column("subroot")[0].as_py() if above is not None else bytes.fromhex(levels[-1][0])
        own = [_pack(siblings(levels, i)) + upper for i in range(t.num_rows)]
        kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
        return pa.table({"group": t.column("group"), "idx": t.column("idx"), "path": pa.array(own, kind),
                         "subroot": pa.array([root] * t.num_rows, pa.binary())})

    schema = f"group string, idx long, path {_PATH}, subroot binary"
    own = _with_block(nodes, depth).groupBy("group", "block")
    if most <= FANOUT ** depth:
        return own.applyInArrow(lambda key, t: run(key, t), schema)
    above = _paths(cut_lineage(_tops(nodes, depth)), -(-most // FANOUT ** depth), depth).select(
        "group", F.col("idx").alias("block"), "path", "subroot")
    return own.cogroup(above.groupBy("group", "block")).applyInArrow(
        lambda key, t, up: run(key, t, up), schema)


def numbered(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` with ``idx`` (place in its group) and ``n`` (leaves of the group)."""
    placed = cut_lineage(row_index(leaves, [group, *order], "__place"))
    sizes = cut_lineage(placed.groupBy(group).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("n")))
    return (placed.join(sizes, group).withColumn("idx", F.col("__place") - F.col("__first"))
            .drop("__place", "__first"))


def manifest(leaves: DataFrame, with_paths: bool = False, depth: int = BLOCK_LEVELS) -> DataFrame:
    """Proof of every leaf, and the root its own version of the tree has.

    ``leaves(doc_id, group, leaf, changed)``: hex digests; ``group`` is not
    null; ``changed`` is the leaf's digest after a change, null for none.
    Leaves of a group ascend by ``doc_id`` (null first), equal ids by digest.
    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root`` and,
    if asked for, ``path``: the siblings before and after the leaf and each of
    its ancestors. One row for each row, also for repeated ones; no rows for
    no rows. A lone leaf is its own root, with an empty proof. ``depth`` is the
    levels of a block; the result does not depend on it.
    """
    ensure_importable(leaves.sparkSession)
    thin = cut_lineage(leaves.select("doc_id", "group", F.unhex("leaf").alias("hash"),
                                     F.unhex("changed").alias("changed")))  # sorting reads it twice
    nodes = cut_lineage(numbered(thin, "group", ["doc_id", "hash"]))
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0

    # The tree of each group above its blocks, then the tree of the groups' roots.
    tops = cut_lineage(_tops(nodes, depth))
    upper = cut_lineage(_paths(tops, -(-most // FANOUT ** depth), depth))
    roots = numbered(upper.groupBy("group").agg(F.first("subroot").alias("hash")).withColumn("all", F.lit("")),
                     "all", ["group"])
    roots = cut_lineage(roots.select("group", F.struct(
        F.col("all").alias("group"), "idx", "n", "hash").alias("node")))
    n_groups = roots.count()
    over = cut_lineage(_paths(roots.select("node.*"), n_groups, depth)).select("idx", F.col("path").alias("over"),
                                                                        F.col("subroot").alias("root"))
    over = over.join(roots.select("group", "node.idx"), "idx").drop("idx")
    above = upper.join(over, "group").select(
        "group", F.col("idx").alias("block"), F.size("path").alias("n_inner"), F.concat("path", "over").alias("path"),
        "subroot", "root")

    def run(key, t, up):
        return pa.Table.from_batches([_proved(t.sort_by("idx"), up.slice(0, 1).to_pylist()[0], with_paths, depth)])

    schema = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
              + (f", path {_PATH}" if with_paths else ""))
    return (_with_block(nodes, depth).groupBy("group", "block").cogroup(above.groupBy("group", "block"))
            .applyInArrow(run, schema))


def _proved(t: pa.Table, up: dict, with_paths: bool, depth: int) -> pa.RecordBatch:
    """Result rows of one block of leaves; ``up`` is the block's path to the root."""
    leaves = [h.hex() for h in t.column("hash").to_pylist()]
    levels = block_levels(leaves, t.column("n")[0].as_py(), depth)
    upper = _unpack(up["path"])
    rest = "".join(b + a for b, a in upper)
    proofs, folded, paths = [], [], []
    for i, changed in enumerate(t.column("changed").to_pylist()):
        own = siblings(levels, i)
        proofs.append(digest("".join(b + a for b, a in own) + rest))
        if changed is None:
            folded.append(up["root"].hex())
        else:
            inner = copied_path(changed.hex(), own)  # ancestors copied inside the block
            top = inner[-1] if inner else changed.hex()
            outer = copied_path(top, upper)          # and above it
            folded.append(outer[-1] if outer else top)
        if with_paths:
            paths.append(_pack(own) + up["path"])
    cols = [t.column("doc_id").combine_chunks(), *[pa.array(c, pa.string()) for c in (
        leaves, [up["subroot"].hex()] * len(leaves), [up["root"].hex()] * len(leaves), proofs, folded)]]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    if with_paths:
        names.append("path")
        cols.append(pa.array(paths, pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))))
    return pa.RecordBatch.from_arrays(cols, names=names)


# --- leaves of documents -------------------------------------------------------

def row_digest(*cols: Column) -> Column:
    """Hex SHA-256 of the columns: ``-`` for null, else byte count, ``:`` and value."""
    texts = [c.cast("string") for c in cols]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
             for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(lang: Column) -> Column:
    """A text that is never null and sorts as ``lang`` does, null first."""
    return F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang.cast("string")))


def tampered(doc_id: Column) -> Column:
    """Whether the row is tampered with: 3 divides the CRC-32 of its decimal id; never without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, group, leaf, changed`` of documents, tampering as the contract has it:
    A-Z of the text become lower case (a null text stays)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text")
    others = [F.col(c) for c in LEAF_COLUMNS[1:-1]]
    return docs.select(
        doc_id.alias("doc_id"), group_key(F.col("lang")).alias("group"),
        row_digest(doc_id, *others, text).alias("leaf"),
        F.when(tampered(doc_id), row_digest(doc_id, *others, F.translate(text, upper, upper.lower()))).alias("changed"))


def op12_merkle_manifest(spark, sf_dir):
    """Proof of every document, and whether it still holds after the tampering."""
    out = manifest(document_leaves(table(spark, sf_dir, "documents")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 7) -> str:
    """DuckDB SQL of :func:`op12_merkle_manifest`, for groups of up to ``FANOUT ** levels`` leaves."""
    def hashed(c):
        text = f"CAST({c} AS VARCHAR)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"

    others = [hashed(c) for c in LEAF_COLUMNS[1:-1]]
    own = " || ".join([hashed("doc_id"), *others, hashed("text")])
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = " || ".join([hashed("doc_id"), *others, hashed(f"translate(text, '{az}', '{az.lower()}')")])
    bits = ("flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: "
            "list_transform(range(8), lambda k: (CAST(ord(ch) AS BIGINT) >> k) & 1)))")
    crc = (f"list_reduce({bits}, lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 "
           "THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END), CAST(4294967295 AS BIGINT))")
    ctes = [f"""l AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, sha256({own}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND xor({crc}, CAST(4294967295 AS BIGINT)) % 3 = 0 THEN sha256({low}) END AS changed
  FROM documents)""",
            """a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY g) AS n, leaf AS h, doc_id, leaf, changed FROM l)""",
            "t0 AS (SELECT g, i, n, h FROM a0)"]

    def climb(p: str) -> str:
        """Levels above table ``{p}0``; each level carries its nodes' own run."""
        for k in range(levels):
            ctes.append(f"""{p}{k + 1} AS (SELECT g, i // {FANOUT} AS i, max((n + {FANOUT - 1}) // {FANOUT}) AS n,
  CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {p}{k} GROUP BY 1, 2)""")
            ctes.append(f"""{p}s{k} AS (SELECT g, i, n > 1 AS up,
  coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, i // {FANOUT} ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
  coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, i // {FANOUT} ORDER BY i
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM {p}{k})""")
        return f"{p}{levels}"

    top = climb("t")
    ctes.append(f"r AS (SELECT g AS lang, h FROM {top})")
    ctes.append("""u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(lang)) - 1 AS i,
  count(*) OVER () AS n, h, lang FROM r)""")
    peak = climb("u")
    ctes.append("""f0 AS (SELECT doc_id, leaf, changed, g, i, changed AS v, '' AS proof FROM a0)""")
    for k in range(levels):
        ctes.append(f"""f{k + 1} AS (SELECT f.doc_id, f.leaf, f.changed, f.g, f.i // {FANOUT} AS i,
  CASE WHEN s.up THEN sha256(s.lo || f.v || s.hi) ELSE f.v END AS v, f.proof || s.lo || s.hi AS proof
  FROM f{k} f JOIN ts{k} s ON f.g = s.g AND f.i = s.i)""")
    ctes.append(f"""e0 AS (SELECT f.doc_id, f.leaf, f.changed, u.h AS subroot, u.i, f.v, f.proof
  FROM f{levels} f JOIN u0 u ON f.g = u.lang)""")
    for k in range(levels):
        ctes.append(f"""e{k + 1} AS (SELECT f.doc_id, f.leaf, f.changed, f.subroot, f.i // {FANOUT} AS i,
  CASE WHEN s.up THEN sha256(s.lo || f.v || s.hi) ELSE f.v END AS v, f.proof || s.lo || s.hi AS proof
  FROM e{k} f JOIN us{k} s ON f.i = s.i)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT e.doc_id, e.leaf, e.subroot, p.h AS root, sha256(e.proof) AS proof_sha256,
  coalesce(e.v, p.h) AS folded_root, coalesce(e.v, p.h) = p.h AS verified
FROM e{levels} e CROSS JOIN {peak} p"""


OP12_SQL = _sql()
