"""Cheapest repair of a conversation's turn structure.

A conversation is legal if the initials of its rows' roles read
``(s?(ua)+)?``: maybe a system row, then pairs of user and assistant. Every
row is kept (0), given the role user or assistant (3) or deleted (4); rows
with empty text and the role user or assistant may be inserted anywhere (3).
Blank rows and repeats must be deleted, and a truncated row that stays costs 3
more. The edits' initials, in order, are the *audit*; of the cheapest repairs
the one with the ASCII-least audit is taken.

The search is a shortest path over (row, last initial). The weight of a path
is one integer: its high digits are the cost, its low digits, three bits each
and fixed in number, the audit's letters from the left (D=1, I=2, K=3, R=4),
with zeros at the end. An edge adds its cost above and its letter's digit at
the next free place, and the least integer is the cheapest path, least audit
first. Paths that meet in a node have the same rows behind them, and an audit
cannot be the beginning of another of the same cost that ends in the same
node (only inserted rows could make the difference), so the lesser of two
stays the lesser whatever follows.

Spark sorts the rows of each conversation into one stream, and a task reads
the stream once. It holds a node for each of the four last initials, and each
node carries the running SHA-256 of its own repaired text, so no text is held
once its row has gone by. Letters that all nodes share are taken off the
weights as they settle. One long conversation is one stream (its hash is
sequential) but never in memory: what grows is its audit, a letter a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow_map, slices, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
#: What it costs at most to go on from one node as from any other: an inserted assistant row and a
#: deleted system row. Nodes dearer than the cheapest by more can never win.
DETOUR = INSERT + DELETE
LETTERS = "DIKR"                                         # digits 1 to 4
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # what may be inserted or renamed to
NAME = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = {"su", "ua", "au"}
LONG = (1 << 63) - 1
WIDTH = 32  # letters of a weight at first

PLAN = ("conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, "
        "cost long, audit string, repaired_sha256 string")


class Repair:
    """Shortest path through the rows seen so far, one node for each last initial."""

    def __init__(self):
        self.width = WIDTH
        self.settled: list[str] = []
        self.spent = 0
        # node -> weight, letters in it, hash of the repaired rows
        self.nodes = {START: (0, 0, hashlib.sha256())}

    def _relax(self, edges) -> None:
        """Next layer: of the edges ``(to, from, cost, letter, line)`` into a node the least weight."""
        best: dict[int, tuple] = {}
        for to, frm, cost, letter, line in edges:
            weight, length, _ = self.nodes[frm]
            if letter:
                weight += (cost << 3 * self.width) + (letter << 3 * (self.width - 1 - length))
                length += 1
            if to not in best or weight < best[to][0]:
                best[to] = (weight, length, frm, line)
        self.nodes = {to: (weight, length, self._hashed(frm, line))
                      for to, (weight, length, frm, line) in best.items()}

    def _hashed(self, frm: int, line: bytes | None):
        sha = self.nodes[frm][2]
        if line is None:
            return sha
        sha = sha.copy()
        if frm != START:
            sha.update(b"\n")
        sha.update(line)
        return sha

    def _insert(self) -> None:
        """One row may be inserted here; two never pay, as they lead back to a node that was cheaper."""
        same = [(s, s, 0, 0, None) for s in self.nodes]
        self._relax(same + [(NEXT[s], s, INSERT, 2, NAME[NEXT[s]] + b":") for s in self.nodes])

    def row(self, role: str, text: bytes, delete: bool, truncated: bool) -> None:
        if max(n[1] for n in self.nodes.values()) + 2 > self.width:
            self._settle()
        self._insert()
        edges = [(s, s, DELETE, 1, None) for s in self.nodes]
        if not delete:
            more = TRUNCATED if truncated else 0
            kept = role.encode() + b":" + text
            for s in self.nodes:
                if (to := SYSTEM if s == START and role[:1] == "s" else NEXT[s]) in _INITIAL.get(role[:1], ()):
                    edges.append((to, s, KEEP + more, 3, kept))
                edges.append((NEXT[s], s, REROLE + more, 4, NAME[NEXT[s]] + b":" + text))
        self._relax(edges)
        most = min(n[0] for n in self.nodes.values()) + (DETOUR + 1 << 3 * self.width)
        self.nodes = {s: n for s, n in self.nodes.items() if n[0] < most}

    def _digits(self, weight: int) -> str:
        """The letters of a weight, zeros at the end as ``0``."""
        low = weight & ((1 << 3 * self.width) - 1)
        return f"{low:0{self.width}o}".translate(_OCTAL)

    def _settle(self) -> None:
        """Take off the letters that all nodes share; widen the weights where many are left."""
        bits = 3 * self.width
        low = (1 << bits) - 1
        first = next(iter(self.nodes.values()))[0] & low
        differ = 0
        for weight, _, _ in self.nodes.values():
            differ |= (weight & low) ^ first
        same = min(self.width - -(-differ.bit_length() // 3), *(n[1] for n in self.nodes.values()), self.width)
        self.settled.append(self._digits(first)[:same])
        off = min(n[0] >> bits for n in self.nodes.values())
        self.spent += off
        left = max(n[1] for n in self.nodes.values()) - same
        wider = self.width if left <= self.width // 2 else 2 * self.width
        self.nodes = {s: ((((w >> bits) - off) << 3 * wider) | (((w & low) << 3 * same & low) << 3 * (wider - self.width)),
                          n - same, sha) for s, (w, n, sha) in self.nodes.items()}
        self.width = wider

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the cheapest legal repair."""
        if max(n[1] for n in self.nodes.values()) + 1 > self.width:
            self._settle()
        self._insert()
        weight, _, sha = min((self.nodes[s] for s in (START, ASSISTANT) if s in self.nodes), key=lambda n: n[0])
        audit = "".join(self.settled) + self._digits(weight).rstrip("0")
        return self.spent + (weight >> 3 * self.width), audit, sha.hexdigest()


_INITIAL = {"s": (SYSTEM,), "u": (USER,), "a": (ASSISTANT,)}
_OCTAL = str.maketrans("1234", LETTERS)


class Conversation:
    """Counts and repair of one conversation, row by row in order."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.turn = self.initial = None

    def row(self, turn, role: str, text: bytes, first: bool) -> None:
        """``first``: no earlier row has this role and text."""
        self.n += 1
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        shown = text.rstrip(b" \t\n\x0b\f\r")
        blank, duplicate = not shown, bool(shown) and not first
        truncated = not (blank or duplicate) and shown[-1:] not in (b".", b"!", b"?")
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.row(role, text, blank or duplicate, truncated)

    def result(self) -> dict:
        gaps = 0 if self.low is None else min(self.turn - self.low + 1 - self.turns, LONG)
        cost, audit, sha = self.repair.result()
        return {"conv_id": self.conv_id, "n_rows": self.n, "gaps": gaps, "blank": self.blank,
                "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost,
                "audit": audit, "repaired_sha256": sha}


# --- Spark ---------------------------------------------------------------------

ROSTER, MARK, ROW = 0, 1, 2  # kinds of a stream's rows, in the order in which equal ones stand


def _ordered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, said, kind, text``: null role and text as one space, ``said`` the text's SHA-256."""
    blank = F.lit(" ")
    text = F.coalesce(F.col("text"), blank).cast("binary")
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       F.coalesce(F.col("role"), blank).alias("role"), F.unhex(F.sha2(text, 256)).alias("said"),
                       F.lit(ROW).alias("kind"), text.alias("text"))


def _stream(rows: DataFrame) -> DataFrame:
    """All rows of a conversation in one partition: by turn (null first), role, hash of the text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "said", "kind")


def _items(batches) -> Iterator[tuple]:
    for b in batches:
        for part in slices(b):
            yield from zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "kind", "text")))


def plan_repairs(rows: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Faults and cheapest repair of each conversation of ``rows(conv_id, turn, role, text)``.

    Returns the columns of ``PLAN``, one row for each conv_id of ``rows`` and,
    if given, of ``roster(conv_id)``; a conversation without rows has zeros,
    an empty audit and the hash of nothing. Null conv_ids are one
    conversation. Rows stand by turn, null first; rows of the same turn by
    role and by the hash of their text, so copies are neighbours. A null role
    or text is one space: such a role fits nowhere, such a text is blank. So
    does an empty role. Other columns are ignored whatever their names. No
    rows give no rows.

    Repeats are found by a group-by on conversation, role and hash of the
    text, which leaves one thin mark for the first of each; marks are sorted
    into the stream just before the row they mean.
    """
    own = _ordered(rows)
    keys = ["conv_id", "role", "said"]
    marks = own.groupBy(*keys).agg(F.min(F.struct("turn")).alias("first")).select(
        "conv_id", F.col("first.turn").alias("turn"), "role", "said", F.lit(MARK).alias("kind"),
        F.lit(None).cast("binary").alias("text"))
    stream = own.unionByName(marks)
    if roster is not None:
        stream = stream.unionByName(roster.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn(
            "kind", F.lit(ROSTER)), allowMissingColumns=True)

    def run(batches):
        out, now, marked = [], None, False
        for conv_id, turn, role, kind, text in _items(batches):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.result())
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                    out = []
                now, marked = Conversation(conv_id), False
            if kind == ROW:
                now.row(turn, role, text, marked)
            marked = kind == MARK
        if now is not None:
            out.append(now.result())
        if out:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return arrow_map(_stream(stream), run, PLAN)


_SCHEMA = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in PLAN.split(", ")])


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, place, turn, role, text, edit`` of the repaired conversations.

    ``rows`` as in :func:`plan_repairs`, ``plans`` its result. ``edit`` is K, R
    or I; an inserted row has a null turn and an empty text; deleted rows are
    left out. The audits are sorted into the stream ahead of their rows.
    """
    heads = plans.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("binary").alias("said"), F.lit(ROSTER).alias("kind"),
                         F.col("audit").cast("binary").alias("text"))

    def run(batches):
        out, place, state, letters = [], 0, START, iter("")

        def put(turn, role, text, edit):
            nonlocal place, state
            out.append({"conv_id": conv, "place": place, "turn": turn, "role": role, "text": text, "edit": edit})
            place += 1
            state = _INITIAL[role[:1]][0]

        def inserts() -> str | None:
            """Insert what the audit says; the letter after it."""
            while (letter := next(letters, None)) == "I":
                put(None, NAME[NEXT[state]].decode(), "", "I")
            return letter

        conv = None
        for conv_id, turn, role, kind, text in _items(batches):
            if kind == ROSTER:
                inserts()  # at the end of the conversation before
                conv, place, state, letters = conv_id, 0, START, iter(text.decode())
            else:
                letter = inserts()
                if letter in ("K", "R"):
                    put(turn, role if letter == "K" else NAME[NEXT[state]].decode(), text.decode("utf-8", "replace"),
                        letter)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        inserts()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                        ("text", pa.string()), ("edit", pa.string())])
    return arrow_map(_stream(_ordered(rows).unionByName(heads)), run,
                     "conv_id long, place long, turn long, role string, text string, edit string")


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by ``crc32(conv_id:turn) % 20``, 0 drops the row, 1 empties its text,
    2 takes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    cols = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(cols["conv_id"], F.lit(":"), cols["turn"]).cast("binary")) % 20
    text = (F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    return (conversations.select("conv_id", "turn", cols["role"].alias("role"), cols["text"].alias("text"),
                                 fate.alias("fate")).where("fate != 0")
            .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), F.explode(copies).alias("copy")).drop("copy"))


def op11_conversation_repair(spark, sf_dir):
    """Faults and cheapest repair of every conversation after the damage."""
    told = table(spark, sf_dir, "conversations")
    return plan_repairs(damage(told), roster=told.select("conv_id")).drop("n_rows")


def _sql() -> str:
    """DuckDB SQL of :func:`op11_conversation_repair`: the same layers by a recursive query, with
    ``(cost, audit)`` pairs and whole repaired texts."""
    bits = ("flatten(list_transform(string_split(k, ''), lambda ch: "
            "list_transform(range(8), lambda x: (CAST(ord(ch) AS BIGINT) >> x) & 1)))")
    crc = (f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 "
           "THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END), CAST(4294967295 AS BIGINT)), "
           "CAST(4294967295 AS BIGINT))")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    # States: 0 nothing kept, 1 system, 2 user, 3 assistant.
    after = "CASE WHEN {s} = 2 THEN 3 ELSE 2 END"
    name = "CASE WHEN {s} = 2 THEN 'assistant' ELSE 'user' END"
    joined = "CASE WHEN {s} = 0 THEN '' ELSE {body} || chr(10) END || {line}"
    inserted = joined.format(s="n.s", body="n.v.body", line=f"({name.format(s='n.s')}) || ':'")
    kept = joined.format(s="s", body="body", line="role || ':' || text")
    renamed = joined.format(s="s", body="body", line=f"({name.format(s='s')}) || ':' || text")
    fits = ("(ini = 's' AND s = 0) OR (ini = 'u' AND s <> 2) OR (ini = 'a' AND s = 2)")
    return f"""WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fated AS (SELECT *, {crc} % 20 AS fate FROM raw),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE fate <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role, sha256(text), copy) - 1 AS pos FROM damaged),
seen AS (SELECT *, substr(role, 1, 1) AS ini, rtrim(text, {white}) AS shown,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
faulty AS (SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
path AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS pos, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'body': ''}} AS v
  FROM counted
  UNION ALL
  SELECT conv_id, n, pos + 1, s2, min({{'cost': cost2, 'audit': audit2, 'body': body2}}) FROM (
    SELECT conv_id, n, pos, unnest([
        {{'s2': s, 'cost2': cost + 4, 'audit2': audit || 'D', 'body2': body, 'ok': true}},
        {{'s2': CASE WHEN ini = 's' THEN 1 ELSE {after.format(s='s')} END, 'cost2': cost + more,
          'audit2': audit || 'K', 'body2': {kept}, 'ok': ({fits}) AND stays}},
        {{'s2': {after.format(s='s')}, 'cost2': cost + 3 + more, 'audit2': audit || 'R', 'body2': {renamed},
          'ok': stays}}], recursive := true)
    FROM (
      SELECT n.conv_id, n.n, n.pos, f.ini, f.role, f.text, f.fault NOT IN ('blank', 'duplicate') AS stays,
        CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS more,
        CASE WHEN ins THEN {after.format(s='n.s')} ELSE n.s END AS s,
        n.v.cost + CASE WHEN ins THEN 3 ELSE 0 END AS cost, n.v.audit || CASE WHEN ins THEN 'I' ELSE '' END AS audit,
        CASE WHEN ins THEN {inserted} ELSE n.v.body END AS body
      FROM path n JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.pos = n.pos
      CROSS JOIN (VALUES (false), (true)) AS i(ins))) WHERE ok GROUP BY conv_id, n, pos, s2),
ended AS (SELECT n.conv_id, CASE WHEN ins THEN {after.format(s='n.s')} ELSE n.s END AS s,
    n.v.cost + CASE WHEN ins THEN 3 ELSE 0 END AS cost, n.v.audit || CASE WHEN ins THEN 'I' ELSE '' END AS audit,
    CASE WHEN ins THEN {inserted} ELSE n.v.body END AS body
  FROM path n CROSS JOIN (VALUES (false), (true)) AS i(ins) WHERE n.pos = n.n),
best AS (SELECT conv_id, min({{'cost': cost, 'audit': audit, 'body': body}}) AS v FROM ended
  WHERE s IN (0, 3) GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(b.v.cost, 0) AS cost,
  coalesce(b.v.audit, '') AS audit, sha256(coalesce(b.v.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""


OP11_SQL = _sql()
