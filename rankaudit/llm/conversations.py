"""Conversation structure repair by survivor-coalescence Viterbi.

A conversation is read in order and rewritten at least cost, so that the initials
of its roles match ``(s?(ua)+)?``: a row is kept (K, 0), given the role user or
assistant (R, 3) or deleted (D, 4), and an empty row of user or assistant may be
inserted anywhere (I, 3).  Blank and repeated rows must be deleted; a truncated row
that stays adds 3.  Of equally cheap edits the one whose initials come first in
ASCII order is taken.

The states are what has been written so far: nothing, a system row, a user row last,
an assistant row last.  Each state's survivor is a leaf of a tree of backpointers; a
node's references are its children, and a node without any is freed.  Once all
survivors share an ancestor, the edits up to it are final and are emitted, so that
memory holds only what is still open.  A survivor that another can replace for strictly
less, whatever follows, is dropped (``BRIDGE``); without that, the path which deletes
everything would keep all rows open.  Ties compare the whole unresolved suffixes:
edits of one number of rows are never a prefix of one another (the letters beyond
would be a further row), so the order of two suffixes decides the order of all
that grow from them, and each survivor's place in that order is kept with it.

Spark deals conversations by id, marks repeated rows with a window over
(conversation, role, text) and sorts; both sorts spill.  A task then streams its rows
in Arrow batches.  A digest is one SHA-256 over the whole repaired conversation, which
is why the rows of one conversation pass through one task, however many there are;
beyond ``HELD`` bytes of open text each survivor takes the hash of its own path and
the texts are dropped, so that a long conversation costs a task a node for each open row.

Defined cases: a null role or text is one space; a null conv_id is one conversation; rows
without a turn come first; rows of one turn are ordered by role and text; a role's initial is
its first character (an empty role has none and is never kept); an empty table gives an
empty result; repeated rows are duplicates; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rankaudit.llm.scoring import slices
from rankaudit.llm.store import written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing written, a system row, a user row last, an assistant row last.
EMPTY, SYSTEM, USER, ASSISTANT = "0", "s", "u", "a"
ENDS = (EMPTY, ASSISTANT)
#: BRIDGE[y][x]: how much dearer at most the survivor of x can write whatever that of y may
#: yet write (by inserting rows first; a system row that only y may keep is deleted).
BRIDGE = {
    EMPTY: {SYSTEM: 2 * INSERT + DELETE, USER: INSERT + DELETE, ASSISTANT: DELETE},
    SYSTEM: {EMPTY: 0, USER: INSERT, ASSISTANT: 0},
    USER: {EMPTY: INSERT, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {EMPTY: 0, SYSTEM: 2 * INSERT, USER: INSERT},
}
#: Faults of a row; the first that holds counts.
FAULTS = ("", "blank", "duplicate", "truncated")
#: Bytes of text that may be open before survivors take hashes of their own paths.
HELD = 4 << 20
#: Rows of a batch that a task hands back.
OUT_ROWS = 2048
SPACE = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with planted faults: by crc32 of
    ``conv_id:turn`` modulo 20 a row is dropped (0 copies), emptied, stripped of its
    ``[.!?]``, repeated (2 copies), or given the role user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key.cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def as_they_are(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of a table that needs no damage."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.lit(1).alias("copies"))


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), "role", "text", "again"]


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) dealt by conversation and sorted:
    plus gone (a row of 0 copies, kept to name its conversation), again (whether the
    conversation has the same role and text earlier) and fault (index in FAULTS)."""
    each = rows.withColumn("gone", F.col("copies") == 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = each.drop("copies", "copy").repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(end == "", 1).when(F.col("again"), 2)
        .when(~F.substring(end, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    )
    return marked.withColumn("fault", fault).sortWithinPartitions("conv_id", *_order())


class _Node:
    """A survivor's edits for one row: its backpointer, its children (the references that
    keep it), the edits, the row (role, text; no text once hashes are taken) and its size;
    ``taken`` is what the path up to and with this node writes."""

    __slots__ = ("parent", "children", "edits", "row", "size", "taken")

    def __init__(self, parent, edits, row, size):
        self.parent, self.edits, self.row, self.size = parent, edits, row, size
        self.children, self.taken = [], None
        if parent is not None:
            parent.children.append(self)


class _Written:
    """What edits write: the state, whether anything was written, and its hash."""

    __slots__ = ("state", "hash", "any")

    def __init__(self, state=EMPTY, taken=None, any_=False):
        self.state, self.hash, self.any = state, taken or hashlib.sha256(), any_

    def copy(self) -> _Written:
        return _Written(self.state, self.hash.copy(), self.any)

    def edit(self, letter: str, row: tuple | None) -> str | None:
        """Apply one edit; the role it writes, if any."""
        if letter == "D":
            return None
        role = row[0] if letter == "K" else "assistant" if self.state == USER else "user"
        text = "" if letter == "I" else row[1]
        self.state = role[0]
        if text is not None:
            self.hash.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any = True
        return role


class Repair:
    """One conversation, row by row.  ``emit(letter, role)`` is called for every final edit."""

    def __init__(self, conv, emit: Callable[[str, str | None], None], held: int = HELD):
        self.conv, self.emit, self.limit = conv, emit, held
        self.root = _Node(None, "", None, 0)
        self.live = {EMPTY: (0, 0, self.root)}  # state -> cost, place among the open suffixes, leaf
        self.out, self.held, self.cost = _Written(), 0, 0
        self.counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
        self.last_role, self.low, self.high, self.turns = None, None, None, 0

    def _closed(self) -> dict:
        """state -> (cost, place, edits, leaf), with rows inserted where that is cheaper or first."""
        best = {s: (c, place, "", leaf) for s, (c, place, leaf) in self.live.items()}
        for new, olds in ((USER, (EMPTY, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for s in olds:
                if s in best:
                    c, place, edits, leaf = best[s]
                    self._offer(best, new, (c + INSERT, place, edits + "I", leaf))
        return best

    @staticmethod
    def _offer(best: dict, state: str, found: tuple) -> None:
        if state not in best or found[:3] < best[state][:3]:
            best[state] = found

    def row(self, turn, role: str, text: str, fault: int) -> None:
        self._count(turn, role, fault)
        before, best = self._closed(), {}
        more = TRUNCATED if fault == 3 else 0
        for s, (c, place, edits, leaf) in before.items():
            self._offer(best, s, (c + DELETE, place, edits + "D", leaf))
            if fault in (1, 2):
                continue
            turned = ASSISTANT if s == USER else USER
            self._offer(best, turned, (c + REROLE + more, place, edits + "R", leaf))
            first = role[:1]
            if first == turned or (first == SYSTEM and s == EMPTY):
                self._offer(best, first, (c + more, place, edits + "K", leaf))
        size = len(text)
        self._survive(best, (role, text), size)
        self.held += size
        self._settle()
        if self.held > self.limit:
            self._take_hashes()

    def _survive(self, best: dict, row: tuple | None, size: int) -> None:
        """The leaves of the next row; what no survivor refers to is freed."""
        old = [leaf for _, _, leaf in self.live.values()]
        best = {s: x for s, x in best.items() if all(best[o][0] + b >= x[0] for o, b in BRIDGE[s].items() if o in best)}
        in_order = sorted(best.items(), key=lambda x: (x[1][1], x[1][2]))
        self.live = {s: (c, i, _Node(leaf, edits, row, size)) for i, (s, (c, _, edits, leaf)) in enumerate(in_order)}
        for node in old:
            while node is not self.root and not node.children:
                parent, node.parent = node.parent, None
                parent.children.remove(node)
                node = parent

    def _settle(self) -> None:
        """Emit the edits up to the last ancestor that all survivors share."""
        while len(self.root.children) == 1:
            node = self.root.children.pop()
            self.out = self._write(self.out, node, self.emit)
            self.held -= node.size
            node.parent, self.root = None, node

    @staticmethod
    def _write(out: _Written, node: _Node, emit: Callable | None) -> _Written:
        for letter in node.edits:
            role = out.edit(letter, node.row)
            if emit:
                emit(letter, role)
        return node.taken or out

    def _take_hashes(self) -> None:
        paths = []
        for _, _, leaf in self.live.values():
            path, node = [], leaf
            while node is not self.root and node.taken is None:
                path.append(node)
                node = node.parent
            out = (self.out if node is self.root else node.taken).copy()
            for node in reversed(path):
                out = self._write(out, node, None)
            paths.append((leaf, path, out))
        for leaf, path, out in paths:
            leaf.taken = out
            for node in path:
                node.row, node.size = node.row and (node.row[0], None), 0
        self.held = 0

    def _count(self, turn, role: str, fault: int) -> None:
        if fault:
            self.counts[FAULTS[fault]] += 1
        if self.last_role is not None and self.last_role[:1] + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last_role = role
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def finish(self) -> None:
        closed = self._closed()
        cost, place, edits, leaf = min((closed[s] for s in ENDS if s in closed), key=lambda x: x[:3])
        self.cost = cost
        if self.low is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.turns
        self._survive({ASSISTANT: (cost, place, edits, leaf)}, None, 0)
        self._settle()


def _streamed(rows: DataFrame, fields: list[StructField], start: Callable, close: Callable) -> DataFrame:
    """``ordered`` rows through one Repair a conversation: ``start(conv)`` gives its emit and
    what collects, ``close(repair, what)`` the conversation's result rows (tuples of ``fields``)."""
    rows = rows.select("conv_id", "turn", "role", "text", "fault", "gone")
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        open_ = what = None

        def handed() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return done

        for batch in batches:
            for part in slices(batch, "text"):
                for conv, turn, role, text, fault, gone in zip(*[c.to_pylist() for c in part.columns]):
                    if open_ is None or conv != open_.conv:
                        if open_ is not None:
                            open_.finish()
                            out += close(open_, what)
                        emit, what = start(conv)
                        open_ = Repair(conv, emit)
                    if not gone:
                        open_.row(turn, role, text, fault)
                    if len(out) >= OUT_ROWS:
                        yield handed()
        if open_ is not None:
            open_.finish()
            out += close(open_, what)
        if out:
            yield handed()

    return rows.mapInArrow(run, schema)


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text, copies): conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  ``gaps`` are the
    turns missing between its first and last; without any rows all is zero or empty."""
    names = ("gaps", "blank", "duplicate", "truncated", "illegal")

    def start(conv):
        letters: list[str] = []
        return (lambda letter, role: letters.append(letter)), letters

    def close(done: Repair, letters: list[str]) -> list[tuple]:
        return [(done.conv, *[done.counts[n] for n in names], done.cost, "".join(letters), done.out.hash.hexdigest())]

    fields = [StructField(n, LongType()) for n in (*names, "cost")] + [StructField(n, StringType()) for n in ("audit", "repaired_sha256")]
    return _streamed(ordered(rows), fields, start, close)


def repair_edits(rows: DataFrame) -> DataFrame:
    """The edits of every conversation: conv_id, step (from 1), edit, pos (the row it is
    applied to, from 1 in the conversation's order; null for an insertion) and role (what
    it writes; null for a deletion)."""

    def start(conv):
        script: list[tuple] = []
        at = [0]

        def emit(letter, role):
            at[0] += letter != "I"
            script.append((conv, len(script) + 1, letter, at[0] if letter != "I" else None, role))

        return emit, script

    fields = [StructField("step", LongType()), StructField("edit", StringType()), StructField("pos", LongType()), StructField("role", StringType())]
    return _streamed(ordered(rows), fields, start, lambda done, script: script)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, step, edit, turn, role, text (empty for an
    insertion).  The rows keep their texts in Spark: the edits are joined to them."""
    place = Window.partitionBy("conv_id").orderBy(*_order())
    placed = written(ordered(rows).where(~F.col("gone")).withColumn("pos", F.row_number().over(place).cast("long")), "placed-rows")
    edits = repair_edits(rows).where("edit <> 'D'")
    on = edits["conv_id"].eqNullSafe(placed["conv_id"]) & (edits["pos"] == placed["pos"])
    return edits.join(placed, on, "left").select(
        edits["conv_id"], "step", "edit", "turn", edits["role"], F.coalesce(placed["text"], F.lit("")).alias("text")
    )


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The digest query: ``repair_digests`` of the damaged table."""
    return repair_digests(damage(conversations))


def _oracle() -> str:
    """The damage, the faults and a recursive query that carries each state's cheapest edits row by row."""

    def more(x: str, cost: str, letter: str, role: str | None = None, text: str = "''") -> str:
        """The edits ``x`` and one more, or null where there are none."""
        wrote = f"{x}['o'] || chr(10) || {role} || ':' || {text}" if role else f"{x}['o']"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}['c'] + {cost}, 't': {x}['t'] || '{letter}', 'o': {wrote}}} END"

    def least(*xs: str) -> str:
        return f"list_min([{', '.join(xs)}])"

    def where(test: str, x: str) -> str:
        return f"CASE WHEN {test} THEN {x} END"

    closed = f"""z, s, {least("u", *[more(x, str(INSERT), "I", "'user'") for x in "zsa"])} AS u1,
    {least("a", more("u1", str(INSERT), "I", "'assistant'"))} AS a1"""
    stay = f"(CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END)"
    keep = lambda x: more(x, stay, "K", "role", "text")
    turn = lambda x, role: more(x, f"{REROLE} + {stay}", "R", f"'{role}'", "text")
    drop = lambda x: more(x, str(DELETE), "D")
    never = "CAST(NULL AS STRUCT(c BIGINT, t VARCHAR, o VARCHAR))"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(key, '')])]),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos,
  body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM e),
g AS (SELECT *, left(lag(role) OVER w, 1) || left(role, 1) AS pair, lag(pos) OVER w IS NOT NULL AS later FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup,
  count(*) FILTER (truncated) AS truncated, count(*) FILTER (later AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM g GROUP BY conv_id),
v AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, CAST({{'c': 0, 't': '', 'o': ''}} AS STRUCT(c BIGINT, t VARCHAR, o VARCHAR)) AS z, {never} AS s, {never} AS u, {never} AS a FROM n
 UNION ALL
 SELECT conv_id, pos, {drop("z")}, {least(drop("s"), where("stays AND first = 's'", keep("z")))},
  {least(drop("u1"), *[where("stays AND first = 'u'", keep(x)) for x in ("z", "s", "a1")], *[where("stays", turn(x, "user")) for x in ("z", "s", "a1")])},
  {least(drop("a1"), where("stays AND first = 'a'", keep("u1")), where("stays", turn("u1", "assistant")))}
 FROM (SELECT v.conv_id, f.pos, role, text, left(role, 1) AS first, truncated, NOT (blank OR dup) AS stays, {closed}
  FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.pos = v.pos + 1)),
r AS (SELECT v.conv_id, {least("z", "a1")} AS best FROM (SELECT conv_id, pos, {closed} FROM v) v
  JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id AND n.rows = v.pos)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(dup, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best['c'], 0) AS cost, coalesce(best['t'], '') AS audit, sha256(substr(coalesce(best['o'], ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""


ORACLE = _oracle()
