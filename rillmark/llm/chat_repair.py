"""Conversation structure repair: the cheapest edits that make a conversation well formed.

Well formed are no turns at all, or an optional system turn and then user and assistant in
turn, ending with the assistant.  A row may be kept, given the role user or assistant, or
deleted; empty turns may be inserted anywhere.  That is a weighted automaton of four states
(nothing yet, after system, after user, after assistant) which reads the kinds of a
conversation's rows.

It is determinised lazily.  What each state costs after some rows, less the least of them,
is one state of the deterministic automaton; a state's successor under a kind of row is
worked out when first met and kept in a transition table, with the cost that was taken off.
Scanning a conversation is then one look-up a row.  States more than SLACK above the least
are given up: from any state the rest of any path can be imitated at SLACK more, so there
are finitely many vectors, a few dozen, and no best path is lost.  Going backwards from the
end over tight arcs, those that lie on a cheapest path, marks the states that each place
may have; going forwards through these and always taking the least letter gives the audit.

Edits are written K (keep), R (new role), D (delete), I (insert).  K costs nothing, R and I
3, D 4; a truncated row that stays costs 3 more; blank rows and duplicates must go.

Order and memory: rows are dealt by conversation and sorted by turn (nulls first), then
role, text and copy.  They are streamed: while a conversation is read, a byte for each row
and a digest of 16 bytes for each distinct row are held, no texts.  A second pass over the
sorted rows writes the repaired text into its hash as it goes.

Defined cases: a null role or text is one space; a null in the name that decides the damage
too; null conv_id is a conversation of its own; a role other than system, user or assistant
counts by its first letter, and cannot be kept if that is another; rows with one turn are in
the order of their roles and texts; repeated rows are rows; a conversation that the damage
leaves without rows has zeros, an empty audit and the hash of the empty string; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Costs of a new role, a deletion, an insertion, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The most that imitating another state's path can cost: an insertion and a deletion.
SLACK = INSERT + DELETE
NEVER = 1 << 60
#: States; conversations may end in NOTHING or ASSISTANT.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What a turn of a role does to each state (None: not allowed).
STEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {USER: "user", ASSISTANT: "assistant"}

#: Kinds of rows: must go; or first letter of the role (or another), whole or truncated.
GONE = 0
KINDS = {(letter, cut): 1 + 2 * i + cut for i, letter in enumerate("sua?") for cut in (False, True)}
_LETTER = {k: letter for (letter, _), k in KINDS.items()}
_EXTRA = {k: TRUNCATED * cut for (_, cut), k in KINDS.items()}

SPACES = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")


def arcs_of(kind: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of all edits of a row."""
    out = [("D", i, i, DELETE) for i in range(4)]
    if kind != GONE:
        extra = _EXTRA[kind]
        out += [("K", i, j, extra) for i, j in STEP.get(_LETTER[kind], {}).items()]
        out += [("R", i, j, REROLE + extra) for r in "ua" for i, j in STEP[r].items()]
    return out


ARCS = [arcs_of(k) for k in range(len(KINDS) + 1)]
INSERTS = [("I", i, j, INSERT) for r in "ua" for i, j in STEP[r].items()]


def _closed(costs: list[int]) -> list[int]:
    """Costs with insertions; two in a row reach all that more would."""
    for _ in range(2):
        for _, i, j, c in INSERTS:
            costs[j] = min(costs[j], costs[i] + c)
    return costs


class Automaton:
    """The deterministic automaton as far as it is known."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.tight: dict[tuple[int, int, int], int] = {}
        self.start, _ = self._state([0, NEVER, NEVER, NEVER])

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The state of a cost vector and what was taken off its costs."""
        costs = _closed(costs)
        least = min(costs)
        vector = tuple(c - least if c - least <= SLACK else NEVER for c in costs)
        at = self.number.setdefault(vector, len(self.vectors))
        if at == len(self.vectors):
            self.vectors.append(vector)
            self.table.append([None] * len(ARCS))
        return at, least

    def step(self, at: int, kind: int) -> tuple[int, int]:
        known = self.table[at][kind]
        if known is None:
            after = [NEVER] * 4
            for _, i, j, c in ARCS[kind]:
                after[j] = min(after[j], self.vectors[at][i] + c)
            known = self.table[at][kind] = self._state(after)
        return known

    def before(self, at: int, kind: int, ends: int) -> int:
        """States (as bits) at ``at`` from which a tight arc of a row leads into ``ends``, or
        insertions before the row lead to such a state."""
        key = (at, kind, ends)
        if key not in self.tight:
            here, (to, taken) = self.vectors[at], self.step(at, kind)
            there = self.vectors[to]
            found = sum({1 << i for _, i, j, c in ARCS[kind] if ends >> j & 1 and here[i] < NEVER and here[i] + c == there[j] + taken})
            self.tight[key] = self.inserted(at, found)
        return self.tight[key]

    def inserted(self, at: int, ends: int) -> int:
        """``ends`` and the states from which tight insertions lead there."""
        here = self.vectors[at]
        for _ in range(2):
            for _, i, j, c in INSERTS:
                if ends >> j & 1 and here[i] < NEVER and here[i] + c == here[j]:
                    ends |= 1 << i
        return ends

    def repair(self, kinds: bytes | bytearray) -> tuple[int, str]:
        """Cost and audit of a conversation."""
        path, cost = [self.start], 0
        for kind in kinds:
            to, taken = self.step(path[-1], kind)
            path.append(to)
            cost += taken
        last = self.vectors[path[-1]]
        least = min(last[NOTHING], last[ASSISTANT])
        ends = sum(1 << i for i in (NOTHING, ASSISTANT) if last[i] == least)
        # states after each row, with insertions, from which the rest is tight
        marks = [self.inserted(path[-1], ends)]
        for i in range(len(kinds) - 1, -1, -1):
            marks.append(self.before(path[i], kinds[i], marks[-1]))
        marks.reverse()
        now, audit = {NOTHING}, []
        for i, kind in enumerate(kinds):
            here, (to, taken), ahead = self.vectors[path[i]], self.step(path[i], kind), marks[i + 1]
            there = self.vectors[to]
            leaves = [(x, a, b) for x, a, b, c in ARCS[kind] if ahead >> b & 1 and here[a] < NEVER and here[a] + c == there[b] + taken]
            stays = [(x, a, b) for x, a, b, c in INSERTS if marks[i] >> b & 1 and here[a] < NEVER and here[a] + c == here[b]]
            while True:
                arcs = [(x, b, True) for x, a, b in leaves if a in now] + [(x, b, False) for x, a, b in stays if a in now]
                letter = min(x for x, _, _ in arcs)
                audit.append(letter)
                now = {b for x, b, _ in arcs if x == letter}
                if letter != "I":
                    break
        while not any(ends >> i & 1 for i in now):
            audit.append("I")
            now = {b for _, a, b, c in INSERTS if a in now and marks[-1] >> b & 1 and last[a] + c == last[b]}
        return cost + least, "".join(audit)


# Rows ----------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: the rows after the damage of the contract, which a
    hash of conversation and turn decides.  Nulls become one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    fate = F.crc32(name.cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), fate.alias("fate"), F.coalesce("role", space).alias("role"), text.alias("text")).filter("fate <> 0")
    rows = rows.withColumns(
        {
            "text": F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
            "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role")),
            "copy": F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    return rows.drop("fate")


#: What pass one finds in a conversation, in order.
FIGURES = ("gaps", *FAULTS, "illegal", "cost")
#: A conversation is a first row, which names it and may carry its audit, and its rows.
COLUMNS = ("conv_id", "first", "turn", "role", "text", "copy", "figures")


def _in_order(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's head and rows behind one another, in one partition."""
    both = heads.select("conv_id", F.lit(0).alias("first"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), "text", F.lit(0).alias("copy"), "figures")
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.lit(1).alias("first"), "turn", "role", "text", "copy", F.lit(None).cast("array<long>").alias("figures"))
    return both.unionByName(rows).repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in COLUMNS[:-1]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in COLUMNS), strict=True)


def _batched(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH_ROWS rows and, for their strings, about BATCH_BYTES."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == shared.BATCH_ROWS or size > shared.BATCH_BYTES:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _kind(role: str, text: str, seen: set[bytes]) -> tuple[int, str | None]:
    """The kind of a row, and its first fault."""
    digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
    again = digest in seen
    seen.add(digest)
    full = text.strip(SPACES)
    if not full:
        return GONE, "blank"
    if again:
        return GONE, "duplicate"
    cut = full[-1] not in ".!?"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "?"
    return KINDS[letter, cut], "truncated" if cut else None


class _Conversation:
    """What is held of a conversation while its rows go by."""

    def __init__(self, conv: str | None) -> None:
        self.conv, self.kinds, self.seen = conv, bytearray(), set()
        self.faults = dict.fromkeys(FAULTS, 0)
        self.turns, self.low, self.high = 0, None, None
        self.legal, self.last = 0, ""

    def add(self, turn: int | None, role: str, text: str) -> None:
        kind, fault = _kind(role, text, self.seen)
        if fault:
            self.faults[fault] += 1
        self.legal += bool(self.kinds) and self.last + role[:1] in ("su", "ua", "au")
        self.kinds.append(kind)
        self.last = role[:1]
        if turn is not None and turn != self.high:  # turns come in order
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low

    def result(self, machine: Automaton) -> tuple[str | None, list[int], str]:
        cost, audit = machine.repair(self.kinds)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, [gaps, *self.faults.values(), max(len(self.kinds) - 1, 0) - self.legal, cost], audit


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; each conversation's figures and, as text, its audit out."""

    def results() -> Iterator[tuple]:
        machine, now = Automaton(), None
        for conv, first, turn, role, text, _, _ in _rows(batches):
            if first == 0:
                if now:
                    yield now.result(machine)
                now = _Conversation(conv)
            else:
                now.add(turn, role, text)
        if now:
            yield now.result(machine)

    yield from _batched(results(), {"conv_id": pa.string(), "figures": pa.list_(pa.int64()), "text": pa.string()})


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows in, with audits in the heads.  A head goes by as (conv_id, None, figures,
    audit), followed by its repaired turns as (conv_id, place, role, text)."""
    audit, at, state, place = "", 0, NOTHING, 0

    def turn(role: str | None, text: str) -> tuple:
        nonlocal state, place
        if role is not None and state == NOTHING and role[:1] == "s":
            state = SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
        place += 1
        return conv, place - 1, ROLES[state] if role is None else role, text

    for conv, first, _, role, text, _, figures in _rows(batches):
        if first == 0:
            audit, at, state, place = text, 0, NOTHING, 0
            yield conv, None, figures, audit
        else:
            letter, at = audit[at], at + 1
            if letter != "D":
                yield turn(role if letter == "K" else None, text)
        while audit[at : at + 1] == "I":
            at += 1
            yield turn(None, "")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's figures, audit and the hash of its repaired turns."""

    def results() -> Iterator[tuple]:
        head, digest = None, hashlib.sha256()
        for row in _repaired(batches):
            if row[1] is None:
                if head:
                    yield head[0], *head[2], head[3], digest.hexdigest()
                head, digest = row, hashlib.sha256()
            else:
                digest.update(f"{chr(10) if row[1] else ''}{row[2]}:{row[3]}".encode())
        if head:
            yield head[0], *head[2], head[3], digest.hexdigest()

    yield from _batched(results(), {"conv_id": pa.string(), **dict.fromkeys(FIGURES, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()})


def audits(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id (as a string), figures and text (the audit) of the conversations of ``rows``
    (conv_id, turn, role, text, copy), and of ``conversations`` that have no row."""
    named = (rows if conversations is None else conversations).select(F.col("conv_id").cast("string").alias("conv_id")).distinct()
    heads = named.select("conv_id", F.lit("").alias("text"), F.lit(None).cast("array<long>").alias("figures"))
    return shared.map_arrow(_in_order(heads, rows), _audited, "conv_id string, figures array<long>, text string")


def repaired(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the conversations after the edits of ``audits``."""
    kinds = {"conv_id": pa.string(), "place": pa.int64(), "role": pa.string(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((r for r in _repaired(batches) if r[1] is not None), kinds)

    out = shared.map_arrow(_in_order(heads, rows), run, "conv_id string, place long, role string, text string")
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def digests(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, the figures, audit and repaired_sha256: a row for each conversation."""
    heads = shared.table(audits(rows, conversations), "chat-audits")
    schema = "conv_id string, " + ", ".join(f"{f} long" for f in FIGURES) + ", audit string, repaired_sha256 string"
    out = shared.map_arrow(_in_order(heads, rows), _hashed, schema)
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = shared.read(spark, sf_dir, "conversations")
    return digests(damaged(turns), turns)
