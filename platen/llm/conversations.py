"""Repair of conversation structure: damage found, and the cheapest edits that give `(system)? (user assistant)+`.

Rows are brought together by conversation and sorted by turn once. Two streams then run over the sorted rows of each task and carry
only a small state from one Arrow batch to the next, so a conversation of any length needs no more memory than a short one:

1. from the last turn to the first, the cost of repairing what follows, for each of the four states of the pattern. Its backpointers,
   the best edit in each state, are two bits each: one byte a row, which goes with the row.
2. from the first turn to the last, along those bytes: the edits are made, counted and hashed.

Spark sorts again between the two, within the tasks, and spills rows and backpointers where they don't fit. A conversation is one stream
in one task because its repaired text has one hash; no task holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platen.llm.common import table

#: White space that makes no text, and marks that end one.
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States of the pattern: nothing yet, after system, after user, after assistant. The first and the last may end.
START, OPENED, ASKED, ANSWERED = range(4)
#: State -> the state after a user or assistant row: what comes next is a user's but after a user's.
NEXT = (ASKED, ASKED, ANSWERED, ASKED)
ROLE = ("user", "user", "assistant", "user")
#: Edits in the order in which equal costs prefer them, which is that of their letters.
EDITS = "DIKR"
# What a row is to the pattern: its role's initial, and whether it must go or was cut off.
KINDS = {"s": 0, "u": 1, "a": 2}
OTHER, GONE, CUT = 3, 4, 8
_END = (0, 2 * INSERT, INSERT, 0)


def after_keeping(state: int, role: int) -> int | None:
    """The state after a row with this role's number, None where the pattern has no place for it."""
    if role == KINDS["s"]:
        return OPENED if state == START else None
    return NEXT[state] if role == KINDS[ROLE[state][0]] else None


def before_row(ahead: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """(cost by state before a row, best edits, two bits a state) from the cost after it. Insertions stand before the row."""
    role, gone, cut = kind & 3, kind & GONE, TRUNCATED if kind & CUT else 0
    ways: list[dict[str, int]] = []
    for state in range(4):
        found = {"D": DELETE + ahead[state]}
        if not gone:
            kept = after_keeping(state, role)
            if kept is not None:
                found["K"] = cut + ahead[kept]
            found["R"] = REROLE + cut + ahead[NEXT[state]]
        ways.append(found)
    least = [min(w.values()) for w in ways]
    # An insertion leads to another state before the same row; two in a row lead back, so one round of them settles all.
    for state in (ASKED, ANSWERED):
        ways[state]["I"] = INSERT + least[NEXT[state]]
    settled = [min(w.values()) for w in ways]
    for state in (START, OPENED):
        ways[state]["I"] = INSERT + settled[ASKED]
    cost, edits = [], 0
    for state, w in enumerate(ways):
        best = min(w.values())
        cost.append(best)
        edits |= next(k for k, e in enumerate(EDITS) if w.get(e) == best) << 2 * state
    return tuple(cost), edits


class Steps(dict):
    """(costs after a row less the least, kind) -> (costs before it less the least, edits): few ever occur, so each is worked out once."""

    def __missing__(self, key):
        cost, edits = before_row(*key)
        self[key] = tuple(c - min(cost) for c in cost), edits
        return self[key]


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, last turn first, come back with their edits and their place from the end."""
    steps, now, ahead, place = Steps(), object(), _END, 0
    for b in batches:
        edits, places = [], []
        for conv, kind in zip(b.column("conv").to_pylist(), b.column("kind").to_pylist(), strict=True):
            if conv != now:
                now, ahead, place = conv, _END, 0
            made = 0
            if kind is not None:
                ahead, made = steps[ahead, kind]
            edits.append(made)
            places.append(place := place + 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(edits, pa.int16()), pa.array(places, pa.int64())], [*b.schema.names, "edits", "place"])


class Repair:
    """One conversation read from its first turn to its last."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.cost, self.audit = conv, START, 0, bytearray()
        self.hash, self.rows = hashlib.sha256(), 0
        self.low = self.high = self.last = None
        self.turns, self.counts, self.illegal, self.initial = 0, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None

    def put(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.rows > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.rows += 1

    def insert(self) -> None:
        self.put(ROLE[self.state], "")
        self.state, self.cost = NEXT[self.state], self.cost + INSERT
        self.audit += b"I"

    def row(self, turn: int | None, role: str, text: str, kind: int, fault: str | None, edits: int) -> None:
        if turn is not None and turn != self.last:
            self.low, self.high, self.last, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        if fault:
            self.counts[fault] += 1
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        while (edit := EDITS[edits >> 2 * self.state & 3]) == "I":
            self.insert()
        self.audit += edit.encode()
        if edit == "D":
            self.cost += DELETE
            return
        self.put(ROLE[self.state] if edit == "R" else role, text)
        self.cost += (REROLE if edit == "R" else 0) + (TRUNCATED if kind & CUT else 0)
        self.state = NEXT[self.state] if edit == "R" else after_keeping(self.state, kind & 3)

    def done(self) -> tuple:
        while self.state not in (START, ANSWERED):
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = (pa.int64(),) * 7 + (pa.string(),) * 2


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with edits, sorted by conversation, first turn first -> a row for each conversation."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    repair = None
    columns = ("conv", "turn", "role", "text", "kind", "fault", "edits")

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)

    for b in batches:
        rows = []
        for conv, turn, role, text, kind, fault, edits in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if repair is None or conv != repair.conv:
                if repair:
                    rows.append(repair.done())
                repair = Repair(conv)
            if kind is not None:
                repair.row(turn, role, text, kind, fault, edits)
        yield from out(rows)
    if repair:
        yield from out([repair.done()])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, present): rows with faults put in by the hash of `conv:turn`; a row that is dropped stays as one that is not present."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(of("conv"), F.lit(":"), of("turn")).cast("binary")) % 20).cast("int")
    text = F.when(kind <= 1, "").when(kind == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    made = rows.select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows with `fault`, the first of blank, duplicate and truncated that a row has, and `kind`, what it is to the pattern (null: not present)."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    earlier = F.row_number().over(Window.partitionBy("conv", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(~F.col("present"), None).when(trimmed == "", "blank").when(earlier, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(*ENDS), "truncated")
    initial: Column = F.lit(OTHER)
    for letter, number in KINDS.items():
        initial = F.when(F.substring("role", 1, 1) == letter, number).otherwise(initial)
    mark = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(0)
    return rows.withColumn("fault", fault).withColumn("kind", F.when(F.col("present"), initial + mark).cast("int"))


def repaired(rows: DataFrame) -> DataFrame:
    """Rows of faults() -> a row for each conversation. They are shuffled once."""
    own = rows.select("conv", "turn", "role", "text", "fault", "kind")
    copy = F.coalesce(F.col("fault") == "duplicate", F.lit(False))
    last_first = own.sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), copy.desc())
    back = last_first.mapInArrow(backward, "conv long, turn long, role string, text string, fault string, kind int, edits short, place long")
    return back.sortWithinPartitions("conv", F.desc("place")).mapInArrow(forward, RESULT)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null role or text is one space; rows without a conversation's id are one conversation. Rows go by turn, nulls first; rows of one turn by role,
    then text, and of equal rows the first is the original. damage: puts faults in first (see damaged()); a conversation that loses all its rows has zeros, an
    empty audit and the hash of nothing. An empty table gives no row. Other columns are not read.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    rows = damaged(rows) if damage else rows.withColumn("present", F.lit(True))
    return repaired(faults(rows.repartition("conv")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"), damage=True)
