"""Repair of the turn structure of conversations at least cost.

Roles must read `(s?(ua)+)?` by their initials. A turn may be kept (0), given the role that is due (1) or deleted (2, the only
way with a blank or repeated turn), and an empty turn of the role that is due inserted anywhere (5); a truncated turn
that stays adds 5. Four states tell what may come next: NONE (nothing yet), SYSTEM, USER, ASSISTANT (the last initial).

A task gets whole conversations, sorted, and reads them twice. Backwards, turn by turn, it keeps the cost-to-go of
each state, and writes down with the turn what each state would do: the ASCII-least edit among those whose cost plus the
cost-to-go behind it is the state's own (tight edits). Forwards it walks from NONE by these notes and hashes the turns that
result. Both walks keep four numbers or one state besides the sums that they return, and both sorts spill, so no
conversation is ever held; only its audit, a letter per edit, grows. One conversation is one stream, however long, because
the hash of its text is one chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import frugal, lean

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role is put in: by the initial, from which states.
AFTER = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that is due in each state, and the state it leads to. A system turn is never made.
DUE = ("user", "user", "assistant", "user")
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost of ending in a state without further edits.
END = (0, None, None, 0)
SPACE = "\x20\t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)

Costs = tuple[int, int, int, int]


def _with_inserts(plain: tuple[int | None, ...]) -> Costs:
    """Cost-to-go of each state where inserting is allowed before what `plain` costs (None: no other way)."""
    best = [10**18 if c is None else c for c in plain]
    for _ in range(2):
        best = [min(best[s], INSERT + best[NEXT[s]]) for s in range(4)]
    return tuple(best)


def _edits(costs: Costs, initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """Per state, the ways with a turn: (letter, cost with what follows, state after)."""
    ways: list[list[tuple[str, int, int]]] = [[("D", DELETE + costs[s], s)] for s in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = CUT_OFF if fault == TRUNCATED else 0
        for s in range(4):
            if s in AFTER.get(initial, {}):
                ways[s].append(("K", KEEP + more + costs[AFTER[initial][s]], AFTER[initial][s]))
            ways[s].append(("R", REROLE + more + costs[NEXT[s]], NEXT[s]))
    return ways


def _walk(before: Costs, state: int, ways: list[list[tuple[str, int, int]]] | None) -> str:
    """The letters of the ASCII-least tight edits from a state over one turn (or to the end, where ways is None)."""
    letters = ""
    while True:
        if ways is None and END[state] == before[state]:
            return letters
        tight = [] if ways is None else [(letter, after) for letter, cost, after in ways[state] if cost == before[state]]
        if INSERT + before[NEXT[state]] == before[state]:
            tight.append(("I", NEXT[state]))
        letter, after = min(tight)
        letters += letter
        if letter != "I":
            return letters
        state = after


#: Cost-to-go before the end, and the edits that are left there by state.
AT_END = _with_inserts(END)
LAST = tuple(_walk(AT_END, s, None) for s in range(4))


@lru_cache(100_000)
def step_back(costs: Costs, initial: str, fault: int) -> tuple[Costs, str]:
    """(cost-to-go before a turn, the letters of each state over it, joined by `|`). Costs are relative to the least."""
    ways = _edits(costs, initial, fault)
    before = _with_inserts(tuple(min(cost for _, cost, _ in own) for own in ways))
    notes = "|".join(_walk(before, s, ways) for s in range(4))
    return before, notes


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns last first -> the same turns with their notes."""
    now, costs, seen = None, AT_END, False
    for batch in batches:
        notes = []
        for conv, gone, initial, fault in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "gone", "initial", "fault")], strict=True):
            if not seen or conv != now:
                now, costs, seen = conv, AT_END, True
            if gone:
                notes.append(None)
                continue
            costs, note = step_back(costs, initial, fault)
            least = min(costs)
            costs = tuple(c - least for c in costs) if least else costs
            notes.append(note)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(notes, pa.string())], [*batch.schema.names, "notes"])


class _Sums:
    """What one conversation has come to."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.state, self.cost, self.illegal = conv, NONE, 0, 0
        self.faults, self.last, self.audit = [0, 0, 0, 0], None, []
        self.least = self.most = None
        self.turns = 0
        self.hash, self.lines = hashlib.sha256(), 0

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def insert(self) -> None:
        self.put(DUE[self.state], "")
        self.state, self.cost = NEXT[self.state], self.cost + INSERT

    def turn(self, turn: int | None, role: str, text: str, initial: str, fault: int, notes: str) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        self.faults[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        letters = notes.split("|")[self.state]
        self.audit.append(letters)
        for _ in letters[:-1]:
            self.insert()
        edit = letters[-1]
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += CUT_OFF if fault == TRUNCATED else 0
        if edit == "K":
            self.put(role, text)
            self.state = AFTER[initial][self.state]
        else:
            self.put(DUE[self.state], text)
            self.state, self.cost = NEXT[self.state], self.cost + REROLE

    def row(self) -> tuple:
        for _ in LAST[self.state]:
            self.audit.append("I")
            self.insert()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns first to last, with notes -> a row for each conversation."""
    sums: _Sums | None = None
    for batch in batches:
        done = []
        for conv, gone, *turn in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "gone", "turn", "role", "text", "initial", "fault", "notes")], strict=True):
            if sums is None or sums.conv != conv:
                if sums is not None:
                    done.append(sums.row())
                sums = _Sums(conv)
            if not gone:
                sums.turn(*turn)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(_KINDS)], _NAMES)
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(sums.row(), _KINDS, strict=True)], _NAMES)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the turns after damage by crc32(`conv_id:turn`) % 20, nulls read as one space.

    0 drops the turn (it stays, empty and marked as gone), 1 empties its text, 2 removes `.`, `!` and `?`, 3 doubles it, 4 makes it the user's.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    key = F.concat(text[0], F.lit(":"), text[1])
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text[2].alias("role"), text[3].alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_harm"))
    harm = F.col("_harm")
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(harm.isin(0, 1), "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (harm == 0).alias("gone"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


def repair(turns: DataFrame) -> DataFrame:
    """One row per conv_id with what is wrong with its turns, the cheapest edits and the digest of the repaired conversation.

    turns: conv_id, turn (longs, may be null), role, text (strings, not null), gone (such rows only name their conversation).
    Turns are taken by number, nulls first; equal numbers by role, then text. A null conv_id is a conversation of its own. A
    role whose initial is none of s, u, a (the empty one too) cannot be kept. Columns other than these are not read.
    An empty table gives no rows.
    """
    rows = lean(turns).select("conv_id", "turn", "role", "text", "gone")
    # One shuffle; the window and both sorts find each conversation's turns in one partition already.
    held = rows.repartition("conv_id")
    bare = F.rtrim("text", F.lit(SPACE))
    # A turn that is gone is no earlier turn.
    earlier = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.length("_bare") == 0, BLANK).when(F.col("_earlier"), DUPLICATE).when(~F.right("_bare", F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    known = held.withColumn("_earlier", earlier).withColumn("_bare", bare).select("conv_id", "gone", "turn", "role", "text", F.left("role", F.lit(1)).alias("initial"), "_earlier", fault.alias("fault"))
    back = known.sortWithinPartitions(F.col("conv_id"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("_earlier").desc())
    noted = back.mapInArrow(frugal(_backward), "conv_id long, gone boolean, turn long, role string, text string, initial string, _earlier boolean, fault int, notes string")
    return noted.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_earlier").mapInArrow(frugal(_forward), RESULT)
