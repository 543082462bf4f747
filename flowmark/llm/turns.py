"""Repair of the order of roles in conversations, by streams sorted within conversations.

The roles of a sound conversation begin with a system turn or not, then user and assistant take turns, the
assistant last; a conversation may also be empty. Rows may be kept, given another role, deleted, or turns
without text inserted. The cheapest edits are found, of equally cheap ones those whose initials
(``D``elete, ``I``nsert, ``K``eep, ``R``erole) come first as text.

1. Rows are dealt to tasks by conversation once. Rows seen earlier in their conversation are marked.
2. Sorted from the last turn to the first, they stream through ``mapInPandas``. It carries the least cost
   from each of the four states of the grammar to the end of the conversation across Arrow batches, and
   hands every row on with a back pointer of one byte: the first edit for each state.
3. Spark sorts the rows of a task again, from the first turn to the last, which is where back pointers of
   conversations of any length are spilled. They stream through a second ``mapInPandas``, which follows
   the pointers and carries one state.

Neither stream holds a conversation: of one in a third of all rows a task keeps a few numbers, a running digest
and the letters of its edits. There is one shuffle and nothing on a disk but Spark's own files, so a lost
executor costs its tasks only.

Rows of a conversation come by turn (null first), those of one turn by role and text. A null conversation id is a
conversation of its own. Null roles and texts are taken as ``missing``. Repeated rows are rows of their own, and
duplicates of the first. Empty tables give no rows. Columns besides the four named ones are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmark.functions.ship import ship

#: Cost of each edit, and of every row that stays cut short.
RELABEL, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
EDITS = "DIKR"
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted or relabelled turn, and the role it gets.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = ("", "system", "user", "assistant")
#: State after a kept turn, by its initial; no entry: it cannot stand there.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
SOUND = {"su", "ua", "au"}
#: Least cost to a sound end once all rows are through.
END = (0, 2 * INSERT, INSERT, 0)
SPACE = r"\x20\x09-\x0D"
FAULTS = ("blank", "duplicate", "truncated")
REPORT = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired_sha256 string"
)
EDITED = "conv string, position long, edit string, turn long, role string, text string"


def fault_of(text: Column, seen_before: Column) -> Column:
    """The first fault of a row: blank, duplicate or truncated; null if it has none."""
    ended = F.regexp_like(text, F.lit(rf"[.!?][{SPACE}]*\z"))
    return (
        F.when(~F.regexp_like(text, F.lit(rf"[^{SPACE}]")), F.lit(FAULTS[0]))
        .when(seen_before, F.lit(FAULTS[1]))
        .when(~ended, F.lit(FAULTS[2]))
    )


def marked(turns: DataFrame, missing: str = "") -> DataFrame:
    """``conv`` (id as text), ``turn``, ``role``, ``text``, ``gone``, ``fault`` and ``seen`` (how often so far) of
    all rows, dealt to tasks by conversation. ``gone`` rows have no part in their conversation."""
    rows = turns.select(
        F.col("conv"),
        F.col("turn"),
        F.coalesce("role", F.lit(missing)).alias("role"),
        F.coalesce("text", F.lit(missing)).alias("text"),
        F.coalesce("gone", F.lit(False)).alias("gone"),
    ).repartition("conv")
    # needs no second shuffle: rows of a conversation are in one task
    same = Window.partitionBy("conv", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    numbered = rows.withColumn("seen", F.row_number().over(same))
    return numbered.withColumn("fault", fault_of(F.col("text"), F.col("seen") > 1))


def back_pointer(to_end: list[int], initial: str, fault: str | None) -> tuple[list[int], int]:
    """Least costs before a row, from those behind it, and its pointer: two bits for each state."""
    short = CUT_SHORT if fault == "truncated" else 0
    stays = fault is None or fault == "truncated"
    choices = []
    for state in range(4):
        by = [DELETE + to_end[state], None, None, None]
        if stays:
            kept = state if initial == "" else KEEP.get(initial, {}).get(state)
            by[2] = None if kept is None else short + to_end[kept]
            by[3] = RELABEL + short + to_end[NEXT[state]]
        choices.append(by)
    own = [min(x for x in by if x is not None) for by in choices]
    # an inserted turn leads to another state; more than two in a row are never worth it
    least = own
    for _ in range(2):
        least = [min(own[s], INSERT + least[NEXT[s]]) for s in range(4)]
    pointer = 0
    for state in range(4):
        by = choices[state]
        by[1] = INSERT + least[NEXT[state]]
        pointer |= by.index(least[state]) << (2 * state)
    return least, pointer


def _with_pointers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows from the last turn to the first, with ``back``; carries costs from frame to frame."""
    conv, to_end = object(), list(END)
    for frame in frames:
        pointers = []
        for own, role, gone, fault in zip(frame["conv"], frame["role"], frame["gone"], frame["fault"]):
            if own != conv:
                conv, to_end = own, list(END)
            pointer = 0
            if not gone:
                to_end, pointer = back_pointer(to_end, role[:1], fault)
            pointers.append(pointer)
        yield frame.assign(back=pointers)


def _edits(state: int, pointer: int, role: str) -> Iterator[tuple[str, int, str | None]]:
    """Edits up to and including that of a row: letter, state after it, role of the turn it leaves."""
    while (edit := EDITS[(pointer >> (2 * state)) & 3]) == "I":
        state = NEXT[state]
        yield edit, state, NAMES[state]
    if edit == "D":
        yield edit, state, None
    elif edit == "K":
        yield edit, state if role == "" else KEEP[role[0]][state], role
    else:
        yield edit, NEXT[state], NAMES[NEXT[state]]


def _ending(state: int) -> Iterator[tuple[str, int, str]]:
    """Turns inserted after the last row."""
    while state not in (START, ASSISTANT):
        state = NEXT[state]
        yield "I", state, NAMES[state]


class _Conversation:
    """What the second stream carries of a conversation."""

    def __init__(self, conv: str | None):
        self.conv, self.state, self.cost, self.initial = conv, START, 0, None
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal = self.distinct = 0
        self.first = self.last = None
        self.letters: list[str] = []
        self.digest, self.lines = sha256(), 0

    def row(self, turn: str | None, role: str, text: str, fault: str | None, pointer: int) -> None:
        if turn is not None:
            number = int(turn)
            self.first = number if self.first is None else self.first
            self.distinct += number != self.last
            self.last = number
        if fault is not None:
            self.counts[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in SOUND
        self.initial = role[:1]
        for edit, self.state, named in _edits(self.state, pointer, role):
            self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": RELABEL}[edit]
            self._keep(edit, named, "" if edit == "I" else text)
        self.cost += CUT_SHORT if fault == "truncated" and edit != "D" else 0

    def _keep(self, edit: str, role: str | None, text: str) -> None:
        self.letters.append(edit)
        if len(self.letters) > 4096:
            self.letters = ["".join(self.letters)]
        if role is not None:
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def report(self) -> tuple:
        for edit, self.state, named in _ending(self.state):
            self.cost += INSERT
            self._keep(edit, named, "")
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        counted = (self.counts[f] for f in FAULTS)
        audit = "".join(self.letters)
        return self.conv, gaps, *counted, self.illegal, self.cost, audit, self.digest.hexdigest()


def _reports(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per conversation, from rows in order with back pointers."""
    names = [field.split()[0] for field in REPORT.split(", ")]
    carried = None
    for frame in frames:
        done = []
        for conv, turn, role, text, gone, fault, back in zip(*(frame[c] for c in _CARRIED)):
            if carried is None or conv != carried.conv:
                if carried is not None:
                    done.append(carried.report())
                carried = _Conversation(conv)
            if not gone:
                carried.row(turn, role, text, fault, back)
        if done:
            yield pd.DataFrame(done, columns=names)
    if carried is not None:
        yield pd.DataFrame([carried.report()], columns=names)


def _repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of every conversation in order, with the turn each leaves; none for deleted ones."""
    names = [field.split()[0] for field in EDITED.split(", ")]
    conv, state, position = object(), START, 0

    def closing():
        nonlocal position
        for edit, _, named in _ending(state):
            yield conv, position, edit, None, named, ""
            position += 1

    for frame in frames:
        out = []
        for own, turn, role, text, gone, _, back in zip(*(frame[c] for c in _CARRIED)):
            if own != conv:
                out += closing()
                conv, state, position = own, START, 0
            if gone:
                continue
            for edit, state, named in _edits(state, back, role):
                number = None if edit == "I" or turn is None else int(turn)
                words = None if edit == "D" else "" if edit == "I" else text
                out.append((conv, position, edit, number, named, words))
                position += 1
        if out:
            yield pd.DataFrame(out, columns=names).astype({"turn": "Int64"})
    out = list(closing())
    if out:
        yield pd.DataFrame(out, columns=names).astype({"turn": "Int64"})


_CARRIED = ("conv", "turn", "role", "text", "gone", "fault", "back")


def _in_order(turns: DataFrame, missing: str) -> DataFrame:
    """Rows with back pointers, from the first turn to the last within each conversation of a task."""
    rows = marked(turns, missing)
    fields = [f for f in rows.schema.fields if f.name != "turn"]
    schema = T.StructType([*fields, T.StructField("turn", T.StringType()), T.StructField("back", T.IntegerType())])
    # ``seen`` tells rows apart that are equal in all else, so both orders are total and opposite
    backwards = rows.sortWithinPartitions(
        "conv", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("seen")
    ).withColumn("turn", F.col("turn").cast("string"))  # text, as pandas has no null integers
    pointed = backwards.select(*[f.name for f in schema.fields[:-1]]).mapInPandas(_with_pointers, schema)
    forwards = ("conv", F.asc_nulls_first(F.col("turn").cast("long")), "role", "text", "seen")
    return pointed.sortWithinPartitions(*forwards).select(*_CARRIED)


def _named(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone) -> DataFrame:
    return turns.select(
        F.col(conv_col).cast("string").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
        (F.lit(False) if gone is None else gone).alias("gone"),
    )


def repair_report(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    gone: Column | None = None,
    missing: str = "",
) -> DataFrame:
    """A row per conversation: its id, ``gaps`` in the turn numbers, rows by their first fault, ``illegal``
    neighbours, ``cost`` and ``audit`` of the cheapest edits, and the SHA-256 of the repaired turns.

    Rows that ``gone`` marks have no part in their conversation, but it is reported even if it has no others.
    """
    ship(turns.sparkSession)
    rows = _in_order(_named(turns, conv_col, turn_col, role_col, text_col, gone), missing)
    kind = turns.schema[conv_col].dataType
    report = rows.mapInPandas(_reports, REPORT)
    return report.select(F.col("conv").cast(kind).alias(conv_col), *report.columns[1:])


def repaired(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    missing: str = "",
) -> DataFrame:
    """The edits of every conversation, by ``position``: ``edit``, and ``turn``, ``role`` and ``text`` of
    the turn it leaves. Deleted rows have no role and text, inserted ones no turn."""
    ship(turns.sparkSession)
    rows = _in_order(_named(turns, conv_col, turn_col, role_col, text_col, None), missing)
    kind = turns.schema[conv_col].dataType
    edits = rows.mapInPandas(_repaired, EDITED)
    return edits.select(F.col("conv").cast(kind).alias(conv_col), *edits.columns[1:])


def damaged(turns: DataFrame, missing: str = " ") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``gone`` after damage that a hash of conversation and turn
    chooses, one row in five: the row goes, loses its text or its full stops, comes twice, or is a user's."""
    key = F.concat_ws(
        ":",
        F.coalesce(F.col("conv_id").cast("string"), F.lit(missing)),
        F.coalesce(F.col("turn").cast("string"), F.lit(missing)),
    )
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(missing)), F.coalesce("text", F.lit(missing))
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)))).alias("__copy"),
    )
    return rows.drop("__copy")
