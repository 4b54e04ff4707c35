"""Repair of conversation structure by the cheapest edits, in one sorted pass over the rows.

A repaired conversation is empty, or an optional system turn and then user and assistant in turns, as
told by the first letters of the roles. Keeping a row costs 0, giving it the role user or assistant 1,
deleting it 2, inserting an empty row 5; a truncated row that stays costs 5 more. Blank rows and
repeats must go. Of the cheapest edits, those with the least string of letters (D, I, K, R) count.

Rows are shuffled once by conversation and sorted by turn; a task streams them. What is carried from
batch to batch is, for each of four states (what the repaired rows so far end with), its cost, its
place in the order of the edits so far, and the running hash of the repaired text. A step looks only at
cost differences, order and the kind of row, of which there are few, so steps are computed once and
then looked up. Each row leaves 4 bytes of back pointers; those of a conversation beyond
:data:`BLOCK_ROWS` rows leave the task as blocks, rows of a table in the shared folder, and a second
pass follows them from the last block to the first. Memory is thus bounded, whatever a conversation
holds; only its final string of edits is one value. A conversation is one task's work by nature, as
the hash of its text is.

Nulls: a null role or text counts as one space, a null turn sorts first, rows with a null id are one
conversation. Rows of one turn are taken by role, then text. An empty table gives an empty result.
Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sessora.llm.common import stored

#: Rows whose back pointers leave a task together.
BLOCK_ROWS = 1 << 16

RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

#: White space of a blank text.
_SPACE = " \t\n\x0b\x0c\r"
_ORDER = ("turn", "role", "text")  # ascending, nulls first

# --- the rows

#: Kinds of fault, the first that holds; a row has at most one.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in, by a hash of conversation and turn; rows to be lost are marked `dropped`."""
    seen = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    place = F.concat(seen["conv_id"], F.lit(":"), seen["turn"])
    fault = F.crc32(place.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(seen["text"], ".!?", "")).otherwise(seen["text"])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(seen["role"]).alias("role"),
        text.alias("text"),
        (fault == 0).alias("dropped"),
        F.when(fault == 3, 2).otherwise(1).alias("_times"),
    )
    return rows.withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times")


def marked(rows: DataFrame) -> DataFrame:
    """Rows with their fault, partitioned by conversation and sorted by turn; one shuffle."""
    used = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.col("dropped") if "dropped" in rows.columns else F.lit(False)).alias("dropped"),
    ).repartition("conv_id")
    alike = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    numbered = used.withColumn("nth", F.row_number().over(alike))
    return numbered.withColumn("fault", _fault()).drop("nth").sortWithinPartitions("conv_id", *_ORDER)


def _fault() -> Column:
    trimmed = F.rtrim("text", F.lit(_SPACE))
    return (
        F.when(trimmed == "", BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )


# --- steps of the search

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (ASSISTANT, "u"): USER,
    (USER, "a"): ASSISTANT,
}
_LETTERS = "DKR"
#: No state is worth more than this beyond the cheapest: two inserts lead anywhere.
_WORST = 2 * INSERT

#: For each state, (cost above the cheapest, place in the order of the edits so far), or None.
Front = tuple
FIRST: Front = ((0, 0), None, None, None)


@dataclass(frozen=True)
class Step:
    front: Front
    cost: int
    moves: tuple  # (state after, state before, rows inserted first, letter)
    pointers: int


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """States after no, one, two inserted rows."""
    for count in range(3):
        yield count, state
        state = _NEXT[state]


@lru_cache(maxsize=None)
def step(front: Front, initial: str, fault: int) -> Step:
    """The front after one more row."""
    best: dict[int, tuple] = {}
    for before, known in enumerate(front):
        if known is None:
            continue
        for count, state in _inserted(before):
            options = [("D", DELETE, state)]
            if fault not in (BLANK, DUPLICATE):
                extra = CUT_OFF if fault == TRUNCATED else 0
                options.append(("R", RENAME + extra, _NEXT[state]))
                if (state, initial) in _KEPT:
                    options.append(("K", extra, _KEPT[state, initial]))
            for letter, cost, after in options:
                total = known[0] + INSERT * count + cost
                found = (total, known[1], "I" * count + letter, before)
                best[after] = min(best.get(after, found), found)
    least = min(found[0] for found in best.values())
    best = {after: found for after, found in best.items() if found[0] <= least + _WORST}
    order = sorted(best, key=lambda after: best[after][1:3])
    new = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in range(4))
    moves = tuple((s, best[s][3], len(best[s][2]) - 1, best[s][2][-1]) for s in sorted(best))
    pointers = 0
    for after, before, count, letter in moves:
        pointers |= (_LETTERS.index(letter) << 4 | count << 2 | before) << 8 * after
    return Step(new, least, moves, pointers)


def finish(front: Front) -> tuple[int, int, int]:
    """Added cost, state and number of rows still to insert of the cheapest end."""
    ends = []
    for state, known in enumerate(front):
        if known is not None:
            count = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
            ends.append((known[0] + INSERT * count, known[1], state, count))
    cost, _, state, count = min(ends)
    return cost, state, count


def trace(pointers: Iterable[int], state: int) -> tuple[str, int]:
    """The letters that these back pointers, taken from the last to the first, lead through."""
    parts = []
    for packed in pointers:
        own = packed >> 8 * state & 255
        parts.append("I" * (own >> 2 & 3) + _LETTERS[own >> 4])
        state = own & 3
    return "".join(reversed(parts)), state


# --- one pass


class _Conversation:
    """What is carried for the conversation at hand."""

    def __init__(self, key: tuple):
        self.key = key
        self.front, self.cost = FIRST, 0
        self.hashes = [hashlib.sha256(), None, None, None]
        self.pointers, self.blocks = array("I"), 0
        self.faults, self.illegal = [0, 0, 0, 0], 0
        self.before, self.turns, self.low, self.high = None, 0, None, None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.high:  # turns come in order
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        found = step(self.front, initial if initial in ("s", "u", "a") else "", fault)
        content = None
        hashes: list = [None] * 4
        for after, before, count, letter in found.moves:
            if letter == "D" and not count:
                hashes[after] = self.hashes[before]  # never changed in place
                continue
            hashes[after] = self._insert(before, count)
            if letter != "D":
                content = content if content is not None else b":" + text.encode()
                name = role if letter == "K" else _NAMES[after]
                line_break = b"" if before == START and not count else b"\n"
                hashes[after].update(line_break + name.encode() + content)
        self.hashes, self.front = hashes, found.front
        self.cost += found.cost
        self.pointers.append(found.pointers)

    def _insert(self, state: int, count: int):
        made = self.hashes[state].copy()
        for n, (_, after) in enumerate(_inserted(state)):
            if n == count + 1:
                break
            if n:
                line_break = b"" if state == START and n == 1 else b"\n"
                made.update(line_break + _NAMES[after].encode() + b":")
        return made

    def full(self, rows: int) -> dict | None:
        """A block of back pointers, if there are enough."""
        if len(self.pointers) < rows:
            return None
        block = {"conv_id": self.key[0], "block": self.blocks, "pointers": self._packed()}
        self.pointers, self.blocks = array("I"), self.blocks + 1
        return block

    def close(self) -> dict:
        cost, state, count = finish(self.front)
        row = {
            "conv_id": self.key[0],
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            "blank": self.faults[BLANK],
            "duplicate": self.faults[DUPLICATE],
            "truncated": self.faults[TRUNCATED],
            "illegal": self.illegal,
            "cost": self.cost + cost,
            "repaired_sha256": self._insert(state, count).hexdigest(),
        }
        if self.blocks:
            return row | {"block": self.blocks, "pointers": self._packed(), "state": state, "audit": "I" * count}
        return row | {"audit": trace(reversed(self.pointers), state)[0] + "I" * count}

    def _packed(self) -> bytes:
        return np.array(self.pointers, "<u4").tobytes()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COLUMNS = ["conv_id", *COUNTS, "audit", "repaired_sha256", "block", "pointers", "state"]
_RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, repaired_sha256 string, block long, pointers binary, state long"
)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[row.get(c) for c in _COLUMNS] for row in rows], columns=_COLUMNS, dtype=object)


def _search(block_rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for frame in frames:
            out = []
            for has_id, conv, has_turn, turn, role, text, dropped, fault in zip(
                *(frame[c].tolist() for c in frame.columns)
            ):
                key = (conv if has_id else None,)
                if now is None or now.key != key:
                    if now is not None:
                        out.append(now.close())
                    now = _Conversation(key)
                if not dropped:
                    now.add(turn if has_turn else None, role, text, fault)
                    if (block := now.full(block_rows)) is not None:
                        out.append(block)
            if out:
                yield _frame(out)
        if now is not None:
            yield _frame([now.close()])

    return run


def _follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Letters of each block; the blocks of a conversation come from the last to the first."""
    state = None
    for frame in frames:
        parts = []
        for block, pointers, end, tail in zip(frame["block"], frame["pointers"], frame["state"], frame["audit"]):
            state = end if end >= 0 else state  # the last block knows the state at the end
            letters, state = trace(np.frombuffer(pointers, "<u4")[::-1].tolist(), state)
            parts.append((block, letters + tail))
        yield frame[["has_id", "conv_id"]].assign(
            block=[b for b, _ in parts], letters=[letters for _, letters in parts]
        )


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each conversation: faults by kind, missing turns (gaps), illegal neighbours, the least cost,
    its edits (audit) and the hash of the repaired text.

    `rows`: conv_id, turn, role, text, and optionally `dropped`, true for rows that only tell that their
    conversation exists.
    """
    # long columns that hold nulls would reach pandas as floats
    plain = marked(rows).select(
        F.col("conv_id").isNotNull().alias("has_id"),
        F.coalesce("conv_id", F.lit(0)).alias("conv_id"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        "role",
        "text",
        "dropped",
        "fault",
    )
    found = stored(plain.mapInPandas(_search(block_rows), _RESULT))
    result = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    whole = found.where("block is null").select(*result)
    blocks = found.where("block is not null")
    if blocks.isEmpty():
        return whole
    ordered = (
        blocks.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("block"))
        .select(
            F.col("conv_id").isNotNull().alias("has_id"),
            F.coalesce("conv_id", F.lit(0)).alias("conv_id"),
            "block",
            "pointers",
            F.coalesce("state", F.lit(-1)).alias("state"),
            F.coalesce("audit", F.lit("")).alias("audit"),
        )
    )
    pieces = ordered.mapInPandas(_follow, "has_id boolean, conv_id long, block long, letters string")
    in_order = F.sort_array(F.collect_list(F.struct("block", "letters")))
    letters = pieces.groupBy("has_id", "conv_id").agg(F.array_join(in_order["letters"], "").alias("audit"))
    letters = letters.select(F.when(F.col("has_id"), F.col("conv_id")).alias("id"), "audit")
    ends = blocks.where("state is not null").drop("audit")
    long = ends.join(letters, F.col("conv_id").eqNullSafe(F.col("id"))).select(*result)
    return whole.unionByName(long)


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit, role, text; `report` is the result of `repair`."""
    present = rows.where(~F.col("dropped")) if "dropped" in rows.columns else rows
    by_turn = Window.partitionBy("conv_id").orderBy(*_ORDER)
    own = present.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    ).withColumn("nth", F.row_number().over(by_turn) - 1)
    # the edits of one row are the inserted rows before it and its own letter
    groups = F.regexp_extract_all("audit", F.lit("I*[DKR]|I+$"), F.lit(0))
    edits = report.select(F.col("conv_id").alias("id"), F.posexplode(groups).alias("at", "letters"))
    joined = edits.join(own, F.col("id").eqNullSafe(F.col("conv_id")) & (F.col("at") == F.col("nth")), "left")
    letter = F.filter(F.split("letters", ""), lambda x: x != "")
    spread = joined.select("id", "at", "role", "text", F.posexplode(letter).alias("sub", "edit")).where("edit <> 'D'")
    so_far = Window.partitionBy("id").orderBy("at", "sub")
    placed = spread.withColumn("place", F.row_number().over(so_far) - 1).withColumn(
        "system", F.first(((F.col("edit") == "K") & F.col("role").startswith("s")).cast("int")).over(so_far)
    )
    turned = F.when((F.col("place") - F.col("system")) % 2 == 0, "user").otherwise("assistant")
    return placed.select(
        F.col("id").alias("conv_id"),
        "place",
        "edit",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(turned).alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"),
    )
