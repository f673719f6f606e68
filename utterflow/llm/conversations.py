"""Repair of conversations: a cheapest edit of each one's turns, streamed in the order of the turns.

A conversation is well formed where the initials of its roles read ``(s?(ua)+)?``: perhaps
a system row, then pairs of user and assistant. Rows are kept at 0, get another role at 1,
are deleted at 2, which blank and repeated rows must be, and rows are inserted at 5; a
truncated row that stays costs 5 more. Of the cheapest edits the one with the least string
of initials (D, I, K, R) is taken.

Whether a row repeats an earlier one is found by partial aggregation over hashes, on any
number of tasks. Then rows are dealt by conversation and sorted by turn, and one pass
streams them: per conversation it carries, for each of the four states of the pattern, the
least cost and a running SHA-256 of the repaired text, plus how the four edit strings
compare. What a step does depends only on the differences of costs, this comparison and
the kind of row, so steps are looked up. Each row leaves one 16-bit backpointer, which go
to a file of the task's own when a conversation has very many, and are followed back once
at its end. So a task's memory does not grow with a conversation, but for the edit string
that is the result. The digest of a conversation's text is one chain, so one task reads it.

Cases: a null role, text, id or turn reads as one space where its text is needed; rows with a
null id are one conversation; null turns come first and do not count for gaps; rows of one
turn go by role, then text; equal rows are repeats; a role without an initial, or with
another than s, u and a, must be changed or deleted; a conversation without rows gives
zeros and the digest of the empty text; an empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import WHITE, saved

#: Costs of the edits, and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK_ROW, REPEATED_ROW, CUT_ROW, GOOD_ROW = 1, 2, 3, 0
#: States of the pattern: nothing yet, after s, after u, after a; and what each state takes.
STATES, TAKES, LAST = 4, ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (0, 3)
ROLE = {"u": b"user:", "a": b"assistant:"}
INITIALS = "sua"
#: Bytes of backpointers held in memory.
HELD = 1 << 22

#: A step for a state: (state before, edit, letters, role written, inserted roles). All there are, numbered.
_EDITS: list[tuple[int, str, str, str, str]] = []
_NUMBER: dict[tuple[int, str, str, str, str], int] = {}


def _number(step: tuple[int, str, str, str, str]) -> int:
    if step not in _NUMBER:
        _NUMBER[step] = len(_EDITS)
        _EDITS.append(step)
    return _NUMBER[step]


def _inserted(state: int) -> list[tuple[int, str]]:
    """States that insertions reach from ``state``, with the roles inserted."""
    out = [(state, "")]
    while (role := next(iter(r for r in TAKES[out[-1][0]] if r in ROLE))) and (to := TAKES[out[-1][0]][role]) not in [s for s, _ in out]:
        out.append((to, out[-1][1] + role))
    return out


def _less(a: tuple[int, str], b: tuple[int, str], order: tuple[tuple[int, int, str], ...]) -> bool:
    """Whether edit string a = (state, letters behind that state's string) comes before b."""
    (p, x), (q, y) = a, b
    if p != q:
        for first, second, rest in order:
            if (first, second) == (p, q):
                return _ahead(x, rest, y)
            if (first, second) == (q, p):
                return not _ahead(y, rest, x)
    return x < y


def _ahead(x: str, rest: str, y: str) -> bool:
    """Whether S + x comes before S + rest + y; a rest of "<" says that the first differs before."""
    return True if rest == "<" else x < rest + y


@lru_cache(maxsize=1 << 16)
def step(costs: tuple[int | None, ...], order: tuple[tuple[int, int, str], ...], kind: tuple[str, int] | None) -> tuple[tuple, tuple, tuple]:
    """Costs, order and edit (a number, or -1) of each state after a row of ``kind`` (initial, fault); without one, at the start.

    ``order`` has (p, q, rest) where p's edit string comes before q's: rest is "<" if they differ,
    else what q has behind p's.
    """
    found: list[tuple[int, tuple[int, str], int] | None] = [None] * STATES
    for p in range(STATES):
        if costs[p] is None:
            continue
        edits = []
        if kind is None:
            edits.append((p, 0, "", ""))
        else:
            initial, fault = kind
            edits.append((p, DELETE, "D", ""))
            if fault in (GOOD_ROW, CUT_ROW):
                more = TRUNCATED if fault == CUT_ROW else 0
                if initial in TAKES[p]:
                    edits.append((TAKES[p][initial], more, "K", ""))
                edits += [(to, RENAME + more, "R", role) for role, to in TAKES[p].items() if role in ROLE]
        for to, cost, letter, role in edits:
            for q, roles in _inserted(to):
                total, tail = costs[p] + cost + INSERT * len(roles), letter + "I" * len(roles)
                old = found[q]
                if old is None or total < old[0] or (total == old[0] and _less((p, tail), old[1], order)):
                    found[q] = (total, (p, tail), _number((p, letter, tail, role, roles)))
    after = []
    for q in range(STATES):
        for r in range(STATES):
            if q != r and found[q] and found[r] and _less(found[q][1], found[r][1], order):
                after.append((q, r, _rest(found[q][1], found[r][1], order)))
    return tuple(x and x[0] for x in found), tuple(after), tuple(-1 if x is None else x[2] for x in found)


def _rest(a: tuple[int, str], b: tuple[int, str], order: tuple[tuple[int, int, str], ...]) -> str:
    """What b has behind a, which comes before it, or "<" where they differ."""
    (p, x), (q, y) = a, b
    if p != q:
        for first, second, rest in order:
            if (first, second) == (p, q):
                return "<" if rest == "<" or not (rest + y).startswith(x) else (rest + y)[len(x) :]
            if (first, second) == (q, p):
                return "<" if rest == "<" or not y.startswith(rest + x) else y[len(rest + x) :]
    return y[len(x) :] if y.startswith(x) else "<"


class Backpointers:
    """Edits of each row by state, 16 bits a state; those of a giant conversation go to a file of the task."""

    def __init__(self) -> None:
        self.file, self.last, self.rows = None, [], 0

    def add(self, edits: tuple[int, ...]) -> None:
        self.last.append(edits)
        self.rows += 1
        if len(self.last) * 2 * STATES >= HELD:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(np.array(self.last, np.int16).tobytes())
            self.last = []

    def letters(self, state: int) -> str:
        """The edit string that ends in ``state``."""
        parts, size = [], HELD // 2
        blocks = [np.array(self.last, np.int16).reshape(-1, STATES)]
        at = self.file.tell() if self.file else 0
        while True:
            for edits in blocks.pop()[::-1].tolist():
                state, _, tail, _, _ = _EDITS[edits[state]]
                parts.append(tail)
            if not at:
                break
            a = max(0, at - size)
            self.file.seek(a)
            blocks.append(np.frombuffer(self.file.read(at - a), np.int16).reshape(-1, STATES))
            at = a
        return "".join(reversed(parts))

    def close(self) -> None:
        if self.file:
            self.file.close()


class Repair:
    """One conversation's running state."""

    def __init__(self) -> None:
        self.counts = {k: 0 for k in (BLANK_ROW, REPEATED_ROW, CUT_ROW)}
        self.illegal = self.turns = 0
        self.low = self.high = self.turn = None
        self.row = self.initial = None
        self.back = Backpointers()
        self.base, self.digests = 0, [hashlib.sha256(), None, None, None]
        self.empty = [True] * STATES
        self._take((0, None, None, None), (), None, b"", b"")

    def _take(self, costs: tuple, order: tuple, kind: tuple[str, int] | None, role: bytes, text: bytes) -> None:
        self.costs, self.order, edits = step(costs, order, kind)
        self.back.add(edits)
        least = min(c for c in self.costs if c is not None)
        self.base += least
        self.costs = tuple(c if c is None else c - least for c in self.costs)
        digests, empty = [None] * STATES, [True] * STATES
        for q, number in enumerate(edits):
            if number < 0:
                continue
            p, letter, _, new_role, inserted = _EDITS[number]
            digest, none = self.digests[p].copy(), self.empty[p]
            lines = [] if letter not in ("K", "R") else [(role + b":" if letter == "K" else ROLE[new_role], text)]
            for head, body in lines + [(ROLE[r], b"") for r in inserted]:
                digest.update(head if none else b"\n" + head)
                digest.update(body)
                none = False
            digests[q], empty[q] = digest, none
        self.digests, self.empty = digests, empty

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        # equal rows of one turn are neighbours
        if fault in (GOOD_ROW, CUT_ROW) and self.row == (turn, role, text):
            fault = REPEATED_ROW
        self.row = (turn, role, text)
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high, self.turn, self.turns = turn, turn, self.turns + 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self._take(self.costs, self.order, (initial if initial and initial in INITIALS else "", fault), role.encode(), text.encode())

    def result(self) -> tuple:
        state = min((c, q) for q, c in enumerate(self.costs) if q in LAST and c is not None)
        tied = [q for q in LAST if self.costs[q] == state[0]]
        best = tied[0] if len(tied) < 2 or _less((tied[0], ""), (tied[1], ""), self.order) else tied[1]
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        audit = self.back.letters(best)
        self.back.close()
        return gaps, *self.counts.values(), self.illegal, self.base + self.costs[best], audit, self.digests[best].hexdigest()


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``copies``, 0 for a row that is dropped: damaged by the CRC of ``conv_id:turn``."""
    h = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    text = F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(_text("text"), "[.!?]", "")).when(h == 0, F.lit("")).otherwise(_text("text"))
    role = F.when(h == 4, F.lit("user")).otherwise(_text("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) with ``fault``: blank, repeated after an earlier turn, or truncated, or none.

    Repeats within a turn are left to the stream, where they are neighbours.
    """
    inner = F.btrim("text", F.lit(WHITE))
    blank = F.length(inner) == 0
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = saved(rows.withColumns({"name": F.unhex(name), "blank": blank, "cut": ~blank & ~F.substring(inner, -1, 1).isin(".", "!", "?")}))
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.where("copies > 0").groupBy("conv_id", "name").agg(F.min(at).alias("first"), F.max(at).alias("last")).where(F.col("first") != F.col("last"))
    # few rows as a rule; written first, so that Spark knows their size and can split the others
    first = saved(first.select(F.col("conv_id").alias("_conv"), F.col("name").alias("_name"), "first"))
    joined = rows.join(first, rows["conv_id"].eqNullSafe(first["_conv"]) & (rows["name"] == first["_name"]), "left")
    fault = F.when(F.col("blank"), BLANK_ROW).when(F.col("first") < at, REPEATED_ROW).when(F.col("cut"), CUT_ROW).otherwise(GOOD_ROW)
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Per conv_id of rows (conv_id, turn, role, text, copies, fault): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    A row stands for ``copies`` adjacent rows; one of 0 copies only tells that the conversation exists.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, one, out = None, None, []

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done))
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *names])

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")]
            for conv_id, turn, role, text, copies, fault in zip(*columns):
                if one is None or conv_id != conv:
                    if one is not None:
                        out.append((conv, *one.result()))
                    conv, one = conv_id, Repair()
                for _ in range(copies):
                    one.add(turn, role, text, fault)
            if len(out) >= 1024:
                yield batch_of(out)
                out = []
        if one is not None:
            out.append((conv, *one.result()))
        if out:
            yield batch_of(out)

    dealt = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    types = [f"{n} long" for n in names[:6]] + [f"{n} string" for n in names[6:]]
    return dealt.select("conv_id", "turn", "role", "text", "copies", "fault").mapInArrow(run, f"conv_id {kind}, {', '.join(types)}")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """What repairing the damaged ``rows`` (conv_id, turn, role, text) takes, a row per conversation."""
    return repair_conversations(faults(damage(rows)))
