"""Chat formatting with minimum-cost repair of roles.

A legal conversation is at most one system message, then user and assistant in
turn, beginning with user and ending with assistant.  For every source turn the
repair keeps it as a message, gives it another role, or merges it into the
message before; empty messages may be put in where the automaton needs them.
The repair of least total cost (``COSTS``) is found by dynamic programming over
the automaton's states and rendered.

A turn acts on the four states as a matrix of least costs, and matrices
combine in any grouping.  So a conversation of any length is cut into segments
of ``SEGMENT`` turns: each segment's matrix is made on its own, the states at
segment borders follow from the matrices alone, and segments are then repaired
and rendered on their own.  No task holds a whole conversation's texts.

Turns are range-partitioned once, sorted within.  A conversation that begins and
ends within a partition, and has one segment, is repaired and rendered there and
then.  Only what stands at a partition's edge, or is longer than a segment, waits
for its borders and moves again.

Rendering gives each row its piece of the conversation's text; pieces joined in
the order of (segment, place, part) are the rendered conversation.

Defined results: a role is trimmed and lower-cased, one that is none of the
three (or null) costs less to relabel; a null text is empty; turns with equal
numbers are ordered by role and text, repeated rows are turns of their own;
null turns come first; a null conv_id is a conversation; an empty table gives
no rows.  Ties go to the repair met first in the order of ``_moves``.  Only
``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import narrow_batches, partitions_for, write_table

ROLES = ["system", "user", "assistant"]
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
_AFTER = {"system": AFTER_SYSTEM, "user": AFTER_USER, "assistant": AFTER_ASSISTANT}
_LEGAL = {(START, "system"), (START, "user"), (AFTER_SYSTEM, "user"), (AFTER_ASSISTANT, "user"), (AFTER_USER, "assistant")}
COSTS = {"relabel": 4, "name": 2, "merge": 1, "insert": 3}
SEGMENT = 2048
_FAR = 1 << 40


@dataclass(frozen=True)
class Move:
    """What is done with a turn in a state: messages put in before it, and its role; merged if it opens no message."""

    start: int
    end: int
    cost: int
    action: str
    role: str
    inserted: tuple[str, ...]


def _inserts(state: int, role: str | None) -> tuple[str, ...] | None:
    """The fewest empty messages after which ``role`` is legal, or the conversation may end if it is None."""
    for n in range(3):
        for choice in ([()], [("user",), ("assistant",)], [("user", "assistant"), ("assistant", "user")])[n]:
            at, ok = state, True
            for x in choice:
                ok &= (at, x) in _LEGAL
                at = _AFTER[x]
            if ok and ((at, role) in _LEGAL if role else at == AFTER_ASSISTANT):
                return choice
    return None


def _moves(role: str | None) -> list[Move]:
    """All moves for a turn of this role (None: any other), keeping first."""
    out = []
    for state in range(4):
        own = next((r for r in ROLES if _AFTER[r] == state), None)
        for new in sorted(ROLES, key=lambda r: (r != role, ROLES.index(r))):
            put = _inserts(state, new)
            if put is not None:
                change = 0 if new == role else COSTS["relabel"] if role else COSTS["name"]
                out.append(Move(state, _AFTER[new], change + COSTS["insert"] * len(put), "keep" if new == role else "relabel", new, put))
        if own:
            change = 0 if own == role else COSTS["relabel"] if role else COSTS["name"]
            out.append(Move(state, state, COSTS["merge"] + change, "merge", own, ()))
    return out


_BY_ROLE = {role: _moves(role) for role in (*ROLES, None)}
_END = [_inserts(s, None) for s in range(4)]
END_COSTS = [COSTS["insert"] * len(x) if s else 0 for s, x in enumerate(_END)]


def known_role(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def turn_matrix(role: str | None) -> np.ndarray:
    out = np.full((4, 4), _FAR, np.int64)
    for m in _BY_ROLE[role]:
        out[m.start, m.end] = min(out[m.start, m.end], m.cost)
    return out


_MATRICES = {role: turn_matrix(role) for role in _BY_ROLE}


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs of a segment made of two."""
    return np.minimum((a[:, :, None] + b[None]).min(1), _FAR)


def segment_matrix(roles: list[str | None]) -> np.ndarray:
    """The matrix of a run of turns."""
    out = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(out, 0)
    for role in roles:
        out = combine(out, _MATRICES[role])
    return out


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """The states at the borders of a conversation's segments, from its start to its end, on a way of least cost."""
    cost = np.array([0, _FAR, _FAR, _FAR], np.int64)
    back = []
    for m in matrices:
        total = cost[:, None] + m
        back.append(total.argmin(0))
        cost = np.minimum(total.min(0), _FAR)
    states = [int((cost + np.array(END_COSTS)).argmin())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def repair(roles: list[str | None], start: int, end: int) -> list[Move]:
    """The moves of a run of turns that lead from one state to another at least cost."""
    cost = [_FAR] * 4
    cost[start] = 0
    back: list[list[Move | None]] = []
    for role in roles:
        after, by = [_FAR] * 4, [None] * 4
        for m in _BY_ROLE[role]:
            c = cost[m.start] + m.cost
            if c < after[m.end]:
                after[m.end], by[m.end] = c, m
        cost = after
        back.append(by)
    out, state = [], end
    for by in reversed(back):
        out.append(by[state])
        state = by[state].start
    return out[::-1]


def _open(state: int, role: str) -> str:
    return ("" if state == START else "<|im_end|>\n") + f"<|im_start|>{role}\n"


def rendered_rows(turns: list, texts: list[str], moves: list[Move], last: bool) -> list[tuple]:
    """(place, part, turn, action, role, cost, rendered) for the turns of a segment and the messages put in."""
    rows = []
    for place, (turn, text, m) in enumerate(zip(turns, texts, moves, strict=True)):
        state = m.start
        for part, role in enumerate(m.inserted):
            rows.append((place, part, None, "insert", role, COSTS["insert"], _open(state, role)))
            state = _AFTER[role]
        own = m.cost - COSTS["insert"] * len(m.inserted)
        rows.append((place, len(m.inserted), turn, m.action, m.role, own, "\n" + text if m.action == "merge" else _open(state, m.role) + text))
    if last:
        state = moves[-1].end
        for part, role in enumerate(_END[state]):
            rows.append((len(turns), part, None, "insert", role, COSTS["insert"], _open(state, role)))
            state = _AFTER[role]
        rows[-1] = (*rows[-1][:6], rows[-1][6] + "<|im_end|>\n")
    return rows


ROWS = ["conv_id", "segment", "place", "part", "turn", "action", "role", "cost", "rendered"]
DONE, TURN, SEGMENT_OF = 0, 1, 2


class _Rows:
    """Rows of the result, and of what waits, gathered by columns and given out in batches of bounded size."""

    NAMES = ["kind", *ROWS, "matrix"]

    def __init__(self, conv_type: pa.DataType, turn_type: pa.DataType) -> None:
        self.types = [pa.int32(), conv_type, pa.int64(), pa.int32(), pa.int32(), turn_type, pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64())]
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, kind: int, conv, segment: int, rows: list[tuple], matrix: list | None = None) -> None:
        self.rows += [(kind, conv, segment, *row, matrix) for row in rows]
        self.size += sum(len(row[-1] or "") + 100 for row in rows)

    def full(self) -> bool:
        return self.size > 1 << 22

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), self.types, strict=True)], self.NAMES)
        self.rows, self.size = [], 0
        return out


def _read(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """From sorted rows (conv_id, turn, role, text): rows of the result, and turns and matrices of what must wait."""
    segment, first = TaskContext.get().partitionId() << 32, True  # first: the conversation may have begun before this partition
    rows, conv, held = None, None, []
    several = False

    def close(last: bool) -> None:
        """End a segment; ``last``: its conversation ends here, within the partition."""
        roles = [known_role(r) for _, r, _ in held]
        turns, texts = [t for t, _, _ in held], [x for _, _, x in held]
        if last and not first and not several:
            end = int((segment_matrix(roles)[START] + np.array(END_COSTS)).argmin())
            rows.add(DONE, conv, segment, rendered_rows(turns, texts, repair(roles, START, end), True))
        else:
            rows.add(TURN, conv, segment, [(k, None, turn, None, role, None, text) for k, (turn, role, text) in enumerate(held)])
            rows.add(SEGMENT_OF, conv, segment, [(None,) * 7], segment_matrix(roles).reshape(-1).tolist())

    for batch in batches:
        if rows is None:
            rows = _Rows(batch.schema.field(0).type, batch.schema.field(1).type)
        for c, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and (c != conv or len(held) == limit):
                close(c != conv)
                first, several = first and c == conv, c == conv
                segment, held = segment + 1, []
            conv = c
            held.append((turn, role, text))
            if rows.full():
                yield rows.take()
    if held:
        close(False)  # the conversation may go on in the next partition
    if rows is not None and rows.rows:
        yield rows.take()


def _states(table: pa.Table) -> pa.Table:
    """The states at the borders of a conversation's segments."""
    table = table.sort_by("segment")
    states = border_states([np.array(m).reshape(4, 4) for m in table["matrix"].to_pylist()])
    n = table.num_rows
    return pa.table({"segment": table["segment"], "start": pa.array(states[:-1], pa.int32()), "end": pa.array(states[1:], pa.int32()), "last": pa.array([i == n - 1 for i in range(n)])})


def _render(table: pa.Table) -> pa.Table:
    """A segment that had to wait."""
    table = table.sort_by("place")
    conv, segment, start, end, last = (table[c][0].as_py() for c in ("conv_id", "segment", "start", "end", "last"))
    moves = repair([known_role(r) for r in table["role"].to_pylist()], start, end)
    rows = _Rows(table.schema.field("conv_id").type, table.schema.field("turn").type)
    rows.add(DONE, conv, segment, rendered_rows(table["turn"].to_pylist(), table["rendered"].to_pylist(), moves, last))
    return pa.Table.from_batches([rows.take()]).select(ROWS)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, place, part, turn, action, role, cost, rendered: every turn as repaired, and the messages put in.

    segment orders the pieces of a conversation; turn is null for messages put in.
    """
    spark = conversations.sparkSession
    narrow_batches(spark)
    key = conversations.schema["conv_id"].dataType.simpleString()
    kind = conversations.schema["turn"].dataType.simpleString()
    result = f"conv_id {key}, segment long, place int, part int, turn {kind}, action string, role string, cost int, rendered string"
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(max(partitions_for(conversations, 8 << 20), spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    limit = SEGMENT
    read = write_table(ranged.mapInArrow(lambda b: _read(b, limit), f"kind int, {result}, matrix array<long>"), "turns")
    waiting = read.where(f"kind = {TURN}").select("conv_id", "segment", "place", "turn", "role", "rendered")
    states = read.where(f"kind = {SEGMENT_OF}").select("conv_id", "segment", "matrix").groupBy("conv_id").applyInArrow(_states, "segment long, start int, end int, last boolean")
    late = waiting.join(states, "segment").groupBy("segment").applyInArrow(_render, result)
    return read.where(f"kind = {DONE}").select(*ROWS).unionByName(late)
