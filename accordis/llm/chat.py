"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation. Each input turn, in the
order (turn, role, text), is kept, merged into the turn before it, relabelled, or preceded by an empty turn; dynamic
programming over the automaton's four states finds the cheapest repair of the whole conversation. Of equal repairs, seen from
the end, the one counts whose last state comes first, and then at each turn the step that comes first: by the operation
named first here, then by the state before it. The repaired sequence is rendered turn by turn.

A step is a 4 x 4 matrix of costs, and steps combine in the (min, +) semiring, so a conversation may lie across tasks: rows
are range-partitioned by conversation and order, and each task reduces its part of a conversation that crosses a partition's
edge (at most two a partition) to one matrix. From these the driver gets the costs at each part's beginning; with them each
such part tells from which state it is entered for each state that it is left in, and the driver follows these maps from the
end. The repair is that of the whole conversation, wherever partitions begin. No conversation is ever gathered.

Output: a row for each input turn and each empty turn: conv_id, turn (of the input turn), part (0 an empty turn put before
it, 1 the turn itself), role, action, text, rendered. A merged turn's rendered text has no header.

Defined results: roles are matched without case and outer spaces; other or null roles must be relabelled, at the lower
cost; null texts are empty; a null conv_id is a conversation of its own; null turns come first; repeated rows count each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: States that a turn of a role may follow.
AFTER = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
KEEP, MERGE_SAME, MERGE_OTHER, RELABEL, RELABEL_UNKNOWN, INSERT = 0, 1, 4, 3, 1, 2
INFINITE = 1 << 60


def steps(role: int | None) -> list[tuple[int, int, int, str, int | None]]:
    """(from, to, cost, action, role put before) for a turn of a role, the first of equals first. Unknown roles are None."""
    found = []
    for state in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            if state in AFTER[to]:
                found.append((state, to, KEEP, "keep", None) if to == role else (state, to, RELABEL_UNKNOWN if role is None else RELABEL, "relabel", None))
            if state == to:
                found.append((state, to, MERGE_SAME if role == to else MERGE_OTHER, "merge", None))
            if to == role and state not in AFTER[to]:
                for between in (USER, ASSISTANT):
                    if state in AFTER[between] and between in AFTER[to]:
                        found.append((state, to, INSERT, "insert", between))
    return sorted(found, key=lambda s: (("keep", "merge", "relabel", "insert").index(s[3]), s[0], s[4] or 0))


STEPS = {role: steps(role) for role in (None, SYSTEM, USER, ASSISTANT)}


def role_of(name: str | None) -> int | None:
    return ROLES.get((name or "").strip().lower())


def forward(costs: list[int], role: int | None) -> tuple[list[int], list[tuple | None]]:
    """Costs after a turn, and the step that leads to each state."""
    after, by = [INFINITE] * 4, [None] * 4
    for step in STEPS[role]:
        cost = costs[step[0]] + step[2]
        if cost < after[step[1]]:
            after[step[1]], by[step[1]] = cost, step
    return after, by


def backward(costs: list[int], roles: list[int | None]) -> tuple[list[list[tuple | None]], list[int]]:
    """The steps that lead to each state, a list for each turn, from the costs of the states before; and the costs after."""
    back = []
    for role in roles:
        costs, by = forward(costs, role)
        back.append(by)
    return back, costs


def walk(back: list[list[tuple | None]], state: int) -> tuple[list[tuple], int]:
    """The steps that end in a state, and the state that they begin in."""
    path = []
    for by in reversed(back):
        path.append(by[state])
        state = by[state][0]
    return path[::-1], state


def best(costs: list[int]) -> int:
    """The cheapest state, the first of equal ones."""
    return min(range(4), key=lambda s: (costs[s], s))


#: Characters of a text by which turns are dealt to ranges.
HEAD = 64
AT_START = [0, INFINITE, INFINITE, INFINITE]


def repair(roles: list[int | None], costs: list[int] = AT_START, leave: int | None = None) -> list[tuple]:
    """The steps of the cheapest repair, from costs of the states before it, to a state if one is given."""
    back, after = backward(costs, roles)
    return walk(back, best(after) if leave is None else leave)[0]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, list[tuple]]]:
    """(part, conv_id, rows) of runs of rows."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:2] != key:
                yield *key, held
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield *key, held


def ordered(turns: DataFrame) -> DataFrame:
    """Turns with the number of the range partition that holds them, written once so that both passes see the same.

    Ranges go by the beginning of a text, so that the keys that are sampled for their bounds are small; inside a range the whole
    text decides, which is the same order.
    """
    keys = ["conv_id", "turn", "role", "text"]
    ranged = turns.select(*keys, F.substring("text", 1, HEAD).alias("_head")).repartitionByRange("conv_id", "turn", "role", "_head")
    return materialize(ranged.select(F.spark_partition_id().alias("part"), *keys))


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired and rendered turns."""
    rows = ordered(turns)
    ends = rows.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    crossing = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_parts")).filter("_parts > 1").select(F.col("conv_id").alias("_conv"))
    crossing = materialize(crossing)  # at most one a partition edge
    dealt = rows.repartition("part").sortWithinPartitions("part", "conv_id", "turn", "role", "text")

    def reduce_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, conv, held in _parts(batches):
            flat = []
            for entry in range(4):
                costs = [0 if s == entry else INFINITE for s in range(4)]
                for row in held:
                    costs = forward(costs, role_of(row[3]))[0]
                flat += costs
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([conv], pa.int64()), pa.array([flat], pa.list_(pa.int64()))], names=["part", "conv_id", "costs"])

    entered: dict[tuple, list[int]] = {}  # costs of the states at a part's beginning

    def map_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, conv, held in _parts(batches):
            back, after = backward(costs_at.value[(part, conv)], [role_of(row[3]) for row in held])
            befores = [walk(back, s)[1] if after[s] < INFINITE else None for s in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([conv], pa.int64()), pa.array([befores], pa.list_(pa.int64()))], names=["part", "conv_id", "befores"])

    edges: dict[tuple, tuple[list[int], int]] = {}
    if not crossing.isEmpty():
        long = rows.join(F.broadcast(crossing), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").select("part", F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        sorted_long = long.repartition("part").sortWithinPartitions("part", "conv_id", "turn", "role", "text")
        matrices = sorted_long.mapInArrow(reduce_parts, "part int, conv_id long, costs array<long>").collect()
        chains: dict = {}
        for r in sorted(matrices, key=lambda r: r["part"]):
            chains.setdefault(r["conv_id"], []).append((r["part"], r["costs"]))
        last: dict = {}
        for conv, chain in chains.items():
            costs = AT_START
            for part, m in chain:
                entered[(part, conv)] = costs
                costs = [min(costs[a] + m[4 * a + b] for a in range(4)) for b in range(4)]
            last[conv] = best(costs)
        costs_at = turns.sparkSession.sparkContext.broadcast(entered)
        befores = {(r["part"], r["conv_id"]): r["befores"] for r in sorted_long.mapInArrow(map_parts, "part int, conv_id long, befores array<long>").collect()}
        costs_at.destroy()
        for conv, chain in chains.items():
            state = last[conv]
            for part, _ in reversed(chain):
                edges[(part, conv)] = (entered[(part, conv)], state)
                state = befores[(part, conv)][state]
    shared = turns.sparkSession.sparkContext.broadcast(edges)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for part, conv, held in _parts(batches):
            costs, leave = shared.value.get((part, conv), (AT_START, None))
            for row, (_, to, _, action, before) in zip(held, repair([role_of(r[3]) for r in held], costs, leave), strict=True):
                text = row[4] or ""
                if before is not None:
                    out.append((conv, row[2], 0, NAMES[before], "insert", "", f"<|{NAMES[before]}|>\n\n"))
                body = f"{text}\n" if action == "merge" else f"<|{NAMES[to]}|>\n{text}\n"
                out.append((conv, row[2], 1, NAMES[to], "keep" if action == "insert" else action, text, body))
            if len(out) >= 2000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
    names = ["conv_id", "turn", "part", "role", "action", "text", "rendered"]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.mapInArrow(render, "conv_id long, turn long, part int, role string, action string, text string, rendered string")
