"""Chat formatting: minimum-cost role repair over an automaton of legal turns, then rendering.

A legal conversation is an optional system turn, then user and assistant in alternation, ending with
assistant.  Every given turn is kept, merged into the turn before it (cost ``MERGE``), given another role
(``RELABEL``, on top of either) or preceded by an empty turn (``INSERT`` each, at the end too).  Dynamic
programming finds the least total cost; ties take the earliest choice in the order of ``_moves``.

Turns are ordered by (turn, role, text).  Min-plus costs compose, so a conversation is cut wherever the sort's
sampled splitters fall: each cut's segment gives a 4 x 4 cost matrix, the matrices of one conversation
(at most one a partition) fix the states at its cuts, and each segment is then walked on its own.  A
conversation of any length is thus spread over tasks and never rendered into one row: the result has a row
per given turn whose ``rendered`` pieces, in order, are the conversation.

Role marks are ``<|role|>`` lines; a ``<|`` inside a turn's text is escaped, so no text can open a turn.

Null or unknown roles count as none and are always relabelled; null text is empty; rows with a null conv_id
form one conversation; a null turn comes first.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import pin, shuffle_partitions

MERGE, RELABEL, INSERT = 1, 2, 3
ROLES = ("system", "user", "assistant")
#: States: nothing yet, and the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_END = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
FAR = 10**12
_MARK = re.compile(r"<(\\*)\|")


def _moves(state: int) -> list[tuple[int, int, bool, tuple[int, ...]]]:
    """(next state, cost without relabelling, merged, inserted roles), in order of preference."""
    found = [(q, 0, False, ()) for q in _NEXT[state]]
    if state != START:
        found.append((state, MERGE, True, ()))
    for x in _NEXT[state]:
        found += [(q, INSERT, False, (x,)) for q in _NEXT[x] if q not in _NEXT[state]]
    return found


MOVES = [_moves(s) for s in range(4)]


def _role(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def costs(roles: list[str | None]) -> list[list[int]]:
    """Least cost from each state before these turns to each state after them."""
    out = [[0 if i == j else FAR for j in range(4)] for i in range(4)]
    for role in map(_role, roles):
        for i in range(4):
            row, new = out[i], [FAR] * 4
            for s in range(4):
                if row[s] < FAR:
                    for q, cost, _, _ in MOVES[s]:
                        new[q] = min(new[q], row[s] + cost + (RELABEL if q != role else 0))
            out[i] = new
    return out


def end_cost(state: int) -> int:
    return INSERT * len(_END[state])


def walk(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, bool, tuple[int, ...]]]:
    """(role, merged, inserted before) of each turn on a least-cost way from one state to the other."""
    back: list[list] = []
    best = [FAR] * 4
    best[entry] = 0
    for role in map(_role, roles):
        new, came = [FAR] * 4, [None] * 4
        for s in range(4):
            if best[s] < FAR:
                for q, cost, merged, inserted in MOVES[s]:
                    total = best[s] + cost + (RELABEL if q != role else 0)
                    if total < new[q]:
                        new[q], came[q] = total, (s, merged, inserted)
        back.append(came)
        best = new
    out, state = [], leave
    for came in reversed(back):
        before, merged, inserted = came[state]
        out.append((state, merged, inserted))
        state = before
    return out[::-1]


def _ways(segments: list[list[list[int]]]) -> tuple[list[int], int]:
    """States before, between and after the segments on a least-cost way, and that cost."""
    best, back = [0, FAR, FAR, FAR], []
    for m in segments:
        new, came = [FAR] * 4, [0] * 4
        for s in range(4):
            for q in range(4):
                if best[s] + m[s][q] < new[q]:
                    new[q], came[q] = best[s] + m[s][q], s
        back.append(came)
        best = new
    last = min(range(4), key=lambda s: (best[s] + end_cost(s), s))
    states = [last]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1], best[last] + end_cost(last)


def escaped(text: str) -> str:
    """The text with one more backslash inside every ``<|``, ``<\\|``, ..., so that it can hold no role mark."""
    return _MARK.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    """The inverse of ``escaped``."""
    return _MARK.sub(lambda m: f"<{m[1][1:]}|", text)


def _open(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, role_out, merged, inserted (roles put before), closing (roles put after the last
    turn), rendered, conv_cost: one row per given turn."""
    spark = turns.sparkSession
    parts = shuffle_partitions(spark)
    order = ["conv_id", "turn", "role", "text_key"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.sha2("text", 256)).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    rows = pin(rows)

    def streams(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list]]:
        def each() -> Iterator[tuple]:
            for b in batches:
                yield from b.astype(object).where(b.notna(), None).itertuples(index=False, name=None)

        return groupby(each(), key=lambda r: (r[0], r[1]))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (part, conv), group in streams(batches):
            m = costs([r[2] for r in group])
            yield pd.DataFrame([[part, conv, [x for row in m for x in row]]], columns=["part", "conv_id", "m"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b["conv_id"].astype(object).where(b["conv_id"].notna(), None), b["part"], b["m"], strict=True)

        for conv, group in groupby(each(), key=lambda r: r[0]):
            group = list(group)
            states, cost = _ways([[list(m[4 * i : 4 * i + 4]) for i in range(4)] for _, _, m in group])
            n = len(group)
            yield pd.DataFrame({"conv_id": pd.array([conv] * n, "Int64"), "part": [p for _, p, _ in group], "entry": states[:-1], "leave": states[1:], "last": [i == n - 1 for i in range(n)], "conv_cost": cost})

    segments = rows.select("part", "conv_id", "role", "turn", "text_key").repartition(parts, "part").sortWithinPartitions("part", *order)
    segments = segments.select("part", "conv_id", "role").mapInPandas(_gathered(matrices), "part int, conv_id long, m array<long>")
    ways = segments.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part")
    ways = pin(ways.mapInPandas(_gathered(choose), "conv_id long, part int, entry int, leave int, last boolean, conv_cost long"))
    joined = rows.join(ways.withColumnsRenamed({"conv_id": "c", "part": "p"}), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")))
    joined = joined.repartition(parts, "part", "conv_id").sortWithinPartitions("part", *order)
    joined = joined.select("part", "conv_id", "role", "turn", "text", "entry", "leave", "last", "conv_cost")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, conv), group in streams(batches):
            group = list(group)
            entry, leave, last, cost = group[0][5:9]
            steps = walk([r[2] for r in group], entry, leave)
            for i, (r, (state, merged, inserted)) in enumerate(zip(group, steps, strict=True)):
                closing = _END[leave] if last and i == len(group) - 1 else ()
                piece = "".join(_open(x) + "\n" for x in inserted) + ("" if merged else _open(state)) + escaped(r[4]) + "\n" + "".join(_open(x) + "\n" for x in closing)
                yield conv, r[3], r[2], ROLES[state - 1], merged, [ROLES[x - 1] for x in inserted], [ROLES[x - 1] for x in closing], piece, cost

    names = ["conv_id", "turn", "role", "role_out", "merged", "inserted", "closing", "rendered", "conv_cost"]

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for row in render(batches):
            held.append(row)
            if len(held) == 2000:
                yield _frame(held, names)
                held = []
        yield _frame(held, names)

    return joined.mapInPandas(framed, "conv_id long, turn long, role string, role_out string, merged boolean, inserted array<string>, closing array<string>, rendered string, conv_cost long")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"conv_id": "Int64", "turn": "Int64"})


def _gathered(make):  # noqa: ANN001, ANN202
    """Joins the small frames that ``make`` yields, a thousand at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for frame in make(batches):
            held.append(frame)
            if len(held) == 1000:
                yield pd.concat(held, ignore_index=True)
                held = []
        if held:
            yield pd.concat(held, ignore_index=True)

    return run
