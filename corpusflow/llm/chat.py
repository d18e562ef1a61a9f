"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn followed by one or more pairs of
a user and an assistant turn.  Dynamic programming over that automaton chooses
for each turn whether it is kept, relabelled or merged into the turn before it,
and where empty turns are inserted, at the least total cost.

Of the repairs of least cost the one is taken that makes, turn by turn from the
first, the most preferred move that still leads to the least cost.  That choice
needs only the state before a turn and the least costs from the states after it
to the end, so it does not depend on how a conversation is cut.  The automaton
has four states, and a run of turns acts on it as a 4 x 4 matrix of least costs;
such matrices combine in (min, +).  A conversation longer than a block is cut
into blocks: their matrices give the costs that lie ahead of each cut, those give
each block's exit for every entry, and the exits fix the states at the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.runtime import global_rank, materialize

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
AFTER = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
#: For a state and the role of a new turn: the roles of the empty turns to insert first (None: not possible).
INSERT = {
    (START, "system"): (), (START, "user"): (), (START, "assistant"): ("user",),
    (SYSTEM, "user"): (), (SYSTEM, "assistant"): ("user",),
    (USER, "assistant"): (), (USER, "user"): ("assistant",),
    (ASSISTANT, "user"): (), (ASSISTANT, "assistant"): ("user",),
}
AT_END = {START: (), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}
COST_MERGE, COST_INSERT, COST_RELABEL, COST_NAME = 2, 3, 4, 1
BLOCK = 2048


def known_role(role: str | None) -> str | None:
    name = (role or "").strip().lower()
    return name if name in ROLES else ALIASES.get(name)


@lru_cache(maxsize=None)  # four states, four known roles
def moves(state: int, own: str | None) -> list[tuple[int, int, str, str, tuple[str, ...]]]:
    """``(cost, next state, final role, keep or merge, inserted roles)`` for a turn of known role ``own``, in order of preference."""
    out = []
    for final in ROLES:
        relabel = 0 if final == own else COST_NAME if own is None and final != "system" else COST_RELABEL
        if (state, final) in INSERT:
            extra = INSERT[state, final]
            out.append((relabel + COST_INSERT * len(extra), AFTER[final], final, "keep", extra))
        if state == AFTER[final]:
            out.append((relabel + COST_MERGE, state, final, "merge", ()))
    return sorted(out, key=lambda m: (m[0], len(m[4]), m[3], ROLES.index(m[2])))


NO_WAY = 1 << 40
END = tuple(COST_INSERT * len(AT_END[s]) for s in STATES)


@lru_cache(maxsize=65_536)
def step_back(own: str | None, ahead: tuple[int, ...]) -> tuple[tuple, tuple[int, ...]]:
    """For a turn and the least costs after it: the move from each state (None: no way) and the least costs before it."""
    chosen, costs = [], []
    for s in STATES:
        ways = [(cost + ahead[nxt], i) for i, (cost, nxt, *_) in enumerate(moves(s, own)) if ahead[nxt] < NO_WAY]
        least = min(ways, default=None)
        chosen.append(None if least is None else moves(s, own)[least[1]])
        costs.append(NO_WAY if least is None else least[0])
    return tuple(chosen), tuple(costs)


def walk_back(roles: list[str | None], ahead: tuple[int, ...]) -> tuple[list[tuple], list[int]]:
    """The move from each state at each turn, and the least costs before the first turn, given those after the last."""
    table, paid = [], 0
    for role in reversed(roles):
        low = min(ahead)
        if 0 < low < NO_WAY:  # relative costs are few, so steps repeat
            paid, ahead = paid + low, tuple(c - low if c < NO_WAY else NO_WAY for c in ahead)
        chosen, ahead = step_back(known_role(role), ahead)
        table.append(chosen)
    return table[::-1], [c + paid if c < NO_WAY else NO_WAY for c in ahead]


def solve(roles: list[str | None], start: int = START, ahead: tuple[int, ...] = END) -> tuple[int, list]:
    """Least cost from ``start`` to the end and the moves; ``ahead`` holds the least costs from each state after the last turn."""
    table, costs = walk_back(roles, tuple(ahead))
    out, state = [], start
    for chosen in table:
        out.append(chosen[state])
        state = chosen[state][1]
    return costs[start], out


def exits(roles: list[str | None], ahead: tuple[int, ...]) -> list[int]:
    """The state after the last turn for each state before the first one; -1 where there is no way."""
    now = list(STATES)
    for chosen in walk_back(roles, tuple(ahead))[0]:
        now = [-1 if s < 0 or chosen[s] is None else chosen[s][1] for s in now]
    return now


def matrix(roles: list[str | None]) -> list[int]:
    """Least cost between every pair of states, row by row; ``NO_WAY`` where there is none."""
    columns = [walk_back(roles, tuple(0 if s == b else NO_WAY for s in STATES))[1] for b in STATES]
    return [columns[b][a] for a in STATES for b in STATES]


def _costs_ahead(frame: pd.DataFrame) -> pd.DataFrame:
    """The least costs ahead of each block's end in one long conversation, from its blocks' matrices (16 numbers a block)."""
    frame = frame.sort_values("block", ascending=False)
    ahead, out = list(END), []
    for costs in frame["costs"]:
        out.append(ahead)
        ahead = [min(min(int(costs[4 * a + b]) + ahead[b] for b in STATES), NO_WAY) for a in STATES]
    return frame[["conv", "block"]].assign(ahead=out)


def _entries(frame: pd.DataFrame) -> pd.DataFrame:
    """The state before each block of one long conversation, from the blocks' exits (4 numbers a block)."""
    frame = frame.sort_values("block")
    state, out = START, []
    for ends in frame["exits"]:
        out.append(state)
        state = int(ends[state])
    return frame[["conv", "block", "ahead"]].assign(enter=out, last=[False] * (len(out) - 1) + [True])


COLUMNS = ("conv", "block", "place", "turn", "role", "role_out", "action", "inserted_before", "inserted_after", "piece")
MADE = "conv string, block long, place int, turn long, role string, role_out string, action string, inserted_before string, inserted_after string, piece string"


def repair_block(rows: list[dict]) -> Iterator[tuple]:
    """Repairs the turns of one block, in order, and renders each as a piece; pieces in order give the conversation."""
    start, last = rows[0]["enter"], rows[0]["last"]
    _, chosen = solve([r["role"] for r in rows], start, rows[0]["ahead"])
    state = start
    for place, (row, (_, nxt, final, how, extra)) in enumerate(zip(rows, chosen, strict=True), 1):
        text, piece, after = row["text"] or "", "", ""
        if how == "keep":
            open_ = "" if state == START else "<|im_end|>\n"
            for name in extra:
                piece += f"{open_}<|im_start|>{name}\n"
                open_ = "<|im_end|>\n"
            piece += f"{open_}<|im_start|>{final}\n{text}"
        else:
            piece = f"\n{text}"
        if last and place == len(rows):
            after = ",".join(AT_END[nxt])
            piece += "".join(f"<|im_end|>\n<|im_start|>{name}\n" for name in AT_END[nxt]) + "<|im_end|>\n"
        action = how if final == known_role(row["role"]) else "relabel" if how == "keep" else "relabel+merge"
        yield row["conv"], row["block"], place, row["turn"], row["role"], final, action, ",".join(extra), after, piece
        state = nxt


def repair_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs a stream of turns sorted by conversation and block, one block in memory at a time."""
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 6)
    block: list[dict] = []
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(COLUMNS))

    for batch in batches:
        for row in batch.to_pylist():
            if block and (row["conv"], row["block"]) != (block[0]["conv"], block[0]["block"]):
                out += repair_block(block)
                block = []
                if len(out) >= 2000:
                    yield made()
                    out = []
            block.append(row)
    if block:
        out += repair_block(block)
    if out:
        yield made()


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per turn: ``conv_id, position, turn, role, role_out, action, inserted_before, inserted_after, piece``.

    Turns are ordered by ``turn`` (null last), then role and text, which settles
    ties; repeated rows are turns of their own and get merged like others.  A null
    ``conv_id`` is a conversation of its own; a null or unknown role is relabelled
    at a low cost; null text is empty; other columns are ignored; an empty table
    gives no rows.  ``position`` counts from 1 within the conversation.
    Conversations of up to ``block`` turns are repaired at once, longer ones block
    by block, so no task holds more than a block of turns; the rows are the same.
    """
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    base = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00null")).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sizes = base.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    long = materialize(sizes.where(F.col("n") > block))
    blank = [F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("block"), F.lit(START).alias("enter"), F.array(*map(F.lit, END)).cast("array<long>").alias("ahead"), F.lit(True).alias("last")]
    if long.isEmpty():
        ready = base.select("conv", "turn", "role", "text", *blank)
    else:
        short = base.join(long.select("conv"), "conv", "left_anti").select("conv", "turn", "role", "text", *blank)
        hot = base.join(long.select("conv"), "conv", "left_semi").select("conv", "turn", "role", "text")
        ranked = materialize(global_rank(hot, [F.col("conv"), *order], "rank"))
        first = ranked.groupBy("conv").agg(F.min("rank").alias("first"))
        cut = ranked.join(first, "conv").withColumn("at", F.col("rank") - F.col("first")).withColumn("block", F.floor(F.col("at") / block).cast("long"))
        turns_of = cut.select("conv", "block", "at", "role")

        def by_block(rows: DataFrame, name: str, made) -> DataFrame:
            """One array of longs per block, made of its roles in order (and of ``ahead``, if there)."""
            fold = lambda f: pd.DataFrame({k: [f[k].iloc[0]] for k in ("conv", "block", "ahead") if k in f} | {name: [made(f.sort_values("at")["role"].tolist(), f)]})
            ahead = "ahead array<long>, " if "ahead" in rows.columns else ""
            return rows.groupBy("conv", "block").applyInPandas(fold, f"conv string, block long, {ahead}{name} array<long>")

        costs = by_block(turns_of, "costs", lambda roles, f: matrix(roles))
        ahead = materialize(costs.groupBy("conv").applyInPandas(_costs_ahead, "conv string, block long, ahead array<long>"))
        ends = by_block(turns_of.join(ahead, ["conv", "block"]), "exits", lambda roles, f: exits(roles, tuple(f["ahead"].iloc[0])))
        states = ends.groupBy("conv").applyInPandas(_entries, "conv string, block long, ahead array<long>, enter int, last boolean")
        long_ready = cut.join(states, ["conv", "block"]).select("conv", "turn", "role", "text", "at", "block", "enter", "ahead", "last")
        ready = short.unionByName(long_ready)
    # Blocks are dealt by a hash and come sorted, so a task streams through them.
    dealt = ready.repartition("conv", "block").sortWithinPartitions("conv", "block", F.col("at").asc_nulls_last(), *order)
    done = dealt.mapInArrow(repair_sorted, MADE)
    kind = turns.schema["conv_id"].dataType
    conv_id = F.when(F.col("conv") != "\x00null", F.col("conv")).cast(kind)
    position = (F.col("block") * block + F.col("place")).alias("position")
    return done.select(conv_id.alias("conv_id"), position, "turn", "role", "role_out", "action", "inserted_before", "inserted_after", "piece")
