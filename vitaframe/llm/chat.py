"""Chat formatting: minimum-cost repair of role sequences, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, and it
ends with the assistant. Every turn is kept, merged into the turn before, or relabelled, and empty
turns may be put in before it; dynamic programming over the states of that automaton (the role of the
last turn) finds the cheapest way. A run of turns is a table of least costs from state to state, and such
tables combine, so a conversation of any length is worked on in parts: tables per part, then the states
between parts, then each part on its own. Only conversations of more than ``PART`` turns take that way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import written

#: Turns that are gathered in one row at most.
PART = 4096
MERGE_SAME, INSERT, RELABEL, MERGE_OTHER = 1, 2, 3, 4
STATES = ("", "system", "user", "assistant")
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
_FINAL = 3
_FAR = 10**12
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}

Step = tuple[int, str, tuple[int, ...], int]  # cost, what, empty turns before, next state


def state_of(role: str | None) -> int:
    """Number of a role's state; 0 for a role that no state has."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return STATES.index(name) if name in STATES[1:] else 0


def _fills(start: int) -> dict[int, tuple[int, ...]]:
    """Shortest runs of empty turns from ``start`` to every state."""
    found: dict[int, tuple[int, ...]] = {start: ()}
    edge = [start]
    while edge:
        edge = [found.setdefault(t, (*found[s], t)) and t for s in edge for t in _NEXT[s] if t not in found]
    return found


FILLS = {s: _fills(s) for s in range(4)}


def steps(state: int, role: int) -> list[Step]:
    """All ways to take a turn of this role, the cheapest first; of equal cost in the order keep, merge, relabel."""
    out: list[Step] = []
    for wanted in (1, 2, 3):
        for before, fill in FILLS[state].items():
            if wanted in _NEXT[before]:
                cost = INSERT * len(fill) + (0 if wanted == role else RELABEL)
                out.append((cost, "keep" if wanted == role else "relabel", fill, wanted))
    if state:
        out.append((MERGE_SAME if state == role else MERGE_OTHER, "merge", (), state))
    return sorted(out, key=lambda s: (s[0], ("keep", "merge", "relabel").index(s[1]), s[2], s[3]))


STEPS = [[steps(s, r) for r in range(4)] for s in range(4)]
#: Empty turns that end a conversation in each state, and their cost. A conversation without turns stays empty.
ENDS = {s: FILLS[s][_FINAL] for s in range(1, 4)} | {0: ()}


def backward(roles: list[int], final: np.ndarray) -> np.ndarray:
    """Least cost from every state before every turn to the end, where ``final`` is the cost of each last state."""
    table = np.empty((len(roles) + 1, 4), dtype=np.int64)
    table[-1] = final
    for i in range(len(roles) - 1, -1, -1):
        for s in range(4):
            table[i, s] = min(cost + table[i + 1, t] for cost, _, _, t in STEPS[s][roles[i]])
    return table


def costs(roles: list[int]) -> np.ndarray:
    """Least cost of a run of turns from each state (row) to each state (column)."""
    return np.stack([backward(roles, np.where(np.arange(4) == t, 0, _FAR))[0] for t in range(4)], axis=1)


def end_costs() -> np.ndarray:
    return np.array([INSERT * len(ENDS[s]) for s in range(4)], dtype=np.int64)


def repair(roles: list[int], start: int = 0, end: int | None = None) -> tuple[int, list[Step], tuple[int, ...]]:
    """Cost, a step per turn, and the empty turns at the end; ``end`` names the last state of a part that goes on."""
    table = backward(roles, end_costs() if end is None else np.where(np.arange(4) == end, 0, _FAR))
    state, path = start, []
    for i, role in enumerate(roles):
        step = next(s for s in STEPS[state][role] if s[0] + table[i + 1, s[3]] == table[i, state])
        path.append(step)
        state = step[3]
    return int(table[0, start]), path, ENDS[state] if end is None else ()


def render(texts: list[str], path: list[Step], tail: tuple[int, ...], start: int = 0, goes_on: bool = False) -> str:
    """The repaired turns as one string. Parts of a conversation render to strings that follow each other."""
    out: list[str] = []
    opened = start != 0

    def turn(state: int, text: str) -> None:
        nonlocal opened
        if opened:
            out.append("<|end|>\n")
        out.append(f"<|{STATES[state]}|>\n{text}")
        opened = True

    for text, (_, what, fill, state) in zip(texts, path, strict=True):
        for empty in fill:
            turn(empty, "")
        if what == "merge":
            out.append("\n" + text)
        else:
            turn(state, text)
    for empty in tail:
        turn(empty, "")
    if opened and not goes_on:
        out.append("<|end|>\n")
    return "".join(out)


_RESULT = "cost long, n_out int, ops array<string>, rendered string"


def _repaired(roles: list, texts: list, start: int, end: int | None) -> tuple:
    cost, path, tail = repair([state_of(r) for r in roles], start, end)
    ops = [what if not fill else "+".join([*("insert " + STATES[f] for f in fill), what]) for _, what, fill, _ in path]
    ops += ["insert " + STATES[f] for f in tail]
    turns = sum(len(fill) + (what != "merge") for _, what, fill, _ in path) + len(tail)
    return cost, turns, ops, render([t or "" for t in texts], path, tail, start, end is not None)


def _gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Turns of each group in order, at most ``PART``."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy(*keys).agg(turns.alias("turns")).select(*keys, F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))


def repaired_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART
) -> DataFrame:
    """``conv, part, cost, n_out, ops, rendered``: one row per conversation, and more for one of over ``part`` turns.

    Turns go by number, then role, then text, nulls first. A null or unknown role is never kept but
    merged or relabelled; a null text is empty. Rows with a null conversation are one conversation.
    The strings of a long conversation's parts, in order, are its rendering. Repeated turns are turns of their own, texts of any
    length are rendered whole, other columns have no effect; an empty table gives no rows. Of repairs of one cost the first
    in the order of the automaton's states is taken.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    long_ = written(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select(F.col("conv").alias("long")), "chat-long")

    @F.pandas_udf(_RESULT)
    def whole(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_repaired(list(r), list(t), 0, None) for r, t in zip(roles, texts, strict=True)], columns=["cost", "n_out", "ops", "rendered"])

    def shown(df: DataFrame) -> DataFrame:
        return df.select("conv", "part", "r.cost", "r.n_out", "r.ops", "r.rendered")

    short = rows.join(long_, F.col("conv").eqNullSafe(F.col("long")), "left_anti")
    out = shown(_gathered(short, ["conv"]).select("conv", F.lit(0).cast("long").alias("part"), whole("roles", "texts").alias("r")))
    if long_.isEmpty():
        return out

    # long conversations: sorted over all tasks, cut where the place in the task passes a multiple of the part
    many = rows.join(long_, F.col("conv").eqNullSafe(F.col("long")), "left_semi").withColumn("salt", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "text", "salt"]
    ranged = many.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    cut = written(ranged.withColumn("part", F.floor(F.col("place") / part)), "chat-sorted")
    gathered = cut.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("t"))
    parts = written(gathered.select("conv", "part", F.col("t.role").alias("roles"), F.col("t.text").alias("texts")), "chat-parts")

    @F.pandas_udf("array<long>")
    def table(roles: pd.Series) -> pd.Series:
        return pd.Series([costs([state_of(r) for r in rs]).ravel() for rs in roles])

    def between(frame: pd.DataFrame) -> pd.DataFrame:
        """States before and after each part of one conversation: a cheapest path through the tables."""
        frame = frame.sort_values("part")
        tables = [np.asarray(t).reshape(4, 4) for t in frame["costs"]]
        after = [end_costs()]
        for t in reversed(tables):
            after.append((t + after[-1][None, :]).min(axis=1))
        after.reverse()
        state, rows_ = 0, []
        for i, (p, t) in enumerate(zip(frame["part"], tables, strict=True)):
            to = int((t[state] + after[i + 1]).argmin())
            rows_.append((frame["conv"].iloc[0], p, state, to, i == len(tables) - 1))
            state = to
        return pd.DataFrame(rows_, columns=["conv", "part", "start", "end", "last"])

    kind = rows.select("conv").schema.add("part", "long").add("start", "integer").add("end", "integer").add("last", "boolean")
    joints = parts.select("conv", "part", table("roles").alias("costs")).groupBy("conv").applyInPandas(between, kind)

    @F.pandas_udf(_RESULT)
    def piece(roles: pd.Series, texts: pd.Series, start: pd.Series, end: pd.Series, last: pd.Series) -> pd.DataFrame:
        each = zip(roles, texts, start, end, last, strict=True)
        return pd.DataFrame([_repaired(list(r), list(t), int(s), None if z else int(e)) for r, t, s, e, z in each], columns=["cost", "n_out", "ops", "rendered"])

    named = joints.withColumnsRenamed({"conv": "_conv", "part": "_part"})
    met = parts.join(named, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    return out.unionByName(shown(met.select("conv", "part", piece("roles", "texts", "start", "end", "last").alias("r"))))


