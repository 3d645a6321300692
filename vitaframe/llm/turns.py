"""Repair of conversations by weighted CYK parsing.

The legal role sequences are those of ``(s?(ua)+)?``: nothing, or an optional system turn and then user and
assistant in turns. As a grammar in Chomsky normal form its nonterminals are ``X(p, q)``, "these rows, edited,
lead from state p to state q": ``X(p, q) -> X(p, r) X(r, q)``, and ``X(p, q) -> row`` for each edit of one row.
Insertions need no row; their closure (cheapest insertions between any two states) is worked into both sides of
every one-row cell. A cell holds the cheapest ``(cost, audit)``, the audit being the edits' initials, and cells
are combined bottom-up by span length over all splits. Of two audits of equal cost over the same rows and states
neither is a prefix of the other (each row has one letter, and a further insertion costs more), so the least
audit of a span is made of the least audits of its halves.

A conversation may hold any number of rows. Rows find their place by a range shuffle over (conversation, turn,
role, text); spans of at most ``SPAN`` rows are parsed where they lie, and their whole-span cells are the
terminals of the next parse, until one span is left. What a repeated turn repeats is found by an aggregation of
digests. Only the digest of the repaired text reads a conversation in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import numbered, written

SPAN = 16
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: (state, role initial, state); a repaired conversation ends where it starts or after an assistant.
MOVES = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (USER, "a", ASSISTANT), (ASSISTANT, "u", USER))
ENDS = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
OK, BLANK, DUPLICATE, TRUNCATED = "okdt"
MARK = r"[^\x20\x09-\x0D]"

Cell = tuple[int, str]
Table = dict[tuple[int, int], Cell]

_TABLE = "blank long, duplicate long, truncated long, illegal long, head string, tail string, costs array<long>, audits array<string>"


def combined(left: Table, right: Table, best: Table) -> None:
    """Lower the cells of ``best`` to those of a left span and the right span after it."""
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            if (other := right.get((r, q))) is not None:
                found = (cost + other[0], audit + other[1])
                if (p, q) not in best or found < best[p, q]:
                    best[p, q] = found


def _insertions() -> Table:
    """The cheapest insertions between any two states."""
    closure: Table = {(p, p): (0, "") for p in STATES}
    step = {(p, q): (INSERT, "I") for p, initial, q in MOVES if initial != "s"}
    for _ in STATES:
        combined(dict(closure), step, closure)
    return closure


_CLOSURE = _insertions()


@lru_cache(maxsize=None)
def of_row(initial: str, fault: str) -> Table:
    """The cells of one row, insertions before and after it included. There are 16 kinds of rows."""
    edits: Table = {(p, p): (DELETE, "D") for p in STATES}
    if fault not in (BLANK, DUPLICATE):
        extra = CUT_OFF if fault == TRUNCATED else 0
        for p, wanted, q in MOVES:
            if wanted == initial:
                edits[p, q] = (extra, "K")
            elif wanted != "s":
                edits[p, q] = (REROLE + extra, "R")
    before: Table = {}
    combined(_CLOSURE, edits, before)
    out: Table = {}
    combined(before, _CLOSURE, out)
    return out


def parsed(terminals: Sequence[Table]) -> Table:
    """The cells of a whole span from those of its parts: CYK over all shorter spans and all splits."""
    n = len(terminals)
    cells: dict[tuple[int, int], Table] = {(i, i + 1): t for i, t in enumerate(terminals)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best: Table = {}
            for k in range(i + 1, i + length):
                combined(cells[i, k], cells[k, i + length], best)
            cells[i, i + length] = best
    return cells[0, n]


def _flat(table: Table) -> tuple[list[int | None], list[str | None]]:
    cells = [table.get((p, q)) for p in STATES for q in STATES]
    return [c and c[0] for c in cells], [c and c[1] for c in cells]


def _table(costs: Sequence[int | None], audits: Sequence[str | None]) -> Table:
    return {divmod(k, len(STATES)): (int(c), a) for k, (c, a) in enumerate(zip(costs, audits, strict=True)) if a is not None}


@lru_cache(maxsize=100_000)
def _of_codes(codes: str) -> tuple:
    initials, faults = codes[::2], codes[1::2]
    pairs = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:], strict=False))
    counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
    return (*counts, pairs, initials[0], initials[-1], *_flat(parsed([of_row(i, f) for i, f in zip(initials, faults, strict=True)])))


def _of_spans(spans: Sequence[dict]) -> tuple:
    """One span from several in a row: counts add up, borders are checked, tables are the terminals of a parse."""
    pairs = sum(s["illegal"] for s in spans) + sum(a["tail"] + b["head"] not in LEGAL_PAIRS for a, b in zip(spans, spans[1:], strict=False))
    counts = [sum(s[k] for s in spans) for k in ("blank", "duplicate", "truncated")]
    tables = [_table(s["costs"], s["audits"]) for s in spans]
    return (*counts, pairs, spans[0]["head"], spans[-1]["tail"], *_flat(parsed(tables) if len(tables) > 1 else tables[0]))


_NAMES = [part.split()[0] for part in _TABLE.split(", ")]


def _parse_rows(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_of_codes(c) for c in codes], columns=_NAMES)


def _parse_spans(spans: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_of_spans(s) for s in spans], columns=_NAMES)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def located(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, role, text, place, n, code``: rows in order, with role initial and first fault as two letters.

    Null roles and texts count as one space. Rows of one turn are in the order of role and text.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
    )
    rows = numbered(rows, [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], "turns")
    first = rows.groupBy("conv").agg(F.min("_rank").alias("first"), F.count(F.lit(1)).alias("n")).withColumnRenamed("conv", "_conv")
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumn("said", said)
    earliest = rows.groupBy("conv", "said").agg(F.min("_rank").alias("earliest")).select(F.col("conv").alias("_conv2"), F.col("said").alias("_said"), "earliest")
    rows = rows.join(first, _same("conv", "_conv")).join(earliest, _same("conv", "_conv2") & (F.col("said") == F.col("_said")))
    # last character that is no white space
    last = F.regexp_extract("text", MARK + r"(?=[\x20\x09-\x0D]*\z)", 0)
    fault = (
        F.when(~F.col("text").rlike(MARK), BLANK)
        .when(F.col("earliest") < F.col("_rank"), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(OK)
    )
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    return rows.select("conv", "turn", "role", "text", (F.col("_rank") - F.col("first")).alias("place"), "n", F.concat(initial, fault).alias("code"))


def _parses(rows: DataFrame) -> DataFrame:
    """``conv`` and the whole-conversation span of every conversation."""
    parse_rows, parse_spans = F.pandas_udf(_parse_rows, _TABLE), F.pandas_udf(_parse_spans, _TABLE)
    spans = rows.groupBy("conv", "n", F.floor(F.col("place") / SPAN).alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
    level = spans.select("conv", F.ceil(F.col("n") / SPAN).alias("n"), "place", parse_rows(F.array_join("rows.code", "")).alias("span"))
    level = written(level, "turn-spans")
    whole = []
    while True:
        whole.append(level.where("n = 1").select("conv", "span.*"))
        if level.where("n > 1").isEmpty():
            return reduce(DataFrame.unionByName, whole)
        groups = level.where("n > 1").groupBy("conv", "n", F.floor(F.col("place") / SPAN).alias("above"))
        lists = groups.agg(F.sort_array(F.collect_list(F.struct("place", "span"))).alias("spans"))
        level = written(lists.select("conv", F.ceil(F.col("n") / SPAN).alias("n"), F.col("above").alias("place"), parse_spans(F.col("spans.span")).alias("span")), "turn-spans")


def _cheapest() -> tuple[Column, Column]:
    ends = [START * len(STATES) + q for q in ENDS]
    cells = F.filter(F.array(*[F.struct(F.col("costs")[k].alias("cost"), F.col("audits")[k].alias("audit")) for k in ends]), lambda c: c["audit"].isNotNull())
    return F.array_min(cells)["cost"], F.array_min(cells)["audit"]


def judged(rows: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of located rows."""
    turns = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("_k"))
    seen = turns.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    cost, audit = _cheapest()
    found = _parses(rows).select("conv", "blank", "duplicate", "truncated", "illegal", cost.alias("cost"), audit.alias("audit"))
    both = found.join(seen.withColumnRenamed("conv", "_conv"), _same("conv", "_conv"))
    return both.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired turns: the audit's letters say what becomes of each row, the place in the sequence which role it gets."""
    state = START
    turn = {(p, initial): q for p, initial, q in MOVES}
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = turn[state, role[0]]
        yield role, text


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's verdict, then its rows by place, in one task that reads them as a stream."""
    names = [c for c in found.columns if c != "conv"]
    head = found.select("conv", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *names)
    body = rows.select("conv", "place", "role", "text", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names])
    both = head.unionByName(body)
    return both.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "place")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Verdict and repaired turns of one conversation after the other. The turns must be read before the next."""
    rows = (row for batch in batches for part in range(0, batch.num_rows, 256) for row in batch.slice(part, 256).to_pylist())
    head = next(rows, None)

    def body() -> Iterator[tuple[str, str]]:
        nonlocal head
        for row in rows:
            if row["place"] < 0:
                head = row
                return
            yield row["role"], row["text"]
        head = None

    while head is not None:
        verdict, own = head, body()
        yield verdict, _edited(verdict["audit"], own)
        for _ in own:  # rows that were deleted at the end
            pass


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Null conversations are one conversation, null turns come first and leave no gap, null roles and texts count as
    one space, repeated rows are duplicates, a text may have any length. A role with another initial than s, u or a
    can be deleted or get another role. Further columns have no effect. An empty table gives no rows.
    """
    rows = written(located(turns, conv_col, turn_col, role_col, text_col), "turns-located")
    found = judged(rows)
    ordered = _in_order(rows, found)
    schema = found.schema.add("repaired_sha256", "string")
    names = schema.fieldNames()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        kinds = None

        def batch() -> pa.RecordBatch:
            arrays = [pa.array([row[c] for row in out], kinds.field(c).type if c != "repaired_sha256" else pa.string()) for c in names]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for each in batches:
                kinds = each.schema
                yield each

        for verdict, own in _conversations(noted()):
            digest = hashlib.sha256()
            for i, (role, text) in enumerate(own):
                digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
            out.append({**verdict, "repaired_sha256": digest.hexdigest()})
            if len(out) == 1000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return ordered.mapInArrow(task, schema)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations themselves: ``conv, place, role, text``. The same cases as ``repaired``."""
    rows = written(located(turns, conv_col, turn_col, role_col, text_col), "turns-located")
    ordered = _in_order(rows, judged(rows).select("conv", "audit"))
    schema = rows.select("conv", "place", "role", "text").schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for each in batches:
                kind = each.schema.field("conv").type
                yield each

        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [kind, pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.fieldNames())

        out: list[tuple] = []
        for verdict, own in _conversations(noted()):
            for i, (role, text) in enumerate(own):
                out.append((verdict["conv"], i, role, text))
                if len(out) == 256:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return ordered.mapInArrow(task, schema)
