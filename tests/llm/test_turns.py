"""Repaired conversations against a search over all edits, in plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from vitaframe.llm import turns

ROWS = "conv_id long, turn long, role string, text string, place long, conv string, code string, `a.b` int"
SPACE = " \t\n\v\f\r"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(SPACE)
        if not body:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Dijkstra-like search over (row, role initials so far reduced to the last and whether any came)."""
    faults = faults_of(rows)
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, last, made = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, made
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        names = {"u": "user", "a": "assistant"}
        for x in follow:
            if x != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", at, x, (*made, (names[x], ""))))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, made))
            if faults[at] not in ("b", "d"):
                extra = 3 if faults[at] == "t" else 0
                for x in follow:
                    if role[:1] == x:
                        heapq.heappush(heap, (cost + extra, audit + "K", at + 1, x, (*made, (role, text))))
                    elif x != "s":
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", at + 1, x, (*made, (names[x], text))))
    raise AssertionError("no repair")


def by_hand(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in convs.items():
        own.sort()
        lines = [(role, text) for _, _, role, text in own]
        known = [t for real, t, _, _ in own if real]
        faults = faults_of(lines)
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:], strict=False))
        cost, audit, made = cheapest(lines)
        said = "\n".join(f"{r}:{t}" for r, t in made)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), pairs, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def found(spark, rows):
    got = turns.repaired(spark.createDataFrame(rows, ROWS)).collect()
    return {r.conv: tuple(r)[1:] for r in got}


def random_rows(rng, convs, most):
    rows = []
    for conv in convs:
        for _ in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?", "", " \n", None, f"Text {rng.random()}.", f"Cut {rng.random()}", "Ü ö!\t"])
            rows.append((conv, rng.choice([None, *range(9)]), role, text, 0, "x", "y", 1))
    return rows


def test_random_conversations(spark):
    rows = random_rows(random.Random(1), [None, *range(300)], 9)
    assert found(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("n", [15, 16, 17, 33, 300])
def test_conversations_of_any_length(spark, n):
    rng = random.Random(n)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"Cut {i}", f"Text {i}.", ""]), 0, "x", "y", 1) for i in range(n)]
    assert found(spark, rows) == by_hand(rows)


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(8)
    rows = random_rows(rng, range(50), 6) + [(99, i, "user" if i % 2 else "assistant", f"Text {i % 700}.", 0, "x", "y", 1) for i in range(1500)]
    assert found(spark, rows) == by_hand(rows)


def test_long_text_and_repeated_rows(spark):
    row = (1, 0, "user", "Long text. " * 100_000, 0, "x", "y", 1)
    rows = [row] * 5 + [(1, 1, "assistant", "é" * 100_000, 0, "x", "y", 1)]
    assert found(spark, rows) == by_hand(rows)


def test_repaired_turns(spark):
    rows = random_rows(random.Random(2), range(60), 12)
    convs = {}
    for r in turns.repaired_turns(spark.createDataFrame(rows, ROWS)).collect():
        convs.setdefault(r.conv, []).append((r.place, r.role, r.text))
    for conv, verdict in by_hand(rows).items():
        own = [(r, t) for _, r, t in sorted(convs.get(conv, []))]
        assert LEGAL.match("".join(r[0] for r, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == verdict[-1]


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROWS)
    assert turns.repaired(empty).columns == ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert turns.repaired(empty).count() == 0 and turns.repaired_turns(empty).count() == 0


def test_planted_damage(spark):
    from vitaframe.llm.queries import damaged

    rows = [(c, t, "assistant", "One. Two!", 0, "x", "y", 1) for c in range(200) for t in range(3)] + [(None, None, None, None, 0, "x", "y", 1)]
    want = []
    for conv, turn, role, text, *_ in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        line = (conv, turn, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)
        want += [] if f == 0 else [line] * (2 if f == 3 else 1)
    got = damaged(spark.createDataFrame(rows, ROWS)).select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
