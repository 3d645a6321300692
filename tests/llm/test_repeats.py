"""Suffix orders against plain sorting, and repeated passages against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vitaframe.llm import repeats
from vitaframe.llm.suffixes import suffix_orders

DOCS = "doc_id long, text string, _row string, text_key long, n_bytes int, ranges string, `a.b` int"
L = repeats.LENGTH


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_orders(letters):
    rng = random.Random(letters)
    for _ in range(60):
        strings = [[rng.randint(1, letters) for _ in range(rng.choice([0, 1, 2, 5, 40, 90]))] for _ in range(rng.randint(1, 20))]
        strings.sort(key=len, reverse=True)
        symbols = np.array([x for s in strings for x in [*s, 0]])
        ends = np.cumsum([len(s) + 1 for s in strings])
        starts = ends - [len(s) + 1 for s in strings]
        order = suffix_orders(symbols, starts, ends)
        for s, a, b in zip(strings, starts, ends, strict=True):
            full = [*s, 0]
            assert (order[a:b] - a).tolist() == sorted(range(len(full)), key=lambda i: full[i:])  # noqa: B023


def by_hand(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + L] for b in raw for i in range(len(b) - L + 1))
    out, kept = [], []
    for b in raw:
        gone = bytearray(len(b))
        reach = 0
        for i in range(len(b) - L + 1):
            if seen[b[i : i + L]] > 1:
                gone[max(i, reach) : i + L] = b"\1" * (i + L - max(i, reach))
                reach = i + L
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
        kept.append(rest.decode("utf-8", "replace"))
    return out, kept


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, "r", 1, 2, "g", 3) for i, t in enumerate(texts)], DOCS).repartition(3)
    rows = repeats.without_repeats(docs)
    got = {r._row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.collect()}
    return [got[i] for i in range(len(texts))]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeïn") for _ in range(rng.randint(1, 8))) for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(1)
    shared = [prose(rng, n) for n in (30, 40, 45, 60, 200)]
    texts = [None, "", "short", "x" * (L - 1), "y" * L]
    for _ in range(120):
        parts = [prose(rng, rng.randint(1, 80)) for _ in range(3)]
        if rng.random() < 0.6:
            s = rng.choice(shared)
            cut = rng.randint(0, len(s) // 3)
            parts.insert(rng.randint(0, 3), s[cut : len(s) - rng.randint(0, len(s) // 3)])
        texts.append("\n".join(parts))
    texts += [texts[7], texts[7], texts[9][:-3], "z" + texts[9]]
    assert found(spark, texts) == by_hand(texts)[0]


def test_same_text_short_periods_and_borders(spark):
    rng = random.Random(2)
    passage = prose(rng, 60)
    exact = prose(rng, 300)[:L]
    texts = [
        "ab" * 700, "a" * 199, "a" * 200, "b" * 201, "c" * 5000, "abc" * 400 + "x", passage + "|" + passage,
        exact, "q" + exact + "r", exact[:-1] + "!", prose(rng, 100) + exact[1:],
    ]
    assert found(spark, texts) == by_hand(texts)[0]


def test_many_different_surroundings_of_one_passage(spark):
    """One core with far more contexts than a suffix order holds: all borders differ."""
    rng = random.Random(3)
    passage, line = prose(rng, 70)[:260], prose(rng, 40)[:150]
    texts = [prose(rng, 30) + passage + prose(rng, 30) for _ in range(150)] + [prose(rng, 30) + line + prose(rng, 30) for _ in range(150)]
    texts += [passage[k : k + 215] + prose(rng, 20) for k in range(40)]
    assert found(spark, texts) == by_hand(texts)[0]


def test_long_texts_cross_pieces(spark, monkeypatch):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefgh ") for _ in range(repeats.PIECE + 3000))
    middle = body[repeats.PIECE - 400 : repeats.PIECE + 500]
    texts = [body, "start " + middle + " end", body[:300], "k" * (repeats.PIECE + 70_000)]
    got = found(spark, texts)
    want = []
    for t, spans in zip(texts, [[(0, 300), (repeats.PIECE - 400, repeats.PIECE + 500)], [(6, 906)], [(0, 300)], [(0, len(texts[3]))]], strict=True):
        raw = t.encode()
        rest = b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(raw)], strict=True))
        want.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest()))
    assert got[0][:3] == want[0][:3] and got == want


def test_kept_texts_and_empty_table(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = [None, "", "Ünï", prose(rng, 20) + passage + prose(rng, 20), passage + prose(rng, 50)]
    docs = spark.createDataFrame([(i, t, "r", 1, 2, "g", 3) for i, t in enumerate(texts)], DOCS)
    kept = repeats.kept_texts(docs)
    assert kept.columns == docs.columns
    want = by_hand(texts)[1]
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got == {i: (None if texts[i] is None else want[i]) for i in range(len(texts))}
    assert repeats.without_repeats(docs.limit(0)).count() == 0 and repeats.kept_texts(docs.limit(0)).count() == 0


def test_repeated_rows(spark):
    rng = random.Random(6)
    text = prose(rng, 80)
    docs = spark.createDataFrame([(1, text, "r", 1, 2, "g", 3)] * 30 + [(None, prose(rng, 80), "r", 1, 2, "g", 3)], DOCS)
    rows = repeats.without_repeats(docs).collect()
    assert len(rows) == 31
    assert all(r.n_removed == (r.n_bytes if r._row.doc_id == 1 else 0) for r in rows)
