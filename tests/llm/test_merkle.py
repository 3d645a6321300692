"""The manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vitaframe.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, leaves string, node string, `a.b` int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf_of(row):
    fields = (row[0], row[3], row[2], row[4], row[1])
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def grow(level):
    """Levels of one tree, from its leaves to its top."""
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def path(levels, at):
    """Siblings left and right of a leaf, level by level."""
    out = []
    for level in levels[:-1]:
        start = at // 8 * 8
        out.append((level[start:at], level[at + 1 : start + 8]))
        at //= 8
    return out


def by_hand(rows):
    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append(row)
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = grow([leaf_of(r) for r in parts[name]])
    top = grow([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(parts[name]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None
            digest = leaf_of((row[0], lower(row[1]) if hit else row[1], *row[2:]))
            steps = path(trees[name], i) + path(top, k)
            for left, right in steps:
                digest = sha(*left, digest, *right)
            proof = sha(*[x for left, right in steps for x in left + right])
            out.append((row[0], leaf_of(row), trees[name][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def checked(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    text = F.col("text")
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)
    return sorted([tuple(r) for r in merkle.checked(docs, now={"text": now}).collect()], key=repr)


def rows_of(sizes, rng):
    rows, n = [], 0
    for lang, count in sizes.items():
        for _ in range(count):
            text = rng.choice([None, "", "Ünï Co", "abc", "Long " * 5000, "X"])
            rows.append((n, text, lang, rng.choice([None, "s", "é"]), rng.choice([None, 3]), "p", "l", "n", 1))
            n += 1
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {None: 8, "de": 9}, {None: 1, "": 2, "de": 64, "en": 65, "é": 7, "z": 130, **{f"l{i}": 1 for i in range(8)}}])
def test_every_row_as_by_hand(spark, sizes):
    rows = rows_of(sizes, random.Random(3))
    assert checked(spark, rows) == by_hand(rows)


def test_null_and_repeated_ids_and_rows(spark):
    rows = rows_of({"en": 20}, random.Random(4))
    rows += [rows[3]] * 10 + [(None, "Some Text", "en", "s", 1, "p", "l", "n", 1)] * 3 + [(5, "Other", "en", "s", 1, "p", "l", "n", 1)]
    assert checked(spark, rows) == by_hand(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    found = merkle.checked(empty)
    assert found.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.count() == 0


def test_any_changed_field_is_seen(spark):
    rows = rows_of({"en": 30, "de": 3}, random.Random(5))
    docs = spark.createDataFrame(rows, DOCS)
    now = {"n_chars": F.when(F.col("doc_id") == 7, F.lit(99)).otherwise(F.col("n_chars"))}
    assert [r.id for r in merkle.checked(docs, now=now).collect() if not r.verified] == [7]
