"""Passages of ``LENGTH`` bytes that start at two places of a corpus, found by suffix order, and their removal.

A window is ``LENGTH`` bytes of one text. Its core is the one of its ``CORE``-byte pieces with the least hash
(the leftmost of equals), so equal windows have equal cores at the same place. Neighbouring windows mostly share a core;
they make one context: the bytes that these windows cover. Whatever repeats, repeats among contexts of equal cores.

1. Cores are counted; a bitmap of fixed size marks those that occur twice. Only marked contexts go on, by hash, and
   equal ones are one row with a count, so copies, however many, meet as one.
2. The contexts of a core are concatenated and put in suffix order (``suffixes``: linear grouping). Windows of one
   content are neighbours there; they repeat if their contexts' counts make two or more. Neighbours are
   compared byte by byte.
3. A core with more than ``MOST`` different contexts is cut: windows are dealt by their offset from the core into
   blocks of ``BLOCKS`` offsets, and the bytes common to a block's windows are its new, longer core. A block of
   one offset has the window itself as its core and so only one context, hence any core ends in bounded groups.
4. Repeated windows go back to their texts as byte ranges; each different text is cut once.

Texts cross the network only to have contexts cut out and to be cut themselves, each different one once
a stage and only where a bitmap says that it may be concerned. With more repeated cores or texts than a bitmap has
room for, it holds back less; results stay the same. Texts are told apart by 64-bit hashes, contexts by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import packed, written
from vitaframe.llm.suffixes import suffix_orders

LENGTH = 200
CORE = 50
#: Different contexts of a core that one suffix order may hold, and how many offsets a block has where they are more.
MOST = 32
BLOCKS = (32, 8, 1)
#: Bytes that are looked at together.
PIECE = 1 << 17
BATCH = 1 << 20
#: Words of 64 marks each in a bitmap.
WORDS = 1 << 20

_SEED = 20
_CONTEXT = "core long, context long, weight long, first int, n int, bytes binary"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers of the bytes, powers of an odd base and of its inverse, modulo 2^64."""
    rng = np.random.default_rng(_SEED)
    symbols = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) // 8 * 8 + 5

    def powers(of: int) -> np.ndarray:
        out = np.ones(2 * PIECE, np.uint64)
        done, factor = 1, np.array([of], np.uint64)
        while done < len(out):
            np.multiply(out[: len(out) - done][:done], factor, out=out[done : 2 * done])
            done, factor = 2 * done, np.square(factor)
        return out

    return symbols, powers(base), powers(pow(base, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which any piece's hash can be taken."""
    symbols, powers, _ = _tables()
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(symbols[raw] * powers[: len(raw)], out=out[1:])
    return out


def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * _tables()[2][starts]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def contexts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Core and context hashes, text number, place of the first window, offset of the core from it, number of windows, repeats.

    ``raw`` holds texts one after the other. A context that follows itself (text of a short period) is one row.
    """
    nothing = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), nothing, nothing, nothing, nothing, nothing
    sums = _sums(raw)
    at = np.arange(len(raw) - CORE + 1)
    cores = _mixed((sums[CORE:] - sums[:-CORE]) * _tables()[2][at])
    low = np.uint64(2 * PIECE - 1)
    owner = (_least((cores & ~low) | at.astype(np.uint64), LENGTH - CORE + 1) & low).astype(np.int64)
    first = np.ones(len(owner), bool)
    np.not_equal(owner[1:], owner[:-1], out=first[1:])
    begins, ends = offsets[:-1], offsets[1:]
    for border in (begins, np.maximum(ends - LENGTH + 1, begins)):
        first[border[border < len(owner)]] = True
    start = np.flatnonzero(first)
    n = np.diff(np.append(start, len(owner)))
    text = np.searchsorted(offsets, start, side="right") - 1
    inside = start + LENGTH <= ends[text]
    start, n, text = start[inside], n[inside], text[inside]
    core = owner[start]
    key = cores[core]
    spread = ((core - start) << 8 | n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    context = _mixed(_hash(sums, start, start + n - 1 + LENGTH) + spread)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (context[1:] != context[:-1]) | (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(fresh)
    times = np.diff(np.append(heads, len(start)))
    return key[heads], context[heads], text[heads], (start - begins[text])[heads], (core - start)[heads], n[heads], times


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, borders and row numbers of some texts in a row, at most ``PIECE`` bytes; of long texts parts that share ``LENGTH - 1`` bytes."""
    texts = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        if end == row + 1:
            for start in range(offsets[row], max(offsets[row] + 1, offsets[end] - LENGTH + 1), PIECE):
                stop = min(start + PIECE + LENGTH - 1, offsets[end])
                yield raw[start:stop], np.array([0, stop - start]), np.array([row]), start - offsets[row]
        else:
            yield raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], np.arange(row, end), 0
        row = end


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their mark in a bitmap."""
    keys = keys.view(np.uint64)
    return bits[(keys >> np.uint64(6)) & np.uint64(WORDS - 1)] >> (keys & np.uint64(63)) & np.uint64(1) > 0


def _marks(keys: DataFrame, key: str):
    """A broadcast bitmap of 64 * ``WORDS`` marks, 8 MB however many keys there are."""
    word = F.shiftrightunsigned(F.col(key), 6).bitwiseAND(F.lit(WORDS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(WORDS, np.uint64)
    bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())


def _cores(texts: DataFrame) -> DataFrame:
    """The core of every context of every text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, borders, _, _ in _pieces(batch, 1):
                core, _, _, _, _, _, times = contexts(raw, borders)
                yield pa.RecordBatch.from_arrays([_long(core), _long(times)], names=["core", "times"])

    return texts.mapInArrow(task, "core long, times long")


def _occurrences(texts: DataFrame, marks) -> DataFrame:
    """``core, context, text_key, place``: contexts whose core is marked; ``place`` holds first window, offset, windows, repeats."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for raw, borders, rows, before in _pieces(batch, 1):
                core, context, text, first, offset, n, times = contexts(raw, borders)
                kept = _marked(marks.value, core)
                core, context, text, first, offset, n, times = (x[kept] for x in (core, context, text, first, offset, n, times))
                place = (first + before) << 32 | offset << 24 | n << 16 | np.minimum(times, (1 << 16) - 1)
                yield pa.RecordBatch.from_arrays(
                    [_long(core), _long(context), _long(keys[rows[text]]), _long(place)], names=["core", "context", "text_key", "place"]
                )
                more = np.flatnonzero(times >= 1 << 16)
                for i in more:  # a long stretch of one short period
                    for done in range((1 << 16) - 1, int(times[i]), (1 << 16) - 1):
                        at = first[i] + before + done * n[i]
                        one = int(at) << 32 | int(offset[i]) << 24 | int(n[i]) << 16 | min(int(times[i]) - done, (1 << 16) - 1)
                        values = [core[i : i + 1], context[i : i + 1], keys[rows[text[i : i + 1]]], np.array([one])]
                        yield pa.RecordBatch.from_arrays([_long(v) for v in values], names=["core", "context", "text_key", "place"])

    return texts.mapInArrow(task, "core long, context long, text_key long, place long")


def _part(place: str, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(place), shift).bitwiseAND(F.lit((1 << bits) - 1))


def _distinct_texts(texts: DataFrame, marks) -> DataFrame:
    """``text_key, text`` of the texts that may be concerned, each once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(marks.value, batch.column(0).to_numpy())))

    return texts.mapInArrow(task, texts.schema).groupBy("text_key").agg(F.first("text").alias("text"))


def _cut_out(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of ``wanted`` contexts (``core, context, weight, text_key, place``)."""
    lists = wanted.groupBy("text_key").agg(F.collect_list(F.struct("core", "context", "weight", "place")).alias("wanted"))
    met = _distinct_texts(texts, _marks(wanted, "text_key")).join(lists, "text_key").select("text", "wanted")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(0)[row].as_buffer()
                wanted = batch.column(1)[row].values
                place = wanted.field("place").to_numpy()
                start, offset, n = place >> 32, place >> 24 & 255, place >> 16 & 255
                cut = [raw[a:b] for a, b in zip(start.tolist(), (start + n - 1 + LENGTH).tolist(), strict=True)]
                columns = [wanted.field(c) for c in ("core", "context", "weight")]
                columns += [pa.array(-offset, pa.int32()), pa.array(n, pa.int32()), pa.array([b.to_pybytes() for b in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["core", "context", "weight", "first", "n", "bytes"])

    return met.mapInArrow(task, _CONTEXT)


def repeated_windows(groups: list[list[tuple[int, int, bytes]]]) -> list[list[np.ndarray]]:
    """For each context ``(weight, windows, bytes)`` of each group which of its windows repeat in the group, by suffix order."""
    by_size = sorted(range(len(groups)), key=lambda g: -sum(len(b) + 1 for _, _, b in groups[g]))
    # each context ends with a 1, each group with a 0; bytes follow from 2 on
    parts, lengths, weights, windows = [], [], [], []
    for g in by_size:
        for weight, n, body in groups[g]:
            parts.append(body + b"\0")
            lengths.append(len(body) + 1)
            weights.append(weight)
            windows.append(n)
        parts.append(b"\0")
    own = np.array([sum(len(b) + 1 for _, _, b in groups[g]) + 1 for g in by_size])
    ends = np.cumsum(own)
    raw = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    symbols = raw[: ends[-1]].astype(np.int32) + 2
    counts = np.array([len(groups[g]) for g in by_size])
    after = np.repeat(np.arange(len(by_size)), counts)  # group ends before a context
    context_ends = np.cumsum(lengths) + after
    starts = context_ends - np.array(lengths)
    symbols[context_ends - 1] = 1
    symbols[ends - 1] = 0
    order = suffix_orders(symbols, ends - own, ends)
    context = np.full(len(symbols), -1, np.int32)  # of the windows' places
    for_windows = np.repeat(np.arange(len(starts)), windows)
    n = np.array(windows)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    context[at] = for_windows
    order = order[context[order] >= 0]
    group = after[context[order]]
    same = np.flatnonzero(group[1:] == group[:-1])
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        same = same[words[order[same] + k] == words[order[same + 1] + k]]
    fresh = np.ones(len(order), bool)
    fresh[same + 1] = False
    heads = np.flatnonzero(fresh)
    total = np.add.reduceat(np.array(weights)[context[order]], heads) if len(heads) else np.empty(0, np.int64)
    repeats = np.zeros(len(symbols), bool)
    repeats[order] = np.repeat(total > 1, np.diff(np.append(heads, len(order))))
    found: list[list[np.ndarray]] = [[] for _ in groups]
    c = 0
    for g in by_size:
        for _, k, _ in groups[g]:
            found[g].append(repeats[starts[c] : starts[c] + k])
            c += 1
    return found


def _in_suffix_order(rows: DataFrame) -> DataFrame:
    """``core, context, low, high``: runs of repeated windows, by offset from the core, of contexts grouped by core."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0

        def solved(rows: list[tuple]) -> pa.RecordBatch:
            groups: dict[int, list[tuple]] = {}
            for row in rows:
                groups.setdefault(row[0], []).append(row)
            found = repeated_windows([[(w, n, b) for _, _, w, _, n, b in group] for group in groups.values()])
            out = []
            for group, marks in zip(groups.values(), found, strict=True):
                for (core, context, _, first, _, _), own in zip(group, marks, strict=True):
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
                    out += [(core, context, first + a, first + b) for a, b in edges.reshape(-1, 2).tolist()]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["core", "context", "low", "high"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > BATCH and row[0] != waiting[-1][0]:
                    yield solved(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[-1])
        if waiting:
            yield solved(waiting)

    return rows.repartition("core").sortWithinPartitions("core").mapInArrow(task, "core long, context long, low int, high int")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Contexts cut into blocks of offsets from the core, with the hash of the bytes that a block's windows share as their core."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for core, context, weight, first, n, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = np.frombuffer(body, np.uint8)
                sums = _sums(raw)
                for k in range(first // block, (first + n - 1) // block + 1):
                    low, high = max(first, k * block), min(first + n, (k + 1) * block)
                    shared = np.array([(k + 1) * block - 1 - first]), np.array([k * block + LENGTH - first])
                    own = np.array([low - first]), np.array([high - 1 + LENGTH - first])
                    salt = np.uint64(((k & 1023) << 16 | block) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                    seed = np.array([core], np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                    new_core = _mixed(_hash(sums, *shared) + seed + salt).view(np.int64)[0]
                    shape = np.uint64(((low & 1023) << 16 | (high - low)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                    new_context = _mixed(_hash(sums, *own) + shape).view(np.int64)[0]
                    out.append((core, context, int(new_core), int(new_context), weight, low, high - low, body[own[0][0] : own[1][0]]))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["old_core", "old_context", "core", "context", "weight", "first", "n", "bytes"],
            )

    return rows.mapInArrow(task, "old_core long, old_context long, " + _CONTEXT)


def _crowds(rows: DataFrame) -> DataFrame:
    """Rows whose core occurs twice, with ``crowd``, the number of its different contexts."""
    totals = rows.groupBy("core").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("crowd"))
    # written, so that the rows of one core are free to be split among tasks when they meet its total
    totals = written(totals.where("total > 1").drop("total"), "repeat-cores")
    return rows.join(totals, "core")


def _repeats(rows: DataFrame, crowded: Callable[[], DataFrame], blocks: tuple[int, ...]) -> DataFrame:
    """Repeated windows of contexts in groups of at most ``MOST`` and, through smaller blocks, of ``crowded`` ones."""
    found = _in_suffix_order(rows)
    if not blocks:
        return found
    pieces = written(_dealt(crowded(), blocks[0]), "repeat-pieces")
    if pieces.isEmpty():
        return found
    merged = pieces.groupBy("core", "context").agg(
        F.sum("weight").alias("weight"), F.first("first").alias("first"), F.first("n").alias("n"), F.first("bytes").alias("bytes")
    )
    merged = written(_crowds(merged), "repeat-blocks")
    names = [part.split()[0] for part in _CONTEXT.split(", ")]
    few = merged.where(F.col("crowd") <= MOST).select(*names)
    below = _repeats(few, lambda: merged.where(F.col("crowd") > MOST).select(*names), blocks[1:])
    links = pieces.select("old_core", "old_context", "core", "context")
    back = links.join(below, ["core", "context"]).select(F.col("old_core").alias("core"), F.col("old_context").alias("context"), "low", "high")
    return found.unionByName(back)


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """``text_key, ranges``: the byte ranges (first << 32 | end) that repeated windows cover, of ``text_key, text``."""
    cores = _cores(texts).groupBy("core").agg(F.sum("times").alias("times")).where("times > 1").select("core")
    places = written(_occurrences(texts, _marks(cores, "core")), "repeat-places")
    # equal contexts are one, with a count and one of its places
    groups = places.groupBy("core", "context").agg(F.sum(_part("place", 0, 16)).alias("weight"), F.min(F.struct("text_key", "place")).alias("at"))
    wanted = written(_crowds(groups.select("core", "context", "weight", "at.text_key", "at.place")), "repeat-contexts")
    few, many = wanted.where(F.col("crowd") <= MOST), wanted.where(F.col("crowd") > MOST)
    found = written(_repeats(_cut_out(texts, few), lambda: _cut_out(texts, many), BLOCKS), "repeat-windows")
    met = places.join(found, ["core", "context"])
    start, offset, n, times = _part("place", 32, 32), _part("place", 24, 8), _part("place", 16, 8), _part("place", 0, 16)
    low = F.when(times > 1, start).otherwise(start + offset + F.col("low"))
    high = F.when(times > 1, start + times * n).otherwise(start + offset + F.col("high"))
    ranges = F.shiftleft(low, 32).bitwiseOR(high + (LENGTH - 1))
    return met.groupBy("text_key").agg(F.collect_set(ranges).alias("ranges"))


def _union(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the maximal ranges that the given ones cover."""
    ranges = np.sort(ranges)
    low, high = ranges >> 32, np.maximum.accumulate(ranges & 0xFFFFFFFF)
    fresh = np.append(True, low[1:] > high[:-1])
    heads = np.flatnonzero(fresh)
    return low[heads], high[np.append(heads[1:], len(ranges)) - 1]


def _cut(texts: DataFrame, schema: str, rest: Callable[[bytes, np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """``text_key`` and what ``rest`` makes of each different text with repeats and its maximal ranges."""
    ranges = written(repeated_ranges(texts), "repeat-ranges")
    met = _distinct_texts(texts, _marks(ranges, "text_key")).join(ranges, "text_key").select("text_key", "text", "ranges")
    width = schema.count(",") + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                low, high = _union(batch.column(2)[row].values.to_numpy())
                out = rest(batch.column(1)[row].as_buffer().to_pybytes(), low, high)
                arrays = [batch.column(0).slice(row, 1), *[pa.array([v]) for v in out]]
                yield pa.RecordBatch.from_arrays(arrays, names=["text_key", *[part.split()[0] for part in schema.split(", ")]][: width + 1])

    return met.mapInArrow(task, "text_key long, " + schema)


def _keyed(docs: DataFrame, text_col: str) -> tuple[Column, DataFrame]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    long_enough = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).where(F.octet_length("text") >= LENGTH)
    return text, long_enough


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_row`` (the whole row of ``docs``), ``n_bytes, n_removed, n_spans, kept_sha256``, one row per row.

    A byte goes if a window of ``LENGTH`` bytes covers it that starts anywhere else too, in the same text or another;
    windows are judged on the texts as they came and do not cross texts. Null counts as an empty text; texts
    shorter than ``LENGTH`` lose nothing; repeated rows and equal long texts lose everything, all of them alike.
    An empty table stays empty.
    """
    text, texts = _keyed(docs, text_col)

    def rest(raw: bytes, low: np.ndarray, high: np.ndarray) -> tuple:
        digest = hashlib.sha256()
        for a, b in zip(np.append(0, high).tolist(), np.append(low, len(raw)).tolist(), strict=True):
            digest.update(raw[a:b])
        return int((high - low).sum()), len(low), digest.hexdigest()

    cut = written(_cut(texts, "n_removed long, n_spans long, kept_sha256 string", rest), "repeat-cut")
    rows = packed(docs, text_key=F.xxhash64(text), n_bytes=F.octet_length(text).cast("long"), whole=F.sha2(text, 256))
    met = rows.join(cut, "text_key", "left")
    zero = F.lit(0).cast("long")
    return met.select(
        "_row", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )


def kept_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text. What is left of a character that was cut apart becomes U+FFFD."""
    text, texts = _keyed(docs, text_col)

    def rest(raw: bytes, low: np.ndarray, high: np.ndarray) -> tuple:
        kept = b"".join(raw[a:b] for a, b in zip(np.append(0, high).tolist(), np.append(low, len(raw)).tolist(), strict=True))
        return (kept.decode("utf-8", "replace"),)

    cut = written(_cut(texts, "kept string", rest), "repeat-kept").withColumn("found", F.lit(True))
    met = packed(docs, text_key=F.xxhash64(text)).join(cut, "text_key", "left")
    own = F.when(F.col("found"), F.col("kept")).otherwise(F.col("_row").getField(text_col))
    return met.select(*[own.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
