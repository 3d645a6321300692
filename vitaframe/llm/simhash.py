"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact Hamming check, components.

A fingerprint belongs to a text, so it is worked out row by row where the text lies; only
``(id, fingerprint)`` is written and shuffled. Equal fingerprints are one node from then on, so a
group of copies costs one node however large it is.

Pairs at ``distance`` 2 or less: the 64 bits are cut into four blocks of 16. Two differing bits
touch at most two blocks, so such a pair agrees in at least two whole blocks: the nodes are joined
on each of the six choices of two blocks (32 bits), and a pair is kept only if its Hamming
distance is right. A block pair that many fingerprints share (near-copies of one text) is not
expanded into pairs. There each fingerprint is cut again, by two of the four 8-bit pieces of the
rest, and where even those 48 bits are shared by many, by clearing each pair of the last 16 bits:
two fingerprints at distance 2 or less agree after clearing the bits they differ in, and at most
four fingerprints fall together, so rows grow with the group and not with its square. All three
ways find exactly the pairs within the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import packed, unpacked, written
from vitaframe.llm.components import components

SEED = 42
DISTANCE = 2
#: Groups of more fingerprints than this are cut again rather than paired. The links are the same either way.
PAIRED = 32

_WEIGHTS = (1 << np.arange(64, dtype=np.uint64)).astype(np.uint64)
#: Bits of every byte value: row v has bit b of v in column b.
_BYTE_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.int64)


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle; of the whole sequence where the words are too few, nothing without words."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    n = len(words)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)][:n], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)),
        dtype=np.uint64,
        count=n - shingle + 1,
    )


def _majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in over half the hashes: a histogram of each of the 8 byte columns, times the bits of its values."""
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return _WEIGHTS[2 * ones > len(hashes)].sum(dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text (UTF-8), as an unsigned number; 0 for a text without words."""
    hashes = _shingle_hashes(text, shingle)
    return int(_majority(hashes)) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)``: one row per document; ``fp`` holds the 64 bits as a signed long. Null text counts as empty."""
    schema = docs.select(F.col(id_col).alias("id")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(task, schema.add("fp", "long"))


def _bits(value: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))


def _pick(value: Column, pieces: list[int], width: int, tag: int) -> Column:
    """The named pieces (by their lowest bit) side by side, below the number of the choice."""
    out = F.lit(tag).cast("long")
    for start in pieces:
        out = F.shiftleft(out, width).bitwiseOR(_bits(value, start, width))
    return out


def _crowds(keyed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of small groups and rows of large ones; rows alone under their key are left out."""
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sized = keyed.join(sizes, keys)
    return sized.where(F.col("_n") <= PAIRED).drop("_n"), sized.where(F.col("_n") > PAIRED).drop("_n")


def _close(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a group within the distance."""
    right = keyed.select(*keys, F.col("fp").alias("b"))
    pairs = keyed.withColumnRenamed("fp", "a").join(right, keys).where(F.col("a") < F.col("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: all pairs of the distinct fingerprints ``fp`` at Hamming distance 1 or 2."""
    choices = list(combinations(range(4), 2))
    fp = F.col("fp")
    outer = nodes.select(
        "fp", F.explode(F.array(*[_pick(fp, [16 * i for i in two], 16, t) for t, two in enumerate(choices)])).alias("k1")
    )
    small, crowded = _crowds(outer, ["k1"])
    # within a crowd: the 32 bits that the choice has left open, in pieces of 8
    arms = []
    for t, two in enumerate(choices):
        rest = [16 * i + 8 * half for i in range(4) if i not in two for half in (0, 1)]
        keys = F.array(*[_pick(fp, list(pieces), 8, u) for u, pieces in enumerate(combinations(rest, 2))])
        arms.append(F.when(F.shiftrightunsigned(F.col("k1"), 32) == t, keys))
    inner = crowded.select("fp", "k1", F.explode(F.coalesce(*arms)).alias("k2"))
    small2, crowded2 = _crowds(inner, ["k1", "k2"])
    # within a crowd that shares 48 bits: clear two of the last 16
    free = []
    for two in choices:
        rest = [16 * i + 8 * half for i in range(4) if i not in two for half in (0, 1)]
        free += [[start + bit for start in rest if start not in pieces for bit in range(8)] for pieces in combinations(rest, 2)]
    table = "array(" + ",".join(f"array({','.join(map(str, bits))})" for bits in free) + ")"
    cleared = "array(" + ",".join(f"named_struct('i', {i}, 'j', {j})" for i, j in combinations(range(16), 2)) + ")"
    hubs = crowded2.select(
        "fp", F.expr(f"{table}[shiftright(k1, 32) * 6 + shiftright(k2, 16)]").alias("bits"), F.explode(F.expr(cleared)).alias("c")
    )
    hubs = hubs.select("fp", F.expr("~(shiftleft(1L, bits[c.i]) | shiftleft(1L, bits[c.j]))").alias("mask")).distinct()
    hubs = hubs.select("fp", "mask", fp.bitwiseAND(F.col("mask")).alias("left"))
    pairs = _close(small, ["k1"]).unionByName(_close(small2, ["k1", "k2"])).unionByName(_close(hubs, ["mask", "left"]))
    return pairs.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp, component)``: one row per document; ``component`` is the smallest id reachable over links.

    Documents with equal fingerprints are linked, texts without words (fingerprint 0) included.
    Rows with a null id take part in links but never name a component (null where no other row does). Null text counts
    as empty, a text of any length is read whole, repeated rows link with each other; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-nodes")
    roots = components(close_fingerprints(nodes.select("fp")))
    rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = rooted.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    named = rooted.join(firsts, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the document with the smallest id.

    Rows with a null id always stay, and rows that share an id stay or go together.
    """
    found = simhash_components(docs, id_col, text_col, shingle)
    gone = found.where("id IS NOT NULL").groupBy("id").agg(F.bool_or(F.col("id") == F.col("component")).alias("_first"))
    gone = gone.where(~F.col("_first")).select(F.col("id").alias("_gone"))
    return unpacked(packed(docs, _id=F.col(f"`{id_col}`")).join(gone, F.col("_id") == F.col("_gone"), "left_anti"), docs.columns)
