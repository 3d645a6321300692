"""Near-duplicate embeddings by lattice hashing.

Random projections take a vector to two points of eight dimensions per table, each decoded to the
nearest point of the E8 lattice; both lattice points together are a cell. Besides its own cell a
vector is put in the two neighbouring cells that it lies nearest to (one per point). Vectors that
meet in a cell of any of the tables are candidates, and their cosine is worked out in double precision.

- Vectors that are equal component by component are one node.
- In ordinary cells candidates are joined, and a sketch of 64 signs is compared before any vector
  is shipped. In crowded cells vectors come in blocks; every pair of blocks is compared by one
  task, which returns a spanning forest of the links it finds and not the links.
- Links counted per vector are counted within its component, again by joins in small components and
  by pairs of blocks in large ones, so a count covers links of that component that no table showed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.functions.text import let
from vitaframe.llm.common import written
from vitaframe.llm.components import components

LEAST = 0.95
TABLES = 20
#: Width of the projections in units of the lattice: the larger, the more pairs share a cell.
WIDTH = 2.0
#: Sign sketches of vectors at cosine 0.95 differ in 6.5 of 64 places on average; more than this is beyond five deviations.
SKETCH = 19
#: Cells and components of more nodes are compared by blocks of ``BLOCK`` nodes rather than by a join.
CROWD = 32
BLOCK = 1024
SEED = 7


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        off = (x - near)[odd]
        worst = np.abs(off).argmax(axis=1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of both cosets, whole and half coordinates."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    better = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(better[:, None], whole, half)


class Lattice:
    """The projections for vectors of one length; the same on every machine."""

    def __init__(self, length: int, tables: int = TABLES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng([seed, length])
        self.projections = rng.normal(size=(tables, 2, length, 8)) / width
        self.signs = rng.normal(size=(length, 64))
        self.mixers = rng.integers(0, 1 << 63, size=(tables, 2, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(0, 1 << 63, size=tables, dtype=np.uint64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """``(rows, tables * 3)`` numbers of cells: home, and the nearest neighbour of either point."""
        out = []
        for table, (first, second) in enumerate(self.projections):
            marks = []
            for part, matrix in enumerate((first, second)):
                x = unit @ matrix
                home = nearest_e8(x)
                beside = nearest_e8(2 * x - home)  # on from the home point through x
                for point in (home, beside):
                    coordinates = (2 * point).astype(np.int64).astype(np.uint64)
                    marks.append((coordinates * self.mixers[table, part]).sum(axis=1, dtype=np.uint64))
            salt = self.salts[table]
            out += [marks[0] + marks[2] + salt, marks[1] + marks[2] + salt, marks[0] + marks[3] + salt]
        return np.stack(out, axis=1).view(np.int64)

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        bits = (unit @ self.signs > 0).astype(np.uint64)
        return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def unit_vector(vector: Column) -> Column:
    """Vector of length one in double precision; null if it is null, empty, zero or not finite throughout."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    largest = F.array_max(F.transform(doubles, F.abs))
    # bound once each, or they would be worked out again for every component
    scaled = let(largest, lambda m: F.transform(doubles, lambda x: x / m))  # squares neither overflow nor vanish
    unit = let(scaled, lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)), lambda n: F.transform(v, lambda x: x / n)))
    return F.when(finite & F.exists(vector, lambda x: x != 0), unit)


def _cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


def _cells(nodes: DataFrame) -> DataFrame:
    """``node, size, cell, sketch``: every node with each of its cells."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                unit = flat[starts[rows][:, None] + np.arange(length)]
                lattice = made.setdefault(int(length), Lattice(int(length)))
                cells = lattice.cells(unit)
                columns = [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.full(len(rows), length, dtype=np.int32)),
                    pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * cells.shape[1], cells.ravel()),
                    pa.array(lattice.sketches(unit)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "cells", "sketch"])

    found = nodes.select("node", "unit").mapInArrow(task, "node long, size int, cells array<long>, sketch long")
    return found.select("node", "size", F.explode(F.array_distinct("cells")).alias("cell"), "sketch")


def _in_blocks(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Rows of each pair of blocks ``(keys, lo, hi)``; ``mine`` says whether a row is of the first block."""
    blocks = F.ceil(F.col(count) / BLOCK).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return paired.select(
        *keys, "node", "unit", "weight", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("mine")
    )


def _similar(frame: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first and second block of a group, and which of their pairs are linked."""
    unit = np.stack(frame["unit"].to_numpy())
    one = frame["lo"].iloc[0] == frame["hi"].iloc[0]
    mine = frame["mine"].to_numpy()
    a = np.arange(len(frame)) if one else np.flatnonzero(mine)
    b = a if one else np.flatnonzero(~mine)
    linked = unit[a] @ unit[b].T >= least
    if one:
        np.fill_diagonal(linked, False)
    return a, b, linked


def _forest(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """A spanning forest of the links of one pair of blocks: every node but a root with one edge."""
    a, b, linked = _similar(frame, least)
    if a is not b:  # both blocks as one square
        square = np.zeros((len(frame), len(frame)), dtype=bool)
        square[np.ix_(a, b)] = linked
        linked = square | square.T
    nodes = frame["node"].to_numpy()
    seen = ~linked.any(axis=1)
    edges: list[pd.DataFrame] = []
    for start in range(len(nodes)):
        if seen[start]:
            continue
        seen[start] = True
        front = np.array([start])
        while len(front):  # breadth first: each node is tied to one of the front before
            new = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[new] = True
            edges.append(pd.DataFrame({"a": nodes[front[linked[np.ix_(front, new)].argmax(axis=0)]], "b": nodes[new]}))
            front = new
    return pd.concat(edges) if edges else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def _counts(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of each node in one pair of blocks, copies counted."""
    a, b, linked = _similar(frame, least)
    nodes, weight = frame["node"].to_numpy(), frame["weight"].to_numpy()
    out = [pd.DataFrame({"node": nodes[a], "links": linked @ weight[b]})]
    if a is not b:
        out.append(pd.DataFrame({"node": nodes[b], "links": linked.T @ weight[a]}))
    return pd.concat(out)


def _edges(nodes: DataFrame, least: float) -> DataFrame:
    """Links that join all found components: ``a, b``."""
    cells = written(_cells(nodes), "lattice-cells")
    crowds = cells.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = cells.join(crowds, ["size", "cell"])
    small = sized.where(F.col("n") <= CROWD)
    left = small.select("size", "cell", F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = small.select("size", "cell", F.col("node").alias("b"), F.col("sketch").alias("sb"))
    pairs = left.join(right, ["size", "cell"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= SKETCH))
    pairs = pairs.select("a", "b").distinct()
    units = nodes.select("node", "unit")
    met = pairs.join(units.withColumnsRenamed({"node": "a", "unit": "ua"}), "a").join(units.withColumnsRenamed({"node": "b", "unit": "ub"}), "b")
    direct = met.where(_cosine(F.col("ua"), F.col("ub")) >= least).select("a", "b")
    crowded = sized.where(F.col("n") > CROWD).join(nodes.select("node", "unit", "weight"), "node")
    blocks = _in_blocks(crowded, ["size", "cell"], "n")
    forests = blocks.groupBy("size", "cell", "lo", "hi").applyInPandas(lambda frame: _forest(frame, least), "a long, b long")
    return direct.unionByName(forests)


def _links(members: DataFrame, least: float) -> DataFrame:
    """``node, links``: links to other nodes of the same component (``node, unit, weight, root, n``)."""
    small = members.where(F.col("n") <= CROWD)
    other = small.select("root", F.col("node").alias("b"), F.col("unit").alias("ub"), F.col("weight").alias("wb"))
    pairs = small.join(other, "root").where((F.col("node") != F.col("b")) & (F.size("unit") == F.size("ub")))
    joined = pairs.where(_cosine(F.col("unit"), F.col("ub")) >= least).groupBy("node").agg(F.sum("wb").alias("links"))
    blocks = _in_blocks(members.where(F.col("n") > CROWD), ["root"], "n")
    counted = blocks.groupBy("root", "lo", "hi").applyInPandas(lambda frame: _counts(frame, least), "node long, links long")
    return joined.unionByName(counted).groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(df: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n_links, component, kept`` per row of ``df``.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are
    components of their own. Vectors of different lengths never link. Rows that repeat a vector (also
    with one id) are linked with each other. A null id names no component unless it stands alone. A cosine of
    exactly ``least`` links. Other columns have no effect; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    classes = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    classes = classes.withColumn("unit", unit_vector(F.col("v"))).where(F.col("unit").isNotNull())
    nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")
    roots = written(components(_edges(nodes, least)), "lattice-roots")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = nodes.select("node", "unit", "weight").join(roots.join(sizes, "root"), "node")
    links = _links(members, least)
    named = nodes.select("node", "v", "first_id", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("root").agg(F.min("first_id").alias("component"))
    judged = named.join(firsts, "root").join(links, "node", "left")
    judged = judged.select("v", "component", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(judged, "v", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
