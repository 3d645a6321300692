"""Merkle manifest of a table: trees of degree 8 per part, a tree over their roots, and a check of every row.

A leaf is the SHA-256 of a row's fields; eight consecutive nodes make the node above. Levels are built
bottom-up, each an aggregation of at most eight rows a group, and are kept as node rows that name their
parent and hold the digests of their siblings to the left and to the right. A recursive query of Spark then
climbs from every leaf: it folds the digest that the row has now with the siblings of each level and appends
these to the proof, until it stands at the root. The leaves of one run have all ancestors in common, so they
climb in one row with a digest for each of them; only the first step, inside the run, differs.

Leaves find their places by a range shuffle over (part, order, digest), so a part that holds a third of all
rows is spread like any other. The table's rows cross the network as digests, never as texts. Digests move as
bytes and are hashed as hex text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import numbered, written

DEGREE = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _text(digest: Column) -> Column:
    """Lower-case hex text of one digest or of several in a row."""
    return F.lower(F.hex(digest))


def _of(digests: Column) -> Column:
    """The node above an array of digests."""
    return _hash(F.array_join(F.transform(digests, _text), ""))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


@dataclass
class Manifest:
    """``runs`` (leaves, eight in a row), ``nodes`` (parent links and siblings), ``subroots`` and the root."""

    runs: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str
    root_node: str


def _levels(level: DataFrame, most: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Node rows of a forest whose trees, ``part``, stand on ``(part, node, place, digest, n)``, and the trees' tops."""
    links, tops = [], []
    height = 0
    while True:
        tops.append(level.where("n = 1").select("part", "node", "digest"))
        if most <= 1:
            return links, tops
        height += 1
        groups = level.where("n > 1").groupBy("part", "n", F.floor(F.col("place") / DEGREE).alias("above"))
        kids = groups.agg(F.sort_array(F.collect_list(F.struct("place", "node", "digest"))).alias("kids"))
        grown = kids.select("part", F.ceil(F.col("n") / DEGREE).alias("n"), F.col("above").alias("place"), "kids", _of(F.col("kids.digest")).alias("digest"))
        grown = written(grown.withColumn("node", F.concat_ws("/", F.lit(name), F.col("part"), F.lit(str(height)), F.col("place"))), f"merkle-{name}")
        each = grown.select(F.col("node").alias("parent"), F.col("kids.digest").alias("all"), F.posexplode("kids").alias("i", "kid"))
        links.append(
            each.select(
                F.col("kid.node").alias("node"),
                "parent",
                _joined(F.slice("all", F.lit(1), F.col("i"))).alias("left"),
                _joined(F.slice("all", F.col("i") + 2, F.lit(DEGREE))).alias("right"),
            )
        )
        level = grown.select("part", "node", "place", "digest", "n")
        most = -(-most // DEGREE)


def build(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    part_col: str = "lang",
    order_col: str = "doc_id",
    now: Mapping[str, Column] | None = None,
) -> Manifest | None:
    """The manifest of a table; ``now`` gives values that fields have when they are checked. None if it is empty."""
    as_built = [F.col(f"`{name}`") for name in fields]
    as_found = [(now or {}).get(name, column) for name, column in zip(fields, as_built, strict=True)]
    leaf, claim = (_hash(F.concat(*map(field, columns))) for columns in (as_built, as_found))
    rows = docs.select(F.col(f"`{part_col}`").cast("string").alias("part"), F.col(f"`{order_col}`").alias("id"), leaf.alias("leaf"), claim.alias("claim"))
    placed = numbered(rows, [F.asc_nulls_first("part"), F.asc_nulls_first("id"), F.asc("leaf")], "merkle-leaves")
    parts = placed.groupBy("part").agg(F.min("_rank").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = written(numbered(parts, [F.asc_nulls_first("part")], "merkle-parts").withColumnRenamed("_rank", "p"), "merkle-parts")
    sizes = parts.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")).first()
    if not sizes.parts:
        return None
    other = parts.withColumnRenamed("part", "_part")
    located = placed.join(other, F.col("part").eqNullSafe(F.col("_part"))).withColumn("place", F.col("_rank") - F.col("first"))
    runs = located.groupBy("p", "n", F.floor(F.col("place") / DEGREE).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "leaf", "claim"))).alias("rows")
    )
    leaves = F.col("leaves")
    # inside the run: the leaf as it is now among its siblings as they were
    folded = F.when(F.col("n") == 1, F.col("rows.claim")).otherwise(
        F.transform(
            F.col("rows"),
            lambda row, i: _hash(F.concat(_text(_joined(F.slice(leaves, F.lit(1), i))), _text(row["claim"]), _text(_joined(F.slice(leaves, i + 2, F.lit(DEGREE)))))),
        )
    )
    runs = runs.select("p", "n", "run", "rows", F.col("rows.leaf").alias("leaves")).select(
        F.col("p").alias("part"),
        F.concat_ws("/", F.lit("run"), F.col("p"), F.col("run")).alias("node"),
        F.col("run").alias("place"),
        F.ceil(F.col("n") / DEGREE).alias("n"),
        F.when(F.col("n") == 1, F.col("leaves")[0]).otherwise(_of(leaves)).alias("digest"),
        F.col("rows.id").alias("ids"),
        "leaves",
        folded.alias("folds"),
    )
    runs = written(runs, "merkle-runs")
    links, tops = _levels(runs.select("part", "node", "place", "digest", "n"), -(-sizes.most // DEGREE), "part")
    subroots = written(reduce(DataFrame.unionByName, tops), "merkle-subroots")
    above = subroots.select(F.lit(0).cast("long").alias("part"), "node", F.col("part").alias("place"), "digest", F.lit(sizes.parts).alias("n"))
    more, top = _levels(above, sizes.parts, "top")
    root = reduce(DataFrame.unionByName, top).first()
    no_link = runs.where("false").select("node", F.col("node").alias("parent"), F.col("digest").alias("left"), F.col("digest").alias("right"))
    nodes = written(reduce(DataFrame.unionByName, links + more, no_link), "merkle-nodes")
    return Manifest(runs, nodes, subroots, bytes(root.digest).hex(), root.node)


_CLIMB = """
WITH RECURSIVE climb(run, node, folds, proof) AS (
  SELECT node, node, folds, CAST('' AS BINARY) FROM {runs}
  UNION ALL
  SELECT c.run, n.parent,
         transform(c.folds, h -> unhex(sha2(concat(lower(hex(n.left)), lower(hex(h)), lower(hex(n.right))), 256))),
         concat(c.proof, n.left, n.right)
  FROM climb c JOIN {nodes} n ON c.node = n.node
)
SELECT run, folds, proof FROM climb WHERE node = :root
"""


def climb(manifest: Manifest) -> DataFrame:
    """``run, folds, proof``: for each run what its leaves fold to at the root, and the siblings met above the run."""
    spark = manifest.runs.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # a row per run and level
    return spark.sql(_CLIMB, args={"root": manifest.root_node}, runs=manifest.runs, nodes=manifest.nodes)


def checked(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    part_col: str = "lang",
    order_col: str = "doc_id",
    now: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A row whose fields ``now`` differ from those in the manifest does not fold to the root. Null fields are hashed
    as ``-``; a null part is the first part, a null id comes first in its part, rows that repeat an id
    are ordered by digest (equal rows are equal leaves), a text of any length is one leaf. Columns that
    are no fields have no effect, whatever their names. An empty table gives no rows.
    """
    manifest = build(docs, fields, part_col, order_col, now)
    if manifest is None:
        kind = docs.schema[order_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )
    runs = manifest.runs.select("part", F.col("node").alias("run"), "ids", "leaves")
    subroots = manifest.subroots.select("part", _text(F.col("digest")).alias("subroot"))
    met = runs.join(climb(manifest), "run").join(subroots, "part")
    beside = F.transform(
        F.col("leaves"),
        lambda leaf, i: F.struct(
            leaf.alias("leaf"),
            F.sha2(F.concat(_text(_joined(F.slice("leaves", F.lit(1), i))), _text(_joined(F.slice("leaves", i + 2, F.lit(DEGREE)))), _text(F.col("proof"))), 256).alias("proof"),
        ),
    )
    each = met.select("subroot", F.explode(F.arrays_zip("ids", "folds", beside.alias("beside"))).alias("r"))
    folded = _text(F.col("r.folds"))
    return each.select(
        F.col("r.ids").alias("id"),
        _text(F.col("r.beside.leaf")).alias("leaf"),
        "subroot",
        F.lit(manifest.root).alias("root"),
        F.col("r.beside.proof").alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.lit(manifest.root)).alias("verified"),
    )
