"""Nearest neighbours by cosine similarity: exact over a whole table, and exact through inverted lists.

Questions and vectors are both tables. They meet in blocks: a group of at most ``ROWS`` vectors and ``QUESTIONS``
questions of one length (and list) is one matrix product, which hands on the best ``k`` per question. How many
blocks a length or list is cut into follows from its counts, so a list with a third of all vectors, or one that
every question opens, is many groups. No pairs are emitted and nothing passes through the driver.

Inverted lists know their radius, the largest angle between their centroid and a vector. A question first opens
the lists with the nearest centroids; its ``k``-th similarity there is a bound, and every other list that can hold
a vector as near (angle to the centroid less the radius) is opened next. What remains closed cannot change the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.functions.text import let
from vitaframe.session import written

#: Vectors and questions of a block.
ROWS = 1 << 14
QUESTIONS = 1 << 11
#: Questions and vectors of which a task holds the similarities at one time.
STEP = 128
TILE = 1 << 10
# Similarities are compared at this many decimals, so equal vectors tie on every engine.
DECIMALS = 6
#: What rounding may add to a similarity.
_SLACK = 2 * 10.0**-DECIMALS


def finite(vector: Column) -> Column:
    """True where no component is null, NaN or infinite; false for null."""
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, good), F.lit(False))


def unit(vector: Column) -> Column:
    """Vector of length one; null for null and zero vectors and where a component is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    largest = F.array_max(F.transform(doubles, F.abs))  # scaled first, so that no square overflows
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # each value is bound once: a lambda would work it out again for every component
    scaled = let(doubles, lambda v: let(largest, lambda m: F.when(m > 0, F.transform(v, lambda x: x / m))))
    return F.when(finite(vector), let(scaled, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n))))


def mean_vectors(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label: one aggregate with a fixed-size state per label."""
    grouped = df.where(F.col(vector).isNotNull()).groupBy(label).agg(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m")
    )
    return grouped.select(label, vector_to_array("m").alias(vector))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ready(df: DataFrame, id_col: str, vector: str, name: str) -> DataFrame:
    """``name, length, unit`` of the vectors that can be compared."""
    rows = df.select(F.col(id_col).alias(name), unit(F.col(vector)).alias("unit"))
    return rows.where(F.col("unit").isNotNull()).select(name, F.size("unit").alias("length"), "unit")


def _asked(queries: DataFrame, id_col: str, vector: str) -> DataFrame:
    """The questions with a number of their own, so that a repeated id is answered for each row."""
    ready = _ready(queries, id_col, vector, "query_id").withColumn("question", F.monotonically_increasing_id())
    return written(ready, "questions")


def _best(questions: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and places of each question's best ``k``, the first of equals first; never more than a tile of the product."""
    at = np.zeros((len(questions), 0), np.int64)
    sims = np.zeros((len(questions), 0))
    for start in range(0, len(vectors), TILE):
        new = questions @ vectors[start : start + TILE].T
        np.round(new, DECIMALS, out=new)
        new += 0.0
        places = np.broadcast_to(np.arange(start, start + new.shape[1]), new.shape)
        sims, at = np.concatenate([sims, new], axis=1), np.concatenate([at, places], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # vectors are in the order of ids
        sims, at = np.take_along_axis(sims, order, 1), np.take_along_axis(at, order, 1)
    return sims, at


def _blocks(asked: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best ``k`` of each block for each of its questions: ``question, id, similarity``.

    Both sides have ``keys`` and ``unit``. A block is a part of the vectors and a part of the questions of one key.
    """
    sizes = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("q")).join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    shape = written(
        sizes.select(*keys, F.ceil(F.col("n") / ROWS).cast("int").alias("pieces"), F.ceil(F.col("q") / QUESTIONS).cast("int").alias("parts")), "blocks"
    )
    spread = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(shape, keys).withColumn("part", spread("parts")).select(*keys, each("pieces").alias("piece"), "part", "question", "unit")
    right = rows.join(shape, keys).withColumn("piece", spread("pieces")).select(*keys, "piece", each("parts").alias("part"), "id", "unit")
    id_type = rows.schema["id"].dataType.simpleString()

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.column("id"), null_placement="at_end"))
        vectors = _matrix(rows.column("unit"))
        found = [_best(_matrix(asked.column("unit").slice(i, STEP)), vectors, k) for i in range(0, len(asked), STEP)]
        sims, at = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table(
            {
                "question": asked.column("question").take(pa.array(np.repeat(np.arange(len(asked)), at.shape[1]))),
                "id": rows.column("id").take(pa.array(at.ravel())),
                "similarity": pa.array(sims.ravel()),
            }
        )

    keyed = [*keys, "piece", "part"]
    return left.groupBy(*keyed).cogroup(right.groupBy(*keyed)).applyInArrow(
        lambda a, b: best(a, b) if len(a) and len(b) else _nothing(a, b), f"question bigint, id {id_type}, similarity double"
    )


def _nothing(asked: pa.Table, rows: pa.Table) -> pa.Table:
    return pa.table({"question": asked.column("question").slice(0, 0), "id": rows.column("id").slice(0, 0), "similarity": pa.array([], pa.float64())})


def _top(partial: DataFrame, k: int) -> DataFrame:
    """Final ranking: at most k rows per question and block come here, and each task drops what is beyond its own k."""
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("similarity"), F.asc_nulls_last("id")))
    return partial.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _answers(asked: DataFrame, ranked: DataFrame) -> DataFrame:
    names = asked.select("question", "query_id")
    return ranked.join(names, "question").select("query_id", F.col("id").alias("vec_id"), "similarity", "rank")


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector: str = "embedding",
    query_id: str = "query_id",
) -> DataFrame:
    """Exact ``k`` nearest vectors of every query: ``(query_id, vec_id, similarity, rank)``.

    Ids may be of any type; of equal similarities the smallest id comes first, null last. A question meets the vectors of its own
    length. Vectors that ``refused`` lists are not found, and as questions have no answer. Questions that repeat an id are
    answered one by one, vectors that repeat an id are different vectors.
    """
    asked = _asked(queries, query_id, vector)
    return _answers(asked, _top(_blocks(asked, _ready(df, id_col, vector, "id"), ["length"], k), k))


class InvertedLists:
    """Vectors assigned to the nearest of ``lists`` centroids, with each list's radius."""

    def __init__(self, assigned: DataFrame, centroids: dict[int, np.ndarray], radii: dict[int, np.ndarray], vector: str):
        self.assigned, self.centroids, self.radii, self.vector = assigned, centroids, radii, vector

    @classmethod
    def build(
        cls,
        df: DataFrame,
        lists: int = 100,
        id_col: str = "vec_id",
        vector: str = "embedding",
        seed: int = 42,
        train_rows_per_list: int = 1000,
    ) -> InvertedLists:
        """Fit centroids for each length and assign every vector to one list.

        The centroids are fitted on a sample of about ``lists * train_rows_per_list`` vectors a length, chosen by hash; they only
        guide the search. All vectors are assigned, measured and searchable.
        """
        ready = _ready(df, id_col, vector, "id")
        counts = {r.length: r.n for r in ready.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
        centroids = {}
        for length, n in sorted(counts.items()):
            share = min(1.0, lists * train_rows_per_list / n)
            chosen = F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) < share * (1 << 20)
            train = ready.where((F.col("length") == length) & chosen).select(array_to_vector("unit").alias("_u"))
            train = written(train, "list-sample")
            fitted = KMeans(k=lists, seed=seed, featuresCol="_u", maxIter=10).fit(train).clusterCenters() if not train.isEmpty() else [np.ones(length)]
            found = np.array([c for c in map(np.asarray, fitted) if np.linalg.norm(c) > 0] or [np.ones(length)])
            centroids[length] = found / np.linalg.norm(found, axis=1, keepdims=True)
        shipped = df.sparkSession.sparkContext.broadcast(centroids)  # lists * length doubles a length

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for length in np.unique(batch.column(1).to_numpy()).tolist():
                    part = batch.filter(pc.equal(batch.column(1), length))
                    sims = _matrix(part.column(2)) @ shipped.value[length].T
                    nearest_list = sims.argmax(axis=1)
                    angle = np.arccos(np.clip(sims.max(axis=1), -1, 1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest_list, pa.int32()), pa.array(angle)], names=[*batch.schema.names, "list_id", "angle"])

        id_type = ready.schema["id"].dataType.simpleString()
        schema = f"id {id_type}, length int, unit array<double>, list_id int, angle double"
        assigned = written(ready.mapInArrow(assign, schema), "lists")
        radii = {length: np.full(len(c), -1.0) for length, c in centroids.items()}  # below 0: an empty list
        for r in assigned.groupBy("length", "list_id").agg(F.max("angle").alias("radius")).collect():  # a row per list
            radii[r.length][r.list_id] = r.radius
        return cls(assigned, centroids, radii, vector)

    def write(self, path: str) -> None:
        """Store by list, so that a search prunes the folders of lists it does not open.

        Rows are spread over files by list and hash: a hot list becomes many files.
        """
        salt = F.pmod(F.xxhash64("id"), F.lit(16))
        self.assigned.repartition("list_id", salt).write.mode("overwrite").partitionBy("list_id").parquet(path)

    def _bounds(self, asked: DataFrame) -> DataFrame:
        """``question, length, unit, lists``: the lists of the question's length that are not empty, nearest centroid first, with
        the greatest similarity that one of their vectors can have."""
        shipped = asked.sparkSession.sparkContext.broadcast((self.centroids, self.radii))  # lists * length doubles a length
        kind = pa.list_(pa.struct([("list_id", pa.int32()), ("most", pa.float64())]))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, radii = shipped.value
            for batch in batches:
                for length in np.unique(batch.column("length").to_numpy()).tolist():
                    part = batch.filter(pc.equal(batch.column("length"), length))
                    if length not in centroids:
                        continue
                    used = np.flatnonzero(radii[length] >= 0)
                    angles = np.arccos(np.clip(_matrix(part.column("unit")) @ centroids[length][used].T, -1, 1))
                    most = np.cos(np.maximum(angles - radii[length][used], 0.0))
                    order = np.argsort(angles, axis=1, kind="stable")
                    lists = [[{"list_id": int(used[j]), "most": float(most[i, j])} for j in row] for i, row in enumerate(order)]
                    yield pa.RecordBatch.from_arrays([part.column("question"), part.column("length"), part.column("unit"), pa.array(lists, kind)], names=["question", "length", "unit", "lists"])

        schema = "question bigint, length int, unit array<double>, lists array<struct<list_id:int,most:double>>"
        return asked.mapInArrow(task, schema)

    def _search(self, queries: DataFrame, k: int, nprobe: int, query_id: str, index: DataFrame | None, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Questions, ranked answers, and the lists opened for each question."""
        stored = (self.assigned if index is None else index).select("id", "length", "list_id", "unit")
        asked = _asked(queries, query_id, self.vector)
        bounds = written(self._bounds(asked), "list-bounds")
        opened = lambda lists: bounds.select("question", "length", "unit", F.explode(lists).alias("l")).select("question", "length", "unit", "l.list_id")
        keys = ["length", "list_id"]
        near = opened(F.slice("lists", 1, nprobe))
        found = written(_top(_blocks(near, stored, keys, k), k), "list-answers")
        effort = near.select("question")
        if exact:
            least = found.where(F.col("rank") == k).select("question", F.col("similarity").alias("least"))
            bounds = bounds.join(least, "question", "left")
            rest = F.slice("lists", F.lit(nprobe + 1), F.greatest(F.size("lists") - nprobe, F.lit(0)))
            far = F.filter(rest, lambda x: F.col("least").isNull() | (x["most"] >= F.col("least") - F.lit(_SLACK)))
            more = opened(far)
            effort = effort.unionByName(more.select("question"))
            both = found.drop("rank").unionByName(_blocks(more, stored, keys, k))
            found = _top(both, k)
        return asked, found, effort

    def search(
        self, queries: DataFrame, k: int = 10, nprobe: int = 10, query_id: str = "query_id", index: DataFrame | None = None, exact: bool = True
    ) -> DataFrame:
        """The ``k`` nearest vectors of every question, as ``nearest`` gives them.

        ``nprobe`` lists are opened first; then, unless ``exact`` is false, all others that their bound does not rule out.
        """
        asked, found, _ = self._search(queries, k, nprobe, query_id, index, exact)
        return _answers(asked, found)

    def effort(self, queries: DataFrame, k: int = 10, nprobe: int = 10, query_id: str = "query_id") -> DataFrame:
        """``query_id, opened, lists``: how many of the lists the exact search opens."""
        asked, _, effort = self._search(queries, k, nprobe, query_id, None, True)
        counts = effort.groupBy("question").agg(F.count(F.lit(1)).alias("opened"))
        lists = {length: int((r >= 0).sum()) for length, r in self.radii.items()}
        total = F.element_at(F.create_map(*[F.lit(x) for pair in lists.items() for x in pair]), F.col("length"))
        return asked.join(counts, "question").select("query_id", "opened", total.cast("long").alias("lists"))


def refused(df: DataFrame, dim: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, length, reason`` of vectors that no search compares, and of those of another length than ``dim``
    (by default the most frequent), which only questions of their own length meet."""
    length = F.when(F.col(vector).isNotNull(), F.size(vector))
    if dim is None:
        most = df.where(F.col(vector).isNotNull()).groupBy(length.alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = most.n if most else 0
    reason = (
        F.when(F.col(vector).isNull(), "null")
        .when(length != dim, "length")
        .when(F.exists(vector, lambda x: x.isNull()), "null component")
        .when(~finite(F.col(vector)), "not finite")
        .when(unit(F.col(vector)).isNull(), "zero")
    )
    return df.select(F.col(id_col), length.alias("length"), reason.alias("reason")).where("reason IS NOT NULL")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found, over all queries."""
    hits = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.count("*").alias("expected"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
