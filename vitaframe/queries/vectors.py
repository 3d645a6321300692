"""Queries over embeddings: nearest vectors of every label's mean and of every 50th row, exact and by inverted lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaframe.operators import vectors as E
from vitaframe.queries.base import register
from vitaframe.sources.tables import table

_K = 5
_LISTS, _FIRST, _PROBED = 16, 4, 8
_MEANS = (
    "dims AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), "
    "m AS (SELECT label, list(a ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS a FROM dims GROUP BY 1, 2) GROUP BY 1)"
)


def _queries(spark, folder):
    """One query per label: the mean of all its vectors."""
    means = E.mean_vectors(table(spark, folder, "embeddings"), "label", "embedding")
    return means.select(F.col("label").cast("long").alias("query_id"), "embedding")


@register(
    f"WITH {_MEANS}, s AS (SELECT m.label, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS similarity FROM m CROSS JOIN embeddings), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM s) "
    f"SELECT CAST(label AS BIGINT) AS query_id, vec_id, similarity, rank FROM r WHERE rank <= {_K}"
)
def nearest_to_label_means(spark, folder):
    """Exact nearest vectors of each label's mean over the whole table."""
    return E.nearest(table(spark, folder, "embeddings"), _queries(spark, folder), _K)


def _rows_asked(spark, folder):
    """One query per row whose id is divisible by 50."""
    return table(spark, folder, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_NEAREST_SQL = (
    "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity "
    "FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) "
    f"SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= {_K}"
)


@register(_NEAREST_SQL)
def nearest_to_rows(spark, folder):
    """Exact nearest vectors of every 50th row over the whole table."""
    return E.nearest(table(spark, folder, "embeddings"), _rows_asked(spark, folder), _K)


@register(_NEAREST_SQL)
def nearest_by_inverted_lists(spark, folder):
    """The same through inverted lists: the nearest first, then all that can hold a nearer vector."""
    vectors = table(spark, folder, "embeddings")
    return E.InvertedLists.build(vectors, lists=_LISTS).search(_rows_asked(spark, folder), _K, nprobe=_FIRST)


@register(
    "WITH q AS (SELECT 'vector ' || vec_id AS query_id, embedding[1:CASE WHEN vec_id % 100 = 0 THEN 32 ELSE 64 END]::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), "
    "v AS (SELECT 'vector ' || vec_id AS vec_id, embedding[1:CASE WHEN vec_id % 4 = 0 THEN 32 ELSE 64 END]::DOUBLE[] AS e FROM embeddings), "
    "s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM q JOIN v ON len(q.e) = len(v.e)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) "
    f"SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= {_K}"
)
def nearest_of_two_lengths(spark, folder):
    """String ids, and vectors and questions of two lengths in one table and one index."""
    vectors = table(spark, folder, "embeddings")
    cut = lambda every: F.slice("embedding", F.lit(1), F.when(F.col("vec_id") % every == 0, 32).otherwise(64))
    name = F.concat(F.lit("vector "), F.col("vec_id").cast("string"))
    mixed = vectors.select(name.alias("vec_id"), cut(4).alias("embedding"))
    questions = vectors.where("vec_id % 50 = 0").select(name.alias("query_id"), cut(100).alias("embedding"))
    return E.InvertedLists.build(mixed, lists=_LISTS).search(questions, _K, nprobe=_FIRST)


@register()
def lists_opened(spark, folder):
    """How many lists the exact search opens for each question; the centroids come from KMeans, which SQL has not."""
    index = E.InvertedLists.build(table(spark, folder, "embeddings"), lists=_LISTS)
    return index.effort(_rows_asked(spark, folder), _K, nprobe=_FIRST)


@register()
def recall_of_half_the_lists(spark, folder):
    """Share of the exact neighbours of every 50th row in the nearest half of the lists alone."""
    vectors, queries = table(spark, folder, "embeddings"), _rows_asked(spark, folder)
    found = E.InvertedLists.build(vectors, lists=_LISTS).search(queries, _K, nprobe=_PROBED, exact=False)
    return E.recall(found, E.nearest(vectors, queries, _K))


@register(
    "WITH n AS (SELECT len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
    "e AS (SELECT vec_id, CASE vec_id % 40 WHEN 1 THEN NULL WHEN 2 THEN list_transform(embedding, lambda x: 0.0::FLOAT) WHEN 3 THEN embedding[1:5] "
    "WHEN 4 THEN list_concat(embedding[2:], ['nan'::FLOAT]) WHEN 5 THEN list_concat(embedding[2:], ['inf'::FLOAT]) WHEN 6 THEN list_concat(embedding[2:], [NULL]) "
    "ELSE embedding END AS v FROM embeddings) "
    "SELECT vec_id, CAST(len(v) AS INTEGER) AS length, CASE WHEN v IS NULL THEN 'null' WHEN len(v) <> (SELECT n FROM n) THEN 'length' "
    "WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN 'null component' WHEN len(list_filter(v, lambda x: NOT isfinite(x))) > 0 THEN 'not finite' ELSE 'zero' END AS reason "
    "FROM e WHERE v IS NULL OR len(v) <> (SELECT n FROM n) OR len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(v, lambda x: x <> 0)) = 0"
)
def refused_vectors(spark, folder):
    """Vectors that no search of the most frequent length compares, with one of each kind planted in every 40 rows."""
    rows = table(spark, folder, "embeddings")
    kind, v = F.col("vec_id") % 40, F.col("embedding")
    last = lambda x: F.concat(F.slice(v, F.lit(2), F.size(v) - 1), F.array(x.cast("float")))
    planted = (
        F.when(kind == 1, F.lit(None))
        .when(kind == 2, F.transform(v, lambda x: F.lit(0).cast("float")))
        .when(kind == 3, F.slice(v, 1, 5))
        .when(kind == 4, last(F.lit(float("nan"))))
        .when(kind == 5, last(F.lit(float("inf"))))
        .when(kind == 6, last(F.lit(None)))
        .otherwise(v)
    )
    return E.refused(rows.select("vec_id", planted.alias("embedding")))


@register(
    f"SELECT count(DISTINCT label) * {_K} AS expected, count(DISTINCT label) * {_K} AS found, 1.0::DOUBLE AS recall FROM embeddings"
)
def recall_of_all_lists(spark, folder):
    """Reading every list finds exactly the exact neighbours: no vector is lost in the index."""
    vectors, queries = table(spark, folder, "embeddings"), _queries(spark, folder)
    found = E.InvertedLists.build(vectors, lists=16).search(queries, _K, nprobe=16)
    return E.recall(found, E.nearest(vectors, queries, _K))
