"""Shards of bounded bytes by extendible hashing. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.llm import extendible
from vitaframe.llm.common import packed, written


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, shard, depth, shard_bytes, shard_docs`` per row of ``docs``.

    ``shard`` is the prefix of the id's hash, as zeros and ones; only shards of more than ``limit``
    bytes of text are split on their next bit. A text larger than the limit has a shard of its own.
    Rows that repeat an id (null ids too) are hashed by their place in the table as well, so they
    spread like others. Null text has 0 bytes. Only ids, sizes and hashes are shuffled. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("id"), _bytes_of(F.col(text_col)).alias("weight"))
    sized = written(sized.withColumn("place", F.monotonically_increasing_id()), "shard-sizes")
    return _assigned(sized, limit).select(
        "id",
        F.col("weight").alias("n_bytes"),
        extendible.bucket_name(F.col("depth"), F.col("number")).alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        F.col("bucket_weight").alias("shard_bytes"),
        F.col("bucket_items").alias("shard_docs"),
    )


def _bytes_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _assigned(sized: DataFrame, limit: int) -> DataFrame:
    """The bucket of every ``id, weight, place``, a written table."""
    repeated = sized.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again"), F.lit(True).alias("salted"))
    marked = sized.join(repeated, F.col("id").eqNullSafe(F.col("again")), "left")
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    key = F.when(F.col("salted"), F.concat(name, F.lit("#"), F.col("place").cast("string"))).otherwise(name)
    hashed = written(marked.select("id", "place", "weight", extendible.md5_hash(key).alias("h")), "shard-hashes")
    return extendible.assign(hashed, limit)


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows, a folder per shard, each row of ``docs`` once. Rows meet their shard by their place in the table."""
    keyed = packed(docs, id=F.col(f"`{id_col}`"), weight=_bytes_of(F.col(f"`{text_col}`")))
    rows = written(keyed.withColumn("place", F.monotonically_increasing_id()), "shard-rows")
    found = _assigned(rows.select("id", "weight", "place"), limit)
    found = found.select("place", extendible.bucket_name(F.col("depth"), F.col("number")).alias("_shard"))
    placed = rows.join(found, "place").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], "_shard")
    placed.repartition("_shard").write.mode("overwrite").partitionBy("_shard").parquet(path)
