"""Exact duplicates: Spark's aggregation finds them; an extendible-hash index of its result is kept on shared files.

1. Every row gets the 64-bit key of its normalised text (A-Z in lower case, null as empty). The
   keys are written, and a directory is built from their counts: it doubles until no bucket holds
   more than ``capacity`` distinct keys, and only overfull buckets split.
2. Rows meet by key and by the bytes of the text: Spark's hash aggregation keeps the whole text in
   its grouping key, so texts that collide on a key are chained as entries of their own and only
   texts equal byte by byte are merged. Copies are merged in every map task first, so a text that a
   third of all rows hold is shipped once per task and not once per row.
3. Entries ``(bucket, key, text digest, row that stays, size of the group)`` are written in order of
   the bucket, each owner task holding a range of buckets; rows look their entry up by key and digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm import extendible
from vitaframe.llm.common import ascii_lower, packed, unpacked, written

CAPACITY = 50_000


def _unsigned60(key: Column) -> Column:
    """The leading 60 bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - extendible.BITS)


def _entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One entry per distinct text: ``key``, ``sha``, ``keep_id``, ``group_size``, ``keepers`` (rows that bear keep_id)."""
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("text"))
    keyed = norm.withColumn("key", F.xxhash64("text"))
    merged = keyed.groupBy("key", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return merged.select("key", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The index as a written table: entries with ``bucket`` (bits) and ``chain`` (place among the texts of one key)."""
    entries = written(_entries(docs, id_col, text_col), "exact-entries")
    keys = entries.select("key").distinct().select("key", _unsigned60(F.col("key")).alias("h"), F.lit(1).cast("long").alias("weight"))
    owners = extendible.assign(written(keys, "exact-keys"), capacity)
    owners = owners.select("key", extendible.bucket_name(F.col("depth"), F.col("number")).alias("bucket"))
    chain = F.row_number().over(Window.partitionBy("key").orderBy("sha"))  # texts that share a 64-bit key
    owned = entries.join(owners, "key").withColumn("chain", chain)
    return written(owned.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain"), "exact-index")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, text_sha256, bucket``.

    Of equal texts the row with the largest id stays. A null text equals an empty one. A row with a
    null id stays only where no row of its group has an id; rows that repeat both id and text share
    one verdict. An empty table gives an empty result.
    """
    index = build_index(docs, id_col, text_col, capacity)
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("text"))
    rows = norm.select("id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("sha"))
    return rows.join(index, ["key", "sha"]).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket"
    )


def one_of_each_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay; rows that repeat the id and text of one that stays are left out too."""
    verdicts = written(exact_duplicates(docs, id_col, text_col, capacity), "exact-verdicts")
    gone = verdicts.where("NOT kept").select(F.col("id").alias("_i"), F.col("text_sha256").alias("_s")).distinct()
    again = verdicts.where("kept").groupBy("id", "text_sha256").count().where("count > 1")
    again = again.select(F.col("id").alias("_i"), F.col("text_sha256").alias("_s"))
    key = {"_id": F.col(f"`{id_col}`"), "_sha": F.sha2(ascii_lower(F.col(f"`{text_col}`")), 256)}
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sha") == F.col("_s"))
    keyed = packed(docs, **key)
    rest = keyed.join(gone, same, "left_anti")
    if again.isEmpty():
        return unpacked(rest, docs.columns)
    single = rest.join(again, same, "left_anti")
    repeated = rest.join(again, same, "left_semi").dropDuplicates(["_id", "_sha"])
    return unpacked(single.unionByName(repeated), docs.columns)
