"""Extendible hashing as DataFrame operations: a directory of hash-prefix slots, split only where overfull.

Hashes are unsigned numbers of ``BITS`` bits in a long. A bucket is a prefix of ``depth`` bits; it is
split on its next bit only while it holds more than the capacity. The directory lists every slot of
``level`` leading bits with the bucket it points to, so finding a row's bucket is one equi-join on
the slot. Buckets that are still overfull at that level get a directory of a deeper level of their
own, so one hot prefix does not double the directory for all others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import written

BITS = 60


def md5_hash(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string, which other engines can work out as well."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def prefix(hash_col: Column, depth: Column | int) -> Column:
    """The leading ``depth`` bits as a number."""
    bits = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", hash_col, (F.lit(BITS) - bits).cast("int"))


def bucket_name(depth: Column, number: Column) -> Column:
    """The prefix as a string of ``depth`` zeros and ones (empty for the whole table)."""
    return F.when(depth == 0, F.lit("")).otherwise(F.call_function("lpad", F.bin(number), depth.cast("int"), F.lit("0")))


def _resolve(weights: DataFrame, low: int, level: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Buckets of depth ``low`` to ``level`` that fit, and the slots of depth ``level`` that are still overfull.

    ``weights`` has a row per distinct hash: ``h``, ``weight``, ``items``. A bucket of one item always
    fits, as nothing is left to split.
    """
    slots = weights.groupBy(prefix(F.col("h"), level).alias("slot")).agg(F.sum("weight").alias("weight"), F.sum("items").alias("items"))
    # one row per slot and depth, summed: at most 2^level slots whatever the number of rows
    depths = slots.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(level))))
    number = F.call_function("shiftright", F.col("slot"), (F.lit(level) - F.col("depth")).cast("int"))
    sums = depths.groupBy("depth", number.alias("number")).agg(F.sum("weight").alias("weight"), F.sum("items").alias("items"))
    fits = (F.col("weight") <= capacity) | (F.col("items") <= 1)
    over = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("number").alias("parent"))
    good = sums.where(fits).withColumn("parent", F.shiftright("number", 1))
    # a bucket exists where it fits and its parent did not (or it is a root)
    roots = good.where(F.col("depth") == low)
    split = good.where(F.col("depth") > low).join(over, ["depth", "parent"], "left_semi")
    return roots.unionByName(split).drop("parent"), sums.where(~fits & (F.col("depth") == level)).select(F.col("number").alias("slot"))


def _slots(buckets: DataFrame, level: int) -> DataFrame:
    """The directory: every slot of ``level`` bits that points to a bucket."""
    spread = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(level) - F.col("depth")).cast("int"))
    first = F.col("number") * spread
    return buckets.withColumn("slot", F.explode(F.sequence(first, first + spread - 1)))


def assign(rows: DataFrame, capacity: int, hash_col: str = "h", weight_col: str = "weight") -> DataFrame:
    """``rows`` plus ``depth``, ``number``, ``bucket_weight``, ``bucket_items``: the bucket of every row.

    ``rows`` should be a written table, as it is read once per level. Every row counts as an item of
    its weight (null: 0). Rows of one hash stay together, whatever they weigh. Only sizes of the
    directory's levels reach the driver.
    """
    weights = rows.groupBy(F.col(hash_col).alias("h")).agg(
        F.coalesce(F.sum(weight_col), F.lit(0)).alias("weight"), F.lit(1).cast("long").alias("items")
    )
    total = rows.agg(F.coalesce(F.sum(weight_col), F.lit(0)).alias("w")).first().w
    # doubled until the mean slot is well below the capacity, so that one level settles nearly all
    level = min(BITS, max(1, math.ceil(math.log2(max(1, total / max(1, capacity)))) + 3))
    low, pending, done = 0, rows, None
    while True:
        buckets, over = _resolve(weights, low, level, capacity)
        buckets = written(buckets.withColumnsRenamed({"weight": "bucket_weight", "items": "bucket_items"}), "buckets")
        over = written(over, "overfull")
        keyed = pending.withColumn("_slot", prefix(F.col(hash_col), level))
        directory = _slots(buckets, level).withColumnRenamed("slot", "_slot")
        found = keyed.join(directory, "_slot").drop("_slot")
        done = found if done is None else done.unionByName(found)
        if level == BITS or over.isEmpty():
            return done
        slot = over.withColumnRenamed("slot", "_slot")
        pending = keyed.join(slot, "_slot", "left_semi").drop("_slot")
        weights = weights.withColumn("_slot", prefix(F.col("h"), level)).join(slot, "_slot", "left_semi").drop("_slot")
        low, level = level + 1, min(BITS, level + 8)
