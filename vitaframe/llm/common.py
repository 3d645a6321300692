"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``.

    Only where the session names none (a laptop, the tests) a temporary folder is set instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="vitaframe-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{spark.sparkContext.applicationId}-{os.urandom(6).hex()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a cut in the lineage that outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows in one struct ``_row`` beside working columns, so that no name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in keys.items()])


def unpacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` as a written table with ``_rank``, the place from 0 in ``order``.

    A range shuffle sorts; places are those inside the sorted partitions plus the rows of the
    partitions before, so no task sees more than its share however the keys are spread.
    """
    ordered = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row per sorted partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    return ordered.withColumn("_part", part).join(offsets, "_part").withColumn("_rank", F.col("_before") + place).drop("_part", "_before", "_at")
