"""Repeated uploads within a time: one rule for tables and streams.

Of the uploads with one checksum the earliest stays (the smallest id at equal times). After an upload that
stays, those up to ``within`` later go; the first one after that stays and starts a new period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaframe.session import shared_dir, written

#: Uploads of one checksum that are looked through inside a row.
CHUNK = 1000


def first_within(uploads: DataFrame, within_us: int, id_col: str = "id") -> DataFrame:
    """``checksum, at, id`` of the uploads that stay; ``uploads`` has these columns, ``at`` in microseconds.

    Most checksums have few uploads and are looked through in a row each. The uploads of a checksum with more than
    ``CHUNK`` are dealt by time into buckets as long as a period. At most one upload of a bucket stays, so one pass over the
    buckets, in the order of time, finds it with a minimum per checksum that is combined before the shuffle.
    Rows without checksum or time stay out.
    """
    rows = uploads.select("checksum", "at", F.col(id_col).alias("id")).where("checksum IS NOT NULL AND at IS NOT NULL")
    # of equal times only the smallest id can stay
    rows = written(rows.groupBy("checksum", "at").agg(F.min("id").alias("id")), "uploads")
    counts = rows.groupBy("checksum").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") > CHUNK).select("checksum")
    few = rows.join(hot, "checksum", "left_anti")
    period = F.lit(within_us)
    item = few.select("at", "id").schema.simpleString()
    start = F.struct(F.array().cast(f"array<{item}>").alias("kept"), F.lit(None).cast("long").alias("last"))
    step = lambda acc, x: F.when(
        acc["last"].isNull() | (x["at"] > acc["last"] + period), F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), x["at"].alias("last"))
    ).otherwise(acc)
    lists = few.groupBy("checksum").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("all"))
    kept = lists.select("checksum", F.explode(F.aggregate("all", start, step, lambda acc: acc["kept"])).alias("x")).select("checksum", "x.at", "x.id")
    if hot.isEmpty():
        return kept
    return kept.unionByName(_sweep(rows.join(hot, "checksum", "left_semi"), within_us))


def _sweep(rows: DataFrame, within_us: int) -> DataFrame:
    spark = rows.sparkSession
    root = shared_dir(spark, "upload-buckets")
    rows.withColumn("bucket", F.floor(F.col("at") / within_us)).write.partitionBy("bucket").parquet(f"{root}/in")
    dealt = spark.read.parquet(f"{root}/in")
    buckets = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())  # as many as periods fit in the table's time
    schema = rows.select("checksum", "at", "id").schema
    kept_of = lambda bucket: f"{root}/kept/of={bucket}"
    for before, bucket in zip([None, *buckets], buckets, strict=False):
        part = dealt.where(F.col("bucket") == bucket).select("checksum", "at", "id")  # reads this bucket's files only
        if before == bucket - 1:  # what stayed earlier is over a period away
            last = spark.read.schema(schema).parquet(kept_of(before)).select("checksum", F.col("at").alias("last"))
            part = part.join(last, "checksum", "left").where(F.col("last").isNull() | (F.col("at") > F.col("last") + within_us))
        first = part.groupBy("checksum").agg(F.min(F.struct("at", "id")).alias("m"))
        first.select("checksum", "m.at", "m.id").write.parquet(kept_of(bucket))
    return spark.read.schema(schema).parquet(*map(kept_of, buckets))
