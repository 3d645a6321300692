from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitaframe.operators import catalog as C


def test_numbering_of_a_hot_group(spark):
    """One group with nearly all rows, spread over many chunks, is numbered without gaps."""
    rows = spark.range(3000).selectExpr(
        "id", "IF(id % 10 = 0, concat('k', id), 'hot') AS k", "timestamp_seconds(id * 5000) AS ts"
    )
    got = C.numbered(rows, ["k"], "ts", "id").where("k = 'hot'").orderBy("ts").collect()
    assert [r.version for r in got] == list(range(1, 2701))


def test_numbering_handles_null_keys_and_ties(spark):
    rows = spark.createDataFrame([(3, None, "2024-01-01"), (1, None, "2024-01-01"), (2, None, "2023-01-01")], "id int, k string, d string")
    got = C.numbered(rows.withColumn("ts", F.to_timestamp("d")), ["k"], "ts", "id").orderBy("version").collect()
    assert [r.id for r in got] == [2, 1, 3]


def test_insert_if_absent(spark):
    old = spark.createDataFrame([(1, "a")], "id int, email string")
    new = spark.createDataFrame([(9, "b"), (8, "b"), (7, "a")], "id int, email string")
    assert sorted(map(tuple, C.insert_if_absent(old, new).collect())) == [(1, "a"), (8, "b")]


def test_erasure_cascades(spark):
    users = spark.createDataFrame([("u1",), ("u2",)], "id string")
    resumes = spark.createDataFrame([("r1", "u1"), ("r2", "u2")], "id string, user_id string")
    artifacts = spark.createDataFrame([("a1", "u1", "r1"), ("a2", "u2", "r1"), ("a3", "u2", "r2")], "id string, user_id string, resume_id string")
    left = C.erase_users(spark.createDataFrame([("u1",)], "id string"), users, resumes, artifacts)
    assert [r.id for r in left["users"].collect()] == ["u2"]
    assert [r.id for r in left["resumes"].collect()] == ["r2"]
    assert sorted(map(tuple, left["artifacts"].collect())) == [("a2", "u2", None), ("a3", "u2", "r2")]
    only = C.erase_resumes(spark.createDataFrame([("r2",)], "id string"), resumes, artifacts)
    assert {r.id: r.resume_id for r in only["artifacts"].collect()} == {"a1": "r1", "a2": "r1", "a3": None}


def test_file_path_falls_back_to_the_artifact_id(spark):
    artifacts = spark.createDataFrame(
        [("a1", "r1", "/old", "2024-01-01"), ("a2", "r1", "/new", "2024-02-01"), ("a3", None, "/own", "2024-01-01")],
        "id string, resume_id string, file_path string, created_at string",
    )
    ids = spark.createDataFrame([("r1",), ("a3",), ("zz",)], "resume_id string")
    got = {r.resume_id: r.file_path for r in C.resume_file_paths(ids, artifacts).collect()}
    assert got == {"r1": "/new", "a3": "/own", "zz": None}


def test_retention_by_age_and_size(spark):
    a = spark.createDataFrame([(1, 10, "2024-01-01"), (2, 10, "2023-01-01"), (3, 99, "2024-01-01")], "id int, file_size int, d string")
    a = a.withColumn("created_at", F.to_timestamp("d"))
    kept = C.retained(a, F.to_timestamp(F.lit("2024-02-01")), max_age_days=90, max_bytes=50)
    assert [r.id for r in kept.collect()] == [1]


def test_one_group_at_one_time_is_spread(spark):
    rows = spark.range(20_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("u")).alias("user"), F.lit("t").alias("title"), F.lit("2024-01-01").cast("timestamp").alias("ts")
    )
    got = C.numbered(rows, ["user", "title"], "ts", "id")
    want = rows.withColumn("version", F.row_number().over(Window.partitionBy("user", "title").orderBy("ts", "id")).cast("long"))
    assert got.exceptAll(want).isEmpty() and got.count() == 20_000


def test_artifacts_without_a_resume_are_not_shuffled(spark):
    """Null links go through no join: their rows stay in the partitions they come in."""
    artifacts = spark.range(0, 8000, 1, 8).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 1000 < 2, F.concat(F.lit("r"), F.col("id") % 1000)).alias("resume_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.unlink_resumes(spark.createDataFrame([("r0",)], "id string"), artifacts).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(out) == 8000 and sorted(r.resume_id for r in out if r.resume_id) == ["r1"] * 8
    sizes = Counter(r.part for r in out)
    assert max(sizes.values()) < 2000
