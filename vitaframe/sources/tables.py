"""Read test and catalog tables; spread scans over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.plans.profile import PROFILE_DDL, to_profile_json

MANIFEST_DDL = (
    "fixtures array<struct<id:string,filename:string,category:string,format:string,difficulty:string,"
    "file_size_kb:int,description:string,expected_sections:map<string,boolean>,extraction_notes:string,"
    "test_tags:array<string>,parsing_expectations:struct<success_rate:int,sections_detected:int,"
    "skills_extracted:int,experience_entries:int,warnings_expected:array<string>,error_expected:string,"
    "error_message:string>>>"
)
# Input that gives each core less than this is spread before text work.
_BYTES_PER_CORE = 16 * 1024 * 1024
# What a task gets of an input that is spread before expensive work.
_BYTES_PER_TASK = 8 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _size_of(df: DataFrame) -> int:
    """The optimizer's estimate in bytes, so nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame) -> DataFrame:
    """Repartition an input too small to occupy every core; leave a large one where it lies.

    At scale the scan has far more splits than cores and no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _size_of(df) < cores * _BYTES_PER_CORE else df


def spread(df: DataFrame, *keys: str, task_bytes: int = _BYTES_PER_TASK) -> DataFrame:
    """Spread an input over tasks of bounded size, before work that costs far more than a shuffle of its rows.

    Left as its files are cut, a task would work through a whole split or row group, however long each row takes. A small
    input occupies every core. With ``keys`` the rows of a key come together, and grouping by them shuffles no more.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-_size_of(df) // task_bytes)), *keys)


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """One row per fixture of a JSON manifest (one document over many lines)."""
    raw = spark.read.schema(MANIFEST_DDL).option("multiLine", True).json(path)
    return raw.select(F.explode("fixtures").alias("f")).select("f.*")


def manifests(df: DataFrame, json: str) -> DataFrame:
    """The rows of ``df`` with one fixture each, from manifests held as text: ``fixture`` and ``read_error``.

    A text that is no JSON (or null) or has no list of fixtures is one row without a fixture and with the reason.
    """
    parsed = F.from_json(F.col(json), f"struct<{MANIFEST_DDL},_bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    staged = df.withColumn("_m", parsed)
    broken = F.col("_m._bad").isNotNull() | F.col("_m").isNull()
    error = F.when(broken, F.lit("Invalid JSON")).when(F.col("_m.fixtures").isNull(), F.lit("No fixtures"))
    staged = staged.withColumn("read_error", error).withColumn("fixture", F.explode_outer(F.when(error.isNull(), F.col("_m.fixtures"))))
    return staged.select(*df.columns, "fixture", "read_error")


def profiles_from_json(df: DataFrame, json: str) -> DataFrame:
    """Parse profile JSON into the profile struct ``profile``, with ``read_error``.

    Text that is not JSON (or null) gives no profile and "Invalid JSON". A field of another type than
    the profile's is null, and "Field of another type" says so; the other fields stay.
    """
    schema = PROFILE_DDL.removeprefix("struct<").removesuffix(">")
    parsed = F.from_json(
        F.col(json), f"struct<{schema},_bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    staged = df.withColumn("_p", parsed)
    misfit = F.col("_p._bad").isNotNull()
    # where the whole struct fits, the text was JSON; the variant reader refuses repeated keys
    bad = F.col("_p").isNull() | (misfit & F.try_parse_json(F.col(json)).isNull())
    names = [f.split(":")[0] for f in _top_fields(schema)]
    return staged.withColumns(
        {
            "profile": F.when(~bad, F.struct(*[F.col(f"_p.{n}").alias(n) for n in names])),
            "read_error": F.when(bad, F.lit("Invalid JSON")).when(misfit, F.lit("Field of another type")),
        }
    ).drop("_p")


def _top_fields(ddl: str) -> list[str]:
    """Split a struct's DDL at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def write_profiles(df: DataFrame, path: str, profile: str = "profile", mode: str = "append") -> None:
    """One JSON document per line, ISO dates."""
    df.select(to_profile_json(F.col(profile)).alias("value")).write.mode(mode).text(path)
