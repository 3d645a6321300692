"""Ingest uploaded files: check, hash, store, and record them in the catalog."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.functions import files as N
from vitaframe.functions.crypto import checksum, encrypt
from vitaframe.functions.text import basename
from vitaframe.operators.catalog import insert_if_absent


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content``; content is only read where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def resolve_placeholder(spark: SparkSession, path: str) -> DataFrame:
    """The newest file that fits a path with ``[RUN_ID]`` in it (one row)."""
    found = spark.read.format("binaryFile").load(path.replace("[RUN_ID]", "*"))
    return found.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def refused_uploads(listing: DataFrame) -> DataFrame:
    """Files that cannot be taken and why; reads no content.

    Spark's own listing leaves out empty files; they can only show up here when the listing
    comes from elsewhere (a table of names and sizes).
    """
    errors = N.upload_errors(basename(F.col("path")), F.col("length"))
    return listing.select(basename(F.col("path")).alias("file_name"), "length", errors.alias("errors")).where(
        F.size("errors") > 0
    )


def accepted_uploads(listing: DataFrame, run_id: str, as_of: Column, owner_id: str) -> DataFrame:
    """Artifact rows (and the content) of the files that pass the checks.

    The size bound is pushed into the listing, so oversized files are never opened. Ids are
    hashes of run, path and content: running the job again gives the same rows.
    """
    name = basename(F.col("path"))
    ok = listing.where(F.col("length").between(1, N.MAX_FILE_SIZE)).where(N.has_allowed_extension(name))
    hashed = ok.select("path", "length", "content", checksum(F.col("content")).alias("checksum"))
    name = basename(F.col("path"))
    artifact = F.sha2(F.concat_ws("|", F.lit(run_id), F.col("path"), F.col("checksum")), 256)
    return hashed.select(
        artifact.alias("id"),
        F.lit(owner_id).alias("user_id"),
        F.sha2(F.concat(artifact, F.lit("|resume")), 256).alias("resume_id"),
        N.storage_path(F.lit(run_id), name, as_of).alias("file_path"),
        name.alias("file_name"),
        F.col("length").cast("int").alias("file_size"),
        N.mime_type(name).alias("mime_type"),
        F.col("checksum"),
        as_of.alias("created_at"),
        F.lit("pending").alias("status"),
        F.lit(run_id).alias("run_id"),
        "content",
    )


def newest_paths(requests: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """``requests`` with ``found``, the newest path that fits a request with one ``[RUN_ID]`` folder in it; null if none fits.

    ``listing`` has ``path`` and ``modificationTime``. Each listed path is written once for each of its folders with
    that folder as the placeholder, so requests meet it in an equality join. A request without placeholder fits itself.
    """
    parts = F.split("path", "/")
    patterns = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.array_join(F.transform(parts, lambda x, k: F.when(k == i, F.lit("[RUN_ID]")).otherwise(x)), "/"),
    )
    fits = listing.select("path", "modificationTime", F.explode(F.concat(F.array("path"), patterns)).alias("_pattern"))
    newest = fits.groupBy("_pattern").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("found"))
    return requests.join(newest, F.col(path) == F.col("_pattern"), "left").drop("_pattern")


def store_content(accepted: DataFrame, root: str, key: Column | None = None) -> None:
    """Write contents below ``root/original/year=/month=/run_id=``, encrypted when a key is given.

    A run that is repeated replaces its own folder.
    """
    content = F.col("content") if key is None else encrypt(F.col("content"), key)
    rows = accepted.select(
        "id", "file_name", content.alias("content"), "run_id",
        F.date_format("created_at", "yyyy").alias("year"), F.date_format("created_at", "MM").alias("month"),
    )
    replace_runs(rows, f"{root}/original", "year", "month", "run_id")


def replace_runs(rows: DataFrame, path: str, *by: str) -> None:
    """Write rows by folder; folders that the rows name are replaced, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None if there is none yet; any other failure is raised."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def started_at(spark: SparkSession, root: str, run_id: str, as_of: Column) -> Column:
    """The time of a run's first attempt; a repeated run keeps it, so that its rows are the same."""
    path = f"{root}/runs_started/{run_id}"
    spark.range(1).select(as_of.alias("as_of")).write.mode("ignore").parquet(path)
    return F.lit(spark.read.parquet(path).first().as_of)


def record_uploads(spark: SparkSession, accepted: DataFrame, root: str, owner: DataFrame) -> None:
    """Record a run's artifacts, resumes and (if new) the owner in the catalog below ``root``.

    Every table is partitioned by run and a run replaces its own partitions, so a run may be repeated, also after
    it ended between two tables. Its commit record is written last; ``catalog_table`` shows committed runs only.
    Hashing reads every file, so it is done once: the resume rows come from the artifact rows just written. An
    accepted table holds one run; one without rows records nothing.
    """
    replace_runs(accepted.drop("content"), f"{root}/artifacts", "run_id")
    run = accepted.select("run_id").first()
    if run is None:
        return
    run_id = run.run_id
    artifacts = spark.read.parquet(f"{root}/artifacts").where(F.col("run_id") == run_id)
    resumes = artifacts.select(
        F.col("resume_id").alias("id"), "user_id", F.col("file_name").alias("title"), F.lit("{}").alias("content"),
        F.lit(1).alias("version"), "created_at", F.col("created_at").alias("updated_at"),
        F.lit(True).alias("is_active"),
        F.to_json(F.struct(F.lit("upload").alias("source"), "run_id")).alias("metadata"), "run_id",
    )
    replace_runs(resumes, f"{root}/resumes", "run_id")
    known = read_or_none(spark, f"{root}/users")
    if known is not None:  # users that this run itself brought in do not count
        known = known.where(F.col("run_id") != run_id).select(*owner.columns)
    fresh = insert_if_absent(owner.limit(0), owner) if known is None else insert_if_absent(known.limit(0), owner).join(known.select("email"), "email", "left_anti")
    replace_runs(fresh.select(*owner.columns, F.lit(run_id).alias("run_id")), f"{root}/users", "run_id")
    commit = artifacts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    replace_runs(commit, f"{root}/runs", "run_id")


def catalog_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A catalog table's rows of the runs that were recorded to their end."""
    runs = spark.read.parquet(f"{root}/runs").select("run_id")
    return spark.read.parquet(f"{root}/{name}").join(runs, "run_id", "left_semi")
