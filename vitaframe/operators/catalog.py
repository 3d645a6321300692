"""Users, resumes and artifacts: views, lookups, integrity, erasure, audits.

Joins carry no broadcast hints here: Spark broadcasts a side when its measured size is
under the threshold, and otherwise splits skewed join partitions at run time. Per-key
"newest" and "count" are aggregates (merged on the map side), not windows, so one key
with a third of all rows does not become one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.session import written

# Life cycle of an artifact.
STATUSES = ("pending", "processing", "completed", "failed")

USERS_DDL = "id string, email string, created_at timestamp, updated_at timestamp, is_active boolean, settings string"
RESUMES_DDL = (
    "id string, user_id string, title string, content string, version int, created_at timestamp, "
    "updated_at timestamp, is_active boolean, metadata string"
)
ARTIFACTS_DDL = (
    "id string, user_id string, resume_id string, file_path string, file_name string, file_size int, "
    "mime_type string, checksum string, embedding array<float>, created_at timestamp, processed_at timestamp, "
    "status string, profile_schema_version string, profile_data string, validation_errors string"
)


# ------------------------------------------------------------------ views and lookups


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    return (
        artifacts.where(F.col("resume_id").isNotNull())
        .groupBy("resume_id")
        .agg(F.count("*").alias("artifact_count"))
    )


def active_resumes(users: DataFrame, resumes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Active resumes of active users with the owner's mail and the number of artifacts."""
    owners = users.where("is_active").select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    counts = artifact_counts(artifacts).withColumnRenamed("resume_id", "id")
    return (
        resumes.where("is_active")
        .join(owners, "user_id")
        .join(counts, "id", "left")
        .select(
            "id", "user_id", "user_email", "title", "version", "created_at", "updated_at",
            F.coalesce("artifact_count", F.lit(0)).cast("long").alias("artifact_count"),
        )
    )


def artifact_stats(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("status").agg(
        F.count("*").alias("count"),
        F.avg("file_size").alias("avg_file_size"),
        F.sum(F.col("file_size").cast("long")).alias("total_size"),
    )


def newest_per_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The latest row of every key; equal times are settled by the larger ``tie``."""
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_row")
    )
    return best.select(key, "_row.*")


def resume_file_paths(ids: DataFrame, artifacts: DataFrame, id_col: str = "resume_id") -> DataFrame:
    """File to parse for each id: newest artifact of that resume, else the artifact of that id."""
    slim = artifacts.select("id", "resume_id", "file_path", "created_at")
    by_resume = newest_per_key(slim, "resume_id", "created_at", "id").select(
        F.col("resume_id").alias("_r"), F.col("file_path").alias("_by_resume")
    )
    by_id = newest_per_key(slim.drop("resume_id"), "id", "created_at", "file_path").select(
        F.col("id").alias("_i"), F.col("file_path").alias("_by_id")
    )
    joined = ids.join(by_resume, F.col(id_col) == F.col("_r"), "left").join(by_id, F.col(id_col) == F.col("_i"), "left")
    return joined.select(
        *ids.columns,
        F.coalesce(F.when(F.col("_by_resume") != "", F.col("_by_resume")), F.col("_by_id")).alias("file_path"),
    )


def numbered(df: DataFrame, keys: Sequence[str], ts: str, tie: str, name: str = "version") -> DataFrame:
    """Number the rows of each group by ``(ts, tie)`` from 1, null keys being a group of their own.

    A range shuffle over ``(keys, ts, tie)`` puts the rows of a group into as many neighbouring partitions as they need, also
    where all of them have one time. A row's place in the whole table is its place in its partition plus the rows of
    the partitions before; less the first place of its group, that is its number.
    """
    order = [F.asc_nulls_first(c) for c in (*keys, ts, tie)]
    ordered = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))  # a row per partition
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.withColumn("_part", part).join(sizes.select("_part", before.alias("_before")), "_part")
    placed = placed.withColumn("_place", F.col("_before") + inside)
    firsts = placed.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_place").alias("_first"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return placed.join(firsts, on).select(*df.columns, (F.col("_place") - F.col("_first") + 1).cast("long").alias(name))


# ------------------------------------------------------------------ integrity and erasure


def orphans(users: DataFrame, resumes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Rows whose owner or resume does not exist: ``(fk, child_id, missing_id)``."""

    def missing(child: DataFrame, fk: str, parent: DataFrame, name: str) -> DataFrame:
        rows = child.select(F.col("id").alias("child_id"), F.col(fk).alias("missing_id")).where(
            F.col("missing_id").isNotNull()
        )
        parents = parent.select(F.col("id").alias("missing_id"))
        return rows.join(parents, "missing_id", "left_anti").select(F.lit(name).alias("fk"), "child_id", "missing_id")

    return (
        missing(resumes, "user_id", users, "resumes.user_id")
        .unionByName(missing(artifacts, "user_id", users, "artifacts.user_id"))
        .unionByName(missing(artifacts, "resume_id", resumes, "artifacts.resume_id"))
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str = "email", order: str = "id") -> DataFrame:
    """Existing rows plus those incoming rows whose key is new; the first of equal keys wins."""
    rest = [c for c in incoming.columns if c != key]
    firsts = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")
    fresh = firsts.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def erase_users(gone: DataFrame, users: DataFrame, resumes: DataFrame, artifacts: DataFrame) -> dict[str, DataFrame]:
    """Remove users (``gone.id``) and, with them, their resumes and artifacts.

    Artifacts of other users that point to a removed resume keep their row, without the link. The keys that go are
    written once and serve all three tables.
    """
    ids = written(gone.select(F.col("id").alias("user_id")).distinct(), "gone-users")
    dropped = written(resumes.join(ids, "user_id", "left_semi").select("id").distinct(), "gone-resumes")
    return {
        "users": users.join(ids.withColumnRenamed("user_id", "id"), "id", "left_anti").select(*users.columns),
        "resumes": resumes.join(ids, "user_id", "left_anti").select(*resumes.columns),
        "artifacts": unlink_resumes(dropped, artifacts).join(ids, "user_id", "left_anti").select(*artifacts.columns),
    }


def unlink_resumes(gone: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Null ``resume_id`` of the artifacts of removed resumes (``gone.id``).

    Artifacts without a resume stay where they lie: in the join they would all go to one task.
    """
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    linked = artifacts.where(F.col("resume_id").isNotNull()).join(ids, F.col("resume_id") == F.col("_gone"), "left")
    unlinked = linked.withColumn("resume_id", F.when(F.col("_gone").isNull(), F.col("resume_id"))).drop("_gone")
    return unlinked.unionByName(artifacts.where(F.col("resume_id").isNull()))


def erase_resumes(gone: DataFrame, resumes: DataFrame, artifacts: DataFrame) -> dict[str, DataFrame]:
    ids = gone.select("id").distinct()
    return {
        "resumes": resumes.join(ids, "id", "left_anti").select(*resumes.columns),
        "artifacts": unlink_resumes(ids, artifacts).select(*artifacts.columns),
    }


def subject_export(subjects: DataFrame, users: DataFrame, resumes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Everything stored about the given users (``subjects.user_id``): one JSON record per row."""
    ids = subjects.select("user_id").distinct()

    def records(df: DataFrame, owner: str, table: str) -> DataFrame:
        mine = df.withColumn("_owner", F.col(owner)).join(
            ids.withColumnRenamed("user_id", "_owner"), "_owner", "left_semi"
        )
        return mine.select(
            F.col("_owner").alias("user_id"),
            F.lit(table).alias("table"),
            F.col("id").cast("string").alias("id"),
            F.to_json(F.struct(*df.columns)).alias("record"),
        )

    return (
        records(users, "id", "users")
        .unionByName(records(resumes, "user_id", "resumes"))
        .unionByName(records(artifacts, "user_id", "artifacts"))
    )


def retained(
    artifacts: DataFrame, as_of: Column, max_age_days: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Artifacts that retention keeps: young enough and small enough, by the limits given.

    ``as_of`` is a parameter, so the filter is a constant that reaches the scan.
    """
    out = artifacts
    if max_age_days is not None:
        out = out.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(max_age_days)))
    if max_bytes is not None:
        out = out.where(F.col("file_size") <= max_bytes)
    return out


# ------------------------------------------------------------------ changes


def upsert_touching(current: DataFrame, changes: DataFrame, as_of: Column, key: str = "id") -> DataFrame:
    """Apply full replacement rows; ``updated_at`` moves only where a row existed before."""
    data = [c for c in current.columns if c not in (key, "updated_at")]
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in data], F.lit(True).alias("_hit"))
    joined = current.withColumn("_old", F.lit(True)).join(new, F.col(key) == F.col("_key"), "full_outer")
    changed = F.col("_hit") & F.col("_old")
    picked = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in data]
    stamp = F.when(F.coalesce(changed, F.lit(False)) | F.col("_old").isNull(), as_of).otherwise(F.col("updated_at"))
    return joined.select(F.coalesce(key, "_key").alias(key), *picked, stamp.alias("updated_at")).select(*current.columns)


# ------------------------------------------------------------------ audits

# Declared lengths of the catalog's text columns.
MAX_LENGTHS = {
    "users": {"email": 255},
    "resumes": {"title": 255},
    "artifacts": {
        "file_path": 512, "file_name": 255, "mime_type": 100, "checksum": 64, "profile_schema_version": 20,
    },
}
NOT_NULL = {
    "users": ("id", "email"),
    "resumes": ("id", "user_id", "title", "content"),
    "artifacts": ("id", "user_id", "file_path", "file_name", "file_size", "mime_type", "checksum"),
}
VECTOR_LENGTH = 384


def row_violations(df: DataFrame, table: str, vector_length: int = VECTOR_LENGTH) -> DataFrame:
    """Broken row-level rules of one catalog table: ``(table, rule, id)``.

    All rules are tested in one pass; a row is emitted once per broken rule.
    """
    checks = [F.when(F.col(c).isNull(), f"{c} is null") for c in NOT_NULL[table] if c in df.columns]
    checks += [
        F.when(F.length(c) > n, f"{c} longer than {n}") for c, n in MAX_LENGTHS[table].items() if c in df.columns
    ]
    if table == "artifacts" and "status" in df.columns:
        checks.append(F.when(~F.col("status").isin(*STATUSES), "status unknown"))
    if table == "artifacts" and "embedding" in df.columns:
        checks.append(F.when(F.size("embedding") != vector_length, f"embedding length is not {vector_length}"))
    # the outer form: for explode the optimizer would work all checks out a second time as a filter
    found = df.select(
        F.lit(table).alias("table"),
        F.explode_outer(F.array_compact(F.array(*checks))).alias("rule"),
        F.col("id").cast("string").alias("id"),
    )
    return found.where(F.col("rule").isNotNull())


def duplicate_keys(df: DataFrame, table: str, column: str) -> DataFrame:
    """Values of a unique column that occur more than once, in the shape of ``row_violations``."""
    dup = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
    return dup.select(
        F.lit(table).alias("table"), F.lit(f"{column} not unique").alias("rule"), F.col(column).cast("string").alias("id")
    )


def catalog_audit(
    users: DataFrame, resumes: DataFrame, artifacts: DataFrame, vector_length: int = VECTOR_LENGTH
) -> DataFrame:
    return (
        row_violations(users, "users")
        .unionByName(row_violations(resumes, "resumes"))
        .unionByName(row_violations(artifacts, "artifacts", vector_length))
        .unionByName(duplicate_keys(users, "users", "email"))
    )
