"""Queries over the catalog roles: customers as users, orders as resumes, line items as artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaframe.functions.text import date_range_label
from vitaframe.operators import catalog as C
from vitaframe.queries.base import FILE_NAME, register
from vitaframe.session import shared_dir
from vitaframe.sources import files as S
from vitaframe.sources import tables as T
from vitaframe.sources.tables import table

_USER = {
    "id": "CAST(c_custkey AS STRING)",
    "email": "CASE WHEN c_custkey % 50 = 0 THEN 'shared@x.org' WHEN c_custkey % 71 = 0 THEN NULL ELSE concat('u', CAST(c_custkey AS STRING), '@x.org') END",
    "is_active": "c_acctbal > 0",
    "settings": "concat('segment ', c_mktsegment)",
}
_RESUME = {
    "id": "CAST(o_orderkey AS STRING)",
    "user_id": "CASE WHEN o_orderkey % 97 = 0 THEN concat('gone', CAST(o_custkey AS STRING)) ELSE CAST(o_custkey AS STRING) END",
    "title": "concat('cv ', o_orderpriority)",
    "content": "CASE WHEN o_orderkey % 301 = 0 THEN NULL ELSE '{}' END",
    "version": "1",
    "created_at": "o_orderdate",
    "is_active": "o_orderstatus <> 'P'",
}
_ARTIFACT = {
    "id": "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING), CAST(CAST(l_quantity AS INT) AS STRING))",
    "user_id": "CAST(l_suppkey * 3 AS STRING)",
    "resume_id": "CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN concat('x', CAST(l_orderkey AS STRING)) ELSE CAST(l_orderkey AS STRING) END",
    "file_path": "CASE WHEN l_partkey % 37 = 0 THEN '' ELSE concat('/data/', CAST(l_orderkey AS STRING), '/', CAST(l_partkey AS STRING), '.pdf') END",
    "file_name": "concat(CAST(l_partkey AS STRING), '.pdf')",
    "file_size": "CAST(floor(l_extendedprice) AS INT)",
    "mime_type": "CASE WHEN l_linenumber = 7 THEN NULL ELSE 'application/pdf' END",
    "checksum": "repeat(l_returnflag, 63 + l_linenumber % 3)",
    "created_at": "l_shipdate",
    "status": "CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'pending' ELSE CASE WHEN l_linestatus = 'F' THEN 'failed' ELSE 'lost' END END",
}


def _shape(spark, folder, name, columns):
    return table(spark, folder, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def users(spark, folder):
    return _shape(spark, folder, "customer", _USER)


def resume_rows(spark, folder):
    return _shape(spark, folder, "orders", _RESUME).withColumn("updated_at", F.col("created_at"))


def artifacts(spark, folder):
    return _shape(spark, folder, "lineitem", _ARTIFACT)


def _cte(name, source, columns):
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})"


CTES = ", ".join([_cte("u", "customer", _USER), _cte("r", "orders", {**_RESUME, "updated_at": "o_orderdate"}), _cte("a", "lineitem", _ARTIFACT)])


# ------------------------------------------------------------------ views and lookups


@register(
    f"WITH {CTES} SELECT r.id, r.user_id, u.email AS user_email, r.title, r.version, r.created_at, r.updated_at, "
    "(SELECT count(*) FROM a WHERE a.resume_id = r.id) AS artifact_count FROM r JOIN u ON r.user_id = u.id WHERE r.is_active AND u.is_active"
)
def active_resumes(spark, folder):
    return C.active_resumes(users(spark, folder), resume_rows(spark, folder), artifacts(spark, folder))


@register(
    f"WITH {CTES} SELECT status, count(*) AS \"count\", avg(file_size) AS avg_file_size, CAST(sum(file_size) AS BIGINT) AS total_size FROM a GROUP BY 1"
)
def artifact_statistics(spark, folder):
    return C.artifact_stats(artifacts(spark, folder))


@register(f"WITH {CTES} SELECT resume_id, count(*) AS artifact_count FROM a WHERE resume_id IS NOT NULL GROUP BY 1")
def artifacts_per_resume(spark, folder):
    return C.artifact_counts(artifacts(spark, folder))


@register(
    f"WITH {CTES}, n AS (SELECT resume_id, id, file_path, created_at, row_number() OVER (PARTITION BY resume_id ORDER BY created_at DESC, id DESC) AS rn "
    "FROM a WHERE resume_id IS NOT NULL) SELECT resume_id, id, file_path, created_at FROM n WHERE rn = 1"
)
def newest_artifact_per_resume(spark, folder):
    rows = artifacts(spark, folder).select("resume_id", "id", "file_path", "created_at")
    return C.newest_per_key(rows, "resume_id", "created_at", "id")


@register(
    f"WITH {CTES}, n AS (SELECT resume_id, file_path, row_number() OVER (PARTITION BY resume_id ORDER BY created_at DESC, id DESC) AS rn FROM a WHERE resume_id IS NOT NULL), "
    "m AS (SELECT id, file_path, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, file_path DESC) AS rn FROM a), "
    "ids AS (SELECT id AS resume_id FROM r UNION SELECT id FROM a) "
    "SELECT ids.resume_id, coalesce(nullif(n.file_path, ''), m.file_path) AS file_path FROM ids LEFT JOIN n ON n.resume_id = ids.resume_id AND n.rn = 1 "
    "LEFT JOIN m ON m.id = ids.resume_id AND m.rn = 1"
)
def file_path_of_id(spark, folder):
    """Path for every resume id and every artifact id."""
    rows = artifacts(spark, folder)
    ids = resume_rows(spark, folder).select(F.col("id").alias("resume_id")).union(rows.select("id")).distinct()
    return C.resume_file_paths(ids, rows)


@register(
    f"WITH {CTES} SELECT id, user_id, title, row_number() OVER (PARTITION BY user_id, title ORDER BY created_at, id) AS version FROM r"
)
def resume_versions(spark, folder):
    rows = resume_rows(spark, folder).select("id", "user_id", "title", "created_at")
    return C.numbered(rows, ["user_id", "title"], "created_at", "id").drop("created_at")


# ------------------------------------------------------------------ integrity, erasure, export


@register(
    f"WITH {CTES} SELECT 'resumes.user_id' AS fk, id AS child_id, user_id AS missing_id FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.id = r.user_id) "
    "UNION ALL SELECT 'artifacts.user_id', id, user_id FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.id = a.user_id) "
    "UNION ALL SELECT 'artifacts.resume_id', id, resume_id FROM a WHERE resume_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.id = a.resume_id)"
)
def orphan_rows(spark, folder):
    return C.orphans(users(spark, folder), resume_rows(spark, folder), artifacts(spark, folder))


_INCOMING = "concat('u', CAST(s_suppkey * 40 AS STRING), '@x.org')"


@register(
    f"WITH {CTES}, n AS (SELECT {_INCOMING} AS email, s_name AS id FROM supplier UNION ALL SELECT {_INCOMING} AS email, concat('z', s_name) FROM supplier), "
    "k AS (SELECT email, min(id) AS id FROM n GROUP BY 1) SELECT id, email FROM u UNION ALL SELECT id, email FROM k WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.email = k.email)"
)
def insert_absent_users(spark, folder):
    """Suppliers become users unless their mail is taken; the first of two equal mails wins."""
    existing = users(spark, folder).select("id", "email")
    suppliers = table(spark, folder, "supplier")
    incoming = suppliers.selectExpr("s_name AS id", f"{_INCOMING} AS email").union(
        suppliers.selectExpr("concat('z', s_name) AS id", f"{_INCOMING} AS email")
    )
    return C.insert_if_absent(existing, incoming)


_GONE_CTE = "gone AS (SELECT id FROM u WHERE NOT is_active)"


@register(
    f"WITH {CTES}, {_GONE_CTE}, rr AS (SELECT * FROM r WHERE user_id NOT IN (SELECT id FROM gone)), "
    "dropped AS (SELECT id FROM r WHERE user_id IN (SELECT id FROM gone)) "
    "SELECT 'users' AS \"table\", id, NULL AS resume_id FROM u WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'resumes', id, NULL FROM rr "
    "UNION ALL SELECT 'artifacts', id, CASE WHEN resume_id IN (SELECT id FROM dropped) THEN NULL ELSE resume_id END FROM a WHERE user_id NOT IN (SELECT id FROM gone)"
)
def erase_inactive_users(spark, folder):
    """What is left in the three tables once inactive users are erased."""
    people = users(spark, folder)
    left = C.erase_users(
        people.where("NOT is_active").select("id"), people, resume_rows(spark, folder), artifacts(spark, folder)
    )
    none = F.lit(None).cast("string").alias("resume_id")
    return (
        left["users"].select(F.lit("users").alias("table"), "id", none)
        .unionByName(left["resumes"].select(F.lit("resumes").alias("table"), "id", none))
        .unionByName(left["artifacts"].select(F.lit("artifacts").alias("table"), "id", "resume_id"))
    )


@register(
    f"WITH {CTES}, gone AS (SELECT id FROM r WHERE NOT is_active) SELECT id, CASE WHEN resume_id IN (SELECT id FROM gone) THEN NULL ELSE resume_id END AS resume_id FROM a"
)
def erase_inactive_resumes(spark, folder):
    """Artifacts stay when their resume goes, without the link."""
    rows = resume_rows(spark, folder)
    left = C.erase_resumes(rows.where("NOT is_active").select("id"), rows, artifacts(spark, folder))
    return left["artifacts"].select("id", "resume_id")


@register(
    f"WITH {CTES}, s AS (SELECT id AS user_id FROM u WHERE NOT is_active) SELECT id AS user_id, 'users' AS \"table\", id, settings AS detail FROM u WHERE id IN (SELECT user_id FROM s) "
    "UNION ALL SELECT user_id, 'resumes', id, title FROM r WHERE user_id IN (SELECT user_id FROM s) "
    "UNION ALL SELECT user_id, 'artifacts', id, file_name FROM a WHERE user_id IN (SELECT user_id FROM s)"
)
def export_of_subjects(spark, folder):
    """All records of the inactive users, as JSON; one field of each record is read back."""
    people = users(spark, folder)
    out = C.subject_export(
        people.where("NOT is_active").select(F.col("id").alias("user_id")), people,
        resume_rows(spark, folder), artifacts(spark, folder),
    )
    detail = F.coalesce(*[F.get_json_object("record", f"$.{c}") for c in ("settings", "title", "file_name")])
    return out.select("user_id", "table", "id", detail.alias("detail"))


@register(
    f"WITH {CTES} SELECT id, file_size, created_at FROM a WHERE created_at >= TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 730 DAY AND file_size <= 50000"
)
def retained_artifacts(spark, folder):
    as_of = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return C.retained(artifacts(spark, folder), as_of, 730, 50_000).select("id", "file_size", "created_at")


# ------------------------------------------------------------------ audits and changes


@register(
    f"WITH {CTES}, e AS (SELECT CAST(vec_id AS STRING) AS id, len(embedding) AS n FROM embeddings), "
    "x AS (SELECT 'users' AS \"table\", 'email is null' AS rule, id FROM u WHERE email IS NULL "
    "UNION ALL SELECT 'users', 'email not unique', email FROM u WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1 "
    "UNION ALL SELECT 'resumes', 'content is null', id FROM r WHERE content IS NULL "
    "UNION ALL SELECT 'artifacts', 'mime_type is null', id FROM a WHERE mime_type IS NULL "
    "UNION ALL SELECT 'artifacts', 'checksum longer than 64', id FROM a WHERE length(checksum) > 64 "
    "UNION ALL SELECT 'artifacts', 'status unknown', id FROM a WHERE status NOT IN ('pending', 'processing', 'completed', 'failed') "
    "UNION ALL SELECT 'embeddings', 'embedding length is not 384', id FROM e WHERE n <> 384) SELECT \"table\", rule, id FROM x"
)
def catalog_rule_audit(spark, folder):
    """Unique, not-null, length, status and vector-length rules over the catalog."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    sizes = C.row_violations(vectors, "artifacts").withColumn("table", F.lit("embeddings"))
    return C.catalog_audit(users(spark, folder), resume_rows(spark, folder), artifacts(spark, folder)).unionByName(sizes)


@register(
    f"WITH {CTES}, ch AS (SELECT CAST(s_suppkey * 20 AS STRING) AS id, concat(s_name, '@new.org') AS email, true AS is_active, 'changed' AS settings FROM supplier) "
    "SELECT coalesce(u.id, ch.id) AS id, CASE WHEN ch.id IS NOT NULL THEN ch.email ELSE u.email END AS email, coalesce(ch.settings, u.settings) AS settings, "
    "CASE WHEN ch.id IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM u FULL JOIN ch ON u.id = ch.id"
)
def upsert_users(spark, folder):
    """Changed users get a new ``updated_at``, untouched ones keep theirs."""
    old = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    current = users(spark, folder).withColumn("updated_at", old)
    changes = table(spark, folder, "supplier").selectExpr(
        "CAST(s_suppkey * 20 AS STRING) AS id", "concat(s_name, '@new.org') AS email", "true AS is_active", "'changed' AS settings"
    )
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    return C.upsert_touching(current, changes, as_of).select("id", "email", "settings", "updated_at")


_START = "CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) WHEN 2 THEN 'spring term' ELSE '' END"
_END = "CASE o_orderkey % 5 WHEN 0 THEN 'present' WHEN 1 THEN '2015' WHEN 2 THEN NULL ELSE '2014-07-09' END"


def _label_sql(c: str) -> str:
    month = "strftime({d}, '%b %Y')"
    return (
        f"CASE WHEN {c} IS NULL OR {c} = '' THEN '' WHEN {c} IN ('present', 'current') THEN 'Present' "
        f"WHEN regexp_full_match({c}, '\\d{{4}}-\\d\\d-\\d\\d') THEN {month.format(d=f'TRY_CAST({c} AS DATE)')} "
        f"WHEN regexp_full_match({c}, '\\d{{4}}-\\d\\d') THEN {month.format(d=f'TRY_CAST({c} || {chr(39)}-01{chr(39)} AS DATE)')} "
        f"WHEN regexp_full_match({c}, '\\d{{4}}') THEN {month.format(d=f'TRY_CAST({c} || {chr(39)}-01-01{chr(39)} AS DATE)')} ELSE {c} END"
    )


@register(
    f"WITH o AS (SELECT o_orderkey, {_START} AS s, {_END} AS e, o_orderkey % 6 = 0 AS cur, CASE WHEN o_orderkey % 7 = 0 THEN 'since ' || o_orderpriority END AS raw FROM orders), "
    f"l AS (SELECT o_orderkey, raw, {_label_sql('s')} AS a, CASE WHEN cur THEN 'Present' ELSE {_label_sql('e')} END AS b FROM o) "
    "SELECT o_orderkey, CASE WHEN raw IS NOT NULL THEN raw WHEN a <> '' AND b <> '' THEN a || ' - ' || b ELSE a || b END AS label FROM l"
)
def date_range_labels(spark, folder):
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderkey", f"{_START} AS s", f"{_END} AS e", "o_orderkey % 6 = 0 AS cur",
        "CASE WHEN o_orderkey % 7 = 0 THEN concat('since ', o_orderpriority) END AS raw",
    )
    return rows.select("o_orderkey", date_range_label(*[F.col(c) for c in ("s", "e", "cur", "raw")]).alias("label"))


# ------------------------------------------------------------------ uploads, listings and manifests

_RUN = "2024-02-29 10:00:00"
_FILES_SQL = (
    f"f AS (SELECT doc_id, {FILE_NAME} AS name, concat('in/', CAST(doc_id % 7 AS STRING), '/', {FILE_NAME}) AS path, sha256(text) AS checksum, strlen(text) AS size "
    "FROM documents WHERE text IS NOT NULL), "
    "ok AS (SELECT *, sha256(concat_ws('|', 'run1', path, checksum)) AS id FROM f WHERE size BETWEEN 1 AND 10485760 AND name LIKE '%.%' AND lower(regexp_extract(name, '[^.]*$')) IN ('pdf', 'docx'))"
)


def _file_listing(spark, folder):
    """Documents as a listing of files with their content."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    path = F.concat(F.lit("in/"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.expr(FILE_NAME))
    content = F.col("text").cast("binary")
    return docs.select(path.alias("path"), F.octet_length("text").cast("long").alias("length"), content.alias("content"))


@register(
    f"WITH {_FILES_SQL} "
    "SELECT 'artifact' AS kind, id, sha256(id || '|resume') AS other_id, name AS title, concat('original/2024/02/run1/', name) AS detail, CAST(size AS BIGINT) AS size FROM ok "
    "UNION ALL SELECT 'resume', sha256(id || '|resume'), 'admin', name, '{\"source\":\"upload\",\"run_id\":\"run1\"}', 1 FROM ok "
    "UNION ALL SELECT 'user', 'admin', NULL, 'admin@example.org', NULL, NULL WHERE EXISTS (SELECT 1 FROM ok)"
)
def uploads_recorded_twice(spark, folder):
    """The catalog after a run that was repeated, at another time, and one that was never ended."""
    root = shared_dir(spark, "catalog")
    listing = _file_listing(spark, folder)
    owner = spark.createDataFrame([("admin", "admin@example.org")], "id string, email string")
    for at in (_RUN, "2024-03-01 09:00:00"):
        as_of = S.started_at(spark, root, "run1", F.lit(at).cast("timestamp"))
        S.record_uploads(spark, S.accepted_uploads(listing, "run1", as_of, "admin"), root, owner)
    unfinished = S.accepted_uploads(listing.where("length < 1000"), "run2", F.lit(_RUN).cast("timestamp"), "admin")
    S.replace_runs(unfinished.drop("content"), f"{root}/artifacts", "run_id")
    artifacts, resumes, users = (S.catalog_table(spark, root, name) for name in ("artifacts", "resumes", "users"))
    none = F.lit(None)
    return (
        artifacts.select(F.lit("artifact").alias("kind"), "id", F.col("resume_id").alias("other_id"), F.col("file_name").alias("title"), F.col("file_path").alias("detail"), F.col("file_size").cast("long").alias("size"))
        .unionAll(resumes.select(F.lit("resume"), "id", "user_id", "title", "metadata", F.col("version").cast("long")))
        .unionAll(users.select(F.lit("user"), "id", none.cast("string"), "email", none.cast("string"), none.cast("long")))
    )


@register(
    "WITH l AS (SELECT concat('data/original/run-', CAST(doc_id % 11 AS STRING), '/cv_', CAST(doc_id % 40 AS STRING), '.pdf') AS path, max(n_chars) AS t FROM documents GROUP BY 1), "
    "q AS (SELECT DISTINCT concat('data/original/[RUN_ID]/cv_', CAST(doc_id % 50 AS STRING), '.pdf') AS path FROM documents) "
    "SELECT q.path, (SELECT arg_max(l.path, {'t': l.t, 'p': l.path}) FROM l WHERE l.path LIKE replace(q.path, '[RUN_ID]', '%')) AS found FROM q"
)
def newest_of_runs(spark, folder):
    """For every path with a placeholder the newest file of any run."""
    docs = table(spark, folder, "documents")
    name = lambda run, n: F.concat(F.lit("data/original/"), run, F.lit("/cv_"), (F.col("doc_id") % n).cast("string"), F.lit(".pdf"))
    run = F.concat(F.lit("run-"), (F.col("doc_id") % 11).cast("string"))
    listing = docs.groupBy(name(run, 40).alias("path")).agg(F.max("n_chars").alias("modificationTime"))
    return S.newest_paths(docs.select(name(F.lit("[RUN_ID]"), 50).alias("path")).distinct(), listing)


@register(
    f"WITH d AS (SELECT doc_id, source, {FILE_NAME} AS name, n_chars FROM documents) "
    "SELECT source, name AS filename, 'pdf' AS category, CAST(n_chars % 9 AS INTEGER) AS sections, n_chars % 2 = 0 AS skills, CAST(NULL AS VARCHAR) AS read_error "
    "FROM d WHERE substr(source, 4) NOT IN ('3', '4') "
    "UNION ALL SELECT DISTINCT source, NULL, NULL, NULL, NULL, CASE substr(source, 4) WHEN '3' THEN 'Invalid JSON' ELSE 'No fixtures' END FROM d WHERE substr(source, 4) IN ('3', '4')"
)
def manifest_fixtures(spark, folder):
    """A manifest per source, written as text and read back; one is cut off and one has another key."""
    docs = table(spark, folder, "documents")
    fixture = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.expr(FILE_NAME).alias("filename"), F.lit("pdf").alias("category"),
        F.create_map(F.lit("skills"), F.col("n_chars") % 2 == 0).alias("expected_sections"),
        F.struct((F.col("n_chars") % 9).cast("int").alias("sections_detected")).alias("parsing_expectations"),
    )
    text = F.to_json(F.struct(F.collect_list(fixture).alias("fixtures")))
    written = docs.groupBy("source").agg(text.alias("manifest"))
    number = F.substring("source", 4, 9)
    cut = F.when(number == "3", F.concat(F.lit("{"), F.col("manifest"))).when(number == "4", F.regexp_replace("manifest", "fixtures", "files"))
    rows = T.manifests(written.withColumn("manifest", cut.otherwise(F.col("manifest"))), "manifest")
    return rows.select(
        "source", "fixture.filename", "fixture.category", F.col("fixture.parsing_expectations.sections_detected").alias("sections"),
        F.col("fixture.expected_sections")["skills"].alias("skills"), "read_error",
    )
