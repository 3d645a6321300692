"""Queries over profile JSON: format checks, versions, rules, prohibited keys, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaframe.functions import extract as X
from vitaframe.functions.dates import date_or_text
from vitaframe.operators import validate as V
from vitaframe.plans import parse
from vitaframe.plans import profile as P
from vitaframe.queries.base import FILE_NAME, quote, register, resumes, strip_sql
from vitaframe.queries.sections import CONTACT_SQL, LEAD_SQL, RESUMES_CTE, plain_ctes
from vitaframe.sources.tables import profiles_from_json, spread, table

# ------------------------------------------------------------------ formats

_MAIL = "CASE c_custkey % 6 WHEN 0 THEN concat('a', c_name, '@x.org') WHEN 1 THEN 'no-at-sign' WHEN 2 THEN 'a@b' WHEN 3 THEN 'a@@b.c' WHEN 4 THEN concat(c_mktsegment, '@', c_name, '.de') ELSE '@x.y' END"
_PHONE = "CASE c_custkey % 5 WHEN 0 THEN concat('+1 (', CAST(c_custkey AS STRING), ') 555-0000') WHEN 1 THEN CAST(c_custkey AS STRING) WHEN 2 THEN concat('00', CAST(c_custkey AS STRING), '.', CAST(c_nationkey AS STRING), '-77 x') WHEN 3 THEN '1234567890123456' ELSE '(030) 44 55 66' END"
_VERSION = "CASE c_custkey % 9 WHEN 0 THEN '1.0.0' WHEN 1 THEN '1.0.7' WHEN 2 THEN '2.0.0' WHEN 3 THEN '1.1.0' WHEN 4 THEN '1.0' WHEN 5 THEN 'v1.0.0' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE concat('0.', CAST(c_nationkey AS STRING), '.3') END"


@register(
    f"WITH x AS (SELECT c_custkey, {_MAIL} AS m, {_PHONE} AS p, {_VERSION} AS v FROM customer) SELECT c_custkey, regexp_matches(m, '^[^@]+@[^@]+\\.[^@]+$') AS mail_ok, "
    "regexp_matches(regexp_replace(p, '[\\s()+.-]', '', 'g'), '^\\d{7,15}$') AS phone_ok, regexp_matches(v, '^\\d+\\.\\d+\\.\\d+$') AS version_ok FROM x"
)
def format_checks(spark, folder):
    x = table(spark, folder, "customer").selectExpr("c_custkey", f"{_MAIL} AS m", f"{_PHONE} AS p", f"{_VERSION} AS v")
    return x.select(
        "c_custkey", V.is_email("m").alias("mail_ok"), V.is_phone("p").alias("phone_ok"), V.is_semver("v").alias("version_ok")
    )


_COMPATIBLE = "regexp_matches(v, '^\\d+(\\.\\d+)+$') AND TRY_CAST(split_part(v, '.', 1) AS INT) = 1 AND TRY_CAST(split_part(v, '.', 2) AS INT) <= 0"


@register(
    f"WITH x AS (SELECT c_custkey, {_VERSION} AS v FROM customer), y AS (SELECT *, coalesce({_COMPATIBLE}, false) AS compatible, coalesce(v = '', true) AS missing FROM x) "
    "SELECT c_custkey, compatible, CASE WHEN missing OR v = '1.0.0' OR compatible THEN '1.0.0' ELSE v END AS migrated, "
    "CASE WHEN NOT (missing OR v = '1.0.0' OR compatible) THEN 'Cannot migrate from schema version ' || v || ' to 1.0.0' END AS error FROM y"
)
def schema_versions(spark, folder):
    """Compatibility with, and migration to, the current schema version."""
    x = table(spark, folder, "customer").selectExpr("c_custkey", f"{_VERSION} AS v")
    migrated, error = V.migrated_version(F.col("v"))
    return x.select(
        "c_custkey", V.is_compatible(F.col("v")).alias("compatible"), migrated.alias("migrated"), error.alias("error")
    )


_DATE = (
    "CASE o_orderkey % 8 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) "
    "WHEN 2 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) WHEN 3 THEN concat(' ', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2), '/', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)) "
    "WHEN 4 THEN '2/30/2020' WHEN 5 THEN concat('3/', CAST(o_orderkey % 28 + 1 AS STRING), '/2011') WHEN 6 THEN 'Spring 2019 ' ELSE '2019-13' END"
)


@register(
    f"WITH x AS (SELECT o_orderkey, {strip_sql(_DATE)} AS t FROM orders) SELECT o_orderkey, CASE WHEN regexp_full_match(t, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST(t AS DATE) "
    "WHEN regexp_full_match(t, '\\d{4}-\\d{1,2}') THEN TRY_CAST(t || '-01' AS DATE) WHEN regexp_full_match(t, '\\d{4}') THEN TRY_CAST(t || '-01-01' AS DATE) "
    "WHEN regexp_full_match(t, '\\d{1,2}/\\d{4}') THEN TRY_CAST(split_part(t, '/', 2) || '-' || split_part(t, '/', 1) || '-01' AS DATE) "
    "WHEN regexp_full_match(t, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN TRY_CAST(split_part(t, '/', 3) || '-' || split_part(t, '/', 1) || '-' || split_part(t, '/', 2) AS DATE) END AS parsed, t AS raw FROM x"
)
def flexible_dates(spark, folder):
    """Five date forms in order; what fits none stays text."""
    x = spread(table(spark, folder, "orders")).select("o_orderkey", date_or_text(F.expr(_DATE)).alias("d"))
    return x.select("o_orderkey", "d.parsed", "d.raw")


# ------------------------------------------------------------------ profiles

_META = '"metadata": {"extractor_version": "1", "extraction_timestamp": "2025-01-01T00:00:00Z", "confidence_score": 0.5}'
_HEAD = '"extraction_method": "x", "source_file": "a.pdf"'
# (what follows the opening brace, strict errors, stays valid when lenient)
_CATEGORY = V.MESSAGES["category"]
_CASES = (
    (f'"schema_version": "1.0.0", {_HEAD}, {_META}', "", True),
    (f'"schema_version": "1.0.0", {_HEAD}, {_META}, "contact": {{"email": "bad", "phone": "12"}}',
     "Field 'contact -> email': Value error, Invalid email format;Field 'contact -> phone': Value error, Invalid phone format", False),
    (f'"schema_version": "2.0.0", {_HEAD}, {_META}', "Incompatible schema version: 2.0.0 (current: 1.0.0)", True),
    (f'"schema_version": "1.0", {_HEAD}, {_META}', "", True),
    (f"{_HEAD}, {_META}", "", True),
    (f'"schema_version": "1.0.0", {_HEAD}, {_META}, "skills": [{{"name": "x", "category": "zzz"}}, {{"category": "cloud"}}, 5]',
     f"Field 'skills -> 0 -> category': {_CATEGORY};Field 'skills -> 1 -> name': Field required;Field 'skills -> 2': Input should be a valid dictionary", False),
    (f'"schema_version": "1.0.0", {_HEAD}, {_META}, "additional_sections": {{"a": {{"b": {{"Age": 1}}}}, "l": [{{"age": 2}}]}}',
     "Field '': Value error, Prohibited derived PII field detected: additional_sections.a.b.Age", False),
    (f'"schema_version": "1.0.0", {_HEAD}, {_META}, "experience": "none"', "Field 'experience': Input should be a valid list", True),
    (f'"schema_version": "1.0.0", {_HEAD}', "Field 'metadata': Field required", False),
    (f'"schema_version": "1.0.0", {_HEAD}, {_META}, "projects": [{{"name": "p", "team_size": "many", "dates": {{"is_current": "maybe"}}}}]',
     "Field 'projects -> 0 -> dates -> is_current': Input should be a valid boolean;Field 'projects -> 0 -> team_size': Input should be a valid integer", False),
    ('"schema_version": ', "Invalid JSON", False),
)
_K = len(_CASES)
_PICK = "CASE c_custkey % {k} " .format(k=_K) + " ".join(f"WHEN {i} THEN {quote(c[0])}" for i, c in enumerate(_CASES)) + " END"
# Every profile also carries its customer's name; a long one breaks the length rule.
_TITLE = "CASE WHEN c_custkey % 13 = 0 THEN repeat(c_name, 12) ELSE c_name END"
_TAIL = f"concat(', \"achievements\": [{{\"title\": \"', {_TITLE}, '\"}}]}}')"
PROFILE_JSON = f"concat('{{', {_PICK}, CASE WHEN c_custkey % {_K} = {_K - 1} THEN '' ELSE {_TAIL} END)"


def _profile_json(spark, folder):
    return spread(table(spark, folder, "customer")).select("c_custkey", F.expr(PROFILE_JSON).alias("j"))


_LONG = "Field 'achievements -> 0 -> title': String should have at most 200 characters"
# Where an expected error stands relative to the title error, by field order.
_BASE = "CASE c_custkey % {k} ".format(k=_K) + " ".join(f"WHEN {i} THEN {quote(c[1])}" for i, c in enumerate(_CASES)) + " END"
_AFTER = [i for i, c in enumerate(_CASES) if "additional" in c[1] or "metadata" in c[1]]
_STOPS = [i for i, c in enumerate(_CASES) if c[1].startswith(("Incompatible", "Invalid JSON"))]
_IS_LONG = "(c_custkey % 13 = 0)"
_ERRORS_SQL = (
    f"CASE WHEN NOT {_IS_LONG} OR c_custkey % {_K} IN ({', '.join(map(str, _STOPS))}) THEN base WHEN base = '' THEN {quote(_LONG)} "
    f"WHEN c_custkey % {_K} IN ({', '.join(map(str, _AFTER))}) THEN {quote(_LONG + ';')} || base ELSE base || {quote(';' + _LONG)} END"
)


@register(
    f"WITH b AS (SELECT c_custkey, {_BASE} AS base FROM customer), e AS (SELECT c_custkey, {_ERRORS_SQL} AS errors FROM b) "
    f"SELECT c_custkey, errors = '' AS is_valid, errors, CASE c_custkey % {_K} WHEN 3 THEN 'Migrated schema from 1.0 to 1.0.0' "
    "WHEN 4 THEN 'No schema version found, assuming 1.0.0' ELSE '' END AS warnings, CASE WHEN errors = '' THEN '1.0.0' END AS schema_version FROM e"
)
def validate_strict(spark, folder):
    """Errors per profile, in field order."""
    out = V.validate(_profile_json(spark, folder), "j", strict=True)
    return out.select(
        "c_custkey", "is_valid", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "schema_version"
    )


_LENIENT_OK = [i for i, c in enumerate(_CASES) if c[2]]


@register(
    f"SELECT c_custkey, c_custkey % {_K} IN ({', '.join(map(str, _LENIENT_OK))}) AND (NOT {_IS_LONG}) AS is_valid, "
    f"CASE WHEN c_custkey % {_K} = 7 AND NOT {_IS_LONG} THEN 'Removed invalid field: ' || {quote(_CASES[7][1])} WHEN c_custkey % {_K} = 2 AND NOT {_IS_LONG} THEN {quote(_CASES[2][1])} "
    f"WHEN c_custkey % {_K} = 3 THEN 'Migrated schema from 1.0 to 1.0.0' WHEN c_custkey % {_K} = 4 THEN 'No schema version found, assuming 1.0.0' ELSE '' END AS warnings FROM customer"
)
def validate_lenient(spark, folder):
    """Broken top-level fields are dropped with a warning; deeper errors stay errors."""
    out = V.validate(_profile_json(spark, folder), "j", strict=False)
    return out.select("c_custkey", "is_valid", F.array_join("warnings", ";").alias("warnings"))


_CLEAN_SQL = (
    f"WITH p AS (SELECT c_custkey, c_custkey % {_K} AS kind, {_TITLE} AS title, {PROFILE_JSON} AS j, "
    f"c_custkey % {_K} IN ({', '.join(map(str, _LENIENT_OK))}) AND NOT {_IS_LONG} AS is_valid FROM customer) "
)


@register(
    _CLEAN_SQL + "SELECT c_custkey, is_valid, CASE WHEN is_valid THEN '1.0.0' END AS version, CASE WHEN is_valid THEN 'a.pdf' END AS source_file, "
    "CASE WHEN is_valid THEN 0.5::DOUBLE END AS confidence, CASE WHEN is_valid THEN title END AS title, "
    "CASE WHEN is_valid THEN array_to_string(list_sort(list_distinct(list_append(list_filter(json_keys(j), lambda k: kind <> 7 OR k <> 'experience'), 'schema_version'))), ',') END AS fields "
    "FROM p"
)
def cleaned_profiles(spark, folder):
    """The profiles that pass a lenient check, without what it dropped and in the current version, read back field by field."""
    cleaned = V.clean(_profile_json(spark, folder), "j")
    read = profiles_from_json(cleaned, "cleaned")
    return read.select(
        "c_custkey", "is_valid", F.col("profile.schema_version").alias("version"), F.col("profile.source_file").alias("source_file"),
        F.col("profile.metadata.confidence_score").alias("confidence"), F.col("profile.achievements")[0]["title"].alias("title"),
        F.array_join(F.array_sort(F.json_object_keys("cleaned")), ",").alias("fields"),
    )


_TYPED_BAD = "(c_custkey % 13 = 0 OR c_custkey % {k} IN (1, 6, 8, {last}))".format(k=_K, last=_K - 1)


@register(
    f"SELECT c_custkey, NOT {_TYPED_BAD} AS is_valid, CASE WHEN NOT {_TYPED_BAD} THEN '1.0.0' END AS version, CASE WHEN NOT {_TYPED_BAD} THEN c_name END AS title FROM customer"
)
def cleaned_typed_profiles(spark, folder):
    """The same for typed profiles: those read from JSON, where fields of another type are null already."""
    typed = profiles_from_json(_profile_json(spark, folder), "j").drop("read_error")
    out = V.clean_profiles(typed)
    return out.select(
        "c_custkey", "is_valid", F.col("profile.schema_version").alias("version"), F.col("profile.achievements")[0]["title"].alias("title")
    )


@register(
    f"WITH b AS (SELECT c_custkey, {_BASE} AS base FROM customer), e AS (SELECT {_ERRORS_SQL} AS errors FROM b), "
    "x AS (SELECT regexp_replace(unnest(string_split(errors, ';')), '-> \\d+', '-> *', 'g') AS error FROM e WHERE errors <> '') "
    "SELECT error, count(*) AS profiles FROM x GROUP BY 1"
)
def validation_error_counts(spark, folder):
    return V.error_counts(V.profile_errors(_profile_json(spark, folder), "j"))


_NESTED = (
    "concat('{\"a\": {\"b', CAST(c_nationkey AS STRING), '\": {\"', CASE c_custkey % 4 WHEN 0 THEN 'Gender' WHEN 1 THEN 'wage' WHEN 2 THEN 'age' ELSE 'note' END, "
    "'\": {\"c\": {\"nationality\": \"', c_name, '\"}}}}, \"list\": [{\"race\": 1}], \"text\": \"{\\\\\"age\\\\\": 1}\"', CASE WHEN c_custkey % 5 = 0 THEN ', \"marital_status\": null' ELSE '' END, '}')"
)


@register(
    "WITH x AS (SELECT c_custkey, 'additional_sections.a.b' || CAST(c_nationkey AS STRING) || '.' || CASE c_custkey % 4 WHEN 0 THEN 'Gender' WHEN 1 THEN 'wage' WHEN 2 THEN 'age' ELSE 'note' END AS p FROM customer) "
    "SELECT c_custkey, p AS path FROM x WHERE c_custkey % 4 IN (0, 2) UNION ALL SELECT c_custkey, p || '.c.nationality' FROM x "
    "UNION ALL SELECT c_custkey, 'additional_sections.marital_status' FROM x WHERE c_custkey % 5 = 0"
)
def prohibited_keys(spark, folder):
    """Prohibited keys in nested objects, with their paths; lists and strings are not entered."""
    rows = table(spark, folder, "customer").select("c_custkey", F.expr(_NESTED).alias("extra"))
    return V.prohibited_paths(rows, "extra", "c_custkey")


_CONTACT_JSON = "concat('{\"email\": \"a@b.c\", \"', CASE c_custkey % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'birthday' ELSE lower(c_mktsegment) END, '\": \"x\", \"github\": null, \"age\": 3}')"


@register(
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'age' WHEN 1 THEN 'birthday,age' ELSE lower(c_mktsegment) || ',age' END AS disallowed FROM customer"
)
def contact_keys_not_allowed(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", F.expr(_CONTACT_JSON).alias("contact"))
    return rows.select("c_custkey", F.array_join(V.disallowed_contact_keys(F.col("contact")), ",").alias("disallowed"))


@register(
    f"SELECT c_custkey, CASE WHEN c_custkey % {_K} = {_K - 1} THEN 'Invalid JSON' WHEN c_custkey % {_K} IN (5, 7, 9) THEN 'Field of another type' END AS read_error, "
    f"CASE WHEN c_custkey % {_K} <> {_K - 1} THEN {_TITLE} END AS title, CASE WHEN c_custkey % {_K} = 1 THEN 'bad' END AS mail FROM customer"
)
def profiles_read_from_json(spark, folder):
    """Typed profiles from JSON; fields of another type are marked and cost only themselves."""
    out = profiles_from_json(_profile_json(spark, folder), "j")
    return out.select(
        "c_custkey", "read_error", F.col("profile.achievements")[0]["title"].alias("title"), F.col("profile.contact.email").alias("mail")
    )


# ------------------------------------------------------------------ profiles of parsed résumés

_AT = "2024-03-01 12:00:00"


@register(
    f"WITH {RESUMES_CTE}, {plain_ctes()}, b AS (SELECT doc_id, array_to_string(list_filter(ls, lambda s: s <> ''), chr(10)) AS body FROM p_c), "
    f"c AS (SELECT doc_id, {CONTACT_SQL} FROM b), sm AS (SELECT doc_id, {LEAD_SQL} AS summary FROM p_text WHERE section = 'summary'), "
    "x AS (SELECT c.doc_id, email, phone, regexp_extract_all(urls, '\\S+') AS us, coalesce(length(summary), 0) AS n, "
    "phone <> '' AND NOT regexp_matches(regexp_replace(phone, '[\\s()+.-]', '', 'g'), '^\\d{7,15}$') AS bad_phone FROM c LEFT JOIN sm USING (doc_id)) "
    f"SELECT doc_id, {FILE_NAME} AS source_file, 'pdf_heuristic' AS extraction_method, nullif(email, '') AS email, "
    "list_filter(us, lambda u: contains(u, 'github.com'))[1] AS github, list_filter(us, lambda u: NOT regexp_matches(lower(u), 'linkedin\\.com|github\\.com'))[1] AS website, "
    "'2024-03-01T12:00:00.000000' AS generated_at, NOT bad_phone AND n <= 2000 AS is_valid, "
    "array_to_string(list_filter([CASE WHEN bad_phone THEN 'Field ''contact -> phone'': Value error, Invalid phone format' END, "
    "CASE WHEN n > 2000 THEN 'Field ''summary -> text'': String should have at most 2000 characters' END], lambda e: e IS NOT NULL), ';') AS errors FROM x"
)
def profiles_of_resumes(spark, folder):
    """Parse, build the profile and check it as it is."""
    parsed = parse.parse_plain(resumes(spark, folder), boundary="ascii", limits=X.PUBLISHED_LIMITS)
    path = F.concat(F.lit("/in/2024/"), F.expr(FILE_NAME))
    built = P.with_profiles(parsed, path, F.lit(_AT).cast("timestamp"))
    checked = V.validate_profiles(built.select("doc_id", "profile"))
    read = lambda p: F.col(f"profile.{p}")
    return checked.select(
        "doc_id", read("source_file").alias("source_file"), read("extraction_method").alias("extraction_method"),
        read("contact.email").alias("email"), read("contact.github").alias("github"), read("contact.website").alias("website"),
        F.date_format(read("generated_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("generated_at"), "is_valid", F.array_join("errors", ";").alias("errors"),
    )


# the order date in each form that is recognised, and one that is not
_WRITTEN_DATE = (
    "CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 1 THEN date_format(o_orderdate, 'M/yyyy') WHEN 2 THEN date_format(o_orderdate, 'yyyy') "
    "WHEN 3 THEN date_format(o_orderdate, ' yyyy-M-d ') WHEN 4 THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE concat('Spring ', date_format(o_orderdate, 'yyyy')) END"
)
_PARSER_JSON = (
    "concat('{\"extraction_method\": \"m\", \"file_path\": \"/home/u/', CAST(o_orderkey AS STRING), '.docx\", \"sections\": {\"contact\": {\"name\": \"', o_orderpriority, '\"}, \"summary\": ', "
    "CASE o_orderkey % 3 WHEN 0 THEN '\"plain\"' WHEN 1 THEN '{\"text\": \"t\", \"objective\": \"o\"}' ELSE 'null' END, ', \"experience\": [{\"title\": \"T', CAST(o_custkey AS STRING), '\", \"company\": \"C\", "
    "\"dates\": {\"start\": \"', " + _WRITTEN_DATE + ", '\", \"end\": \"\"}}, \"noise\"], \"education\": [{\"school\": \"S\", \"major\": \"', o_orderstatus, '\", \"year\": \"2001\"}], "
    "\"skills\": [\"SQL\", {\"name\": \"Go\", \"category\": \"cloud\"}, 7], \"projects\": [{\"title\": \"P\", \"link\": \"u\"}, {}], \"achievements\": [\"A\", {\"name\": \"B\", \"issuer\": \"I\", \"date\": \"2019\"}]}, "
    "\"metadata\": {\"confidence_score\": 0.25}, \"warnings\": [\"w1\", \"w2\"]}')"
)


@register(
    "SELECT o_orderkey, CAST(o_orderkey AS STRING) || '.docx' AS source_file, o_orderpriority AS full_name, CASE o_orderkey % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 't' END AS summary, "
    "'T' || CAST(o_custkey AS STRING) AS \"position\", CASE WHEN o_orderkey % 6 < 2 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') "
    "WHEN o_orderkey % 6 = 2 THEN strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'Spring ' || strftime(o_orderdate, '%Y') END AS start_date, CAST(1 AS BIGINT) AS jobs, 'S' AS institution, o_orderstatus AS field_of_study, '2001' AS edu_dates, "
    "'SQL,Go' AS skills, 'P:u,Unnamed Project:' AS projects, 'A:,B:I' AS achievements, 0.25::DOUBLE AS confidence, 'docx' AS file_type, "
    "CAST(1 + CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END + 1 + 1 + 2 AS BIGINT) AS size FROM orders"
)
def profiles_of_parser_json(spark, folder):
    """Profiles from foreign parser JSON with field synonyms and mixed lists."""
    rows = spread(table(spark, folder, "orders")).select("o_orderkey", F.expr(_PARSER_JSON).alias("j"))
    p = rows.withColumn("p", P.profile_of_json(F.col("j"), F.lit(_AT).cast("timestamp")))
    pair = lambda xs, a, b: F.array_join(F.transform(xs, lambda x: F.concat(x[a], F.lit(":"), F.coalesce(x[b], F.lit("")))), ",")
    return p.select(
        "o_orderkey", "p.source_file", "p.contact.full_name", F.col("p.summary.text").alias("summary"),
        F.col("p.experience")[0]["position"].alias("position"), F.col("p.experience")[0]["dates"]["start_date"].alias("start_date"),
        F.size("p.experience").cast("long").alias("jobs"), F.col("p.education")[0]["institution"].alias("institution"),
        F.col("p.education")[0]["field_of_study"].alias("field_of_study"), F.col("p.education")[0]["dates"]["raw_date_text"].alias("edu_dates"),
        F.array_join(F.transform("p.skills", lambda s: s["name"]), ",").alias("skills"), pair(F.col("p.projects"), "name", "url").alias("projects"),
        pair(F.col("p.achievements"), "title", "organization").alias("achievements"), F.col("p.metadata.confidence_score").alias("confidence"),
        F.col("p.metadata.file_type").alias("file_type"), P.profile_size(F.col("p")).alias("size"),
    )

