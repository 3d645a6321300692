"""Queries over whole texts: redaction, contacts, lines, casing, encryption."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaframe.functions import crypto, redact
from vitaframe.functions import extract as X
from vitaframe.functions import sections as S
from vitaframe.functions import text as T
from vitaframe.queries.base import (
    join_sql,
    lines_sql,
    quote,
    register,
    replace_hashed_sql,
    strip_sql,
)
from vitaframe.sources.documents import line_rows
from vitaframe.sources.tables import spread, table


def _docs(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def _rx(kind: str) -> str:
    pattern, ignore_case = redact.PII_PATTERNS[kind]
    return ("(?i)" if ignore_case else "") + pattern


def redact_sql(source: str, key: str, order=redact.SEQUENTIAL, column: str = "text") -> str:
    steps = [f"s0 AS (SELECT {key}, {column} AS t FROM {source})"]
    for i, kind in enumerate(order, 1):
        steps.append(f"s{i} AS (SELECT {key}, {replace_hashed_sql('t', kind, _rx(kind))} AS t FROM s{i - 1})")
    last = f"s{len(order)}"
    # User paths: the folder before the name is kept.
    path = quote("(?i)" + redact.USER_PATH)
    user = f"regexp_extract(z[2], {path}, 1)"
    woven = (
        f"list_transform(list_zip(string_split_regex(t, {path}), regexp_extract_all(t, {path}, 0)), lambda z: z[1] || "
        f"CASE WHEN z[2] IS NULL THEN '' ELSE replace(z[2], {user}, 'user_[' || substr(sha256({user}), 1, 8) || ']') END)"
    )
    steps.append(
        f"done AS (SELECT {key}, CASE WHEN regexp_matches(t, {path}) THEN array_to_string({woven}, '') ELSE t END AS redacted FROM {last})"
    )
    return "WITH " + ", ".join(steps)


@register(redact_sql("documents", "doc_id") + " SELECT doc_id, redacted FROM done")
def redact_documents(spark, folder):
    """All personal data patterns, one after the other, over the whole text."""
    return _docs(spark, folder).select("doc_id", redact.redact_text(F.col("text"), boundary="ascii").alias("redacted"))


@register(redact_sql("documents", "doc_id", redact.SPECIFIC_FIRST) + " SELECT doc_id, redacted FROM done")
def redact_documents_specific_first(spark, folder):
    """The same patterns, narrow ones first."""
    text = redact.redact_text(F.col("text"), redact.SPECIFIC_FIRST, "ascii")
    return _docs(spark, folder).select("doc_id", text.alias("redacted"))


@register(
    "SELECT doc_id, "
    + ", ".join(f"CAST(len(regexp_extract_all(text, {quote(_rx(k))})) AS BIGINT) AS n_{k}" for k in redact.SEQUENTIAL)
    + " FROM documents"
)
def count_personal_data(spark, folder):
    """Matches of each pattern kind in the untouched text."""
    counts = [redact.count_matches(F.col("text"), k, "ascii").alias(f"n_{k}") for k in redact.SEQUENTIAL]
    return _docs(spark, folder).select("doc_id", *counts)


@register(
    redact_sql("conversations", "conv_id, turn, role")
    + ", named AS (SELECT *, 'User ' || CAST(conv_id AS STRING) AS full_name, 'u' || CAST(conv_id % 9 AS STRING) || '@x.example.com' AS email "
    "FROM done) SELECT conv_id, turn, role, 'name_[' || substr(sha256(full_name), 1, 8) || ']' AS full_name, "
    "'email_[' || substr(sha256(email), 1, 8) || ']' AS mail, CASE WHEN conv_id % 11 = 0 THEN '' ELSE 'phone_[' || "
    "substr(sha256('555 0' || CAST(conv_id AS STRING)), 1, 8) || ']' END AS phone, redacted AS note, redacted AS first_remark, true AS _pii_redacted FROM named"
)
def redact_nested_events(spark, folder):
    """Log-like rows with structs, maps and arrays: personal fields become placeholders, other
    strings are searched, the rest stays."""
    talk = spread(table(spark, folder, "conversations"))
    nested = talk.select(
        "conv_id",
        "turn",
        "role",
        F.struct(
            F.concat(F.lit("User "), F.col("conv_id").cast("string")).alias("full_name"), F.col("text").alias("note")
        ).alias("who"),
        F.create_map(
            F.lit("email"), F.expr("concat('u', CAST(conv_id % 9 AS STRING), '@x.example.com')"),
            F.lit("phone"), F.expr("CASE WHEN conv_id % 11 = 0 THEN '' ELSE concat('555 0', CAST(conv_id AS STRING)) END"),
        ).alias("labels"),
        F.array(F.struct(F.col("text").alias("remark"))).alias("remarks"),
    )
    masked = redact.redact_log_events(nested, keep=("conv_id", "turn", "role"), boundary="ascii")
    return masked.select(
        "conv_id", "turn", "role", "who.full_name", F.col("labels")["email"].alias("mail"),
        F.col("labels")["phone"].alias("phone"), "who.note", F.col("remarks")[0]["remark"].alias("first_remark"), "_pii_redacted",
    )


@register(
    "SELECT c_custkey, 'name_[' || substr(sha256(c_name), 1, 8) || ']' AS c_name, "
    "CASE WHEN c_nationkey = 0 THEN '0' ELSE 'pii_[' || substr(sha256(CAST(c_nationkey AS STRING)), 1, 8) || ']' END AS c_nationkey, "
    "c_acctbal, c_mktsegment FROM customer"
)
def redact_fields_by_name(spark, folder):
    """Column names decide: ``c_name`` holds *name*, ``c_nationkey`` holds *key*."""
    return redact.redact_frame(table(spark, folder, "customer"), keep=("c_custkey",), boundary="ascii")


@register(
    "WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{e}') AS es, regexp_extract(text, '{p}') AS ph, "
    "regexp_extract_all(text, '{u}') AS us FROM documents) "
    "SELECT doc_id, es[1] AS email, CAST(len(es) AS BIGINT) AS emails, CASE WHEN ph <> '' THEN {ps} END AS phone, "
    "{ul} AS urls FROM d".format(e=X.EMAIL, p=X.PHONE, u=X.URL, ps=strip_sql("ph"), ul=join_sql("us[1:3]", "' '"))
)
def document_contacts(spark, folder):
    """First mail, first phone and first three links of every text."""
    text = F.col("text")
    found = _docs(spark, folder).select(
        "doc_id", X.contact(text, "ascii").alias("c"), F.size(X.emails(text, "ascii")).cast("long").alias("emails")
    )
    return found.select("doc_id", "c.email", "emails", "c.phone", F.array_join("c.urls", " ").alias("urls"))


@register(
    "WITH p AS (SELECT page_id, regexp_extract_all(url || ' ' || html, '{u}') AS us, regexp_extract_all(html, '{e}') AS es, "
    "regexp_extract_all(html, '{p}') AS ps FROM pages) SELECT page_id, CAST(len(us) AS BIGINT) AS n_urls, {j} AS urls, "
    "CAST(len(es) AS BIGINT) AS n_emails, CAST(len(ps) AS BIGINT) AS n_phones FROM p".format(
        u=X.URL, e=X.EMAIL, p=X.PHONE, j=join_sql("us[1:3]", "' '")
    )
)
def page_links(spark, folder):
    """Links, mails and phones in raw pages."""
    pages = spread(table(spark, folder, "pages"))
    whole = F.concat_ws(" ", "url", "html")
    return pages.select(
        "page_id",
        F.size(X.urls(whole, "ascii")).cast("long").alias("n_urls"),
        F.array_join(X.first_urls(whole, "ascii"), " ").alias("urls"),
        F.size(X.emails(F.col("html"), "ascii")).cast("long").alias("n_emails"),
        F.size(X.phones(F.col("html"), "ascii")).cast("long").alias("n_phones"),
    )


_ASCII_WS = r"[ \t\n\x0B\f\r]"


@register(
    "SELECT doc_id, regexp_replace(regexp_replace({s}, '{w}+', ' ', 'g'), '^[•\\-*+]{w}*', '') AS cleaned, {j} AS lead FROM documents".format(
        s=strip_sql("text"),
        w=_ASCII_WS,
        j=join_sql(
            f"list_filter(list_transform(string_split(text, '.')[1:5], lambda s: {strip_sql('s')}), lambda s: length(s) > 10)",
            "'. '",
        ),
    )
)
def document_summaries(spark, folder):
    """Summary texts: squeezed to one line, and the first sentences."""
    return _docs(spark, folder).select(
        "doc_id",
        X.clean_summary(F.col("text"), "ascii").alias("cleaned"),
        X.lead_sentences(F.col("text")).alias("lead"),
    )


@register(
    f"WITH l AS (SELECT doc_id, {lines_sql('text')} AS ls FROM documents) "
    "SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line FROM l"
)
def document_lines(spark, folder):
    """Stripped non-empty lines of every text."""
    return line_rows(_docs(spark, folder))


def clean_page_sql(c: str) -> str:
    """Lines of the cleaned text, blank ones kept as separators but for the ends."""
    line = "trim(regexp_replace(s, ' {2,}', ' ', 'g'), %s)" % strip_sql("s")[len("trim(s, ") : -1]
    kept = (
        f"list_filter(list_transform(string_split({c}, chr(10)), lambda s: {line}), "
        "lambda s: s = '' OR (length(s) >= 2 AND NOT regexp_full_match(s, '[0-9]+')))"
    )
    return f"string_split(trim(array_to_string({kept}, chr(10)), chr(10)), chr(10))"


@register(
    f"WITH l AS (SELECT doc_id, {clean_page_sql('text')} AS ls FROM documents) SELECT doc_id, array_to_string(ls, chr(10)) AS cleaned, "
    "array_to_string(list_filter(ls, lambda s: s <> ''), chr(10)) AS dense FROM l"
)
def cleaned_page_text(spark, folder):
    """Squeezed blanks, no page numbers, no one-character lines."""
    return _docs(spark, folder).select(
        "doc_id",
        S.clean_page_text(F.col("text"), True, "ascii").alias("cleaned"),
        S.clean_page_text(F.col("text"), False, "ascii").alias("dense"),
    )


@register(
    "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(s), '[a-z]+|[^a-z]+'), "
    "lambda r: upper(r[1]) || r[2:]), '') AS title FROM (SELECT p_partkey, p_name || '-' || p_brand || '''s ' || p_type || '2x' AS s FROM part)"
)
def title_case_names(spark, folder):
    """Every run of letters starts with a capital: ``o'neil-c3po`` -> ``O'Neil-C3Po``."""
    parts = table(spark, folder, "part")
    raw = F.concat("p_name", F.lit("-"), "p_brand", F.lit("'s "), "p_type", F.lit("2x"))
    return parts.select("p_partkey", T.title_case(raw).alias("title"))


@register(
    "SELECT doc_id, {j} AS terms FROM (SELECT doc_id, list_transform(list_filter([{t}], lambda t: contains(lower(text), t))[1:10], "
    "lambda t: upper(t[1]) || t[2:]) AS ts FROM documents)".format(
        t=", ".join(quote(t) for t in X.TECH_TERMS), j=join_sql("ts", "', '")
    )
)
def technology_terms(spark, folder):
    """Known technology terms anywhere in a text, for documents without sections."""
    return _docs(spark, folder).select("doc_id", F.array_join(X.tech_terms(F.col("text")), ", ").alias("terms"))


# ------------------------------------------------------------------ checksums and encryption


def _test_key():
    # A key for checking round trips on test data only.
    return F.unhex(F.sha2(F.lit("key for round trip checks"), 256))


@register("SELECT doc_id, sha256(text) AS checksum FROM documents")
def document_checksums(spark, folder):
    return _docs(spark, folder).select("doc_id", crypto.checksum(F.col("text")).alias("checksum"))


@register("SELECT conv_id, turn, text AS restored, text AS plain_read FROM conversations")
def encrypted_columns_read_back(spark, folder):
    """Encrypt, decrypt; and read a column that was never encrypted through the same path."""
    talk = table(spark, folder, "conversations")
    sealed = crypto.encrypt_columns(talk.withColumn("sealed", F.col("text")), ["sealed"], _test_key())
    return sealed.select(
        "conv_id",
        "turn",
        crypto.decrypt_or_plain(F.col("sealed"), _test_key()).cast("string").alias("restored"),
        crypto.decrypt_or_plain(F.col("text").cast("binary"), _test_key()).cast("string").alias("plain_read"),
    )


@register("SELECT count(*) AS values_checked, CAST(0 AS BIGINT) AS values_broken, true AS healthy FROM conversations WHERE text IS NOT NULL")
def encryption_round_trip(spark, folder):
    return crypto.round_trip_check(table(spark, folder, "conversations"), "text", _test_key())


@register(
    "SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS original_size, CAST(strlen(text) + 28 AS BIGINT) AS encrypted_size, "
    "sha256(text) AS source_hash, 'AES-GCM' AS algorithm FROM conversations"
)
def encryption_sizes(spark, folder):
    report = crypto.encryption_report(table(spark, folder, "conversations"), "text", _test_key())
    return report.select("conv_id", "turn", "original_size", "encrypted_size", "source_hash", "algorithm")
