"""Shared pieces of the registered queries and of their DuckDB counterparts.

Expressions written as text here (file names, résumé texts, metric kinds) use the SQL that
Spark and DuckDB have in common, so both engines derive their input from the given tables
with the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.functions.text import WHITESPACE
from vitaframe.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a query under its function name, with the SQL that gives the same rows."""

    def wrap(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


# ------------------------------------------------------------------ SQL building blocks

WS = "'" + WHITESPACE + "'"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip_sql(c: str) -> str:
    return f"trim({c}, {WS})"


def lines_sql(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda s: {strip_sql('s')}), lambda s: s <> '')"


def join_sql(items: str, mark: str) -> str:
    return f"coalesce(array_to_string({items}, {mark}), '')"


def replace_hashed_sql(c: str, label: str, pattern: str) -> str:
    p = quote(pattern)
    mark = f"'{label}_[' || substr(sha256(z[2]), 1, 8) || ']'"
    woven = (
        f"list_transform(list_zip(string_split_regex({c}, {p}), regexp_extract_all({c}, {p}, 0)), "
        f"lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE {mark} END)"
    )
    return f"CASE WHEN regexp_matches({c}, {p}) THEN array_to_string({woven}, '') ELSE {c} END"


# ------------------------------------------------------------------ derived input

FILE_NAME = (
    "concat('cv_', CAST(doc_id AS STRING), CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.txt' "
    "WHEN 3 THEN '.jpg' WHEN 4 THEN '.v2.pdf' WHEN 5 THEN '.text' WHEN 6 THEN '' ELSE '.doc' END)"
)
FILE_SIZE = "CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars * CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 700 WHEN 2 THEN 9000 WHEN 3 THEN 30 ELSE 600000 END END"

_NAME = (
    "CASE doc_id % 5 WHEN 0 THEN 'Ana Silva' WHEN 1 THEN 'Bo Chen' WHEN 2 THEN 'Carla Reyes' "
    "WHEN 3 THEN 'Dev Patel' ELSE 'Eva Novak' END"
)
_MAIL = (
    "CASE WHEN doc_id % 3 = 0 THEN 'no mail given' ELSE concat('Mail: user', CAST(doc_id AS STRING), '@mail', "
    "CAST(doc_id % 7 AS STRING), '.example.com') END"
)
_PHONE = (
    "CASE WHEN doc_id % 4 = 0 THEN 'no phone' ELSE concat('Phone: +1 (555) ', lpad(CAST(doc_id % 1000 AS STRING), 3, '0'), "
    "'-', lpad(CAST(doc_id * 7 % 10000 AS STRING), 4, '0')) END"
)
_LINK = (
    "CASE doc_id % 4 WHEN 0 THEN concat('see https://github.com/dev', CAST(doc_id AS STRING)) WHEN 1 THEN 'www.person.dev' "
    "WHEN 2 THEN concat('https://linkedin.com/in/p', CAST(doc_id AS STRING), ' and http://a.example.org/x') ELSE 'no link' END"
)
_JOBS = (
    "CASE doc_id % 4 "
    "WHEN 0 THEN concat_ws(chr(10), 'Senior Engineer, Acme Corp', '2015 - 2019 in Lisbon', '• Developed pipelines', "
    "'led a team of five', '', 'Data Analyst | Data Ltd', 'Jan 2012 to Mar 2014', '* cleaned tables', 'Reports and plots') "
    "WHEN 1 THEN concat_ws(chr(10), 'Consultant - Self', '2020 – present', 'Managed clients', '', '', 'Intern', 'Bluebird Inc', "
    "'3/4/2018', '+ made coffee') "
    "WHEN 2 THEN concat_ws(chr(10), 'Globex company 2011 2013', 'Built things', 'x', '12', 'Implemented more things', "
    "'Manager', '2009 until present day', 'others too') "
    "ELSE concat_ws(chr(10), 'short', 'Lead Developer, 2016 - 2018', 'Initech LLC', '- improved latency 2017', "
    "'- collaborated widely') END"
)
_SCHOOLS = (
    "CASE doc_id % 3 "
    "WHEN 0 THEN concat_ws(chr(10), 'Bachelor of Science, State University 2014', 'Honors program', 'MSc Tech Institute', '2016') "
    "WHEN 1 THEN concat_ws(chr(10), 'general notes', 'PhD Physics', 'Ocean College, 1999', 'Thesis on waves', 'M.A. History 2003') "
    "ELSE concat_ws(chr(10), 'Self taught', 'Some School of Arts, 2021') END"
)
SKILL_TEXT = (
    "CASE doc_id % 4 "
    "WHEN 0 THEN concat_ws(chr(10), 'Skills: Python 3, ReactJS; K8s | Knowledge of SQL', 'Technologies: C++, golang - Rust', 'x, Java 11') "
    "WHEN 1 THEN concat_ws(chr(10), 'AWS, .NET, Spring Framework', '• React.js • react js • Project planning', 'tool: Risk Management (senior)') "
    "WHEN 2 THEN concat_ws(chr(10), 'Technology: proficient in Postgres database, MongoDB, mongo', 'web apis, JSON, java-script') "
    "ELSE concat_ws(chr(10), 'tools: Docker, docker, CI/CD, Linux 5.4, teamwork!', 'a very long skill name that goes on and on and on until it is cut') END"
)
_PROJECTS = (
    "CASE doc_id % 3 "
    "WHEN 0 THEN concat_ws(chr(10), 'Weather Station', 'measures rain and wind', 'with sensors', '', 'Chess Engine', 'plays chess') "
    "WHEN 1 THEN concat_ws(chr(10), 'tiny', '', '', 'Photo Archive for Families', 'sorts pictures') "
    "ELSE 'One line project description' END"
)
_AWARDS = "CASE doc_id % 2 WHEN 0 THEN concat_ws(chr(10), '- Best paper 2015 - runner up', '• ok', 'Employee of the year') ELSE 'Dean list * Marathon finisher' END"

# One résumé around the whole text of each document.
RESUME_TEXT = (
    f"concat_ws(chr(10), {_NAME}, {_MAIL}, {_PHONE}, {_LINK}, '7', "
    "CASE doc_id % 3 WHEN 0 THEN 'Professional Summary' WHEN 1 THEN 'PROFILE' ELSE 'About' END, text, "
    f"'Work  Experience', {_JOBS}, 'EDUCATION', {_SCHOOLS}, 'Technical  Skills:', {SKILL_TEXT}, "
    f"'Key Projects', {_PROJECTS}, 'Awards', {_AWARDS}, 'Experience', 'Freelance since 2022 to present, many short jobs', "
    "concat('References of document ', CAST(doc_id AS STRING)))"
)
# Which lines of it stand out in bold, for the styled extractor.
BOLD_LINE = "^(Professional Summary|About|Work  Experience|Technical  Skills:|Key Projects|Awards|Experience|Ana Silva)$"


def resumes(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text``: a résumé around the whole text of every document."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.expr(RESUME_TEXT).alias("text"))


def styled_resumes(spark: SparkSession, folder: str) -> DataFrame:
    """The same résumés as arrays of paragraphs with a bold flag."""
    paragraphs = F.transform(
        F.split("text", "\n"), lambda x: F.struct(x.alias("text"), x.rlike(BOLD_LINE).alias("is_bold"))
    )
    return resumes(spark, folder).select("doc_id", paragraphs.alias("paragraphs"))


METRIC_TYPE = (
    "CASE event_type WHEN 'error' THEN 'parse_failure' WHEN 'purchase' THEN 'parse_success' WHEN 'view' THEN 'parse_duration' "
    "WHEN 'click' THEN 'sections_extracted' ELSE 'upload_size' END"
)
TRACE_ID = "concat('t', CAST(event_id - event_id % 5 AS STRING))"
FORMAT = "CASE event_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'txt' END"
AS_OF = "2024-01-31 00:00:00"


def metric_events(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table read as metric events."""
    return as_metric_events(table(spark, folder, "events"))


def as_metric_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr(METRIC_TYPE).alias("metric_type"),
        "value",
        F.expr(
            f"CASE WHEN event_type = 'signup' THEN map('trace_id', {TRACE_ID}, 'format', {FORMAT}) "
            f"WHEN event_type = 'error' THEN map('trace_id', {TRACE_ID}, 'error_type', concat('E', CAST(user_id % 7 AS STRING))) "
            f"ELSE map('trace_id', {TRACE_ID}) END"
        ).alias("labels"),
        F.expr(
            "CASE WHEN event_type = 'purchase' THEN map('sections_count', CAST(event_id % 8 AS DOUBLE), 'skills_count', "
            "CAST(event_id % 23 AS DOUBLE), 'warnings_count', CAST(event_id % 4 AS DOUBLE)) "
            "ELSE CAST(map() AS map<string,double>) END"
        ).alias("metadata"),
    )


METRIC_CTE = (
    f"me AS (SELECT event_id, ts, value, user_id, {METRIC_TYPE} AS metric_type, {TRACE_ID} AS trace_id, {FORMAT} AS format, "
    "event_id % 8 AS sections, event_id % 23 AS skills, event_id % 4 AS warnings FROM events)"
)
