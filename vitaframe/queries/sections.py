"""Queries over résumés derived from the documents: sections, extraction, parse results."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaframe.functions import extract as X
from vitaframe.functions import files as N
from vitaframe.functions import sections as S
from vitaframe.functions.text import human_size, strip
from vitaframe.operators import lines as L
from vitaframe.operators import quality
from vitaframe.plans import parse
from vitaframe.queries.base import (
    BOLD_LINE,
    FILE_NAME,
    FILE_SIZE,
    RESUME_TEXT,
    join_sql,
    lines_sql,
    quote,
    register,
    resumes,
    strip_sql,
    styled_resumes,
)
from vitaframe.queries.text import clean_page_sql
from vitaframe.sources import documents as D
from vitaframe.sources.tables import spread, table

# ------------------------------------------------------------------ the same in SQL


def label_sql(line: str, sections) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({line}, {quote('(?i)' + '|'.join(S.SECTION_PATTERNS[s]))}) THEN '{s}'" for s in sections
    )
    return f"CASE {cases} END"


RESUMES_CTE = f"r AS (SELECT doc_id, {RESUME_TEXT} AS text FROM documents)"


def plain_ctes(source: str = "r", last_line: bool = False) -> str:
    """``p_content(doc_id, section, i, line)`` with blank separators, and ``p_headers``."""
    header = f"CASE WHEN regexp_matches(line, '^\\S+(?:\\s+\\S+){{0,4}}$') THEN {label_sql('line', S.PLAIN_SECTIONS)} END"
    return (
        f"p_c AS (SELECT doc_id, {clean_page_sql('text')} AS ls FROM {source}), "
        "p_l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line, len(ls) AS n FROM p_c), "
        f"p_h AS (SELECT *, {header} AS header FROM p_l), "
        "p_s AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM p_h), "
        "p_headers AS (SELECT doc_id, header, i FROM p_h WHERE header IS NOT NULL), "
        "p_content AS (SELECT doc_id, section, i, line FROM p_s WHERE header IS NULL AND section IS NOT NULL "
        f"AND i {'<=' if last_line else '<'} n), "
        "p_text AS (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY i) AS t, "
        "coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), '') AS d FROM p_content GROUP BY 1, 2)"
    )


def styled_ctes(source: str = "r") -> str:
    """``s_content(doc_id, section, i, line)`` and ``s_text``."""
    header = (
        f"CASE WHEN length(line) <= 50 AND (bold OR (upper(line) = line AND lower(line) <> line)) "
        f"THEN {label_sql('line', S.STYLED_SECTIONS)} END"
    )
    return (
        "s_raw AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS raw FROM "
        f"(SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source})), "
        f"s_l AS (SELECT doc_id, i, {strip_sql('raw')} AS line, regexp_matches(raw, {quote(BOLD_LINE)}) AS bold FROM s_raw), "
        f"s_h AS (SELECT *, {header} AS header FROM s_l WHERE line <> ''), "
        "s_s AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM s_h), "
        "s_headers AS (SELECT doc_id, header, i FROM s_h WHERE header IS NOT NULL), "
        "s_content AS (SELECT doc_id, section, i, line, row_number() OVER (PARTITION BY doc_id, section ORDER BY i) AS k, "
        "count(*) OVER (PARTITION BY doc_id, section) AS n FROM s_s WHERE header IS NULL AND section IS NOT NULL), "
        "s_text AS (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY i) AS t FROM s_content GROUP BY 1, 2)"
    )


def styled_entries(section: str, starts: str, shortest: int) -> str:
    """``e(doc_id, entry, ls)``: entries of a section, opened by lines that meet ``starts``."""
    return (
        f"e0 AS (SELECT doc_id, k, line, sum(CASE WHEN k > 1 AND {starts} THEN 1 ELSE 0 END) OVER "
        f"(PARTITION BY doc_id ORDER BY k) AS g FROM s_content WHERE section = '{section}'), "
        "e1 AS (SELECT doc_id, g, list(line ORDER BY k) AS ls FROM e0 GROUP BY 1, 2), "
        "e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS entry, ls FROM e1 "
        f"WHERE length(array_to_string(ls, chr(10))) >= {shortest})"
    )


def plain_entries(section: str, shortest: int, cap: int | None) -> str:
    """``e(doc_id, entry, ls)``: entries between blank lines."""
    pieces = (
        f"list_filter(list_transform(string_split_regex(t, '\\n\\n+'), lambda s: {strip_sql('s')}), "
        f"lambda s: length(s) >= {shortest})" + (f"[1:{cap}]" if cap else "")
    )
    return (
        f"e0 AS (SELECT doc_id, {pieces} AS es FROM p_text WHERE section = '{section}'), "
        "e1 AS (SELECT doc_id, generate_subscripts(es, 1) - 1 AS entry, unnest(es) AS x FROM e0), "
        f"e AS (SELECT doc_id, entry, {lines_sql('x')} AS ls FROM e1)"
    )


def any_word_sql(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {quote(w)})" for w in words) + ")"


def date_sql(c: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, {quote('(?i)' + p)}), '')" for p in X.DATE_PATTERNS) + ")"


BULLET_SQL = quote(X.BULLET)


# ------------------------------------------------------------------ sections


def _plain(spark, folder):
    """Résumés cut into plain sections (``_segments``), in their rows."""
    clean = S.clean_page_text(F.col("text"), True, "ascii")
    staged = resumes(spark, folder).select("doc_id", clean.alias("_clean"))
    return staged.select("doc_id", S.plain_segments(F.split("_clean", "\n"), boundary="ascii").alias("_segments"))


def _plain_text(section: str, keep_blank: bool = False):
    items = S.section_items(F.col("_segments"), section)
    return F.array_join(items if keep_blank else F.filter(items, lambda x: x != ""), "\n")


def _styled(spark, folder):
    trimmed = F.transform(
        F.col("paragraphs"), lambda p: F.struct(strip(p["text"]).alias("text"), p["is_bold"].alias("is_bold"))
    )
    staged = styled_resumes(spark, folder).select("doc_id", F.filter(trimmed, lambda p: p["text"] != "").alias("_p"))
    return staged.select("doc_id", S.styled_segments(F.col("_p"), boundary="ascii").alias("_segments"))


def _styled_text(section: str):
    return S.section_text(F.col("_segments"), section)


@register(
    f"WITH {RESUMES_CTE}, {plain_ctes()}, d AS (SELECT doc_id, section, i, line FROM p_content WHERE line <> ''), "
    "n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_no FROM p_l WHERE line <> '') "
    "SELECT d.doc_id, d.section, CAST(n.line_no AS INTEGER) AS line_no, d.line FROM d JOIN n ON d.doc_id = n.doc_id AND d.i = n.i"
)
def section_lines(spark, folder):
    """Lines as rows, labelled with the section they stand in (chunked carry-forward)."""
    dense = S.clean_page_text(F.col("text"), False, "ascii")
    rows = D.line_rows(resumes(spark, folder).select("doc_id", dense.alias("text")))
    return L.section_lines(rows, boundary="ascii", chunk=16)


@register(f"WITH {RESUMES_CTE}, {plain_ctes()} SELECT doc_id, section, d AS text FROM p_text WHERE d <> ''")
def section_texts_from_lines(spark, folder):
    """Section texts put together again from the line rows."""
    return L.section_texts(section_lines(spark, folder))


@register(f"WITH {RESUMES_CTE}, {plain_ctes()} SELECT doc_id, section, d AS text FROM p_text WHERE d <> ''")
def section_texts_in_row(spark, folder):
    """The same texts by the shuffle-free form."""
    texts = F.array(*[F.struct(F.lit(s).alias("section"), _plain_text(s).alias("text")) for s in S.PLAIN_SECTIONS])
    flat = _plain(spark, folder).select("doc_id", F.explode(texts).alias("x")).select("doc_id", "x.*")
    return flat.where("text <> ''")


@register(f"WITH {RESUMES_CTE}, {styled_ctes()} SELECT doc_id, section, t AS text FROM s_text")
def styled_section_texts(spark, folder):
    """Sections of styled paragraphs: short, bold or capitals, and a section word."""
    texts = F.array(*[F.struct(F.lit(s).alias("section"), _styled_text(s).alias("text")) for s in S.STYLED_SECTIONS])
    flat = _styled(spark, folder).select("doc_id", F.explode(texts).alias("x")).select("doc_id", "x.*")
    return flat.where("text <> ''")


@register(
    f"WITH {RESUMES_CTE}, {plain_ctes()}, {styled_ctes()}, "
    "a AS (SELECT doc_id, header, min(i) AS i FROM p_headers GROUP BY 1, 2), "
    "b AS (SELECT doc_id, header, min(i) AS i FROM s_headers GROUP BY 1, 2) "
    "SELECT 'plain' AS kind, doc_id, string_agg(header, ',' ORDER BY i) AS found FROM a GROUP BY 2 "
    "UNION ALL SELECT 'styled', doc_id, string_agg(header, ',' ORDER BY i) FROM b GROUP BY 2"
)
def sections_detected(spark, folder):
    """Which sections have a header, in order of appearance."""
    found = F.array_join(S.sections_found(F.col("_segments")), ",").alias("found")
    plain = _plain(spark, folder).select(F.lit("plain").alias("kind"), "doc_id", found)
    return plain.unionByName(_styled(spark, folder).select(F.lit("styled").alias("kind"), "doc_id", found))


# ------------------------------------------------------------------ jobs


def _job_rows(df, jobs):
    flat = df.select("doc_id", F.posexplode(jobs).alias("entry", "j"))
    return flat.select(
        "doc_id", F.col("entry").cast("long"), "j.title", "j.company", "j.duration",
        F.array_join("j.responsibilities", " / ").alias("responsibilities"),
    )


_SPAN = quote("(?i)" + X.YEAR_SPAN)


@register(
    f"WITH {RESUMES_CTE}, {plain_ctes()}, {plain_entries('experience', 20, X.MAX_JOBS)} "
    f"SELECT doc_id, entry, CASE WHEN {any_word_sql('lower(ls[1])', X.COMPANY_WORDS)} THEN '' ELSE ls[1] END AS title, "
    f"CASE WHEN {any_word_sql('lower(ls[1])', X.COMPANY_WORDS)} THEN ls[1] ELSE '' END AS company, "
    f"coalesce({strip_sql(f'list_filter(list_transform(ls[1:3], lambda x: regexp_extract(x, {_SPAN})), lambda x: x <> {quote(str())})[1]')}, '') AS duration, "
    + join_sql(
        f"list_filter(list_transform(list_filter(ls[2:], lambda x: NOT regexp_matches(x, {quote(X.FOUR_DIGITS)})), "
        f"lambda x: regexp_replace(x, {BULLET_SQL}, '')), lambda x: x <> '')",
        "' / '",
    )
    + " AS responsibilities FROM e"
)
def plain_jobs(spark, folder):
    """Jobs of plain text, one entry per block between blank lines."""
    return _job_rows(_plain(spark, folder), X.plain_jobs(_plain_text("experience", True), "ascii"))


_DUTY = f"(regexp_matches(x, '^[•\\-*+]') OR regexp_matches(lower(x), '^(?:{'|'.join(X.ACTION_VERBS)})'))"


def _part_sql(side: str, mark: str) -> str:
    if side == "before":
        return strip_sql(f"split_part(h, {quote(mark)}, 1)")
    return strip_sql(f"substr(h, strpos(h, {quote(mark)}) + {len(mark)})")


@register(
    f"WITH {RESUMES_CTE}, {styled_ctes()}, "
    + styled_entries("experience", "regexp_matches(line, '^[A-Z]') AND (contains(line, ',') OR k < n)", 10)
    + f", t AS (SELECT *, list_filter(ls, lambda x: NOT {_DUTY}) AS titles, "
    f"list_filter(list_transform(ls, lambda x: {date_sql('x')}), lambda d: d IS NOT NULL) AS dates, "
    f"list_filter(list_transform(list_filter(ls, lambda x: {_DUTY}), lambda x: regexp_replace(x, {BULLET_SQL}, '')), lambda x: x <> '') AS duties FROM e), "
    f"u AS (SELECT *, titles[1] AS h, titles[2] AS h2, {date_sql('titles[1]')} IS NOT NULL AS dated, {date_sql('titles[2]')} IS NOT NULL AS dated2 FROM t), "
    "v AS (SELECT doc_id, entry, coalesce(CASE "
    f"WHEN contains(h, '|') THEN {_part_sql('before', '|')} WHEN contains(h, ' - ') THEN {_part_sql('before', ' - ')} "
    f"WHEN contains(h, ',') AND NOT dated THEN {_part_sql('before', ',')} ELSE h END, '') AS title, coalesce(CASE "
    f"WHEN contains(h, '|') THEN {_part_sql('after', '|')} WHEN contains(h, ' - ') THEN {_part_sql('after', ' - ')} "
    f"WHEN contains(h, ',') AND NOT dated THEN {_part_sql('after', ',')} WHEN NOT dated2 THEN h2 END, '') AS company, "
    f"coalesce(CASE WHEN len(titles) > 0 THEN dates[1] END, '') AS duration, {join_sql('duties', quote(' / '))} AS responsibilities FROM u) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY entry) - 1 AS entry, title, company, duration, responsibilities "
    "FROM v WHERE title <> '' OR company <> '' OR responsibilities <> ''"
)
def styled_jobs(spark, folder):
    """Jobs of styled documents: title, company, first date and duties."""
    return _job_rows(_styled(spark, folder), X.jobs(_styled_text("experience"), "ascii"))


# ------------------------------------------------------------------ education


def _school_rows(df, schools):
    flat = df.select("doc_id", F.posexplode(schools).alias("entry", "s"))
    return flat.select(
        "doc_id", F.col("entry").cast("long"), "s.degree", "s.institution", "s.year",
        F.array_join("s.details", " / ").alias("details"),
    )


_WORD = (
    "CASE "
    + " ".join(f"WHEN contains(lower(ls[1]), '{w}') THEN strpos(lower(ls[1]), '{w}')" for w in X.SCHOOL_WORDS)
    + " END"
)


@register(
    f"WITH {RESUMES_CTE}, {styled_ctes()}, "
    + styled_entries("education", "regexp_matches(line, '^[A-Z].*(?:University|College|Institute|School)')", 5)
    + f", w AS (SELECT *, {_WORD} AS pos, list_filter(list_transform(ls, lambda x: regexp_extract(x, {quote(X.YEAR)})), lambda y: y <> '') AS ys FROM e) "
    f"SELECT doc_id, entry, CASE WHEN pos IS NULL THEN ls[1] ELSE {strip_sql('substr(ls[1], 1, pos - 1)')} END AS degree, "
    f"CASE WHEN pos IS NULL THEN '' ELSE {strip_sql('substr(ls[1], pos)')} END AS institution, coalesce(ys[1], '') AS year, '' AS details FROM w"
)
def styled_education(spark, folder):
    """Education of styled documents, opened by lines that name a school."""
    return _school_rows(_styled(spark, folder), X.schools(_styled_text("education"), "ascii"))


_OPENS = any_word_sql("lower(line)", X.DEGREE_WORDS + X.PLAIN_SCHOOL_WORDS)


@register(
    f"WITH {RESUMES_CTE}, {plain_ctes()}, "
    f"a AS (SELECT doc_id, i, line, {_OPENS} AS opens, sum(CASE WHEN {_OPENS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g "
    "FROM p_content WHERE section = 'education' AND line <> ''), "
    "b AS (SELECT doc_id, g, list(line ORDER BY i) AS ls FROM a WHERE g BETWEEN 1 AND 5 GROUP BY 1, 2) "
    f"SELECT doc_id, CAST(g - 1 AS BIGINT) AS entry, CASE WHEN {any_word_sql('lower(ls[1])', X.DEGREE_WORDS)} THEN ls[1] ELSE '' END AS degree, "
    f"CASE WHEN {any_word_sql('lower(ls[1])', X.PLAIN_SCHOOL_WORDS)} THEN ls[1] ELSE '' END AS institution, "
    f"regexp_extract(ls[1], {quote(X.YEAR)}) AS year, {join_sql('ls[2:]', quote(' / '))} AS details FROM b"
)
def plain_education(spark, folder):
    """Education of plain text: an opening line and the details that follow it."""
    return _school_rows(_plain(spark, folder), X.plain_schools(_plain_text("education"), "ascii"))


# ------------------------------------------------------------------ lists


def _rows(df, items, name):
    return df.select("doc_id", F.posexplode(items).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


def _list_sql(ctes: str, source: str, column: str, section: str, items: str, name: str) -> str:
    return (
        f"WITH {RESUMES_CTE}, {ctes}, x AS (SELECT doc_id, {items.format(t=column)} AS xs FROM {source} WHERE section = '{section}') "
        f"SELECT doc_id, generate_subscripts(xs, 1) - 1 AS pos, unnest(xs) AS {name} FROM x"
    )


def _split_items(text: str, breaks: str, keep: str) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '{breaks}'), lambda s: {strip_sql('s')}), lambda s: length(s) {keep})"


_BREAKS = r"[,;\n|•\-*+]+"


@register(
    _list_sql(plain_ctes(), "p_text", "d", "skills",
              _split_items("regexp_replace({t}, '(?im)^(?:skills?|technologies?):?\\s*', '', 'g')", _BREAKS, "BETWEEN 2 AND 50") + f"[1:{X.MAX_SKILLS}]", "skill")
)
def plain_skills(spark, folder):
    return _rows(_plain(spark, folder), X.plain_skills(_plain_text("skills")), "skill")


@register(
    _list_sql(styled_ctes(), "s_text", "t", "skills",
              _split_items("regexp_replace({t}, '(?i)^(?:skills?|technologies?|tools?):?\\s*', '')", _BREAKS, "BETWEEN 2 AND 49"), "skill")
)
def styled_skills(spark, folder):
    return _rows(_styled(spark, folder), X.skills(_styled_text("skills")), "skill")


@register(
    _list_sql(plain_ctes(), "p_text", "d", "achievements",
              _split_items("{t}", r"[\n•\-*+]+", "BETWEEN 5 AND 200") + f"[1:{X.MAX_AWARDS}]", "award")
)
def plain_achievements(spark, folder):
    return _rows(_plain(spark, folder), X.plain_achievements(_plain_text("achievements")), "award")


@register(_list_sql(styled_ctes(), "s_text", "t", "achievements", _split_items("{t}", r"[\n•\-*+]+", "> 5"), "award"))
def styled_achievements(spark, folder):
    return _rows(_styled(spark, folder), X.achievements(_styled_text("achievements")), "award")


_PROJECT_SQL = f"SELECT doc_id, entry, ls[1] AS name, {join_sql('ls[2:]', quote(' '))} AS description FROM e"


def _project_rows(df, projects):
    flat = df.select("doc_id", F.posexplode(projects).alias("entry", "p"))
    return flat.select("doc_id", F.col("entry").cast("long"), "p.name", "p.description")


@register(f"WITH {RESUMES_CTE}, {plain_ctes()}, {plain_entries('projects', 10, X.MAX_PROJECTS)} {_PROJECT_SQL}")
def plain_projects(spark, folder):
    return _project_rows(_plain(spark, folder), X.plain_projects(_plain_text("projects", True)))


@register(
    f"WITH {RESUMES_CTE}, {styled_ctes()}, {styled_entries('projects', 'regexp_matches(line, ' + quote('^[A-Z]') + ')', 10)} {_PROJECT_SQL}"
)
def styled_projects(spark, folder):
    return _project_rows(_styled(spark, folder), X.projects(_styled_text("projects")))


# ------------------------------------------------------------------ whole results

CONTACT_SQL = (
    f"regexp_extract(body, '{X.EMAIL}') AS email, "
    + strip_sql(f"regexp_extract(body, '{X.PHONE}')")
    + f" AS phone, array_to_string(regexp_extract_all(body, '{X.URL}')[1:3], ' ') AS urls"
)


LEAD_SQL = join_sql(
    f"list_filter(list_transform(string_split(d, '.')[1:5], lambda s: {strip_sql('s')}), lambda s: length(s) > 10)", "'. '"
)


def _contact_out():
    c = F.col("result.sections.contact")
    return [
        F.coalesce(c["email"], F.lit("")).alias("email"),
        F.coalesce(c["phone"], F.lit("")).alias("phone"),
        F.array_join(c["urls"], " ").alias("urls"),
    ]


def _round(c):
    return F.round(c, 4)


@register(
    f"WITH {RESUMES_CTE}, {plain_ctes()}, "
    f"b AS (SELECT doc_id, array_to_string(list_filter(ls, lambda s: s <> ''), chr(10)) AS body FROM p_c), "
    f"c AS (SELECT doc_id, {CONTACT_SQL} FROM b), "
    f"sm AS (SELECT doc_id, {LEAD_SQL} AS summary FROM p_text WHERE section = 'summary'), "
    f"{plain_entries('experience', 20, X.MAX_JOBS)}, j AS (SELECT doc_id, count(*) AS jobs FROM e GROUP BY 1), "
    f"sc AS (SELECT doc_id, least(count(*), 5) AS schools FROM p_content WHERE section = 'education' AND {_OPENS} GROUP BY 1), "
    "sk AS (SELECT doc_id, len("
    + _split_items("regexp_replace(d, '(?im)^(?:skills?|technologies?):?\\s*', '', 'g')", _BREAKS, "BETWEEN 2 AND 50")
    + f"[1:{X.MAX_SKILLS}]) AS skills FROM p_text WHERE section = 'skills') "
    "SELECT c.doc_id, email, phone, urls, coalesce(summary, '') AS summary, coalesce(jobs, 0) AS jobs, coalesce(schools, 0) AS schools, "
    "coalesce(skills, 0) AS skills, CAST(7 AS BIGINT) AS sections_count, "
    "round(least((CASE WHEN email <> '' THEN 0.15 ELSE 0.0 END + CASE WHEN coalesce(summary, '') <> '' THEN 0.1 ELSE 0.0 END + "
    "CASE WHEN jobs > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN schools > 0 THEN 0.15 ELSE 0.0 END + CASE WHEN skills > 0 THEN 0.1 ELSE 0.0 END)::DOUBLE * 0.8::DOUBLE, 0.8::DOUBLE), 4) AS confidence, "
    f"array_to_string([{', '.join(quote(w) for w in X.PDF_WARNINGS)}], ';') || CASE WHEN email = '' THEN {quote(';' + X.NO_PDF_EMAIL)} ELSE '' END AS warnings "
    "FROM c LEFT JOIN sm USING (doc_id) LEFT JOIN j USING (doc_id) LEFT JOIN sc USING (doc_id) LEFT JOIN sk USING (doc_id)"
)
def parse_plain_resumes(spark, folder):
    """Whole plain parse: contact, summary, counts, confidence and warnings per document."""
    parsed = parse.parse_plain(resumes(spark, folder), boundary="ascii", limits=X.PUBLISHED_LIMITS)
    s = F.col("result.sections")
    counts = parse.section_counts(F.col("result"))
    return parsed.select(
        "doc_id",
        *_contact_out(),
        s["summary"].alias("summary"),
        F.size(s["experience"]).cast("long").alias("jobs"),
        F.size(s["education"]).cast("long").alias("schools"),
        counts["skills_count"].alias("skills"),
        counts["sections_count"].alias("sections_count"),
        _round(F.col("result.metadata.confidence_score")).alias("confidence"),
        F.array_join("result.warnings", ";").alias("warnings"),
    )


#: Every resume four times in a row: more entries than the published limits keep.
_LONG_CTE = "long AS (SELECT doc_id, repeat(text || chr(10), 4) AS text FROM r)"


def _kept_sql(name: str, section: str, items: str) -> str:
    return f"{name} AS (SELECT doc_id, len({items}) AS n FROM p_text WHERE section = '{section}')"


@register(
    f"WITH {RESUMES_CTE}, {_LONG_CTE}, {plain_ctes('long', last_line=True)}, {plain_entries('experience', 20, None)}, "
    "j AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1), "
    f"sc AS (SELECT doc_id, count(*) AS n FROM p_content WHERE section = 'education' AND {_OPENS} GROUP BY 1), "
    + _kept_sql("sk", "skills", _split_items("regexp_replace(d, '(?im)^(?:skills?|technologies?):?\\s*', '', 'g')", _BREAKS, "BETWEEN 2 AND 50"))
    + ", "
    + _kept_sql("aw", "achievements", _split_items("d", r"[\n•\-*+]+", "BETWEEN 5 AND 200"))
    + ", "
    + _kept_sql("pr", "projects", _split_items("t", r"\n\n+", ">= 10"))
    + " SELECT long.doc_id, coalesce(j.n, 0) AS jobs, coalesce(sc.n, 0) AS schools, coalesce(sk.n, 0) AS skills, "
    "coalesce(pr.n, 0) AS projects, coalesce(aw.n, 0) AS awards FROM long LEFT JOIN j USING (doc_id) LEFT JOIN sc USING (doc_id) "
    "LEFT JOIN sk USING (doc_id) LEFT JOIN pr USING (doc_id) LEFT JOIN aw USING (doc_id)"
)
def parse_plain_in_full(spark, folder):
    """Plain parse without limits: all entries of long resumes, the last line included."""
    long = resumes(spark, folder).withColumn("text", F.repeat(F.concat("text", F.lit("\n")), F.lit(4)))
    s = F.col("result.sections")
    kept = {"jobs": "experience", "schools": "education", "skills": "skills", "projects": "projects", "awards": "achievements"}
    parsed = parse.parse_plain(long, boundary="ascii")
    return parsed.select("doc_id", *[F.size(s[key]).cast("long").alias(name) for name, key in kept.items()])


@register(
    f"WITH {RESUMES_CTE}, {styled_ctes()}, "
    f"b AS (SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS body FROM s_l WHERE line <> '' GROUP BY 1), c AS (SELECT doc_id, {CONTACT_SQL} FROM b), "
    f"sm AS (SELECT doc_id, regexp_replace(regexp_replace({strip_sql('t')}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), {BULLET_SQL}, '') AS summary FROM s_text WHERE section = 'summary'), "
    + styled_entries("experience", "regexp_matches(line, '^[A-Z]') AND (contains(line, ',') OR k < n)", 10)
    + ", j AS (SELECT doc_id, count(*) AS jobs FROM e GROUP BY 1), ed AS (SELECT DISTINCT doc_id, 1 AS ed FROM s_text WHERE section = 'education' AND length(t) >= 5), "
    "sk AS (SELECT doc_id, len("
    + _split_items("regexp_replace(t, '(?i)^(?:skills?|technologies?|tools?):?\\s*', '')", _BREAKS, "BETWEEN 2 AND 49")
    + ") AS skills FROM s_text WHERE section = 'skills') "
    "SELECT c.doc_id, email, phone, urls, coalesce(summary, '') AS summary, coalesce(skills, 0) AS skills, "
    "round(least(CASE WHEN email <> '' THEN 0.2 ELSE 0.0 END + CASE WHEN coalesce(summary, '') <> '' THEN 0.1 ELSE 0.0 END + CASE WHEN jobs > 0 THEN 0.3 ELSE 0.0 END "
    "+ CASE WHEN ed = 1 THEN 0.2 ELSE 0.0 END + CASE WHEN skills > 0 THEN 0.2 ELSE 0.0 END, 1.0)::DOUBLE, 4) AS confidence, "
    "array_to_string(list_filter([CASE WHEN email = '' THEN 'No email address found' END, CASE WHEN coalesce(jobs, 0) = 0 THEN 'No work experience found' END], "
    "lambda w: w IS NOT NULL), ';') AS warnings "
    "FROM c LEFT JOIN sm USING (doc_id) LEFT JOIN j USING (doc_id) LEFT JOIN ed USING (doc_id) LEFT JOIN sk USING (doc_id)"
)
def parse_styled_resumes(spark, folder):
    """Whole styled parse: contact, summary, skills, confidence and warnings per document."""
    parsed = parse.parse_styled(styled_resumes(spark, folder), boundary="ascii", limits=X.PUBLISHED_LIMITS)
    s = F.col("result.sections")
    return parsed.select(
        "doc_id",
        *_contact_out(),
        s["summary"].alias("summary"),
        F.size(s["skills"]).cast("long").alias("skills"),
        _round(F.col("result.metadata.confidence_score")).alias("confidence"),
        F.array_join("result.warnings", ";").alias("warnings"),
    )


@register(
    f"WITH {plain_ctes('documents')}, has AS (SELECT DISTINCT doc_id, 1 AS content FROM p_content WHERE line <> ''), "
    + "b AS (SELECT doc_id, array_to_string(list_filter(ls, lambda s: s <> ''), chr(10)) AS body FROM p_c), "
    "x AS (SELECT b.doc_id, body, content IS NULL AS loose, regexp_matches(body, '{e}') AS mail, list_transform(list_filter([{t}], "
    "lambda t: contains(lower(body), t))[1:10], lambda t: upper(t[1]) || t[2:]) AS terms FROM b LEFT JOIN has USING (doc_id)) "
    "SELECT doc_id, loose, CASE WHEN loose THEN {j} END AS terms, array_to_string(list_filter([{w}, CASE WHEN loose THEN {n} END, "
    "CASE WHEN loose THEN {l} END, CASE WHEN NOT mail THEN {m} END], lambda w: w IS NOT NULL), ';') AS warnings FROM x".format(
        e=X.EMAIL, t=", ".join(quote(t) for t in X.TECH_TERMS), j=join_sql("terms", "','"),
        w=", ".join(quote(w) for w in X.PDF_WARNINGS), n=quote(X.NO_SECTIONS), l=quote(X.LIMITED), m=quote(X.NO_PDF_EMAIL),
    )
)
def parse_without_sections(spark, folder):
    """Plain parse of the raw documents, most of which have no section headers."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    parsed = parse.parse_plain(docs, boundary="ascii", limits=X.PUBLISHED_LIMITS)
    loose = F.array_contains("result.warnings", X.NO_SECTIONS)
    return parsed.select(
        "doc_id",
        loose.alias("loose"),
        F.when(loose, F.array_join("result.sections.skills", ",")).alias("terms"),
        F.array_join("result.warnings", ";").alias("warnings"),
    )


def _routed(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    named = docs.select(
        "doc_id", "lang", "source", "n_chars", F.expr(FILE_NAME).alias("file_name"), F.expr(RESUME_TEXT).alias("text")
    )
    paragraphs = F.transform(
        F.split("text", "\n"), lambda x: F.struct(x.alias("text"), x.rlike(BOLD_LINE).alias("is_bold"))
    )
    return named.withColumns({"file_type": N.detect_type(F.col("file_name")), "paragraphs": paragraphs})


_TYPE = "CASE doc_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' WHEN 4 THEN 'pdf' WHEN 5 THEN 'txt' ELSE 'unknown' END"


@register(
    f"WITH {RESUMES_CTE}, {plain_ctes()}, {styled_ctes()}, n AS (SELECT doc_id, {_TYPE} AS kind FROM documents), "
    "a AS (SELECT doc_id, header, min(i) AS i FROM p_headers GROUP BY 1, 2), b AS (SELECT doc_id, header, min(i) AS i FROM s_headers GROUP BY 1, 2), "
    "pf AS (SELECT doc_id, string_agg(header, ',' ORDER BY i) AS f FROM a GROUP BY 1), sf AS (SELECT doc_id, string_agg(header, ',' ORDER BY i) AS f FROM b GROUP BY 1) "
    "SELECT doc_id, kind AS file_type, CASE WHEN kind = 'unknown' THEN 'failed' ELSE 'completed' END AS status, "
    "CASE WHEN kind = 'unknown' THEN 'Unsupported file type: unknown' END AS error, "
    "CASE kind WHEN 'pdf' THEN 'pdf_heuristic' WHEN 'txt' THEN 'txt_lines' WHEN 'docx' THEN 'docx_deterministic' END AS method, "
    "CASE kind WHEN 'docx' THEN sf.f WHEN 'unknown' THEN NULL ELSE pf.f END AS found FROM n LEFT JOIN pf USING (doc_id) LEFT JOIN sf USING (doc_id)"
)
def parse_by_file_type(spark, folder):
    """Every document goes to the extractor of its type; unknown types become failed jobs."""
    jobs = parse.parse_documents(_routed(spark, folder), boundary="ascii", limits=X.PUBLISHED_LIMITS)
    return jobs.select(
        "doc_id", "file_type", "status", "error", F.col("result.extraction_method").alias("method"),
        F.array_join("sections_found", ",").alias("found"),
    )


_EXPECTED = {"summary": "true", "experience": "true", "education": "doc_id % 2 = 0", "projects": "doc_id % 3 = 1", "contact": "false"}


def _compared(spark, folder):
    routed = _routed(spark, folder)
    fixtures = routed.select(
        F.col("file_name").alias("filename"),
        F.col("source").alias("category"),
        F.col("lang").alias("difficulty"),
        F.array("lang", "source").alias("test_tags"),
        F.create_map(*[x for k, v in _EXPECTED.items() for x in (F.lit(k), F.expr(v))]).alias("expected_sections"),
        (F.col("file_type") == "unknown").alias("expects_error"),
    )
    jobs = parse.parse_documents(routed, boundary="ascii", limits=X.PUBLISHED_LIMITS)
    results = jobs.select(
        F.col("file_name").alias("filename"),
        "status",
        F.col("sections_found").alias("found_sections"),
        (F.col("n_chars") * 2).alias("processing_time_ms"),
    )
    return quality.compare(fixtures, results)


_COMPARED_SQL = (
    f"WITH {RESUMES_CTE}, {plain_ctes()}, {styled_ctes()}, n AS (SELECT doc_id, {_TYPE} AS kind, {FILE_NAME} AS filename, lang, source, n_chars FROM documents), "
    "f AS (SELECT doc_id, header FROM p_headers JOIN n USING (doc_id) WHERE kind IN ('pdf', 'txt') UNION SELECT doc_id, header FROM s_headers JOIN n USING (doc_id) WHERE kind = 'docx'), "
    "g AS (SELECT doc_id, list(header) AS hs FROM f GROUP BY 1), "
    "cmp AS (SELECT n.*, kind = 'unknown' AS expects_error, kind <> 'unknown' AS succeeded, CAST(5 AS BIGINT) AS sections_expected, CAST("
    + " + ".join(f"CASE WHEN ({v}) = coalesce(list_contains(hs, '{k}'), false) THEN 1 ELSE 0 END" for k, v in _EXPECTED.items())
    + " AS BIGINT) AS sections_right, n_chars * 2 < 5000 AS in_time FROM n LEFT JOIN g USING (doc_id))"
)


@register(
    _COMPARED_SQL + " SELECT filename, expects_error, succeeded, CASE WHEN expects_error THEN NOT succeeded END AS error_handled, sections_expected, sections_right, in_time FROM cmp"
)
def fixtures_against_results(spark, folder):
    """Expected and found sections per file."""
    out = _compared(spark, folder).select(
        "filename", "expects_error", "succeeded", "error_handled", "sections_expected", "sections_right", "in_time"
    )
    return out.withColumn("error_handled", F.when(F.col("expects_error"), F.col("error_handled")))


def _scorecard_sql(source: str) -> str:
    return (
        " SELECT \"group\", count(*) AS fixtures, "
        "round(count(*) FILTER (NOT expects_error AND succeeded) / nullif(count(*) FILTER (NOT expects_error), 0) * 100, 2) AS parse_success, "
        "round(sum(sections_right) FILTER (NOT expects_error) / nullif(sum(sections_expected) FILTER (NOT expects_error), 0) * 100, 2) AS section_accuracy, "
        "round(count(*) FILTER (expects_error AND NOT succeeded) / nullif(count(*) FILTER (expects_error), 0) * 100, 2) AS error_coverage, "
        f"round(count(*) FILTER (in_time) / count(*) * 100, 2) AS in_time FROM {source} GROUP BY 1"
    )


_SCORE_COLUMNS = ("group", "fixtures", "parse_success", "section_accuracy", "error_coverage", "in_time")


@register(
    _COMPARED_SQL + ", flat AS (SELECT unnest([lang, source]) AS \"group\", expects_error, succeeded, sections_expected, sections_right, in_time FROM cmp)" + _scorecard_sql("flat")
)
def quality_scorecard_by_tag(spark, folder):
    return quality.scorecard(_compared(spark, folder), "test_tags").select(*_SCORE_COLUMNS)


@register(_COMPARED_SQL + ", flat AS (SELECT source AS \"group\", expects_error, succeeded, sections_expected, sections_right, in_time FROM cmp)" + _scorecard_sql("flat"))
def quality_scorecard_by_category(spark, folder):
    return quality.scorecard(_compared(spark, folder), "category").select(*_SCORE_COLUMNS)


# ------------------------------------------------------------------ pages, runs, files

#: Text of a task that is taken apart into lines or words, of which each becomes a row several times as large.
_ROWS_BYTES = 2 * 1024 * 1024


def _by_document(spark, folder):
    """Whole texts shuffled by document: what is made of them then lies where it is grouped, and is not shuffled itself."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", task_bytes=_ROWS_BYTES)


@register(
    "WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS page_no, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), "
    "p AS (SELECT doc_id, page_no, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN page_no % 4 = 0 THEN '' ELSE t END AS a, t AS b FROM l), "
    "g AS (SELECT doc_id, coalesce(string_agg(a, chr(10) || chr(10) ORDER BY page_no) FILTER (a <> ''), '') AS a, "
    "coalesce(string_agg(b, chr(10) || chr(10) ORDER BY page_no) FILTER (b <> ''), '') AS b FROM p GROUP BY 1) "
    f"SELECT doc_id, CASE WHEN {strip_sql('a')} = '' THEN b ELSE a END AS text, {strip_sql('a')} = '' AS used_fallback FROM g"
)
def documents_from_pages(spark, folder):
    """Pages put together, with the second extractor's text where the first found none."""
    docs = _by_document(spark, folder)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    pages = lines.select(
        "doc_id",
        (F.col("i") + 1).alias("page_no"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN (i + 1) % 4 = 0 THEN '' ELSE t END").alias("primary"),
        F.col("t").alias("fallback"),
    )
    return D.assemble_pages(pages)


@register(
    "WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS idx, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), "
    "w AS (SELECT doc_id, idx, generate_subscripts(ws, 1) - 1 AS run_no, unnest(ws) AS x FROM (SELECT doc_id, idx, string_split(t, ' ') AS ws FROM l)) "
    "SELECT doc_id, CAST(idx AS INTEGER) AS idx, array_to_string(list(x ORDER BY run_no), '') AS text, bool_or(length(x) = 13) AS is_bold, "
    "CAST(arg_min(length(x), run_no) FILTER (length(x) % 3 = 1) AS INTEGER) AS font_size, count(*) AS runs FROM w GROUP BY 1, 2"
)
def paragraphs_from_runs(spark, folder):
    """Runs rolled up to paragraphs: text, any bold, first font size."""
    docs = _by_document(spark, folder)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "t"))
    words = lines.select("doc_id", "idx", F.posexplode(F.split("t", " ")).alias("run_no", "text"))
    runs = words.withColumns(
        {
            "bold": F.length("text") == 13,
            "size": F.when(F.length("text") % 3 == 1, F.length("text")),
        }
    )
    return D.paragraphs_of_runs(runs).select(
        "doc_id", "idx", "text", "is_bold", "font_size", F.size("runs").cast("long").alias("runs")
    )


_EXT = "lower(list_last(string_split(f, '.')))"
_DOTTED = f"CASE WHEN contains(f, '.') THEN '.' || {_EXT} ELSE '.' END"


@register(
    f"WITH n AS (SELECT doc_id, {FILE_NAME} AS f, CAST({FILE_SIZE} AS BIGINT) AS s FROM documents) SELECT doc_id, f AS file_name, s AS file_size, "
    f"{_EXT} IN ('pdf', 'docx') AS type_ok, s BETWEEN 1 AND 10485760 AS size_ok, "
    f"array_to_string(list_filter([CASE WHEN NOT ({_DOTTED}) IN ('.pdf', '.docx') THEN 'File type \"' || ({_DOTTED}) || '\" is not supported. Please upload .pdf or .docx files.' END, "
    "CASE WHEN s > 10485760 THEN 'File size (' || CAST(CAST(floor(s / 1048576 + 0.5) AS BIGINT) AS STRING) || 'MB) exceeds the maximum limit of 10MB.' END, "
    "CASE WHEN s = 0 THEN 'File appears to be empty. Please select a valid file.' END], lambda e: e IS NOT NULL), '|') AS errors, "
    f"CASE {_EXT} WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN '{N.MIME_TYPES['docx']}' ELSE 'application/octet-stream' END AS mime_type, "
    f"{_TYPE} AS detected, CASE doc_id % 8 WHEN 7 THEN 'docx' WHEN 3 THEN 'unknown' WHEN 6 THEN 'unknown' ELSE {_TYPE} END AS profile_type, "
    f"s <= 10485760 AND {_TYPE} <> 'unknown' AS parseable, "
    "CASE WHEN s = 0 THEN '0 B' WHEN s < 1024 THEN format('{:.1f} B', s::DOUBLE) WHEN s < 1048576 THEN format('{:.1f} KB', s / 1024) "
    "WHEN s < 1073741824 THEN format('{:.1f} MB', s / 1048576) ELSE format('{:.1f} GB', s / 1073741824) END AS readable, "
    "'original/2024/02/run7/' || f AS stored_as FROM n"
)
def file_checks(spark, folder):
    """Upload checks, types, MIME type, readable size and storage path of derived files."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    files = docs.select(
        "doc_id", F.expr(FILE_NAME).alias("file_name"), F.expr(f"CAST({FILE_SIZE} AS BIGINT)").alias("file_size")
    )
    name, size = F.col("file_name"), F.col("file_size")
    at = F.lit("2024-02-29 10:00:00").cast("timestamp")
    return files.select(
        "doc_id", "file_name", "file_size",
        N.has_allowed_extension(name).alias("type_ok"),
        N.has_allowed_size(size).alias("size_ok"),
        F.array_join(N.upload_errors(name, size), "|").alias("errors"),
        N.mime_type(name).alias("mime_type"),
        N.detect_type(F.concat(F.lit("/a/b/"), name)).alias("detected"),
        N.type_of_name(name).alias("profile_type"),
        N.is_parseable(name, size).alias("parseable"),
        human_size(size).alias("readable"),
        N.storage_path(F.lit("run7"), name, at).alias("stored_as"),
    )

