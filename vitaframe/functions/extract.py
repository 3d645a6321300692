"""Pull contacts, jobs, education, skills, projects and awards out of section texts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaframe.functions.text import blank_to_null, dialect, drop_nulls, let, lines_of, strip, title_case

# Contact patterns (case-sensitive, unlike the redaction ones).
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"[\+]?[1-9]?[\d\s\-\(\)\.]{8,15}\d"
URL = r"https?://[^\s]+|www\.[^\s]+"
MAX_URLS = 3

# Dates of a job, tried in this order.
DATE_PATTERNS = (
    r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}\b",
    r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b",
    r"\b\d{4}\s*[-–]\s*\d{4}\b",
    r"\b\d{4}\s*[-–]\s*(?:present|current)\b",
)
YEAR = r"\b(?:19|20)\d{2}\b"
FOUR_DIGITS = r"\b\d{4}\b"
YEAR_SPAN = r"\b\d{4}\b.*?\b\d{4}\b|\b\d{4}\b.*?present"
BULLET = r"^[•\-*+]\s*"

# Words that steer the extraction.
ACTION_VERBS = ("developed", "managed", "led", "built", "implemented", "improved", "collaborated")
COMPANY_WORDS = ("inc", "corp", "ltd", "llc", "company")
DEGREE_WORDS = ("bachelor", "master", "phd", "degree", "b.s.", "m.s.", "b.a.", "m.a.")
SCHOOL_WORDS = ("university", "college", "institute", "school")
PLAIN_SCHOOL_WORDS = ("university", "college", "institute")
TECH_TERMS = (
    "python", "java", "javascript", "react", "angular", "vue",
    "sql", "mysql", "postgresql", "mongodb", "git", "docker",
    "aws", "azure", "linux", "windows", "html", "css",
)

# Caps of the plain-text extractor.
MAX_JOBS, MAX_EDUCATION, MAX_SKILLS, MAX_PROJECTS, MAX_AWARDS, MAX_TERMS = 10, 5, 20, 5, 10, 10
MAX_LEAD = 5


class Limits(NamedTuple):
    """How much of a document the parsers keep: entries of each kind (None: all), and its last line."""

    jobs: int | None = None
    education: int | None = None
    skills: int | None = None
    projects: int | None = None
    awards: int | None = None
    terms: int | None = None
    urls: int | None = None
    lead: int | None = None
    last_line: bool = True


KEEP_ALL = Limits()
PUBLISHED_LIMITS = Limits(
    MAX_JOBS, MAX_EDUCATION, MAX_SKILLS, MAX_PROJECTS, MAX_AWARDS, MAX_TERMS, MAX_URLS, MAX_LEAD, last_line=False
)

JOB_DDL = "array<struct<title:string,company:string,duration:string,responsibilities:array<string>>>"
SCHOOL_DDL = "array<struct<degree:string,institution:string,year:string,details:array<string>>>"
PROJECT_DDL = "array<struct<name:string,description:string,technologies:array<string>,details:array<string>>>"


def _first(items: Column, cap: int | None) -> Column:
    return items if cap is None else F.slice(items, 1, cap)


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def first_match(text: Column, pattern: str) -> Column:
    """First match of a Java regex, null when there is none."""
    return blank_to_null(F.regexp_extract(text, pattern, 0))


def no_strings() -> Column:
    return F.array().cast("array<string>")


# ------------------------------------------------------------------ contacts


def emails(text: Column, boundary: str = "unicode") -> Column:
    return F.regexp_extract_all(text, F.lit(dialect(EMAIL, boundary)), F.lit(0))


def phones(text: Column, boundary: str = "unicode") -> Column:
    return F.regexp_extract_all(text, F.lit(dialect(PHONE, boundary)), F.lit(0))


def urls(text: Column, boundary: str = "unicode") -> Column:
    return F.regexp_extract_all(text, F.lit(dialect(URL, boundary)), F.lit(0))


def first_email(text: Column, boundary: str = "unicode") -> Column:
    # Looking for the sign first spares most texts the regex.
    return F.when(F.contains(text, F.lit("@")), first_match(text, dialect(EMAIL, boundary)))


def first_phone(text: Column, boundary: str = "unicode") -> Column:
    return strip(first_match(text, dialect(PHONE, boundary)))


def first_urls(text: Column, boundary: str = "unicode", cap: int | None = MAX_URLS) -> Column:
    hit = F.contains(text, F.lit("http")) | F.contains(text, F.lit("www."))
    return F.when(hit, _first(urls(text, boundary), cap)).otherwise(no_strings())


def contact(text: Column, boundary: str = "unicode", max_urls: int | None = MAX_URLS) -> Column:
    """``{email, phone, urls}`` from a whole document."""
    return F.struct(
        first_email(text, boundary).alias("email"),
        first_phone(text, boundary).alias("phone"),
        first_urls(text, boundary, max_urls).alias("urls"),
    )


# ------------------------------------------------------------------ summaries


def clean_summary(text: Column, boundary: str = "unicode") -> Column:
    """One line, single blanks, no leading bullet."""
    return F.regexp_replace(F.regexp_replace(strip(text), dialect(r"\s+", boundary), " "), BULLET, "")


def lead_sentences(text: Column, sentences: int | None = MAX_LEAD) -> Column:
    """The first pieces between full stops that are longer than ten characters."""
    pieces = F.transform(_first(F.split(text, r"\."), sentences), strip)
    return F.array_join(F.filter(pieces, lambda p: F.length(p) > 10), ". ")


# ------------------------------------------------------------------ jobs


def date_token(text: Column, boundary: str = "unicode") -> Column:
    """The first date or range, by pattern order and then by position; null when none."""
    return F.coalesce(*[first_match(text, dialect(p, boundary, ignore_case=True)) for p in DATE_PATTERNS])


def _before(text: Column, mark: str) -> Column:
    return strip(F.substring_index(text, mark, 1))


def _after(text: Column, mark: str) -> Column:
    return strip(F.substr(text, F.length(F.substring_index(text, mark, 1)) + (len(mark) + 1)))


def _entries(text: Column, separator: str, shortest: int) -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda e: F.length(e) >= shortest)


def split_jobs(text: Column) -> Column:
    """A capitalised line with a comma, or with a line after it, opens a job entry."""
    return _entries(text, r"\n(?=[A-Z][^\n]*(?:,|\n))", 10)


def _is_duty(line: Column) -> Column:
    verbs = "|".join(ACTION_VERBS)
    return line.rlike(r"^[•\-*+]") | F.lower(line).rlike(f"^(?:{verbs})")


def _job(lines: Column, boundary: str) -> Column:
    def build(titles: Column) -> Column:
        head, second = F.get(titles, F.lit(0)), F.get(titles, F.lit(1))
        dates = F.filter(F.transform(lines, lambda x: date_token(x, boundary)), lambda d: d.isNotNull())
        head_dated = date_token(head, boundary).isNotNull()
        bar, dash = F.contains(head, F.lit("|")), F.contains(head, F.lit(" - "))
        comma = F.contains(head, F.lit(",")) & ~head_dated
        title = (
            F.when(bar, _before(head, "|")).when(dash, _before(head, " - ")).when(comma, _before(head, ","))
        ).otherwise(head)
        company = (
            F.when(bar, _after(head, "|"))
            .when(dash, _after(head, " - "))
            .when(comma, _after(head, ","))
            .when(date_token(second, boundary).isNull(), second)
        )
        duties = F.transform(F.filter(lines, _is_duty), lambda x: F.regexp_replace(x, BULLET, ""))
        duration = F.when(F.size(titles) > 0, F.get(dates, F.lit(0)))
        return F.struct(
            F.coalesce(title, F.lit("")).alias("title"),
            F.coalesce(company, F.lit("")).alias("company"),
            F.coalesce(duration, F.lit("")).alias("duration"),
            F.filter(duties, lambda x: x != "").alias("responsibilities"),
        )

    return let(F.filter(lines, lambda x: ~_is_duty(x)), build)


def jobs(text: Column, boundary: str = "unicode") -> Column:
    """Jobs of a styled document: duties are bullets or start with an action verb; the
    first other line holds title and company."""
    parsed = F.transform(split_jobs(text), lambda e: let(lines_of(e), lambda ls: _job(ls, boundary)))
    filled = (lambda j: (j["title"] != "") | (j["company"] != "") | (F.size(j["responsibilities"]) > 0))
    return F.filter(parsed, filled)


def _plain_job(lines: Column, boundary: str) -> Column:
    head = F.get(lines, F.lit(0))
    is_company = contains_any(F.lower(head), COMPANY_WORDS)
    span = "(?d)" + dialect(YEAR_SPAN, boundary, ignore_case=True)
    spans = F.filter(
        F.transform(F.slice(lines, 1, 3), lambda x: first_match(x, span)), lambda d: d.isNotNull()
    )
    duties = F.filter(F.slice(lines, 2, 1 << 30), lambda x: ~x.rlike(dialect(FOUR_DIGITS, boundary)))
    duties = F.transform(duties, lambda x: F.regexp_replace(x, BULLET, ""))
    return F.struct(
        F.when(is_company, F.lit("")).otherwise(head).alias("title"),
        F.when(is_company, head).otherwise(F.lit("")).alias("company"),
        F.coalesce(strip(F.get(spans, F.lit(0))), F.lit("")).alias("duration"),
        F.filter(duties, lambda x: x != "").alias("responsibilities"),
    )


def plain_jobs(text: Column, boundary: str = "unicode", cap: int | None = MAX_JOBS) -> Column:
    """Jobs of plain text: entries stand between blank lines."""
    entries = _first(_entries(text, r"\n\n+", 20), cap)
    return F.transform(entries, lambda e: let(lines_of(e), lambda ls: _plain_job(ls, boundary)))


# ------------------------------------------------------------------ education


def split_schools(text: Column) -> Column:
    return _entries(text, r"\n(?=[A-Z][^\n]*(?:University|College|Institute|School))", 5)


def _school(lines: Column, boundary: str) -> Column:
    def build(head: Column) -> Column:
        lowered = F.lower(head)
        word = None
        for w in SCHOOL_WORDS:
            hit = F.contains(lowered, F.lit(w))
            word = F.when(hit, w) if word is None else word.when(hit, w)
        at = F.position(word, lowered)
        years = F.filter(
            F.transform(lines, lambda x: first_match(x, dialect(YEAR, boundary))), lambda y: y.isNotNull()
        )
        return F.struct(
            F.when(word.isNull(), head).otherwise(strip(F.substr(head, F.lit(1), at - 1))).alias("degree"),
            F.when(word.isNull(), F.lit("")).otherwise(strip(F.substr(head, at))).alias("institution"),
            F.coalesce(F.get(years, F.lit(0)), F.lit("")).alias("year"),
            no_strings().alias("details"),
        )

    return let(F.get(lines, F.lit(0)), build)


def schools(text: Column, boundary: str = "unicode") -> Column:
    """Education of a styled document: degree before the school word, school from it on."""
    return F.transform(split_schools(text), lambda e: let(lines_of(e), lambda ls: _school(ls, boundary)))


def plain_schools(text: Column, boundary: str = "unicode", cap: int | None = MAX_EDUCATION) -> Column:
    """Education of plain text: a degree or school line opens an entry, later lines are details."""

    def entries(lines: Column) -> Column:
        opens = lambda x: let(F.lower(x), lambda low: contains_any(low, DEGREE_WORDS + PLAIN_SCHOOL_WORDS))
        starts = F.filter(
            F.transform(lines, lambda x, i: F.when(opens(x), i)), lambda i: i.isNotNull()
        )

        def build(at: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                head = F.get(lines, start)
                stop = F.coalesce(F.get(at, k + 1), F.size(lines))
                return F.struct(
                    F.when(contains_any(F.lower(head), DEGREE_WORDS), head).otherwise("").alias("degree"),
                    F.when(contains_any(F.lower(head), PLAIN_SCHOOL_WORDS), head).otherwise("").alias("institution"),
                    F.regexp_extract(head, dialect(YEAR, boundary), 0).alias("year"),
                    F.slice(lines, start + 2, stop - start - 1).alias("details"),
                )

            return _first(F.transform(at, one), cap)

        return let(starts, build)

    return let(lines_of(text), entries)


# ------------------------------------------------------------------ skills, projects, awards

_SKILL_BREAKS = r"[,;\n|•\-*+]+"


def skills(text: Column) -> Column:
    """Skills of a styled document: one leading label dropped, 2 to 49 characters each."""
    body = F.regexp_replace(text, r"(?iU)\A(?:skills?|technologies?|tools?):?\s*", "")
    parts = F.transform(F.split(body, _SKILL_BREAKS), strip)
    return F.filter(parts, lambda s: F.length(s).between(2, 49))


def plain_skills(text: Column, cap: int | None = MAX_SKILLS) -> Column:
    """Skills of plain text: labels dropped on every line, 2 to 50 characters, capped."""
    body = F.regexp_replace(text, r"(?imdU)^(?:skills?|technologies?):?\s*", "")
    parts = F.transform(F.split(body, _SKILL_BREAKS), strip)
    return _first(F.filter(parts, lambda s: F.length(s).between(2, 50)), cap)


def tech_terms(text: Column, cap: int | None = MAX_TERMS) -> Column:
    """Known technology terms anywhere in a text without sections."""

    def found(lowered: Column) -> Column:
        terms = F.filter(F.array(*[F.lit(t) for t in TECH_TERMS]), lambda t: F.contains(lowered, t))
        return F.transform(_first(terms, cap), title_case)

    return let(F.lower(text), found)


def _project(lines: Column) -> Column:
    return F.struct(
        F.get(lines, F.lit(0)).alias("name"),
        F.array_join(F.slice(lines, 2, 1 << 30), " ").alias("description"),
        no_strings().alias("technologies"),
        no_strings().alias("details"),
    )


def projects(text: Column) -> Column:
    """Projects of a styled document: every capitalised line opens one."""
    return F.transform(_entries(text, r"\n(?=[A-Z])", 10), lambda e: let(lines_of(e), _project))


def plain_projects(text: Column, cap: int | None = MAX_PROJECTS) -> Column:
    entries = _first(_entries(text, r"\n\n+", 10), cap)
    return F.transform(entries, lambda e: let(lines_of(e), _project))


def achievements(text: Column) -> Column:
    items = F.transform(F.split(text, r"[\n•\-*+]+"), strip)
    return F.filter(items, lambda x: F.length(x) > 5)


def plain_achievements(text: Column, cap: int | None = MAX_AWARDS) -> Column:
    items = F.transform(F.split(text, r"[\n•\-*+]+"), strip)
    return _first(F.filter(items, lambda x: F.length(x).between(5, 200)), cap)


# ------------------------------------------------------------------ scores and warnings

# What each found part adds to the confidence.
STYLED_WEIGHTS = {"email": 0.2, "summary": 0.1, "experience": 0.3, "education": 0.2, "skills": 0.2}
PLAIN_WEIGHTS = {"email": 0.15, "summary": 0.1, "experience": 0.2, "education": 0.15, "skills": 0.1}


def confidence(sections: Column, weights: dict[str, float], scale: float = 1.0) -> Column:
    """Weighted sum of the parts that were found, scaled and capped at the scale."""
    found = {
        "email": F.coalesce(sections["contact"]["email"] != "", F.lit(False)),
        "summary": F.coalesce(sections["summary"] != "", F.lit(False)),
        **{s: F.coalesce(F.size(sections[s]) > 0, F.lit(False)) for s in ("experience", "education", "skills")},
    }
    score = F.lit(0.0)
    for part, weight in weights.items():
        score = score + F.when(found[part], F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(score * F.lit(scale), F.lit(scale))


def styled_warnings(sections: Column) -> Column:
    return drop_nulls(
        F.when(F.coalesce(sections["contact"]["email"], F.lit("")) == "", "No email address found"),
        F.when(F.size(sections["experience"]) == 0, "No work experience found"),
    )


# What every PDF result warns of.
PDF_WARNINGS = (
    "PDF extraction has limitations with complex layouts",
    "Tables and multi-column formats may not parse correctly",
    "Some formatting information may be lost",
)
USED_FALLBACK = "Used fallback PDF extraction method"
IMAGE_BASED = "PDF text extraction failed - document may be image-based"
NO_TEXT = "No text content extracted from PDF"
NO_SECTIONS = "No clear sections detected - using heuristic extraction"
LIMITED = "Limited extraction due to unclear document structure"
NO_PDF_EMAIL = "No email address detected (PDF parsing limitation)"
TXT_LIMITED = "TXT files have limited parsing capabilities"


def plain_warnings(text: Column, email: Column, has_content: Column, used_fallback: Column, is_pdf: Column) -> Column:
    """Warnings of the plain extractor: source first, then structure, then the contact."""
    blank = F.coalesce(strip(text) == "", F.lit(True))
    loose = ~blank & ~has_content
    return drop_nulls(
        *[F.when(is_pdf, w) for w in PDF_WARNINGS],
        F.when(~is_pdf, TXT_LIMITED),
        F.when(is_pdf & F.coalesce(used_fallback, F.lit(False)), USED_FALLBACK),
        F.when(is_pdf & blank, IMAGE_BASED),
        F.when(blank, NO_TEXT),
        F.when(loose, NO_SECTIONS),
        F.when(loose, LIMITED),
        F.when(F.coalesce(email, F.lit("")) == "", NO_PDF_EMAIL),
    )
