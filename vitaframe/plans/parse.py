"""Parse documents into sections: one projection per document, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.functions import extract as X
from vitaframe.functions import sections as S
from vitaframe.functions.files import PARSEABLE
from vitaframe.functions.text import is_set, strip

EXTRACTOR_VERSION = "1.0.0"
SECTION_KEYS = ("contact", "summary", "experience", "education", "skills", "projects", "achievements")


def _result(sections: Column, method: Column, warnings: Column, score: Column) -> Column:
    return F.struct(
        method.alias("extraction_method"),
        sections.alias("sections"),
        warnings.alias("warnings"),
        F.struct(F.lit(EXTRACTOR_VERSION).alias("extractor_version"), score.alias("confidence_score")).alias(
            "metadata"
        ),
    )


def _with_sections(df: DataFrame, **sections: Column) -> tuple[DataFrame, Column]:
    """Each section as a column of its own, so that what a query does not read is not worked out, and all as one struct."""
    names = {f"_section_{name}": value for name, value in sections.items()}
    return df.withColumns(names), F.struct(*[F.col(f"_section_{name}").alias(name) for name in sections])


def _without_sections(df: DataFrame) -> DataFrame:
    return df.drop(*[f"_section_{name}" for name in SECTION_KEYS])


def parse_styled(
    df: DataFrame, paragraphs: str = "paragraphs", boundary: str = "unicode", limits: X.Limits = X.KEEP_ALL
) -> DataFrame:
    """Add ``result`` for documents given as ``array<struct<text, is_bold, ...>>``.

    Blank paragraphs are dropped first, so positions are dense. Of ``limits`` only that of links
    applies to styled documents.
    """
    trimmed = F.transform(
        F.col(paragraphs), lambda p: F.struct(strip(p["text"]).alias("text"), p["is_bold"].alias("is_bold"))
    )
    staged = df.withColumn("_paras", F.filter(trimmed, lambda p: p["text"] != ""))
    staged = staged.withColumn("_segments", S.styled_segments(F.col("_paras"), boundary=boundary))
    whole = F.array_join(F.transform(F.col("_paras"), lambda p: p["text"]), " ")
    text = lambda s: S.section_text(F.col("_segments"), s)
    staged, sections = _with_sections(
        staged,
        contact=X.contact(whole, boundary, limits.urls),
        summary=X.clean_summary(text("summary"), boundary),
        experience=X.jobs(text("experience"), boundary),
        education=X.schools(text("education"), boundary),
        skills=X.skills(text("skills")),
        projects=X.projects(text("projects")),
        achievements=X.achievements(text("achievements")),
    )
    result = _result(
        sections,
        F.lit("docx_deterministic"),
        X.styled_warnings(sections),
        X.confidence(sections, X.STYLED_WEIGHTS),
    )
    return _without_sections(
        staged.withColumns({"result": result, "sections_found": S.sections_found(F.col("_segments"))})
    ).drop("_paras", "_segments")


def parse_plain(
    df: DataFrame,
    text: str = "text",
    is_pdf: Column | None = None,
    used_fallback: Column | None = None,
    compat: bool = False,
    boundary: str = "unicode",
    limits: X.Limits = X.KEEP_ALL,
) -> DataFrame:
    """Add ``result`` for documents given as plain text (PDF pages put together, or TXT).

    ``compat=True`` forgets blank lines, which leaves at most one job and one project per
    section; by default blank lines separate the entries. All entries are kept unless ``limits``
    says otherwise (``PUBLISHED_LIMITS``: the caps of the published parser, which also drops the last line).
    """
    is_pdf = F.lit(True) if is_pdf is None else is_pdf
    used_fallback = F.lit(False) if used_fallback is None else used_fallback
    staged = df.withColumn("_clean", S.clean_page_text(F.col(text), keep_blank=not compat, boundary=boundary))
    staged = staged.withColumn(
        "_segments",
        S.plain_segments(F.split("_clean", "\n"), drop_last=not limits.last_line, boundary=boundary),
    )
    # Contacts see the text without blank lines.
    staged = staged.withColumn("_body", F.regexp_replace("_clean", r"\n\n+", "\n"))
    staged = staged.withColumn(
        "_has_content",
        F.exists(F.col("_segments"), lambda s: F.exists(s["items"], lambda x: x != "")),
    )
    part = lambda s: S.section_text(F.col("_segments"), s)
    dense = lambda s: F.array_join(F.filter(S.section_items(F.col("_segments"), s), lambda x: x != ""), "\n")
    staged, sections = _with_sections(
        staged,
        contact=X.contact(F.col("_body"), boundary, limits.urls),
        summary=X.lead_sentences(dense("summary"), limits.lead),
        experience=X.plain_jobs(part("experience"), boundary, limits.jobs),
        education=X.plain_schools(dense("education"), boundary, limits.education),
        skills=F.when(F.col("_has_content"), X.plain_skills(dense("skills"), limits.skills)).otherwise(
            X.tech_terms(F.col("_body"), limits.terms)
        ),
        projects=X.plain_projects(part("projects"), limits.projects),
        achievements=X.plain_achievements(dense("achievements"), limits.awards),
    )
    email = F.col("_section_contact")["email"]
    result = _result(
        sections,
        F.when(is_pdf, "pdf_heuristic").otherwise("txt_lines"),
        X.plain_warnings(F.col(text), email, F.col("_has_content"), used_fallback, is_pdf),
        X.confidence(sections, X.PLAIN_WEIGHTS, 0.8),
    )
    return _without_sections(
        staged.withColumns({"result": result, "sections_found": S.sections_found(F.col("_segments"))})
    ).drop("_clean", "_segments", "_body", "_has_content")


def parse_documents(
    df: DataFrame, compat: bool = False, boundary: str = "unicode", limits: X.Limits = X.KEEP_ALL
) -> DataFrame:
    """Route every document to its extractor by ``file_type`` and report a job row.

    Input: ``file_type, text, paragraphs[, used_fallback]``. One pass over one scan: each
    extractor sees nulls for the documents that are not its own, which cost nothing. Rows of
    unknown type become failed jobs with an error instead of disappearing.
    """
    fallback = F.col("used_fallback") if "used_fallback" in df.columns else F.lit(False)
    kind = F.col("file_type")
    is_styled, is_plain = kind == "docx", kind.isin("pdf", "txt")
    staged = df.withColumns({"_p": F.when(is_styled, F.col("paragraphs")), "_t": F.when(is_plain, F.col("text"))})
    styled = parse_styled(staged, "_p", boundary, limits).withColumnsRenamed(
        {"result": "_styled", "sections_found": "_styled_found"}
    )
    both = parse_plain(
        styled, "_t", is_pdf=kind == "pdf", used_fallback=fallback, compat=compat, boundary=boundary, limits=limits
    )
    known = F.coalesce(kind.isin(*PARSEABLE), F.lit(False))
    return both.withColumns(
        {
            "result": F.when(is_styled, F.col("_styled")).when(is_plain, F.col("result")),
            "sections_found": F.when(is_styled, F.col("_styled_found")).when(is_plain, F.col("sections_found")),
            "status": F.when(known, "completed").otherwise("failed"),
            "error": F.when(
                ~known, F.concat(F.lit("Unsupported file type: "), F.coalesce(kind, F.lit("unknown")))
            ),
        }
    ).drop("_p", "_t", "_styled", "_styled_found")


def section_counts(result: Column) -> dict[str, Column]:
    """Counts a finished parse reports; ``sections_count`` counts keys, filled or not."""
    s = result["sections"]
    filled = [
        F.coalesce(s["contact"]["email"], s["contact"]["phone"], F.get(s["contact"]["urls"], F.lit(0))).isNotNull(),
        is_set(s["summary"]),
        *[F.size(s[k]) > 0 for k in SECTION_KEYS[2:]],
    ]
    nonempty = F.lit(0)
    for hit in filled:
        nonempty = nonempty + F.coalesce(hit, F.lit(False)).cast("int")
    present = result.isNotNull()
    return {
        "sections_count": F.when(present, F.lit(len(SECTION_KEYS))).otherwise(0).cast("long"),
        "sections_nonempty": F.when(present, nonempty).otherwise(0).cast("long"),
        "skills_count": F.when(present, F.size(s["skills"])).otherwise(0).cast("long"),
        "warnings_count": F.when(present, F.size(result["warnings"])).otherwise(0).cast("long"),
    }


def grouped_skill_count(groups: Column) -> Column:
    """Skill count where skills come as ``map<category, array>``."""
    return F.aggregate(F.map_values(groups), F.lit(0), lambda n, v: n + F.greatest(F.size(v), F.lit(0)))


def with_warnings(df: DataFrame, column: str, *lists: Column) -> DataFrame:
    """Join warning lists in order; repeated entries stay."""
    empty = X.no_strings()
    return df.withColumn(column, F.concat(*[F.coalesce(w, empty) for w in lists]))


def section_rows(df: DataFrame, keys: Sequence[str], segments: Column) -> DataFrame:
    """Long form ``(keys, section, line_no, line)`` of in-row segments."""
    # The outer form keeps the optimizer from testing the segments twice (see validate.error_counts).
    flat = df.select(*keys, F.explode_outer(segments).alias("_s")).where(F.col("_s").isNotNull())
    return flat.select(*keys, F.col("_s.section").alias("section"), F.posexplode("_s.items").alias("line_no", "line"))
