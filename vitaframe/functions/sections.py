"""Find section headers in a document and cut its lines into sections.

A document is one row with an array of lines, so all of this is a projection: no
shuffle, and the work spreads over however many partitions the scan has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaframe.functions.text import dialect, let, strip

# What a header of each section looks like; the first section that matches counts.
SECTION_PATTERNS = {
    "contact": [r"\b(contact|personal\s+info|personal\s+information)\b"],
    "summary": [
        r"\b(summary|objective|profile|overview|about)\b",
        r"\b(professional\s+summary|career\s+summary)\b",
        r"\b(executive\s+summary)\b",
    ],
    "experience": [
        r"\b(experience|employment|work\s+history|professional\s+experience)\b",
        r"\b(work\s+experience|career\s+history|employment\s+history)\b",
    ],
    "education": [
        r"\b(education|academic|qualifications|degrees)\b",
        r"\b(educational\s+background|academic\s+background)\b",
    ],
    "skills": [
        r"\b(skills|technical\s+skills|core\s+competencies)\b",
        r"\b(technologies|expertise|competencies|proficiencies)\b",
    ],
    "projects": [
        r"\b(projects|key\s+projects|notable\s+projects)\b",
        r"\b(project\s+experience|personal\s+projects)\b",
    ],
    "achievements": [
        r"\b(achievements|accomplishments|awards|honors)\b",
        r"\b(recognition|certifications)\b",
    ],
}
PLAIN_SECTIONS = tuple(s for s in SECTION_PATTERNS if s != "contact")
STYLED_SECTIONS = tuple(SECTION_PATTERNS)


def _any_of(patterns: list[str], boundary: str) -> str:
    """One regex for any of the patterns; word edges that all of them share are tested once."""
    if all(p.startswith(r"\b") and p.endswith(r"\b") for p in patterns):
        joined = r"\b(?:" + "|".join(p[2:-2] for p in patterns) + r")\b"
    else:
        joined = "|".join(patterns)
    return dialect(joined, boundary, ignore_case=True)


def any_section(sections=STYLED_SECTIONS, patterns=SECTION_PATTERNS, boundary: str = "unicode") -> str:
    return _any_of([p for s in sections for p in patterns[s]], boundary)


def section_label(
    text: Column, sections=STYLED_SECTIONS, patterns=SECTION_PATTERNS, boundary: str = "unicode"
) -> Column:
    """Name of the first section, in the given order, that the text mentions; else null."""
    out = None
    for section in sections:
        hit = text.rlike(_any_of(patterns[section], boundary))
        out = F.when(hit, section) if out is None else out.when(hit, section)
    return out


def is_plain_header(
    line: Column, sections=PLAIN_SECTIONS, patterns=SECTION_PATTERNS, boundary: str = "unicode"
) -> Column:
    """A stripped line of at most five words that mentions a section."""
    short = line.rlike(dialect(r"^\S+(?:\s+\S+){0,4}$", boundary))
    return short & line.rlike(any_section(sections, patterns, boundary))


def is_styled_header(
    text: Column, is_bold: Column, sections=STYLED_SECTIONS, patterns=SECTION_PATTERNS, boundary: str = "unicode"
) -> Column:
    """A bold or all-capitals paragraph of at most 50 characters that mentions a section."""
    capitals = (F.upper(text) == text) & (F.lower(text) != text)
    return (
        (F.length(text) <= 50)
        & (F.coalesce(is_bold, F.lit(False)) | capitals)
        & text.rlike(any_section(sections, patterns, boundary))
    )


# ------------------------------------------------------------------ plain text (PDF)


def clean_page_text(text: Column, keep_blank: bool = True, boundary: str = "unicode") -> Column:
    """Squeeze blanks, drop page numbers and one-character lines.

    With ``keep_blank`` empty lines survive as entry separators (not at the ends).
    """
    number = dialect(r"^\d+$", boundary)
    squeezed = F.transform(F.split(text, "\n"), lambda line: strip(F.regexp_replace(line, " {2,}", " ")))
    long_enough = F.filter(squeezed, lambda line: (F.length(line) >= 2) & ~line.rlike(number))
    if not keep_blank:
        return F.array_join(long_enough, "\n")
    kept = F.filter(squeezed, lambda line: (line == "") | ((F.length(line) >= 2) & ~line.rlike(number)))
    return F.trim(F.array_join(kept, "\n"), F.lit("\n"))


# ------------------------------------------------------------------ cutting


def _segments(items: Column, headers: Column, end: Column) -> Column:
    """``[{section, items}]``: what lies between each header and the next.

    ``headers`` is ``[{at, section}]`` with zero-based positions; ``end`` is the number of
    leading items that may be content.
    """

    def cut(header: Column, k: Column) -> Column:
        following = F.get(headers, k + 1)
        stop = F.least(F.coalesce(following["at"], end), end)
        count = F.greatest(stop - header["at"] - 1, F.lit(0))
        return F.struct(header["section"].alias("section"), F.slice(items, header["at"] + 2, count).alias("items"))

    return F.transform(headers, cut)


def plain_segments(
    lines: Column,
    sections=PLAIN_SECTIONS,
    patterns=SECTION_PATTERNS,
    drop_last: bool = True,
    boundary: str = "unicode",
) -> Column:
    """Cut plain lines at their headers; the very last line is never content (``drop_last``)."""

    def with_lines(ls: Column) -> Column:
        marks = F.transform(
            ls,
            lambda line, i: F.struct(
                i.alias("at"),
                F.when(
                    is_plain_header(line, sections, patterns, boundary),
                    section_label(line, sections, patterns, boundary),
                ).alias("section"),
            ),
        )
        headers = F.filter(marks, lambda m: m["section"].isNotNull())
        end = F.size(ls) - (1 if drop_last else 0)
        return let(headers, lambda hs: _segments(ls, hs, end))

    return let(lines, with_lines)


def styled_segments(
    paragraphs: Column, sections=STYLED_SECTIONS, patterns=SECTION_PATTERNS, boundary: str = "unicode"
) -> Column:
    """Cut ``[{text, is_bold}]`` paragraphs at their styled headers; items are the texts."""

    def with_paragraphs(ps: Column) -> Column:
        marks = F.transform(
            ps,
            lambda p, i: F.struct(
                i.alias("at"),
                F.when(
                    is_styled_header(p["text"], p["is_bold"], sections, patterns, boundary),
                    section_label(p["text"], sections, patterns, boundary),
                ).alias("section"),
            ),
        )
        headers = F.filter(marks, lambda m: m["section"].isNotNull())
        texts = F.transform(ps, lambda p: p["text"])
        return let(headers, lambda hs: let(texts, lambda ts: _segments(ts, hs, F.size(ts))))

    return let(paragraphs, with_paragraphs)


def section_items(segments: Column, section: str) -> Column:
    """All items of a section; a header that comes again extends the same section."""
    return F.flatten(F.transform(F.filter(segments, lambda s: s["section"] == section), lambda s: s["items"]))


def section_text(segments: Column, section: str) -> Column:
    return F.array_join(section_items(segments, section), "\n")


def sections_found(segments: Column) -> Column:
    """Names of the sections that have a header, in order of appearance."""
    return F.array_distinct(F.transform(segments, lambda s: s["section"]))
