"""Column helpers for text: binding, stripping, casing, formatting."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's ``str.strip`` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Word edge that only knows ASCII letters, cheap lookaheads before lookbehinds.
ASCII_EDGE = r"(?:(?=[A-Za-z0-9_])(?<![A-Za-z0-9_])|(?![A-Za-z0-9_])(?<=[A-Za-z0-9_]))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst does not share common subexpressions inside lambdas, so a nested chain
    that mentions its input twice per step would cost 2^steps. Binding the input as a
    lambda variable keeps evaluation and plan size linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def dialect(pattern: str, boundary: str = "unicode", ignore_case: bool = False) -> str:
    """Java form of a regex: Unicode classes, or plain ASCII classes and word edges.

    Where a leading word edge is followed by a mandatory character class, that class is
    tested first: most positions of a text then fail without an edge test.
    """
    pattern = re.sub(r"^\\b(\[[^\]]+\]|\\d)(?![*?])", r"(?=\1)\\b\1", pattern)
    if boundary == "unicode":
        return ("(?iU)" if ignore_case else "(?U)") + pattern
    if boundary == "ascii":
        body = pattern.replace(r"\b", ASCII_EDGE)
        return ("(?i)" if ignore_case else "") + body
    raise ValueError(f"boundary must be 'unicode' or 'ascii', not {boundary!r}")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def is_set(c: Column) -> Column:
    """True for a non-null, non-empty string."""
    return c.isNotNull() & (c != "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def lines_of(text: Column) -> Column:
    """Stripped, non-empty lines in order."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    ``initcap`` only looks at blanks; here ``c++/java-script`` gives ``C++/Java-Script``.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))),
        "",
    )


def first_or_null(items: Column) -> Column:
    return F.get(items, F.lit(0))


def drop_nulls(*items: Column) -> Column:
    """Array of the given values without nulls, in order."""
    return F.array_compact(F.array(*items))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# ---------------------------------------------------------------- presentation


def rounded(value: Column, digits: int) -> Column:
    """Round on the binary value (17.935 is a little less than that: 17.93).

    ``round`` works on the shortest decimal form of a double and gives 17.94.
    """
    scale = float(10**digits)
    return F.round(value * scale, 0) / scale


def human_size(size: Column) -> Column:
    """``0 B``, ``12.5 KB`` ... up to GB, one decimal, exact halves to the even digit."""
    value = size.cast("double")
    shown = lambda unit, power: F.format_string(f"%.1f {unit}", F.bround(value / 1024**power, 1))
    return (
        F.when(size == 0, F.lit("0 B"))
        .when(size < 1024, shown("B", 0))
        .when(size < 1024**2, shown("KB", 1))
        .when(size < 1024**3, shown("MB", 2))
        .otherwise(shown("GB", 3))
    )


def confidence_tier(score: Column) -> Column:
    return (
        F.when(score.isNull() | (score == 0), F.lit("none"))
        .when(score >= 0.8, F.lit("high"))
        .when(score >= 0.6, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def percent_of(score: Column) -> Column:
    """0..1 score as a whole percentage, halves up."""
    return F.floor(score * 100 + 0.5).cast("long")


def date_label(value: Column) -> Column:
    """``Jan 2024`` for a date, ``Present`` for an open end, else the text itself."""
    parsed = F.coalesce(
        F.try_to_date(value, "yyyy-M-d"), F.try_to_date(value, "yyyy-M"), F.try_to_date(value, "yyyy")
    )
    return (
        F.when(value.isNull() | (value == ""), F.lit(""))
        .when(value.isin("present", "current"), F.lit("Present"))
        .otherwise(F.coalesce(F.date_format(parsed, "MMM yyyy"), value))
    )


def date_range_label(start: Column, end: Column, is_current: Column, raw: Column) -> Column:
    """Raw text wins; otherwise ``start - end`` from whichever sides are known."""
    left = date_label(start)
    right = F.when(F.coalesce(is_current, F.lit(False)), F.lit("Present")).otherwise(date_label(end))
    return F.when(is_set(raw), raw).otherwise(
        F.concat_ws(" - ", blank_to_null(left), blank_to_null(right))
    )
