"""Dates as résumés write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaframe.functions.text import strip

# Accepted forms, tried in this order.
DATE_FORMATS = ("yyyy-M-d", "yyyy-M", "yyyy", "M/yyyy", "M/d/yyyy")
_SHAPES = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}-\d{1,2}$", r"^\d{4}$", r"^\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$")


def parse_date(text: Column) -> Column:
    """The date, or null where none of the forms fits the whole text."""
    t = strip(text)
    return F.coalesce(
        *[F.when(t.rlike(shape), F.try_to_date(t, fmt)) for shape, fmt in zip(_SHAPES, DATE_FORMATS, strict=True)]
    )


def date_or_text(text: Column) -> Column:
    """``{parsed, raw}``: the date when there is one, and always the stripped text."""
    return F.when(
        text.isNotNull(), F.struct(parse_date(text).alias("parsed"), strip(text).alias("raw"))
    )


def iso_date_or_text(text: Column) -> Column:
    """ISO form of a recognised date, else the stripped text; null stays null."""
    return F.coalesce(F.date_format(parse_date(text), "yyyy-MM-dd"), strip(text))
