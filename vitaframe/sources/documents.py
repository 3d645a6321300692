"""Bring pages, runs and paragraphs into the one-row-per-document shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaframe.functions.text import lines_of, strip


def line_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, line_no, line)``: stripped non-empty lines, numbered from 0; no shuffle."""
    return df.select(key, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def assemble_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """One text per document from ``page_no, primary, fallback``.

    Empty pages are skipped and the rest joined by a blank line. The fallback extractor's
    text is used where the whole primary text is blank.
    """

    def joined(column: str):
        pieces = F.sort_array(F.collect_list(F.when(F.col(column) != "", F.struct("page_no", F.col(column).alias("t")))))
        return F.array_join(F.transform(pieces, lambda p: p["t"]), "\n\n")

    texts = pages.groupBy(key).agg(joined("primary").alias("_first"), joined("fallback").alias("_second"))
    use_second = strip(F.col("_first")) == ""
    text = F.when(use_second, F.col("_second")).otherwise(F.col("_first"))
    return texts.select(key, text.alias("text"), use_second.alias("used_fallback"))


def paragraphs_of_runs(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraph rows from text runs: ``(key, idx, text, is_bold, font_size, runs)``.

    Bold if any run is; the font size is that of the first run that has one.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("run_no", "text"))), lambda r: r["text"])
    grouped = runs.groupBy(key, "idx").agg(
        ordered.alias("runs"),
        F.coalesce(F.bool_or("bold"), F.lit(False)).alias("is_bold"),
        F.min_by(F.col("size"), F.when(F.col("size").isNotNull(), F.col("run_no"))).alias("font_size"),
    )
    return grouped.select(key, "idx", F.array_join("runs", "").alias("text"), "is_bold", "font_size", "runs")


def documents_of_paragraphs(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, paragraphs)`` in paragraph order, as ``plans.parse.parse_styled`` reads them."""
    items = F.sort_array(F.collect_list(F.struct("idx", "text", "is_bold", "style", "font_size")))
    return paragraphs.groupBy(key).agg(items.alias("paragraphs"))
