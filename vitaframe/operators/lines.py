"""Sections over a table of lines, for inputs that do not come as one row per document.

``functions.sections`` cuts documents inside their row and needs no shuffle; prefer it. Here
the rows of one document may be many: the carry runs inside chunks of a document and
only one row per chunk crosses chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.functions import sections as S

CHUNK = 4096


def carry_forward(
    df: DataFrame, value: Column, name: str, key: str = "doc_id", order: str = "line_no", chunk: int = CHUNK
) -> DataFrame:
    """Add ``name``: the last non-null ``value`` at or before each row, and ``_last``, the
    document's highest position."""
    staged = df.withColumns({"_value": value, "_chunk": F.floor(F.col(order) / chunk)})
    inner = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumn("_local", F.last("_value", ignorenulls=True).over(inner))
    chunks = staged.groupBy(key, "_chunk").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"), F.max(order).alias("_max")
    )
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    carried = chunks.select(
        key,
        "_chunk",
        F.last("_end", ignorenulls=True).over(earlier).alias("_in"),
        F.max("_max").over(whole).alias("_last"),
    )
    joined = local.join(carried, [key, "_chunk"])
    return joined.select(*df.columns, F.coalesce("_local", "_in").alias(name), "_last")


def section_lines(
    lines: DataFrame,
    sections=S.PLAIN_SECTIONS,
    patterns=S.SECTION_PATTERNS,
    drop_last: bool = True,
    key: str = "doc_id",
    boundary: str = "unicode",
    chunk: int = CHUNK,
) -> DataFrame:
    """``(key, section, line_no, line)``: content lines with the header they stand under.

    Lines before the first header and the headers are left out; so is the very last line
    of a document, unless ``drop_last`` is off.
    """
    line = F.col("line")
    header = F.when(
        S.is_plain_header(line, sections, patterns, boundary), S.section_label(line, sections, patterns, boundary)
    )
    marked = lines.withColumn("_header", header)
    carried = carry_forward(marked, F.col("_header"), "section", key, "line_no", chunk)
    content = carried.where(F.col("_header").isNull() & F.col("section").isNotNull())
    if drop_last:
        content = content.where(F.col("line_no") < F.col("_last"))
    return content.select(key, "section", "line_no", "line")


def section_texts(content: DataFrame, key: str = "doc_id") -> DataFrame:
    """Section texts in line order; one text per document and section is the result asked for."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return content.groupBy(key, "section").agg(F.array_join(ordered, "\n").alias("text"))
