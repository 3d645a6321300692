"""Compare parse results with what a fixture manifest expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Success criteria.
TARGETS = {"parse_success": 85.0, "section_accuracy": 90.0, "error_coverage": 100.0}
MAX_SECONDS = 5.0


def compare(fixtures: DataFrame, results: DataFrame, key: str = "filename") -> DataFrame:
    """Fixtures with their results: what was expected, what was found, per section.

    ``fixtures`` has ``expected_sections map<string,boolean>`` and ``expects_error``;
    ``results`` has ``status``, ``found_sections array<string>`` and ``processing_time_ms``.
    A fixture without a result counts as failed.
    """
    joined = fixtures.join(results, key, "left")
    found = F.coalesce(F.col("found_sections"), F.array().cast("array<string>"))
    wanted = F.map_entries(F.col("expected_sections"))
    hits = F.filter(wanted, lambda e: e["value"] == F.array_contains(found, e["key"]))
    failed = F.coalesce(F.col("status") == "failed", F.lit(True))
    return joined.withColumns(
        {
            "sections_expected": F.size(wanted).cast("long"),
            "sections_right": F.size(hits).cast("long"),
            "succeeded": ~failed,
            "error_handled": F.when(F.col("expects_error"), failed),
            "in_time": F.coalesce(F.col("processing_time_ms") < MAX_SECONDS * 1000, F.lit(False)),
        }
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)) * 100, 2)


def scorecard(compared: DataFrame, by: str | None = None) -> DataFrame:
    """Success, section accuracy, error coverage and time per group, against the targets.

    ``by="test_tags"`` counts a fixture under each of its tags.
    """
    rows = compared
    group = []
    if by is not None:
        rows = rows.withColumn("group", F.explode(by) if by == "test_tags" else F.col(by))
        group = ["group"]
    good = ~F.coalesce(F.col("expects_error"), F.lit(False))
    agg = rows.groupBy(*group).agg(
        F.count("*").alias("fixtures"),
        _percent(F.count_if(good & F.col("succeeded")), F.count_if(good)).alias("parse_success"),
        _percent(F.sum(F.when(good, F.col("sections_right"))), F.sum(F.when(good, F.col("sections_expected")))).alias(
            "section_accuracy"
        ),
        _percent(F.count_if(F.col("error_handled")), F.count("error_handled")).alias("error_coverage"),
        _percent(F.count_if(F.col("in_time")), F.count("*")).alias("in_time"),
    )
    flags = {f"{m}_met": F.coalesce(F.col(m) >= t, F.lit(True)) for m, t in TARGETS.items()}
    return agg.withColumns(flags)
