"""Parse metrics: events out of finished jobs, KPIs, percentiles, traces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.functions.text import rounded
from vitaframe.session import written

EVENT_DDL = (
    "event_id bigint, ts timestamp, metric_type string, value double, "
    "labels map<string,string>, metadata map<string,double>"
)
# Kinds of metric events.
METRIC_TYPES = (
    "parse_duration", "parse_success", "parse_failure", "validation_warning",
    "upload_size", "sections_extracted", "skills_extracted",
)
MAX_HOURS, MAX_RECENT = 168, 1000


def _is(kind: str) -> Column:
    return F.col("metric_type") == kind


# ------------------------------------------------------------------ events


def _event(kind: str, value: Column, labels: Column, metadata: Column | None = None) -> Column:
    none = F.create_map().cast("map<string,double>")
    return F.struct(
        F.lit(kind).alias("metric_type"),
        value.cast("double").alias("value"),
        labels.alias("labels"),
        (none if metadata is None else metadata).alias("metadata"),
    )


def job_events(jobs: DataFrame) -> DataFrame:
    """Events of finished jobs, one explode per job and no shuffle.

    Input: ``trace_id, ts, status, duration_ms, sections_count, skills_count, warnings_count,
    error_type``. Success gives four events and a fifth when there were warnings; failure
    gives two.
    """
    trace = F.create_map(F.lit("trace_id"), F.col("trace_id").cast("string"))
    failed = F.create_map(
        F.lit("trace_id"), F.col("trace_id").cast("string"), F.lit("error_type"), F.coalesce("error_type", F.lit(""))
    )
    number = lambda c: F.col(c).cast("double")
    done = F.create_map(
        *[x for c in ("duration_ms", "sections_count", "skills_count", "warnings_count") for x in (F.lit(c), number(c))]
    )
    success = F.array(
        _event("parse_success", F.lit(1.0), trace, done),
        _event("parse_duration", number("duration_ms"), trace),
        _event("sections_extracted", number("sections_count"), trace),
        _event("skills_extracted", number("skills_count"), trace),
        F.when(F.col("warnings_count") > 0, _event("validation_warning", number("warnings_count"), trace)),
    )
    failure = F.array(
        _event("parse_failure", F.lit(1.0), failed, F.create_map(F.lit("duration_ms"), number("duration_ms"))),
        _event("parse_duration", number("duration_ms"), trace),
    )
    events = F.when(F.col("status") == "completed", F.array_compact(success)).otherwise(failure)
    return jobs.select("ts", F.explode(events).alias("e")).select("ts", "e.*")


def upload_events(uploads: DataFrame) -> DataFrame:
    """Start of a parse: ``resume_id, format, trace_id, file_size, ts`` -> one event."""
    labels = F.create_map(
        F.lit("resume_id"), F.coalesce(F.col("resume_id").cast("string"), F.lit("direct_file")),
        F.lit("format"), F.col("format"),
        F.lit("trace_id"), F.col("trace_id").cast("string"),
    )
    return uploads.select("ts", _event("upload_size", F.col("file_size"), labels).alias("e")).select("ts", "e.*")


def since(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Events of the last ``hours`` before ``as_of``; a constant bound that reaches the scan."""
    if not 1 <= hours <= MAX_HOURS:
        raise ValueError(f"hours must be between 1 and {MAX_HOURS}")
    return events.where(F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(hours)))


# ------------------------------------------------------------------ KPIs


def exact_sum(value: Column) -> Column:
    """Sum of milliseconds in decimals: the same however the rows are spread and merged."""
    return F.sum(value.cast("decimal(18,6)"))


def kpi_aggregates() -> list[Column]:
    """The KPI aggregates, shared by the batch and the streaming jobs."""
    meta = lambda key: F.coalesce(
        F.sum(F.when(_is("parse_success"), F.floor(F.try_element_at("metadata", F.lit(key))))), F.lit(0)
    ).cast("long")
    ok, bad = F.count_if(_is("parse_success")), F.count_if(_is("parse_failure"))
    return [
        (ok + bad).alias("total_parses"),
        ok.alias("successful_parses"),
        bad.alias("failed_parses"),
        F.coalesce(
            exact_sum(F.when(_is("parse_duration"), F.col("value"))).cast("double")
            / F.nullif(F.count_if(_is("parse_duration")), F.lit(0)),
            F.lit(0.0),
        ).alias("average_duration_ms"),
        meta("warnings_count").alias("total_warnings"),
        meta("sections_count").alias("sections_extracted_total"),
        meta("skills_count").alias("skills_extracted_total"),
    ]


def with_ratios(kpis: DataFrame) -> DataFrame:
    """Rates and averages, two decimals. Without parses success is 0 % and failure 100 %."""
    success = F.when(F.col("total_parses") == 0, 0.0).otherwise(
        F.col("successful_parses") / F.nullif("total_parses", F.lit(0)) * 100
    )
    per_parse = lambda c: F.when(F.col("successful_parses") == 0, 0.0).otherwise(
        F.col(c) / F.nullif("successful_parses", F.lit(0))
    )
    warn = F.when(F.col("total_parses") == 0, 0.0).otherwise(
        F.col("total_warnings") / F.nullif("total_parses", F.lit(0)) * 100
    )
    return kpis.withColumns(
        {
            "success_rate_percent": rounded(success, 2),
            "failure_rate_percent": rounded(100.0 - success, 2),
            "average_duration_ms": rounded(F.col("average_duration_ms"), 2),
            "average_sections_per_parse": rounded(per_parse("sections_extracted_total"), 2),
            "average_skills_per_parse": rounded(per_parse("skills_extracted_total"), 2),
            "warning_rate_percent": rounded(warn, 1),
        }
    )


def parse_kpis(events: DataFrame, as_of: Column | None = None, hours: int = 24) -> DataFrame:
    scoped = events if as_of is None else since(events, as_of, hours)
    return with_ratios(scoped.agg(*kpi_aggregates()))


def with_tiers(kpis: DataFrame) -> DataFrame:
    """Labels the dashboard puts on the KPIs."""
    rate, ms, sections = F.col("success_rate_percent"), F.col("average_duration_ms"), F.col("average_sections_per_parse")
    return kpis.withColumns(
        {
            "success_tier": F.when(rate > 90, "Excellent").when(rate > 75, "Good").otherwise("Needs Attention"),
            "duration_tier": F.when(ms < 3000, "Fast").when(ms < 8000, "Moderate").otherwise("Slow"),
            "system_health": F.when(rate > 90, "Healthy").otherwise("Monitoring"),
            "performance": F.when(ms < 5000, "Optimal").otherwise("Review"),
            "data_quality": F.when(sections > 3, "Good").otherwise("Monitor"),
        }
    )


def format_counts(events: DataFrame) -> DataFrame:
    return (
        events.where(_is("upload_size") & F.map_contains_key("labels", "format"))
        .groupBy(F.col("labels")["format"].alias("format"))
        .agg(F.count("*").alias("uploads"))
    )


def collection_period(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total_events"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def recent_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """The newest events: a distributed top-k, not a full sort."""
    if not 1 <= limit <= MAX_RECENT:
        raise ValueError(f"limit must be between 1 and {MAX_RECENT}")
    return events.orderBy(F.desc("ts"), "event_id").limit(limit)


# ------------------------------------------------------------------ percentiles

# Accuracy of the sketch: ranks are off by at most this share.
_ACCURACY = 10_000


def duration_percentiles(
    events: DataFrame, percents: dict[str, float] | None = None, kind: str = "parse_duration", value: str = "value"
) -> DataFrame:
    """Exact order statistics ``sorted[floor(n * p)]`` plus min and max, as one row.

    Two scans, however many percentiles: a sketch of fixed size brackets all of them at once, then the values inside the
    brackets are counted, and those below only summed up. ``percentile_disc`` would gather every distinct value in one
    task; here counts are combined before the shuffle, sorted by range, and added up over the sorted
    partitions, so a bracket of any size is spread. NaN is no measurement and is left out; infinities are
    ordered like other values. Without values all are null.
    """
    percents = {"p50": 0.5, "p90": 0.9, "p95": 0.95} if percents is None else percents
    values = events.where(_is(kind) & F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).where(~F.isnan("v"))
    slack = 2.0 / _ACCURACY
    marks = [min(1.0, max(0.0, p + side)) for p in percents.values() for side in (-slack, slack)]
    seen = values.agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", marks, _ACCURACY).alias("m")
    ).first()
    ends = [F.lit(seen.lo).cast("double").alias("min"), F.lit(seen.hi).cast("double").alias("max")]
    if not seen.n:
        return events.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(name) for name in percents], *ends)
    brackets = [(k, min(seen.n - 1, math.floor(seen.n * p)), seen.m[2 * k], seen.m[2 * k + 1]) for k, p in enumerate(percents.values())]
    # a value counts for every bracket that it is below (as null) or inside
    places = [
        F.when(F.col("v") <= F.lit(hi).cast("double"), F.struct(F.lit(k).alias("k"), F.when(F.col("v") >= F.lit(lo).cast("double"), F.col("v")).alias("v")))
        for k, _, lo, hi in brackets
    ]
    spread = values.select(F.explode(F.array_compact(F.array(*places))).alias("x")).select("x.k", "x.v")
    counts = spread.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    ordered = written(counts.orderBy("k", F.asc_nulls_first("v")).withColumn("_at", F.monotonically_increasing_id()), "percentiles")
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    sums = ordered.groupBy("_part").agg(F.sum("c").alias("_sum"))  # a row per sorted partition
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("c").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    added = ordered.withColumn("_inside", inside).join(sums.select("_part", before.alias("_before")), "_part")
    added = added.withColumn("_end", F.col("_before") + F.col("_inside"))
    starts = added.groupBy("k").agg(F.min(F.col("_end") - F.col("c")).alias("_start"))  # a row per percentile
    rank = F.element_at(F.array(*[F.lit(r).cast("long") for _, r, _, _ in brackets]), F.col("k") + 1)
    placed = added.join(starts, "k").withColumn("_end", F.col("_end") - F.col("_start"))
    hit = placed.where((F.col("_end") > rank) & (F.col("_end") - F.col("c") <= rank))
    return hit.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(name) for k, name in enumerate(percents)], *[F.max(e).alias(n) for e, n in zip(ends, ("min", "max"), strict=True)])


# ------------------------------------------------------------------ traces and reports


def traces(events: DataFrame) -> DataFrame:
    """One row per ``trace_id``: start, outcome, duration and counts, by one aggregate."""
    trace = F.try_element_at("labels", F.lit("trace_id"))
    ended = _is("parse_success") | _is("parse_failure")
    label = lambda key: F.try_element_at("labels", F.lit(key))
    value = lambda kind: F.max(F.when(_is(kind), F.col("value")))
    return (
        events.where(trace.isNotNull())
        .groupBy(trace.alias("trace_id"))
        .agg(
            F.min(F.when(_is("upload_size"), F.col("ts"))).alias("started_at"),
            F.max(F.when(ended, F.col("ts"))).alias("ended_at"),
            F.max(F.when(_is("upload_size"), label("format"))).alias("format"),
            value("upload_size").alias("file_size"),
            value("parse_duration").alias("duration_ms"),
            value("sections_extracted").alias("sections"),
            value("skills_extracted").alias("skills"),
            F.coalesce(value("validation_warning"), F.lit(0.0)).alias("warnings"),
            F.when(F.max(_is("parse_failure").cast("int")) == 1, "failed")
            .when(F.max(_is("parse_success").cast("int")) == 1, "completed")
            .otherwise("open")
            .alias("status"),
            F.max(F.when(_is("parse_failure"), label("error_type"))).alias("error_type"),
        )
    )


def summary_json(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The whole metrics summary as one JSON document.

    Each part is a one-row aggregate written as JSON; the parts are put side by side by a
    last aggregate over their four rows.
    """
    formats = format_counts(events).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("format", "uploads"))))).alias("json")
    )
    parts = {
        "parsing": parse_kpis(events, as_of, hours).select(F.to_json(F.struct("*")).alias("json")),
        "formats": formats,
        "percentiles": duration_percentiles(events).select(F.to_json(F.struct("*")).alias("json")),
    }
    period = collection_period(events).select(
        F.explode(
            F.array(
                F.struct(F.lit("period").alias("part"), F.to_json(F.struct("start", "end")).alias("json")),
                F.struct(F.lit("total").alias("part"), F.col("total_events").cast("string").alias("json")),
            )
        ).alias("p")
    )
    rows = period.select("p.part", "p.json")
    for name, part in parts.items():
        rows = rows.unionByName(part.select(F.lit(name).alias("part"), "json"))
    sides = rows.agg(*[F.max(F.when(F.col("part") == n, F.col("json"))).alias(n) for n in (*parts, "period", "total")])
    document = F.format_string(
        '{"time_window_hours":%d,"parsing":%s,"file_formats":%s,'
        '"performance":{"duration_percentiles_ms":%s,"total_events":%s},"collection_period":%s}',
        F.lit(hours), "parsing", "formats", "percentiles", "total", "period",
    )
    return sides.select(document.alias("summary"))


def persist(events: DataFrame, path: str, as_of: Column, hours: int = 24, limit: int = 100) -> None:
    """Write the summary and the newest events below ``path`` as JSON files."""
    summary_json(events, as_of, hours).write.mode("append").text(f"{path}/summary")
    recent_events(events, limit).write.mode("append").json(f"{path}/events")
