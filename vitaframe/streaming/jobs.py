"""Streaming forms of the metric, redaction and ingest jobs.

Each takes and returns a frame and shares its expressions with the batch operators, so the
same code runs on ``spark.read`` and ``spark.readStream`` input.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitaframe.functions.redact import redact_log_events
from vitaframe.operators.dedupe import first_within
from vitaframe.operators.metrics import EVENT_DDL, exact_sum, kpi_aggregates, with_ratios
from vitaframe.streaming.state import BUCKETS, PARTS, FirstWithin, LatestStatus, Packing, use_timers

# Window lengths offered to users, in hours.
WINDOW_HOURS = (1, 6, 24, 72, 168)


def event_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Metric events that arrive as JSON files."""
    return spark.readStream.schema(EVENT_DDL).option("recursiveFileLookup", True).options(**options).json(folder)


def append_event_batch(events: DataFrame, folder: str, batch: str | int | None = None) -> None:
    """Record metric events where ``event_stream`` picks them up.

    A named ``batch`` is recorded once: files appear when the whole batch is there, and a batch that is there
    already is left as it is, so a writer (or ``foreachBatch``) may repeat it.
    """
    if batch is None:
        events.write.mode("append").json(folder)
        return
    target = f"{folder}/{batch}"
    try:
        if not events.sparkSession.read.format("binaryFile").load(target).isEmpty():
            return
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    events.write.mode("overwrite").json(target)


def tumbling_kpis(events: DataFrame, hours: int = 1, late: str = "1 hour") -> DataFrame:
    """KPIs per fixed window; state is one row per open window."""
    if hours not in WINDOW_HOURS:
        raise ValueError(f"hours must be one of {WINDOW_HOURS}")
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours")).agg(*kpi_aggregates())
    return with_ratios(grouped).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*"
    ).drop("window")


def hourly_sums(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """What the KPIs of any longer window are made of, one row per hour: ``hour`` and sums."""
    is_ = lambda kind: F.col("metric_type") == kind
    meta = lambda key: F.coalesce(
        F.sum(F.when(is_("parse_success"), F.floor(F.try_element_at("metadata", F.lit(key))))), F.lit(0)
    ).cast("long")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour"))
        .agg(
            F.count_if(is_("parse_success")).alias("ok"),
            F.count_if(is_("parse_failure")).alias("bad"),
            exact_sum(F.when(is_("parse_duration"), F.col("value"))).alias("ms"),
            F.count_if(is_("parse_duration")).alias("timed"),
            meta("warnings_count").alias("warnings"),
            meta("sections_count").alias("sections"),
            meta("skills_count").alias("skills"),
            F.max("ts").alias("newest"),
        )
    )


def kpis_of_hours(hourly: DataFrame, window: Column) -> DataFrame:
    """KPIs of windows over hourly sums."""
    grouped = hourly.groupBy(window).agg(
        F.sum(F.col("ok") + F.col("bad")).alias("total_parses"),
        F.sum("ok").alias("successful_parses"),
        F.sum("bad").alias("failed_parses"),
        F.coalesce(F.sum("ms").cast("double") / F.nullif(F.sum("timed"), F.lit(0)), F.lit(0.0)).alias("average_duration_ms"),
        F.sum("warnings").alias("total_warnings"),
        F.sum("sections").alias("sections_extracted_total"),
        F.sum("skills").alias("skills_extracted_total"),
    )
    return with_ratios(grouped).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*"
    ).drop("window")


def trailing_kpis(events: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """KPIs over the last ``hours``, moved on every hour.

    Events are first reduced to one row per hour. Only those rows enter the overlapping
    windows, instead of every event being copied into each window it belongs to.
    """
    return kpis_of_hours(hourly_sums(events, late), F.window(F.window_time("window"), f"{hours} hours", "1 hour"))


def upserted(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key of an ``update`` run: every batch's folder replaces the rows of the same key before it.

    A batch that was retried has replaced its own folder, so nothing counts twice.
    """
    rows = spark.read.option("recursiveFileLookup", False).parquet(out)
    names = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")


def live_windows(events: DataFrame, out: str, checkpoint: str, hours: int, trailing: bool, late: str = "1 hour") -> DataFrame:
    """KPIs of all windows of a stream that has worked off its input, open ones too, with ``is_open``.

    Hourly sums are kept up to date in update mode and upserted by hour; windows are made of them when they are read. A
    window is open while events that the watermark lets through can still change it.
    """
    spark = events.sparkSession
    hourly = hourly_sums(events, late).select(F.col("window.start").alias("hour"), "*").drop("window")
    run_to_parquet(hourly, out, checkpoint, mode="update")
    sums = upserted(spark, out, ["hour"])
    step = "1 hour" if trailing else f"{hours} hours"
    kpis = kpis_of_hours(sums, F.window("hour", f"{hours} hours", step).alias("window"))
    newest = sums.agg(F.max("newest").alias("newest")).first().newest
    return kpis.withColumn("is_open", F.col("window_end") > F.lit(newest) - F.expr(f"interval {late}"))


def redacted_log(logs: DataFrame, keep: tuple[str, ...] = (), boundary: str = "unicode") -> DataFrame:
    """Stateless: each log row is redacted as it passes."""
    return redact_log_events(logs, keep, boundary=boundary)


def first_uploads(uploads: DataFrame, within: timedelta = timedelta(hours=24), late: str = "1 hour", ts: str = "ts", id_col: str = "id") -> DataFrame:
    """``checksum, id, ts`` of the uploads that stay by the rule of ``operators.dedupe``, in batch and in streams.

    A stream holds uploads back until its watermark has passed them, then judges them in the order of time; a checksum
    leaves the state when its period is over. They wait in parts of buckets of checksums and are judged by bucket.
    Stream ids are integers.
    """
    period = within // timedelta(microseconds=1)
    rows = uploads.select("checksum", F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(id_col).alias("id"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.where("checksum IS NOT NULL AND at IS NOT NULL")
    if uploads.isStreaming:
        use_timers(uploads)
        kind = rows.schema["checksum"].dataType.simpleString()
        dealt = rows.withColumns(
            {
                "id": F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))),
                "bucket": F.pmod(F.xxhash64("checksum"), F.lit(BUCKETS)).cast("int"),
                "part": F.pmod(F.xxhash64("at", "id"), F.lit(PARTS)).cast("int"),
            }
        )
        packs = dealt.withWatermark("ts", late).groupBy("bucket", "part").transformWithStateInPandas(
            Packing(), "bucket int, packed binary, ts timestamp", "Append", "EventTime", eventTimeColumnName="ts"
        )
        kept = packs.groupBy("bucket").transformWithStateInPandas(
            FirstWithin(period), f"checksum {kind}, at long, id long", "Append", "EventTime"
        )
    else:
        kept = first_within(rows, period)
    return kept.select("checksum", "id", F.timestamp_micros("at").alias("ts"))


def current_status(updates: DataFrame, job: str = "job_id", keep: timedelta = timedelta(days=7), late: str = "1 hour") -> DataFrame:
    """Latest status per job, by time and event id; a stream runs in update mode.

    The state of a stream holds unfinished jobs, and finished ones until ``keep`` after they finished. An update
    after that opens the job again. What comes later than ``late`` is left out by the watermark, so an old update cannot.
    """
    if not updates.isStreaming:
        return updates.groupBy(job).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"))
    use_timers(updates)
    rows = updates.select(job, "status", F.unix_micros("ts").alias("at"), "event_id", "ts").where("at IS NOT NULL").withWatermark("ts", late)
    kind = updates.schema[job].dataType.simpleString()
    latest = rows.groupBy(job).transformWithStateInPandas(
        LatestStatus(job, keep // timedelta(milliseconds=1)), f"{job} {kind}, status string, at long", "Update", "EventTime"
    )
    return latest.select(job, "status", F.timestamp_micros("at").alias("updated_at"))


def unfinished_traces(starts: DataFrame, outcomes: DataFrame, late: str = "1 hour", bound: str = "24 hours") -> DataFrame:
    """Starts with no outcome within ``bound``; ``trace_id, ts`` on both sides."""
    left = starts.select(F.col("trace_id"), F.col("ts").alias("started_at")).withWatermark("started_at", late)
    right = outcomes.select(F.col("trace_id").alias("_t"), F.col("ts").alias("_ended")).withWatermark("_ended", late)
    on = (
        (F.col("trace_id") == F.col("_t"))
        & (F.col("_ended") >= F.col("started_at"))
        & (F.col("_ended") <= F.col("started_at") + F.expr(f"interval {bound}"))
    )
    return left.join(right, on, "left_outer").where(F.col("_t").isNull()).select("trace_id", "started_at")


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off all input that is there and stop; the ended query tells its progress.

    ``complete`` and ``update`` results replace the folder per batch, keyed by the checkpointed
    batch id, so a batch that is retried after a failure gives the same files.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        query = (
            writer.outputMode(mode)
            .foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}"))
            .start()
        )
    query.awaitTermination()
    return query
