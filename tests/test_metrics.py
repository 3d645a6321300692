import math
import random

import pytest
from pyspark.sql import functions as F

from vitaframe.operators import metrics as M


def events(spark, rows):
    df = spark.createDataFrame(rows, "metric_type string, value double")
    return df.select(
        F.monotonically_increasing_id().alias("event_id"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ts"), "metric_type", "value",
        F.create_map(F.lit("trace_id"), F.lit("t")).alias("labels"), F.create_map().cast("map<string,double>").alias("metadata"),
    )


@pytest.mark.parametrize("n", [1, 2, 3, 10, 20, 97, 100])
def test_percentile_rank(spark, n):
    values = [float(v) for v in random.Random(n).sample(range(1000), n)]
    got = M.duration_percentiles(events(spark, [("parse_duration", v) for v in values])).first()
    ordered = sorted(values)
    assert (got.p50, got.p90, got.p95) == tuple(ordered[math.floor(n * p)] for p in (0.5, 0.9, 0.95))
    assert (got.min, got.max) == (ordered[0], ordered[-1])


@pytest.mark.parametrize("skewed", [False, True])
def test_percentiles_in_wide_brackets(spark, monkeypatch, skewed):
    """With a rough sketch the brackets hold most values and overlap; a third of all values is equal."""
    monkeypatch.setattr(M, "_ACCURACY", 20)
    rnd = random.Random(7)
    values = [5.0 if skewed and i % 3 == 0 else rnd.lognormvariate(3, 2) for i in range(4000)]
    got = M.duration_percentiles(events(spark, [("parse_duration", v) for v in values])).first()
    ordered = sorted(values)
    assert (got.p50, got.p90, got.p95) == tuple(ordered[math.floor(4000 * p)] for p in (0.5, 0.9, 0.95))
    many = {f"p{k}": k / 100 for k in range(0, 100, 7)}
    row = M.duration_percentiles(events(spark, [("parse_duration", v) for v in values]), many).first()
    assert {k: row[k] for k in many} == {k: ordered[math.floor(4000 * p)] for k, p in many.items()}


def test_percentiles_of_nothing(spark):
    got = M.duration_percentiles(events(spark, [("upload_size", 1.0)])).first()
    assert got.p50 is None and got.max is None


def test_kpis_without_parses(spark):
    k = M.with_tiers(M.parse_kpis(events(spark, [("upload_size", 1.0)]))).first()
    assert (k.total_parses, k.success_rate_percent, k.failure_rate_percent) == (0, 0.0, 100.0)
    assert k.success_tier == "Needs Attention" and k.duration_tier == "Fast"


def test_totals_add_up(spark):
    k = M.parse_kpis(events(spark, [("parse_success", 1.0)] * 9 + [("parse_failure", 1.0)] + [("parse_duration", 100.0)] * 3)).first()
    assert k.total_parses == k.successful_parses + k.failed_parses == 10
    assert k.success_rate_percent == 90.0 and k.average_duration_ms == 100.0


def test_limits_of_parameters(spark):
    e = events(spark, [("parse_success", 1.0)])
    with pytest.raises(ValueError):
        M.since(e, F.current_timestamp(), 169)
    with pytest.raises(ValueError):
        M.recent_events(e, 0)


def test_persist_writes_summary_and_events(spark, tmp_path):
    e = events(spark, [("parse_success", 1.0), ("parse_duration", 5.0)])
    M.persist(e, str(tmp_path), F.lit("2024-01-01 12:00:00").cast("timestamp"))
    doc = spark.read.json(f"{tmp_path}/summary").first()
    assert doc.parsing.total_parses == 1 and doc.performance.total_events == 2
    assert spark.read.json(f"{tmp_path}/events").count() == 2


def test_percentiles_with_nan_and_infinity(spark):
    from vitaframe.operators.metrics import duration_percentiles

    values = "VALUES (double('NaN')), (double('Infinity')), (1.0D), (2.0D)"
    row = duration_percentiles(spark.sql(f"SELECT 'parse_duration' AS metric_type, v AS value FROM ({values}) t(v)")).first()
    assert row.p50 == 2.0 and row.min == 1.0 and row.max == float("inf")
