import glob
import os
import random
import tracemalloc
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitaframe.operators.metrics import EVENT_DDL
from vitaframe.streaming import jobs as J
from vitaframe.streaming.state import BUCKETS, PARTS, FirstWithin, Packing


def write_events(spark, folder):
    rows = [
        (i, "parse_success" if i % 3 else "parse_failure", 1.0, {"trace_id": f"t{i}"}, {"sections_count": 7.0, "skills_count": 2.0, "warnings_count": 1.0})
        for i in range(60)
    ] + [(100 + i, "parse_duration", float(i), {"trace_id": f"t{i}"}, {}) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, metric_type string, value double, labels map<string,string>, metadata map<string,double>")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + (F.col("event_id") % 100) * 1200))
    J.append_event_batch(df.select("event_id", "ts", "metric_type", "value", "labels", "metadata"), folder)
    return spark.read.schema(EVENT_DDL).json(folder)


def test_hourly_kpis_equal_their_batch_twin(spark, tmp_path):
    batch = J.tumbling_kpis(write_events(spark, str(tmp_path / "in")), 1)
    stream = J.tumbling_kpis(J.event_stream(spark, str(tmp_path / "in")), 1)
    J.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ck"), mode="complete")
    got = spark.read.parquet(str(tmp_path / "out")).where("batch = (SELECT max(batch) FROM parquet.`%s`)" % (tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_trailing_windows_that_closed_equal_the_batch(spark, tmp_path):
    batch = J.trailing_kpis(write_events(spark, str(tmp_path / "in")), 6)
    stream = J.trailing_kpis(J.event_stream(spark, str(tmp_path / "in")), 6)
    J.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.window_end: tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.window_end: tuple(r) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(want) - len(got) <= 7  # those still open when the input ended


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    write_events(spark, str(tmp_path / "in"))
    run = lambda: J.run_to_parquet(J.redacted_log(J.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120
    write_events(spark, str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 240


def test_latest_status(spark, tmp_path):
    rows = [(1, "a", "pending", 1), (2, "a", "completed", 5), (3, "a", "processing", 3), (4, "b", "failed", 2)]
    df = spark.createDataFrame(rows, "event_id bigint, job_id string, status string, t int").withColumn("ts", F.timestamp_seconds("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    J.run_to_parquet(J.current_status(stream), str(tmp_path / "out"), str(tmp_path / "ck"), mode="update")
    got = {r.job_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "completed", "b": "failed"}


def rows_by_step(spark, folder, steps, ddl):
    """One file per step, to be read one after the other."""
    for i, rows in enumerate(steps):
        path = f"{folder}/{i}"
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(path)
        for part in glob.glob(f"{path}/*.parquet"):
            os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(f"{folder}/0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_finished_jobs_leave_the_state_and_come_back(spark, tmp_path):
    day = 86_400
    steps = [
        [(1, "a", "pending", 10), (2, "b", "processing", 20)],
        [(3, "a", "completed", 30)],
        [(4, "c", "pending", 3 * day)],  # passes the time that "a" is kept
        [(5, "d", "pending", 4 * day)],
        [(6, "a", "processing", 4 * day + 5), (7, "a", "failed", 40)],  # the second is far too late
        [(8, "d", "completed", 4 * day + 6)],
    ]
    df = rows_by_step(spark, f"{tmp_path}/in", steps, "event_id bigint, job_id string, status string, t int")
    stream = J.current_status(df.withColumn("ts", F.timestamp_seconds("t")), keep=timedelta(days=1))
    query = J.run_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ck", mode="update")
    rows = [max(p.stateOperators[0].numRowsTotal, 0) for p in query.recentProgress if p.stateOperators]
    assert max(rows) > rows[0] or rows[0] >= 2
    got = {r.job_id: (r.status, r.updated_at.timestamp()) for r in J.upserted(spark, f"{tmp_path}/out", ["job_id"]).collect()}
    want = spark.createDataFrame([r for step in steps for r in step if r[0] != 7], "event_id bigint, job_id string, status string, t int")
    batch = J.current_status(want.withColumn("ts", F.timestamp_seconds("t"))).collect()
    assert got == {r.job_id: (r.status, r.updated_at.timestamp()) for r in batch}


def test_state_of_finished_jobs_does_not_grow(spark, tmp_path):
    steps = [[(100 * i + k, f"job {i}.{k}", "completed", 1_000_000 + 200_000 * i + k) for k in range(20)] for i in range(5)]
    df = rows_by_step(spark, f"{tmp_path}/in", steps, "event_id bigint, job_id string, status string, t int")
    stream = J.current_status(df.withColumn("ts", F.timestamp_seconds("t")), keep=timedelta(days=1))
    query = J.run_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ck", mode="update")
    rows = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    per_job = max(rows[:1])  # a value and a timer for each job of the first step
    assert rows[-1] <= 2 * per_job
    assert J.upserted(spark, f"{tmp_path}/out", ["job_id"]).count() == 100


def kept_by_hand(rows, within):
    out, last = [], {}
    for checksum, name, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if checksum is not None and (checksum not in last or at > last[checksum] + within):
            out.append((checksum, name, at))
            last[checksum] = at
    return sorted(out)


def random_uploads(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", *"abcdef"]), i, 1_000_000 + rng.randrange(40 * 3600)) for i in range(600)]
    return rows + [("edge", 1000, 1_000_000), ("edge", 1001, 1_007_200), ("edge", 1002, 1_007_201), ("tie", 1004, 1_000_005), ("tie", 1003, 1_000_005)]


def test_first_uploads_in_batch(spark, monkeypatch):
    from vitaframe.operators import dedupe

    rows = random_uploads(1)
    df = spark.createDataFrame([*rows, (None, 7, 3), ("x", 8, None)], "checksum string, id bigint, t int").withColumn("ts", F.timestamp_seconds("t"))
    want = kept_by_hand(rows, 7200)
    read = lambda: sorted((r.checksum, r.id, int(r.ts.timestamp())) for r in J.first_uploads(df, timedelta(hours=2)).collect())
    assert read() == want
    monkeypatch.setattr(dedupe, "CHUNK", 20)  # the hot checksum and some others go bucket by bucket
    assert read() == want
    assert J.first_uploads(df.limit(0)).count() == 0


def test_first_uploads_in_a_stream(spark, tmp_path):
    rows = sorted(random_uploads(2), key=lambda r: r[2])
    rng = random.Random(3)
    steps = [rows[i : i + 100] for i in range(0, len(rows), 100)]
    for step in steps:
        rng.shuffle(step)
    end = rows[-1][2] + 9000
    steps.append([("end", 5000, end)])
    df = rows_by_step(spark, f"{tmp_path}/in", steps, "checksum string, id bigint, t int").withColumn("ts", F.timestamp_seconds("t"))
    query = J.run_to_parquet(J.first_uploads(df, timedelta(hours=2)), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = sorted((r.checksum, r.id, int(r.ts.timestamp())) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [r for r in kept_by_hand([*rows, ("end", 5000, end)], 7200) if r[0] != "end"]
    left = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1]
    assert left < 10  # periods that are over have left the state


def test_open_windows_are_there_and_marked(spark, tmp_path):
    batch = J.trailing_kpis(write_events(spark, str(tmp_path / "in")), 6)
    rows = J.live_windows(J.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), 6, True)
    got = rows.collect()
    assert sorted(tuple(r)[:-1] for r in got) == sorted(map(tuple, batch.collect()))
    newest = max(r.window_end for r in got) - timedelta(hours=6)
    assert {r.window_end for r in got if r.is_open} >= {r.window_end for r in got if r.window_end > newest} and not all(r.is_open for r in got)


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from vitaframe.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(), "x")


def test_window_lengths_are_checked(spark):
    with pytest.raises(ValueError):
        J.tumbling_kpis(spark.createDataFrame([], EVENT_DDL), 5)


class _Kept:
    """State of one key, in memory."""

    def __init__(self):
        self.items, self.timers = [], []

    def exists(self):
        return bool(self.items)

    def get(self):
        return iter(self.items) if self.many else self.items[0]

    def clear(self):
        self.items = []

    def put(self, items):
        self.items = list(items)

    def update(self, item):
        self.items = [item]

    def appendValue(self, item):
        self.items.append(item)

    def appendList(self, items):
        self.items += items

    def _of(self, many):
        out = _Kept()
        out.many = many
        return out

    def getValueState(self, name, schema):
        return self._of(False)

    def getListState(self, name, schema):
        return self._of(True)

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 1 << 40


def test_waiting_uploads_of_a_hot_checksum_are_packed():
    n, hour = 200_000, 3_600_000_000
    rows = FirstWithin(24 * hour)
    rows.init(_Kept())
    frames = (pd.DataFrame({"at": [(i * 7919 % n) * 36_000_000 for i in range(a, a + 10_000)], "id": range(a, a + 10_000)}) for a in range(0, n, 10_000))
    tracemalloc.start()
    assert list(rows.handleInputRows(("c",), frames, _Kept())) == []
    (out,) = rows.handleExpiredTimer(("c",), _Kept(), None)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # every 36 seconds one upload, and the first more than 24 hours after the last that stays: 2,401 steps on
    assert out["at"].tolist() == [k * 2401 * 36_000_000 for k in range(-(-n // 2401))]
    assert [i * 7919 % n for i in out["id"].tolist()] == [k * 2401 for k in range(-(-n // 2401))]
    assert most < 80 * n


class _Calls(_Kept):
    """State that counts what is asked of it."""

    def __init__(self):
        super().__init__()
        self.calls = []

    def __getattribute__(self, name):
        if name in ("get", "clear", "update", "appendValue", "listTimers", "registerTimer", "deleteTimer"):
            object.__getattribute__(self, "calls").append(name)
        return object.__getattribute__(self, name)

    def _of(self, many):
        out = _Calls()
        out.many, out.calls = many, self.calls
        return out


def test_many_checksums_cost_few_calls_to_the_state():
    hour = 3_600_000_000
    rng = random.Random(4)
    rows = [(f"{rng.randrange(500)}", i, rng.randrange(1, 90) * hour + rng.randrange(3)) for i in range(5000)]
    frame = pd.DataFrame(rows, columns=["checksum", "id", "at"])
    waiting, first, calls = Packing(), FirstWithin(24 * hour), _Calls()
    now = lambda ms: type("Now", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    halves, state = _Calls(), 40 * 3_600_000
    waiting.init(halves)
    first.init(calls)
    assert list(waiting.handleInputRows((3, 0), iter([frame[:2000], frame[2000:]]), now(0))) == []
    got = []
    for ms in (state, 1 << 40):  # the second time the rest, and what stayed before is known
        (packs,) = waiting.handleExpiredTimer((3, 0), now(ms), None)
        assert set(packs["bucket"]) == {3}
        for out in first.handleInputRows((3,), iter([packs]), now(ms)):
            got += zip(out["checksum"], out["id"].tolist(), out["at"].tolist(), strict=True)
    assert sorted(got) == kept_by_hand(rows, 24 * hour)
    assert len(halves.calls) + len(calls.calls) < 60
    assert list(first.handleExpiredTimer((3,), now(1 << 40), None)) == [] and halves.timers == calls.timers == []


def test_uploads_of_a_stream_wait_in_parts_and_late_ones_stay_out(spark, tmp_path):
    hour = 3600
    steps = [
        [("hot" if i % 3 else f"f{i}", i, 100_000 + i * 37) for i in range(2000)],
        [("hot", 9001, 100_000 + 80 * hour)],  # the watermark comes to 79 hours
        [("g", 9002, 100_000 + 81 * hour)],
        [("late", 9003, 100_000 + 79 * hour), ("in time", 9004, 100_000 + 79 * hour + 1)],
        [("end", 9005, 100_000 + 90 * hour)],
    ]
    df = rows_by_step(spark, f"{tmp_path}/in", steps, "checksum string, id bigint, t int").withColumn("ts", F.timestamp_seconds("t"))
    query = J.run_to_parquet(J.first_uploads(df, timedelta(hours=2)), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = sorted((r.checksum, r.id, int(r.ts.timestamp())) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    rows = [r for step in steps for r in step]
    assert got == [r for r in kept_by_hand(rows, 2 * hour) if r[0] not in ("late", "end")]
    first = query.recentProgress[0].stateOperators
    assert len(first) == 2 and first[0].numRowsTotal == 0  # nothing is judged before it has waited
    assert BUCKETS < first[1].numRowsTotal <= BUCKETS * PARTS  # uploads of a bucket wait in parts
